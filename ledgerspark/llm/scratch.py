"""Places in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.session import app_folder


def place(spark: SparkSession, name: str) -> str:
    """A new path below the application's part of the shared folder."""
    return f"{app_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result into the shared folder and read it back: later plans start there, a lost executor costs a re-read."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.sparkSession._jvm.java.net.URI(folder))
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def swept(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def numbered(docs: DataFrame) -> DataFrame:
    """Rows as ``_row``, their number, and ``_rest``, all their columns: no column's name can clash with a working column.

    Stored, so that a row keeps its number whenever it is read again.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*(docs[c] for c in docs.columns)).alias("_rest"))
    return stored(rows, "numbered")


def parts(spark: SparkSession, least: int = 64) -> int:
    """How many parts a blocked exchange is cut into; follows the session's shuffle partitions, which follow the cluster."""
    return max(least, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
