"""Session settings and the shared working folder."""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "ledgerspark", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings the library expects; a cluster supplies its own master and sizes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` when the cluster names one.

    Only where it is unset (local runs and tests) a temporary folder is chosen.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="ledgerspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def app_folder(spark: SparkSession) -> str:
    """What this application stores and stages; ``release`` deletes it."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{os.getpid()}"


_WRITTEN: dict[tuple[str, str, str], object] = {}
FOLDERS = 8  # folders of a partitioned table that a task writes to at once; Spark sorts the rest of a task with more
WRITING = {
    "spark.sql.maxConcurrentOutputFileWriters": str(FOLDERS),
    "spark.sql.codegen.hugeMethodLimit": "8000",  # the JVM interprets longer methods; Spark then makes several short ones
}


@contextlib.contextmanager
def _writing(spark: SparkSession):
    """The settings that stored and staged tables are computed and written with."""
    before = {key: spark.conf.get(key, None) for key in WRITING}
    for key, value in WRITING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def _place(spark: SparkSession, name: str, source: str) -> str:
    digest = hashlib.md5(source.encode()).hexdigest()[:12]
    return f"{app_folder(spark)}/{digest}/{name}"


def text_once(spark: SparkSession, name: str, source: str, build) -> str:
    """Write a one-column frame as text files once per application and return the folder."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _WRITTEN:
        path = _place(spark, name, source)
        build().write.mode("overwrite").text(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def written_once(spark: SparkSession, name: str, source: str, build, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``build()`` as parquet under the shared folder once per application and read it back.

    Later plans start at the written table, so an aggregation over the raw lines is paid once and a lost
    executor costs a re-read instead of the whole lineage. A task keeps a file open for each of its first FOLDERS folders, so
    the rows are not sorted by ``partition_by`` first, which would spill most of a large table.
    """
    app = spark.sparkContext.applicationId
    key = (app, name, source)
    if key not in _WRITTEN:
        path = _place(spark, name, source)
        with _writing(spark):
            writer = build().write.mode("overwrite").option("compression", "zstd")
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(path)
        _WRITTEN[key] = spark.read.parquet(path)  # kept, so the footers are read once
    return _WRITTEN[key]


def release(spark: SparkSession) -> None:
    """Delete what this application stored and staged in the shared folder; call it when its results are no longer read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(app_folder(spark))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    for key in [k for k in _WRITTEN if k[0] == spark.sparkContext.applicationId]:
        del _WRITTEN[key]


SPLIT = 4 << 20  # bytes below which Spark does not cut a file for another core (spark.sql.files.openCostInBytes)


def _small(df: DataFrame, cores: int) -> bool:
    """Whether Spark's own splits of the files behind ``df`` would leave cores idle; many files are not looked at."""
    spark = df.sparkSession
    files = df.inputFiles()
    if len(files) >= cores:
        return False
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in files]
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths) < cores * SPLIT


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a small table of fewer files than cores out over the cores by a hash of its keys.

    A single small file would otherwise be read and processed by one task. Spark cuts larger files into splits by itself, and
    tables of many files stay as they are, so at scale no shuffle is added and a task's share does not grow with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if _small(df, cores) else df


FILE_ROWS = 50_000


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as few partitions as about so many rows ask for, two for each core at least.

    For small results before they are written: otherwise each shuffle partition becomes a file, and a local file system starts a
    process for each file's rights. The partitions are taken one after the other, so a task needs no more memory.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / FILE_ROWS)))


_STAGED = itertools.count()


def staged(df: DataFrame) -> DataFrame:
    """Write an intermediate result under the shared folder and read it back.

    Used where one result feeds several branches of a plan: the branches then scan a small table and do not repeat
    the aggregation before it.
    """
    spark = df.sparkSession
    path = f"{app_folder(spark)}/staged/{next(_STAGED)}"
    with _writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
