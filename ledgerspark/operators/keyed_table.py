"""A stored table with one row per key that is changed file by file.

Below the table's path: ``data/v=N`` holds the files written by version N, ``manifest/v=N`` one row for every file that is live at N
with its number of rows and its least and greatest key, ``bloom/v=N`` a Bloom filter for each file of N, cut into blocks, and
``commits/v=N`` a single row, written last. Readers take the files of the newest commit, so a version counts as a whole
or not at all; a load that fails leaves files that no manifest names, and running it again overwrites them.

An upsert looks for the incoming keys in the index before it reads data: key ranges rule out files, the Bloom filters rule out
keys, and only files that may hold an incoming key are read. Where the stored row wins, no file is written again; where the incoming row
wins, only the files read are replaced (copy on write). Files are sorted by key, so loads of new periods touch few
old files when the key begins with the period. One writer at a time.

The manifest has a row per file and is compared with the ranges of the incoming parts; no key passes through the driver, only the names of
the files touched. Null key values are values. A repeated batch number changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerspark.session import staged

FILE_ROWS = 500_000
BLOCK_KEYS = 1024  # keys of a block of a Bloom filter
WORDS = 512  # 64-bit words of a block: 32 bits a key
PROBES = 6  # bits that a key sets in its word
COMMIT = "version long, batch long, live_files long, files_read long, files_written long, rows_in long, rows_live long"
FILES = "version long, file string, rows long, low string, high string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table can be read there; only a missing path counts as no."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def _probe(key: Column, blocks: Column) -> dict[str, Column]:
    """Block, word and bits of a key in a filter of so many blocks."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    bits = F.lit(0).cast("long")
    for k in range(PROBES):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(g, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    return {"_block": F.pmod(h, blocks), "_word": F.pmod(F.shiftright(g, 40), F.lit(WORDS)).cast("int"), "_bits": bits}


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]  # their order is the order of the files
    file_rows: int = FILE_ROWS

    def _key(self) -> Column:
        parts = [F.coalesce(F.col(k).cast("string"), F.lit("\x02")) for k in self.keys]
        return F.concat_ws("\x01", *parts)

    def commits(self) -> DataFrame:
        """One row per version: files live, read and written, rows given and live."""
        if not exists(self.spark, f"{self.path}/commits"):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits").select(*[c.split()[0] for c in COMMIT.split(", ")])

    def latest(self) -> Row | None:
        return self.commits().orderBy(F.desc("version")).first()

    def files(self, version: int) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(f"{self.path}/manifest/v={version}")

    def _read(self, files: DataFrame) -> DataFrame | None:
        rows = files.select("version", "file").collect()
        paths = [f"{self.path}/data/v={r.version}/{r.file}" for r in rows]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame:
        """The rows of the newest commit."""
        last = self.latest()
        if last is None:
            raise ValueError(f"nothing is stored at {self.path}")
        rows = self._read(self.files(last.version))
        return self.spark.read.parquet(f"{self.path}/data/v={last.version}").limit(0) if rows is None else rows

    def touched(self, incoming: DataFrame, live: DataFrame) -> DataFrame:
        """``version, file`` of the live files that may hold one of the incoming keys (``_key``, ``_part``)."""
        ranges = incoming.groupBy("_part").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"))
        near = live.join(ranges, (F.col("low") <= F.col("_high")) & (F.col("high") >= F.col("_low")))
        asked = incoming.select("_key", "_part").join(near.drop("_low", "_high"), "_part").filter(F.col("_key").between(F.col("low"), F.col("high")))
        asked = asked.select("version", "file", *[c.alias(n) for n, c in _probe(F.col("_key"), F.ceil(F.col("rows") / BLOCK_KEYS)).items()])
        bloom = self.spark.read.parquet(f"{self.path}/bloom").withColumnRenamed("v", "version")
        met = asked.join(bloom, ["version", "file", "_block"])
        held = F.coalesce(F.element_at("_words", F.col("_word")), F.lit(0).cast("long")).bitwiseAND(F.col("_bits"))
        return met.filter(held == F.col("_bits")).select("version", "file").distinct()

    def upsert(self, rows: DataFrame, batch: int, wins: str = "last") -> Row:
        """Load rows of different keys; ``wins`` says whose row stays, that stored ``first`` or the incoming, ``last``."""
        if wins not in ("first", "last"):
            raise ValueError("wins must be 'first' or 'last'")
        done = self.commits().filter(F.col("batch") == batch).first()
        if done is not None:
            return done
        last = self.latest()
        version = 0 if last is None else last.version + 1
        dealt = rows.withColumn("_key", self._key()).repartitionByRange("_key")
        incoming = staged(dealt.withColumn("_part", F.spark_partition_id()))
        given = incoming.count()
        out, live, read, stored = incoming.drop("_part"), None, 0, 0
        if last is not None:
            live = self.files(last.version)
            hit = staged(live.join(self.touched(incoming, live), ["version", "file"], "left_semi"))
            read, stored = hit.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
            old = self._read(hit) if read else None
            if old is not None:
                old = old.withColumn("_key", self._key())
                if wins == "first":
                    out = out.join(old.select("_key"), "_key", "left_anti")
                else:
                    out = out.unionByName(old.join(incoming.select("_key"), "_key", "left_anti"))
                    live = live.join(hit.select("version", "file"), ["version", "file"], "left_anti")
        files = self._write(out.drop("_key"), version, given + (0 if wins == "first" else stored))
        written = files.count()
        if live is not None:
            files = live.select(*files.columns).unionByName(files)
        files.write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        total = self.files(version).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
        commit = self.spark.createDataFrame([(version, batch, total.n, read, written, given, total.rows)], COMMIT)
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/v={version}")
        return commit.first()

    def _write(self, rows: DataFrame, version: int, about: int) -> DataFrame:
        """Write ``about`` so many rows in files of a version, with their filters; the files' part of the manifest."""
        path = f"{self.path}/data/v={version}"
        n = max(1, round(about / self.file_rows))
        key = self._key()
        keyed = rows.withColumn("_key", key)
        keyed = keyed.repartitionByRange(n, "_key") if n > 1 else keyed.coalesce(1)
        keyed.sortWithinPartitions("_key").drop("_key").write.mode("overwrite").option("compression", "zstd").parquet(path)
        stored = self.spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), key.alias("_key"))
        files = staged(
            stored.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("_key").alias("low"), F.max("_key").alias("high")).select(F.lit(version).cast("long").alias("version"), "*")
        )
        probes = stored.join(files.select("file", "rows"), "file")
        probes = probes.select("file", *[c.alias(n) for n, c in _probe(F.col("_key"), F.ceil(F.col("rows") / BLOCK_KEYS)).items()])
        words = probes.groupBy("file", "_block", "_word").agg(F.bit_or("_bits").alias("_bits"))
        blocks = words.groupBy("file", "_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_words"))
        blocks.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/bloom/v={version}")
        return files

    def compact(self, batch: int) -> Row:
        """Write all live rows anew, in full files and in key order."""
        last = self.latest()
        if last is None:
            raise ValueError(f"nothing is stored at {self.path}")
        version = last.version + 1
        files = self._write(self.read(), version, last.rows_live)
        files.write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        n = files.count()
        commit = self.spark.createDataFrame([(version, batch, n, last.live_files, n, 0, last.rows_live)], COMMIT)
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/v={version}")
        return commit.first()
