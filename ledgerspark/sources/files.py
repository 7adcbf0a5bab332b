"""Delimited files in and out: encoding, separator, headerless statements, header tables, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import normal_header

# The ten delivered statement columns in file order, and the accepted file names.
STATEMENT_COLUMNS = (
    "sector_code", "entity_type", "ruc", "company_name", "date", "period_type", "account_code", "account_name", "value",
    "entity_subtype",
)
DATA_FILES = "*.{csv,tsv,txt,CSV,TSV,TXT}"
SEPARATORS = ("\t", ";", ",")


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _first_lines(lines: DataFrame) -> Column:
    """First line of a file among its ``value`` rows, by block and place in the block."""
    return F.min_by("value", F.struct("block_start", "row_in_block"))


def file_profile(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, encoding, separator, fields`` of every data file with a line.

    UTF-8 when every line of the file is valid (a byte order mark is), Latin-1 otherwise. The separator is the most frequent
    one of the first line; ties go to tab, then semicolon, then comma. Spark reads the lines as bytes in splits, and each
    task sends one row per file.
    """
    lines = _in_file_order(spark.read.text(path, pathGlobFilter=DATA_FILES))
    files = lines.groupBy(F.col("source_file").alias("path")).agg(F.every(F.is_valid_utf8("value")).alias("utf8"), _first_lines(lines).alias("head"))
    counts = {m: _count(F.col("head"), m) for m in SEPARATORS}
    best = F.greatest(*counts.values())
    separator = F.lit(SEPARATORS[-1])
    for mark in reversed(SEPARATORS[:-1]):
        separator = F.when(counts[mark] == best, mark).otherwise(separator)
    return files.select(
        "path", F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"), separator.alias("separator"), (best + 1).cast("int").alias("fields")
    )


def _refuse(narrow: DataFrame, separator: str | None = None) -> None:
    """Raise for files (``path``) with too few columns; the message names the first of them."""
    names = [r.path for r in narrow.select("path").orderBy("path").limit(5).collect()]
    if names:
        by = f" separated by {separator!r}" if separator else ""
        raise ValueError(f"expected at least {len(STATEMENT_COLUMNS)} columns{by} in {', '.join(names)}")


def _in_file_order(df: DataFrame) -> DataFrame:
    """Add ``source_file``, ``block_start`` and ``row_in_block``; together they follow the order of the lines."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_in_block"),
    )


FILE_ORDER = ["source_file", "block_start", "row_in_block"]


def read_statements(
    spark: SparkSession,
    path: str | list[str],
    separator: str = "\t",
    encoding: str = "UTF-8",
    has_header: bool = False,
) -> DataFrame:
    """Statement lines as ten text columns plus their file order; extra columns are dropped.

    Every file's first line is looked at, and a file with fewer than ten columns is refused by name. In tab files a quote is
    a character like any other.
    """
    schema = ", ".join(f"{c} string" for c in STATEMENT_COLUMNS)
    text = _in_file_order(spark.read.text(path, pathGlobFilter=DATA_FILES))
    heads = text.groupBy(F.col("source_file").alias("path")).agg(_first_lines(text).alias("head"))
    _refuse(heads.filter(_count(F.col("head"), separator) + 1 < len(STATEMENT_COLUMNS)), separator)
    return _statement_lines(spark, path, schema, separator, encoding, has_header)


def _statement_lines(spark: SparkSession, path: str | list[str], schema: str, separator: str, encoding: str, has_header: bool) -> DataFrame:
    lines = (
        spark.read.schema(schema)
        .option("sep", separator)
        .option("quote", "" if separator == "\t" else '"')
        .option("encoding", encoding)
        .option("header", has_header)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", True)
        .csv(path, pathGlobFilter=DATA_FILES)
    )
    return _in_file_order(lines)


def read_mixed_statements(spark: SparkSession, path: str) -> DataFrame:
    """Statement files of different encodings and separators in one table: one reader per combination.

    A file with fewer than ten columns is refused by name. The list of files goes through the driver, as every listing does.
    """
    files = file_profile(spark, path).persist()
    _refuse(files.filter(F.col("fields") < len(STATEMENT_COLUMNS)))
    by_kind: dict[tuple[str, str], list[str]] = {}
    for row in files.toLocalIterator():
        by_kind.setdefault((row.encoding, row.separator), []).append(row.path)
    files.unpersist()
    if not by_kind:
        raise FileNotFoundError(f"no data files under {path}")
    schema = ", ".join(f"{c} string" for c in STATEMENT_COLUMNS)
    parts = [_statement_lines(spark, paths, schema, separator, encoding, False) for (encoding, separator), paths in by_kind.items()]
    return reduce(DataFrame.unionByName, parts)


def read_table(spark: SparkSession, path: str, separator: str = ",", dates: tuple[str, ...] = (), upper: bool = False) -> DataFrame:
    """Header table as text; a byte order mark is taken off the first name and the named columns become dates."""
    df = spark.read.option("header", True).option("sep", separator).csv(path)
    names = [normal_header(c) if upper else c.replace("﻿", "").strip() for c in df.columns]
    df = df.toDF(*names)
    return df.withColumns({c: F.coalesce(F.try_to_date(c), F.try_to_date(c, "d/M/yyyy")) for c in dates}) if dates else df


def read_portal_table(spark: SparkSession, path: str) -> DataFrame:
    """Text export with the first separator of tab, semicolon, comma that splits the header into several columns."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError(f"no data in {path}")
    for separator in SEPARATORS:
        if separator in header[0]:
            return read_table(spark, path, separator, upper=True)
    raise ValueError(f"no separator found in {path}")


# The columns of an uploaded roster.
ROSTER_REQUIRED = ("cedula", "nombre", "apellido")
ROSTER_OPTIONAL = ("email", "grupo_id", "departamento", "cargo")


def read_roster(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Roster lines as text with their line number ``fila``: names in lower case, missing optional columns null.

    Raises an error that names the required columns the header does not have.
    """
    df = read_table(spark, path, separator)
    df = df.toDF(*[c.lower() for c in df.columns])
    missing = [c for c in ROSTER_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    columns = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ROSTER_REQUIRED + ROSTER_OPTIONAL]
    # the header is line 1; numbers grow with the lines and are gapless within a split
    return df.select((F.monotonically_increasing_id() + 2).alias("fila"), *columns)


def read_entities(spark: SparkSession, path: str, entity_types: list[str]) -> DataFrame:
    """Parquet statements of some entity types; the filter reaches the scan."""
    return spark.read.parquet(path).filter(F.col("entity_type").isin(*entity_types))


def export_parquet(df: DataFrame, path: str, files: int | None = None) -> bool:
    """ZSTD parquet export; an empty result writes nothing and returns False."""
    if df.isEmpty():
        return False
    out = df.coalesce(files) if files else df
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return True


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def export_xml(df: DataFrame, path: str, root: str, row: str) -> None:
    df.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).save(path)
