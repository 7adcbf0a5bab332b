"""Order statistics of large groups without putting a group into one task.

``rank() over (partition by year)`` sends every company of a year to one task. Here a mergeable quantile sketch (KLL, built in the same
aggregate that counts the groups) gives splitters that follow the values, so the rows of a group are cut into parts of about
PART_ROWS rows, ordered among each other: narrow, wide and outlying values alike. A value that two splitters name holds more than a part
and becomes a part of its own, whose rows are dealt to several tasks, because all of them have one place. Rows before a part
come from the exact sizes of the parts, the place inside it from a window over that part alone. Several ranks of one table,
such as in the year and in the sector of the year, share the sketch, the sizes and the one exchange that deals out the parts.

The sketch is stored before it is used: it decides where parts end, never the result. The input is read several times;
callers pass a stored table or a staged one (``session.staged``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.session import staged

PART_ROWS = 50_000  # rows of a part
MOST_PARTS = 1024  # parts of a group; the sketch's error stays well below such a part
SKETCH_SIZE = 4096


def null_safe_join(left: DataFrame, right: DataFrame, by: list[str], exact: list[str] = (), how: str = "inner") -> DataFrame:
    """Equi join on ``by`` (null matches null) and ``exact`` (never null); the keys of the left side are kept."""
    keys = [*by, *exact]
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    tests = [left[c].eqNullSafe(renamed[f"__{c}"]) for c in by] + [left[c] == renamed[f"__{c}"] for c in exact]
    return left.join(renamed, reduce(lambda a, b: a & b, tests, F.lit(True)), how).drop(*[f"__{c}" for c in keys])


def _splitters(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``_at``: for every group the values that end its parts, all but the last; stored."""
    grouped = rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_SIZE).alias("_k"), F.count(F.lit(1)).alias("_n"))
    # parts are a power of two, so their ends are among the evenly spaced quantiles that a plan can name
    parts = F.least(F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("_n") / PART_ROWS, F.lit(1.0))))), F.lit(MOST_PARTS)).cast("int")
    known = (F.col("_p") > 1) & (F.kll_sketch_get_n_double("_k") > 0)  # not-a-numbers alone leave a sketch empty
    ends = F.kll_sketch_get_quantile_double("_k", F.expr(f"array({', '.join(f'{k / MOST_PARTS!r}D' for k in range(1, MOST_PARTS))})"))
    at = F.when(known, F.filter(ends, lambda x, k: (k + 1) % F.expr(f"{MOST_PARTS} div _p") == 0)).otherwise(F.array().cast("array<double>"))
    return staged(grouped.withColumn("_p", parts).select(*by, at.alias("_at")))


def _parted(rows: DataFrame, splitters: DataFrame, by: list[str], value: str) -> DataFrame:
    """Add ``_part``, ordered like the values: 2 c for c splitters below a value, 2 c + 1 for a value that two splitters name."""
    v = F.col(value).cast("double")
    steps = F.expr(f"array({', '.join(str(MOST_PARTS >> k) for k in range(MOST_PARTS.bit_length()))})")
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_at", at + step - 1) < v, at + step).otherwise(at))
    rows = null_safe_join(rows, splitters, by).withColumn("_below", below)
    alone = F.coalesce((F.get("_at", F.col("_below")) == v) & (F.get("_at", F.col("_below") + 1) == v), F.lit(False)) | F.isnan(v)
    return rows.withColumn("_part", F.col("_below") * 2 + alone.cast("int")).drop("_below", "_at")


def _sizes(parted: DataFrame, by: list[str], within: list[str], value: str, weight: Column) -> DataFrame:
    """Rows of every part, before it and in the group, for the groups ``by`` and, in them, for ``within``.

    Stored: their size is then known, and they are broadcast where they are small, so the rows are shuffled once.
    """
    v = F.col(value)
    sizes = parted.groupBy(*by, *within, "_part").agg(F.sum(weight).alias("_own"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    columns = {}
    for name, keys in (("", by), ("_in", [*by, *within])) if within else (("", by),):
        whole = Window.partitionBy(*keys)
        run = whole.orderBy("_part")  # rows of one part together
        columns |= {f"_upto{name}": F.sum("_own").over(run), f"_total{name}": F.sum("_own").over(whole)}
        part = Window.partitionBy(*keys, "_part")
        columns |= {f"_rows{name}": F.sum("_own").over(part)}
    part = Window.partitionBy(*by, "_part")
    columns["_one"] = F.min("_lo").over(part) == F.max("_hi").over(part)
    return staged(sizes.withColumns(columns).drop("_own", "_lo", "_hi"))


def placed(df: DataFrame, by: list[str], value: str, within: list[str] = (), weight: str | None = None) -> DataFrame:
    """Add ``_total``, ``_upto`` (rows up to and with the value) and ``_below`` in the groups ``by``, and the same with ``_in`` in
    the groups ``by`` and ``within``. Rows without a value are left out; ``weight`` counts a row so many times."""
    within = list(within)
    rows = df.filter(F.col(value).isNotNull())
    splitters = _splitters(rows, by, value)
    parted = _parted(rows, splitters, by, value)
    w = F.col(weight) if weight else F.lit(1).cast("long")
    sizes = _sizes(_parted(rows.select(*by, *within, value, *([weight] if weight else [])), splitters, by, value), by, within, value, w)
    rows = null_safe_join(parted, sizes, [*by, *within], ["_part"])
    salts = F.when(F.col("_one"), F.ceil(F.col("_rows") / PART_ROWS)).otherwise(1)
    rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts))
    rows = rows.repartition(*by, "_part", "_salt")
    columns = {}
    for name, keys in (("", []), ("_in", within)) if within else (("", []),):
        inside = Window.partitionBy(*by, "_part", "_salt", *keys).orderBy(value)
        before = F.col(f"_upto{name}") - F.col(f"_rows{name}")
        columns[f"_below{name}"] = before + F.when(F.col("_one"), 0).otherwise(F.sum(w).over(inside) - (w if weight else F.count(F.lit(1)).over(inside) - F.rank().over(inside) + 1))
        columns[f"_upto{name}"] = before + F.when(F.col("_one"), F.col(f"_rows{name}")).otherwise(F.sum(w).over(inside))
    return rows.withColumns(columns).drop("_part", "_salt", "_one", "_rows", "_rows_in")


def ladder(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values per group with ``n`` (rows), ``below`` (rows with a smaller value) and ``total``."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return placed(counts, by, value, weight="n").select(*by, value, "n", F.col("_below").alias("below"), F.col("_total").alias("total"))


def with_rank(
    df: DataFrame, by: list[str], value: str, rank: str, percentile: str | None = None, within: list[str] = (), rank_within: str | None = None
) -> DataFrame:
    """Add the descending competition rank and, if named, the ascending percent rank (0..1) and the rank in ``by`` and ``within``.

    Rows without a value are left out.
    """
    rows = placed(df, by, value, within)
    columns = [(F.col("_total") - F.col("_upto") + 1).alias(rank)]
    if percentile:
        spread = F.col("_total") - 1
        columns.append(F.when(spread > 0, F.col("_below") / spread).otherwise(0.0).alias(percentile))
    if rank_within:
        columns.append((F.col("_total_in") - F.col("_upto_in") + 1).alias(rank_within))
    return rows.select(*df.columns, *columns)


def quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, plus ``group_rows``; only the parts that hold one are sorted."""
    rows = df.select(*by, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    parted = _parted(rows, _splitters(rows, by, value), by, value)
    grouped = parted.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    whole = Window.partitionBy(*by)
    sizes = grouped.withColumns({"_upto": F.sum("_rows").over(whole.orderBy("_part")), "_total": F.sum("_rows").over(whole)})
    sizes = staged(sizes.withColumn("_before", F.col("_upto") - F.col("_rows")))
    wanted = [(f"_{name}_{end}", cut(F.lit(p) * (F.col("_total") - 1))) for name, p in points.items() for end, cut in (("lo", F.floor), ("hi", F.ceil))]
    holding = reduce(lambda a, b: a | b, [(i >= F.col("_before")) & (i < F.col("_upto")) for _, i in wanted])
    held = sizes.filter(holding)
    equal = F.col("_lo") == F.col("_hi")
    inside = Window.partitionBy(*by, "_part").orderBy(value)
    some = null_safe_join(parted, held.filter(~equal).select(*by, "_part", "_before", "_total"), by, ["_part"])
    upto, below = F.col("_before") + F.count(F.lit(1)).over(inside), F.col("_before") + F.rank().over(inside) - 1
    steps = some.select(*by, value, below.alias("_below"), upto.alias("_upto"), "_total")
    steps = steps.unionByName(held.filter(equal).select(*by, F.col("_lo").alias(value), F.col("_before").alias("_below"), "_upto", "_total"))
    hits = [F.max(F.when((i >= F.col("_below")) & (i < F.col("_upto")), F.col(value))).alias(name) for name, i in wanted]
    picked = steps.groupBy(*by).agg(F.max("_total").alias("group_rows"), *hits)
    out = []
    for name, p in points.items():
        place = F.lit(p) * (F.col("group_rows") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return picked.select(*by, "group_rows", *out)
