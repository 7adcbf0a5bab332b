"""One-to-one matching: equal amount within a few days, and identifiers contained in file names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.operators.components import components
from ledgerspark.session import staged

PART_ROWS = 65_536  # rows of one amount and day that a part holds on average, at most


def _numbered(df: DataFrame, amount: str, day: str, key: str) -> DataFrame:
    """Place of every row inside its amount and day, counted from 0, in the order of a digest of its key.

    Leading digits of the digest cut each amount and day into parts in the same order. How many digits follows from the
    number of its rows, so a part holds PART_ROWS on average at any size: the parts are counted, and only rows of one part meet
    in a window, also on a day on which one amount fills a third of the table.
    """
    rows = df.withColumn("_digest", F.md5(F.col(key).cast("string")))
    totals = df.groupBy(amount, day).agg(F.count(F.lit(1)).alias("_total"))
    digits = F.ceil(F.greatest(F.lit(0.0), F.log(F.col("_total") / PART_ROWS) / F.log(F.lit(16.0)))).cast("int")
    rows = rows.join(totals.select(amount, day, digits.alias("_digits")), [amount, day])
    rows = rows.withColumn("_part", F.left("_digest", F.col("_digits")))
    sizes = rows.groupBy(amount, day, "_part").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(amount, day).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(amount, day, "_part", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(amount, day, "_part").orderBy("_digest", key)
    placed = rows.withColumn("_row", F.row_number().over(inside) - 1)
    return placed.join(offsets, [amount, day, "_part"]).withColumn("_place", F.col("_before") + F.col("_row")).drop(
        "_part", "_digest", "_digits", "_before", "_row"
    )


def match_in_window(
    left: DataFrame, right: DataFrame, amount: str, left_day: str, right_day: str, left_key: str, right_key: str,
    days: int = 3,
) -> DataFrame:
    """Greedy one-to-one pairs of equal amount whose dates differ by at most ``days``.

    Meaning: left rows in the order of day and tie digest each take the first unused right row, in the same order,
    that lies within the window. Rows of one amount therefore behave like a queue, and the queue only has to be
    followed day by day: of the ``b`` left rows of a day the first ``m`` get the next ``m`` right rows, where

        start = max(position after the day before, right rows too old by now)
        m     = min(b, right rows up to the end of the window - start)

    The days of an amount are few (a calendar), so this runs on a short array per amount; the rows themselves are
    only numbered and joined on (amount, number). No group of rows is ever gathered.
    Result: ``left_key``, ``right_key`` of the pairs.
    """
    d = "_day"
    known = F.col(amount).isNotNull() & F.col(d).isNotNull()
    left = staged(left.select(amount, F.col(left_day).alias(d), F.col(left_key).alias("_l")).filter(known))
    right = staged(right.select(amount, F.col(right_day).alias(d), F.col(right_key).alias("_r")).filter(known))
    l, r = _numbered(left, amount, d, "_l"), _numbered(right, amount, d, "_r")

    left_days = left.groupBy(amount, d).agg(F.count(F.lit(1)).alias("b"))
    right_days = right.groupBy(amount, d).agg(F.count(F.lit(1)).alias("c"))
    # every right day enters the running count twice: when it becomes reachable and when it is too old
    steps = (
        left_days.select(amount, F.col(d).alias("_at"), F.col(d).alias(d), "b", F.lit(0).alias("opened"), F.lit(0).alias("closed"), F.lit(1).alias("_o"))
        .unionByName(right_days.select(amount, F.date_sub(d, days).alias("_at"), F.lit(None).cast("date").alias(d), F.lit(0).alias("b"), F.col("c").alias("opened"), F.lit(0).alias("closed"), F.lit(0).alias("_o")))
        .unionByName(right_days.select(amount, F.date_add(d, days + 1).alias("_at"), F.lit(None).cast("date").alias(d), F.lit(0).alias("b"), F.lit(0).alias("opened"), F.col("c").alias("closed"), F.lit(0).alias("_o")))
    )
    run = Window.partitionBy(amount).orderBy("_at", "_o").rowsBetween(Window.unboundedPreceding, 0)
    bounds = steps.withColumns({"hi": F.sum("opened").over(run), "lo": F.sum("closed").over(run)}).filter(F.col(d).isNotNull())
    days_of = bounds.groupBy(amount).agg(F.array_sort(F.collect_list(F.struct(F.col(d).alias("day"), "b", "lo", "hi"))).alias("_days"))

    def follow(state: Column, x: Column) -> Column:
        start = F.greatest(state["pos"], x["lo"])
        taken = F.least(x["b"], x["hi"] - start)
        return F.struct(
            (start + taken).alias("pos"),
            F.concat(state["out"], F.array(F.struct(x["day"].alias(d), start.alias("_start"), taken.alias("_taken")))).alias("out"),
        )

    empty = F.array().cast(f"array<struct<{d}:date,_start:bigint,_taken:bigint>>")
    followed = F.aggregate("_days", F.struct(F.lit(0).cast("bigint").alias("pos"), empty.alias("out")), follow)["out"]
    plan = days_of.select(amount, F.inline(followed)).filter("_taken > 0")

    before = Window.partitionBy(amount).orderBy(d).rowsBetween(Window.unboundedPreceding, -1)
    right_start = right_days.select(amount, d, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_from"))
    numbered_left = l.join(plan, [amount, d]).filter(F.col("_place") < F.col("_taken")).select(
        amount, (F.col("_start") + F.col("_place")).alias("_no"), F.col("_l").alias(left_key)
    )
    numbered_right = r.join(right_start, [amount, d]).select(
        amount, (F.col("_from") + F.col("_place")).alias("_no"), F.col("_r").alias(right_key)
    )
    return numbered_left.join(numbered_right, [amount, "_no"]).select(left_key, right_key)


def contained_ids(files: DataFrame, ids: DataFrame, file: str, ident: str) -> DataFrame:
    """Pairs (id, file) where the id is a substring of the file name, whatever its length and characters.

    Every window of a name that is as long as some id is equi-joined; the different lengths of ids, no more than the
    longest has characters, are part of the plan. Empty ids are in no name.
    """
    ids = ids.select(ident).filter(F.length(ident) > 0).distinct()
    lengths = sorted(r.n for r in ids.select(F.length(ident).alias("n")).distinct().collect())
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length(file))
    cut = F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length(file) - n + 1), lambda i: F.col(file).substr(i, n)))
    return files.select(file, F.explode(F.flatten(cut)).alias(ident)).distinct().join(ids, ident)


GROUP_PAIRS = 200_000  # pairs that one task walks through


def assign_one_to_one(pairs: DataFrame, ident: str, file: str, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """Ids in ascending order each take their smallest free file.

    Files that hold one id are nobody else's, so an id that only has such files takes the smallest at once. Ids and files that are
    tied together by shared files form components (rounds grow with the logarithm of their size, also for a chain in which every choice
    depends on the one before); components do not touch each other, so each is walked through in one task. A component of more
    than ``group_pairs`` pairs is first cut down by rounds over all of it: pairs that are first choice on both sides are
    fixed and leave, as the walk would choose them, and what is left falls apart or is small enough.
    """
    kinds = pairs.select(ident, file).schema
    known = staged(pairs.select(ident, file).distinct())
    shared = known.groupBy(file).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(file)
    tied = staged(known.join(known.join(shared, file, "left_semi").select(ident).distinct(), ident, "left_semi"))
    out = [known.join(tied.select(ident).distinct(), ident, "left_anti").groupBy(ident).agg(F.min(file).alias(file))]
    while not tied.isEmpty():
        # nodes by hash: two that fall together only make a component larger
        ends = tied.select(F.xxhash64(F.lit("id"), F.col(ident).cast("string")).alias("a"), F.xxhash64(F.lit("file"), F.col(file).cast("string")).alias("b"))
        labels = components(ends).withColumnRenamed("node", "_node")
        named = staged(tied.withColumn("_node", F.xxhash64(F.lit("id"), F.col(ident).cast("string"))).join(labels, "_node").drop("_node"))
        sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
        small = named.join(sizes.filter(F.col("_n") <= group_pairs), "label", "left_semi")
        out.append(_walked(small, ident, file))
        rest = staged(named.join(sizes.filter(F.col("_n") > group_pairs), "label", "left_semi").select(ident, file))
        if rest.isEmpty():
            break
        best_file = rest.groupBy(ident).agg(F.min(file).alias(file))
        best_id = rest.groupBy(file).agg(F.min(ident).alias(ident))
        done = staged(best_file.join(best_id, [ident, file]))
        out.append(done)
        tied = staged(rest.join(done.select(ident), ident, "left_anti").join(done.select(file), file, "left_anti"))
    return reduce(DataFrame.unionByName, [x.select(*kinds.names) for x in out])


def _walked(named: DataFrame, ident: str, file: str) -> DataFrame:
    """The walk over each component (``label``): rows come sorted, and a component's taken files are all that is kept."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, done, taken = None, None, set()
        for batch in batches:
            keep = []
            for row, (own, i, f) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("label", ident, file)))):
                if own != label:
                    label, done, taken = own, None, set()
                if (done is None or done != i) and f not in taken:
                    done = i
                    taken.add(f)
                    keep.append(row)
            yield batch.select([ident, file]).take(pa.array(keep, pa.int64()))

    rows = named.select("label", ident, file).repartition("label").sortWithinPartitions("label", ident, file)
    return rows.mapInArrow(walk, named.select(ident, file).schema)
