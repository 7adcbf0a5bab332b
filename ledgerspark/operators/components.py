"""Connected components of links between numbered nodes, as DataFrame joins on a shrinking link table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.session import fewer, staged

ROUNDS = 3  # of a Feistel network: a bijection of 64-bit numbers whatever the hash, so ids in order do not stay in order
_LOW = (1 << 32) - 1


def _half(half: Column) -> Column:
    return F.hash(half).cast("long").bitwiseAND(F.lit(_LOW))


def _spread(df: DataFrame) -> DataFrame:
    for _ in range(ROUNDS):
        halves = ((c, F.shiftrightunsigned(c, 32), F.col(c).bitwiseAND(F.lit(_LOW))) for c in df.columns)
        df = df.select(*[F.shiftleft(low, 32).bitwiseOR(high.bitwiseXOR(_half(low))).alias(c) for c, high, low in halves])
    return df


def _gathered(df: DataFrame) -> DataFrame:
    """The inverse of ``_spread``."""
    for _ in range(ROUNDS):
        halves = ((c, F.shiftrightunsigned(c, 32), F.col(c).bitwiseAND(F.lit(_LOW))) for c in df.columns)
        df = df.select(*[F.shiftleft(low.bitwiseXOR(_half(high)), 32).bitwiseOR(high).alias(c) for c, high, low in halves])
    return df


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links(a, b)``; the label is some node of its component, one for all of them.

    Each round every node points to the smallest of its neighbours and itself, and links are carried over to what their ends
    point to, until none is left between different nodes. Nodes are compared by spread numbers, so ids in order make no long chains:
    a constant share of the nodes leaves in each round, and rounds grow with the logarithm of a component's size. A node
    with many links is combined on the map side, and each round's tables are stored, so nothing is gathered and nothing recomputed.
    Links of a node to itself keep that node in the result.
    """
    return rounds(links)[0]


def rounds(links: DataFrame, about: int | None = None) -> tuple[DataFrame, int]:
    """The labels of ``components`` and the number of rounds that they took.

    ``about`` is the number of links where it is known; it only sets the number of files of the first table.
    """
    names = _spread(links.select("a", "b")).distinct()
    names = staged(names if about is None else fewer(names, about))
    left = names.count()
    nodes = 2 * left
    labels, n = None, 0
    while True:
        n += 1
        both = names.union(names.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "node")
        step = staged(fewer(step, 2 * left))
        if labels is None:
            labels = step.withColumnRenamed("to", "label")
        else:
            moved = step.withColumnRenamed("node", "label")
            labels = staged(fewer(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), nodes))
        a, b = (step.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        names = names.join(a, "a").join(b, "b").filter("to_a <> to_b")
        # a node may point to one that points on: those chains are links too
        names = names.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        names = staged(fewer(names, left))
        left = names.count()
        if not left:
            return _gathered(labels), n
