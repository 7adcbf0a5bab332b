"""Code hierarchies written as string prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_leaf_flag(df: DataFrame, by: list[str | Column], code: str = "account_code", out: str = "is_leaf") -> DataFrame:
    """True where no other code of the group starts with this code; codes must be unique inside a group.

    In binary order all codes with one prefix are neighbours, so it is enough to look at the next code. This needs
    one window on the grouping keys in place of a pairwise LIKE anti join.
    """
    following = F.lead(code).over(Window.partitionBy(*by).orderBy(code))
    return df.withColumn(out, ~F.coalesce(following.startswith(F.col(code)), F.lit(False)))


def code_depth(code: str = "account_code") -> Column:
    """Dotted codes: number of segments; plain codes of 1, 3 or 5 digits: 1, 2, 3; everything else 4."""
    c, size = F.col(code), F.length(code)
    return (
        F.when(c.contains("."), size - F.length(F.replace(c, F.lit("."))) + 1)
        .when(size == 1, 1)
        .when(size == 3, 2)
        .when(size == 5, 3)
        .otherwise(4)
    )


def code_depth_label(code: str = "account_code") -> Column:
    c = F.col(code)
    dotted = F.element_at(
        F.create_map(F.lit(2), F.lit("grupo"), F.lit(3), F.lit("subgrupo")), F.size(F.split(c, "\\."))
    )
    plain = F.element_at(
        F.create_map(F.lit(1), F.lit("clase"), F.lit(3), F.lit("grupo"), F.lit(5), F.lit("subgrupo")), F.length(c)
    )
    return F.coalesce(F.when(c.contains("."), dotted).otherwise(plain), F.lit("detalle"))


def group_code(code: str = "account_code") -> Column:
    """Group of a code: first segment of a dotted code, first three digits of a plain one."""
    c = F.col(code)
    return F.when(c.contains("."), F.substring_index(c, ".", 1)).when(F.length(c) >= 3, F.left(c, F.lit(3)))


def subgroup_code(code: str = "account_code") -> Column:
    c = F.col(code)
    return F.when(c.contains("."), F.substring_index(c, ".", 2)).when(F.length(c) >= 5, F.left(c, F.lit(5)))
