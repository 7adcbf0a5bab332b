"""URL rules: host-suffix and path-prefix expressions joined by short hash prefixes, confirmed by the whole digest.

A rule ``(host, path, verdict)`` fits a URL if the URL's host is the rule's or a subdomain of it and the URL's path starts with
the rule's. Of the rules that fit, the longest wins; of equal rules with different verdicts, ``block`` wins.

Defined cases: a null URL and one without ``://`` have an empty host and path; a URL that no rule fits gets ``default``; equal
rows each give their row; rules with a null host or path are left out; an empty rule or page table is fine. Further columns of
the pages are kept out of the work and joined by nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that the join compares first.
PREFIX_DIGITS = 8


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` in lower case and the path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every (host suffix, path prefix) of a URL, with prefixes of the given lengths only."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length(path))
    return F.flatten(
        F.transform(suffixes, lambda h: F.transform(fitting, lambda n: F.struct(h.alias("host"), F.substring(path, F.lit(1), n).alias("path"))))
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages(page_id, url)`` under ``rules(host, path, verdict)``.

    Different URLs are expanded once. The lengths of rule paths, of which there are at most as many as characters in the
    longest, are part of the plan, so a path is cut only where a rule could end.
    """
    rules = rules.filter("host is not null and path is not null").select(
        lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )
    rules = rules.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path"))).select(
        F.substring("digest", 1, PREFIX_DIGITS).alias("prefix"), F.col("digest").alias("rule_digest"),
        F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict",
    )
    lengths = sorted(r.n for r in rules_lengths(rules).collect())
    urls = pages.select(F.col("url").cast("string").alias("url"))
    parts = urls.filter("url is not null").distinct()
    host, path = host_and_path(F.col("url"))
    parts = parts.select("url", F.explode(expressions(host, path, lengths)).alias("x")).select("url", _digest(F.col("x.host"), F.col("x.path")).alias("digest"))
    parts = parts.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    found = parts.join(rules, "prefix").filter("digest = rule_digest")
    best = found.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("rule_verdict") == "block").alias("blocks"), "rule", "rule_verdict")).alias("best"))
    best = best.select(F.col("url").alias("judged"), F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    out = rows.join(best, F.col("url") == F.col("judged"), "left")
    return out.select("page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


def rules_lengths(rules: DataFrame) -> DataFrame:
    """Different lengths of rule paths; a rule is its host and its path, which begins at the first slash."""
    return rules.select((F.length("rule") - F.length(F.regexp_extract("rule", r"^[^/]*", 0))).alias("n")).distinct()
