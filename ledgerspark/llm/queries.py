"""Registered queries opN_<name> and pipeline, with DuckDB SQL where it can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import bpe, codes, decontam, jaccard, lm, packing, pii, quality, repeats, tokens, urls, whitening, windows
from ledgerspark.llm.scratch import place

#: Rules of the URL query: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
END_ID = 2
PACKED_END_ID = 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op2_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = place(spark, "tokens.orc")
    tokens.write_tokens(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return tokens.starts(tokens.checksums(tokens.read_tokens(spark, folder)))


def op3_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.removed(_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return urls.judge(_table(spark, sf_dir, "pages"), rules)


def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op8_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    training = docs.filter(~lm.held_out(F.col("doc_id")))
    model, counts = lm.train(training, public_tokenizers.path("piece_bpe_32k.model"))
    scores = lm.score(docs, model, counts)
    return scores.select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(_table(spark, sf_dir, "documents"))


def op10_shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), PACKED_END_ID)


def op12_shifted_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_block_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_repetition_quality, op2_orc_tokens, op3_window_dedup, op4_url_rules, op5_latent_decontamination, op6_byte_bpe,
        op7_byte_repeats, op8_lattice_scores, op9_contextual_pii, op10_shingle_jaccard, op11_bin_completion,
        op12_shifted_whitening, op13_block_codes,
    )
}

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "op3_window_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS key FROM starts),
firsts AS (SELECT key, min(doc_id) AS least FROM win GROUP BY key),
hits AS (SELECT doc_id, i FROM win JOIN firsts USING (key) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hits),
gone_lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(array_to_string([ws[p] FOR p IN range(1, len(ws) + 1) IF ps IS NULL OR NOT list_contains(ps, p)], ' ')) AS kept_sha256
FROM w LEFT JOIN gone_lists USING (doc_id)
""",
    "op10_shingle_jaccard": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE [array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
often AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN often USING (g) JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(d, r) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT d, b FROM reach JOIN both_ways ON a = r)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(w.doc_id, m), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d, min(r) AS m FROM reach GROUP BY d) q ON q.d = w.doc_id
""",
    "op4_url_rules": f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
seen AS (SELECT DISTINCT host, path FROM parts),
fits AS (
  SELECT host, path, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, rule_verdict DESC) AS k
  FROM seen JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, p.host, p.path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.host = p.host AND f.path = p.path AND k = 1
""",
}
