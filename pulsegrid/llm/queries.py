"""Queries over the whole shared tables, one for each corpus operator."""

from __future__ import annotations


import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, embed_dedup, graph_search, html_text, langid, merkle, packing, prefix_trie, secret_scan, simhash, suffix_dedup, token_align, url_filter
from pulsegrid.llm.common import table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), rebuilt=True)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(table(spark, sf_dir, "documents"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_suffix_dedup, op3_simhash, op4_fingerprints, op5_secret_scan, op6_url_filter, op7_packing, op8_bpe,
        op9_language_id, op10_html_text, op11_prefix_trie, op12_token_alignment, op13_nearest,
    )
}

OP6_SQL = """
WITH rules(host, path, verdict) AS (VALUES {rules}),
addresses AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{upper}', '{lower}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
         row_number() OVER () AS n
  FROM pages
),
fits AS (
  SELECT a.n, arg_max(r.host || r.path, length(r.host || r.path) * 1000 + length(r.host)) AS rule,
         arg_max(r.verdict, length(r.host || r.path) * 1000 + length(r.host)) AS verdict
  FROM addresses a JOIN rules r
    ON (a.host = r.host OR ends_with(a.host, '.' || r.host)) AND starts_with(a.path, r.path)
  GROUP BY a.n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM addresses LEFT JOIN fits USING (n)
""".format(rules=", ".join(map(repr, RULES)), upper=url_filter.UPPER, lower=url_filter.LOWER)

OP11_SQL = """
WITH steps AS (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)),
crcs AS (SELECT list(c ORDER BY i) AS t FROM steps),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS m
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (SELECT conv_id, list(m ORDER BY i) AS ms FROM turns GROUP BY conv_id),
digits AS (SELECT conv_id, ms, list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM own),
cut AS (
  SELECT conv_id, ms, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_concat([4294967295], bytes), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 6 AS h
  FROM digits, crcs
),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.ms[1:h], []), c.ms[h + 1:]) AS ms FROM cut c LEFT JOIN own b ON b.conv_id = c.base),
steps_of AS (SELECT conv_id, unnest(range(len(ms) + 1)) AS d, ms FROM rebuilt),
prefixes AS (SELECT conv_id, d, ms[1:d] AS p, d = len(ms) AS ended FROM steps_of),
nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM prefixes GROUP BY d, p
),
hung AS (
  SELECT n.*, up.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND k.p[1:n.d] = n.p) AS n_children
  FROM nodes n LEFT JOIN nodes up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
),
under AS (
  SELECT k AS d, p[1:k] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(p[d].x) END) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS k FROM hung) GROUP BY 1, 2
)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM hung JOIN under USING (d, p)
"""

ORACLES = {"op6_url_filter": OP6_SQL, "op11_prefix_trie": OP11_SQL}


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
