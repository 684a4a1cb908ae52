"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def remainder(key, n: int):
    """crc32 of the key's decimal text, modulo n."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linededup

    out = linededup.drop_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), over_words=linededup.OVER_WORDS)
    return out.select("doc_id", "removed_chunks", F.length("text").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.near_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embedding

    return embedding.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, lambda key: remainder(key, 3) != 1)
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return langid.predict(docs.select("doc_id", held, "text"), model).drop("text")


#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Pages of hosts with this label are on the list of URLs.
LISTED_LABEL = "spam-farm"


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urlfilter as u

    pages = table(spark, sf_dir, "pages").select("page_id", u.host(F.col("url")).alias("host"), u.path(F.col("url")).alias("path"), u.query(F.col("url")).alias("query"))
    pages = pages.withColumn("canonical", u.canonical(F.col("host"), F.col("path"), F.col("query")))
    listed = pages.where(F.concat(F.lit("."), "host").contains(f".{LISTED_LABEL}."))
    judged = u.mark_listed(pages, "canonical", listed, "canonical")
    rule, verdict = u.best_rule(F.col("host"), F.col("path"), RULES)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


OP8_SQL = r"""
WITH a AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]+)', 1) AS query FROM a),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || query END AS canonical FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE contains('.' || host, '.spam-farm.') AND canonical IS NOT NULL),
r(said, h, s) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
m AS (SELECT c.page_id, c.host, c.path, c.canonical, arg_max(r.h || r.s, length(r.h || r.s)) AS rule, arg_max(r.said, length(r.h || r.s)) AS said
  FROM c LEFT JOIN r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.s) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda key: remainder(key, 4) != 2)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return toxicity.score(docs.select("doc_id", held, "text"), model, threshold=0.3).drop("text")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    out = chat.rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda x: F.concat(x["first"], F.lit("-"), x["stop"]))
    return out.select("conv_id", "perspective", "part", "n_turns", "dialogue", F.array_join(spans, ",").alias("mask"))


OP10_SQL = r"""
WITH t AS (SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS body FROM conversations),
v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS DISTINCT FROM 'system'),
h AS (SELECT t.conv_id, t.turn, t.speaker, t.body, v.perspective, CAST(floor(t.turn / 64) AS BIGINT) AS part,
  CASE WHEN t.speaker = 'system' THEN '<|system|>' WHEN t.speaker IS NOT DISTINCT FROM v.perspective THEN '<|assistant|>' WHEN t.speaker IS NULL THEN '<|user|>'
    ELSE '<|user name=' || regexp_replace(t.speaker, '[|<>\r\n]', '_', 'g') || '|>' END || chr(10) AS head,
  t.speaker IS NOT DISTINCT FROM v.perspective AS train
  FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
s AS (SELECT *, head || regexp_replace(body, '<(\\*)\|', '<\1\\|', 'g') || '<|end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, speaker NULLS FIRST, body ROWS UNBOUNDED PRECEDING) AS stop FROM s)
SELECT conv_id, perspective, part, CAST(count(*) AS INTEGER) AS n_turns, string_agg(segment, '' ORDER BY stop) AS dialogue,
  coalesce(string_agg(CAST(stop - length(segment) + length(head) AS VARCHAR) || '-' || CAST(stop AS VARCHAR), ',' ORDER BY stop) FILTER (WHERE train), '') AS mask
FROM o GROUP BY conv_id, perspective, part
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_suffixes": op4_suffixes,
    "op5_decontaminate": op5_decontaminate,
    "op6_embeddings": op6_embeddings,
    "op7_langid": op7_langid,
    "op8_urls": op8_urls,
    "op9_toxicity": op9_toxicity,
    "op10_chat": op10_chat,
}
SQL: dict[str, str] = {"op8_urls": OP8_SQL, "op10_chat": OP10_SQL}
