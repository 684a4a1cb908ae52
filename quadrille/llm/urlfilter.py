"""URL filters: a blocked Bloom filter in front of an exact join.

A listed key sets one bit in each of eight 64-bit words of one 512-bit block, so
a probe touches one row of the filter.  The filter is a table (block, w0..w7).
It is broadcast while its size, known from the count of listed keys, is below
BROADCAST_BYTES; beyond that the same table is joined by block number.  Only
possible hits go to the exact hash join, which removes false positives.

Defined results: a null key is never listed; an empty list lists nothing; repeated
rows are judged alike and stay repeated; columns of any name stay, but for one named
like the added one, which it replaces; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each listed key; largest filter that is broadcast.
BITS_PER_KEY, BROADCAST_BYTES = 24, 16 << 20
WORDS = 8


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null or without one: empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    """What lies between the first ``?`` before any ``#`` and the ``#`` or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)


def canonical(host_: Column, path_: Column, query_: Column) -> Column:
    """host and path without a leading www. or m., a default port and a closing slash, and a query if there is one; null if there is no host."""
    plain = F.regexp_replace(F.regexp_replace(host_, r"^(www|m)\.", ""), r":(80|443)$", "")
    asked = F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(F.lit(""))
    return F.when(host_ != "", F.concat(plain, F.regexp_replace(path_, "/+$", ""), asked))


def best_rule(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _hashed(key: Column) -> list[Column]:
    """Two hashes of a key: one chooses the block, the other has six bits for each of its words."""
    return [F.xxhash64(key).alias("_h"), F.xxhash64(F.lit(1), key).alias("_g")]


def _place(blocks: int) -> Column:
    return F.pmod(F.col("_h"), F.lit(blocks)).alias("_block")


def _bit(word: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("_g", 6 * word).bitwiseAND(F.lit(63)).cast("int"))


def blocked_bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(_block, _w0.._w7) of the distinct non-null keys; only blocks that hold a key."""
    k = F.col(key)
    marks = keys.where(k.isNotNull()).select(*_hashed(k)).select(_place(blocks), *(_bit(i).alias(f"_w{i}") for i in range(WORDS)))
    return marks.groupBy("_block").agg(*(F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)))


def mark_listed(rows: DataFrame, key: str, listed: DataFrame, listed_key: str, into: str = "listed") -> DataFrame:
    """rows with a boolean column: is the key in the list?  A column of that name is replaced; all others stay, whatever their names."""
    keys = listed.select(F.col(listed_key).alias("_key")).where("_key is not null").distinct()
    n = keys.count()
    blocks = max(1, -(-n * BITS_PER_KEY // (64 * WORDS)))
    bloom = blocked_bloom(keys, "_key", blocks)
    if blocks * 8 * (WORDS + 1) <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    kept = [c for c in rows.columns if c != into]
    inner = [F.col(f"_c{i}") for i in range(len(kept))]
    k = F.col("_k")
    probed = rows.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)), F.col(key).alias("_k")).select("*", *_hashed(k))
    probed = probed.withColumn("_block", _place(blocks)).join(bloom, "_block", "left")
    possible = k.isNotNull()
    for i in range(WORDS):
        possible &= F.col(f"_w{i}").bitwiseAND(_bit(i)) != 0
    probed = probed.select(*inner, k, F.coalesce(possible, F.lit(False)).alias("_possible"))
    clear = probed.where(~F.col("_possible")).select(*inner, F.lit(False).alias("_in"))
    hits = probed.where("_possible").join(keys, k == F.col("_key"), "left").select(*inner, F.col("_key").isNotNull().alias("_in"))
    return clear.union(hits).select(*(x.alias(c) for x, c in zip(inner, kept, strict=True)), F.col("_in").alias(into))
