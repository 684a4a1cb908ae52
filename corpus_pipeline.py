"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
all but the last return the columns of documents.

Defined results: a null or empty text is not toxic, repeats nothing, links with
nothing, leaks nothing and has no tokens, so its row stays; rows without a doc_id are
judged like others, but each is kept by the n-gram stage; rows that repeat a doc_id
are judged by their own texts; further columns stay, whatever their names; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import bpe, decontaminate, linededup, ngram_join, toxicity
from quadrille.llm.shared import Scratch, cleaned

#: What the stages read or write; other columns are carried under names that no operator uses.
COLUMNS = ("doc_id", "text", "n_chars")


def _aside(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(f"`{c}`").alias(c if c in COLUMNS else f"_aside{i}") for i, c in enumerate(docs.columns)))


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*(F.col(c if c in COLUMNS else f"_aside{i}").alias(c) for i, c in enumerate(docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model is learned from the labelled documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(toxicity.score(_aside(docs), model, threshold=0.3).where("predicted = 0"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks and long runs of lines that occurred before are cut; n_chars follows the text."""
    out = linededup.drop_repeated_chunks(_aside(docs), over_words=linededup.OVER_WORDS)
    length = F.when(F.col("removed_chunks") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return _back(out.withColumn("n_chars", length), docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word 5-gram Jaccard >= 0.8 the one with the smallest doc_id stays.

    Rows that repeat a doc_id and its text become one row; those with another text are
    decided on their own, in the order of a hash of the text. Rows without a doc_id
    stay.
    """
    # one number for each doc_id and text: doc_id * 2^62, and 62 bits of the text's hash
    row = F.expr(f"CAST(CAST(doc_id AS DECIMAL(19, 0)) * CAST({1 << 62} AS DECIMAL(19, 0)) + (xxhash64(text) & {(1 << 62) - 1}) AS DECIMAL(38, 0))")
    rows = _aside(docs).withColumn("_row", row)
    groups = ngram_join.near_groups(rows.select("_row", "text"), key="_row", n=5, percent=80)
    gone = groups.where(F.col("component_id") < F.col("_row")).select("_row").distinct()
    known = rows.where("_row is not null").join(gone, "_row", "left_anti").dropDuplicates(["_row"])
    return _back(known, docs).union(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a passage that aligns with a test item go, whatever rows hold them."""
    rows = _aside(docs).withColumn("_text", F.md5("text"))
    found = decontaminate.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_text")
    return _back(rows.join(found.select("_text").distinct(), "_text", "left_anti"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: Trained models, alignment and byte-pair merges are not SQL: tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        before = docs
        with cleaned():
            docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
