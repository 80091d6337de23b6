"""The corpus pipeline: language, repeated lines, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. All but the
last return the columns of ``documents``; the last returns each remaining document's token count and
the digests of its ids and of the text they decode to.

Defined cases: rows without a text or a letter go in the first stage; rows that repeat are exact copies, all of whose rows are kept or
go together, as they share key and text; rows without a key are near copies of nothing and stay; ties go to the smallest key; texts of any
length are read whole; an empty table gives an empty result; further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import bpe, decontaminate, langid, lines, neardup
from loomtrace.llm.common import table, written
from loomtrace.llm.queries import vocabulary


#: Keys of 12 bytes that are sent to every task at most, instead of dealing all texts; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language can't be told. The model learns from the labelled part of the input."""
    # Numbered names can't clash with those of the prediction.
    own = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    found = langid.predict(own, langid.train(docs), own.columns, text=f"_{docs.columns.index('text')}")
    return found.where(~F.col("rejected")).select(*own.columns).toDF(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of three-line windows. A text that changes gets its own number of characters."""
    done = lines.dedup_lines(docs)
    n = F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest key."""
    found = neardup.near_duplicates(docs, neardup.FIVE_WORDS).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("check").alias("_check")).distinct()
    found, _ = written(found, "near-copies")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    return docs.join(found, (docs["doc_id"] == found["_id"]) & (F.hash(docs["text"]) == found["_check"]), "left_anti")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, also in other numbers or names."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return bpe.encode_digests(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("repeated_lines", repeated_lines),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]

#: Language identification and the exact ids of a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
