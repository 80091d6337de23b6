"""Imports every module that registers queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators import ordered, planner
from loomtrace.plans import graph, misc, more, planning, retrieval, stats, text  # noqa: F401  (they register their queries)
from loomtrace.plans.catalogue import table
from loomtrace.providers import embed


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark passage the ten most similar distinct chunks of the documents, with their pages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("w"))
    parts = docs.select("doc_id", F.size("w").alias("n"), F.posexplode(ordered.token_windows(F.col("w"))).alias("i", "part"))
    start = F.col("i") * 75
    page = lambda at: (F.floor(at / 300) + 1).cast("int")
    chunks = parts.select(
        F.concat_ws("-", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("i").cast("string"), 6, "0")).alias("doc_id"),
        F.array_join("part", " ").alias("text"),
        ordered.page_range(page(start), page(F.least(start + 149, F.col("n") - 1))).alias("page_id"),
    )
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), embed(F.col("text")).alias("q"))
    return planner.ask(questions, chunks, embed=embed)
