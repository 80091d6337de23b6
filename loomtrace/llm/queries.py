"""The training-data queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import bpe, decontaminate, fingerprint, html, langid, lines, neardup, quality, substrings, warc
from loomtrace.llm.common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, ["doc_id", "held_out"])


@query("op2_html")
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


@query("op3_substrings")
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(table(spark, sf_dir, "documents"))


@query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query("op5_near_duplicates")
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("check")


@query(
    "op6_warc",
    """
    WITH f AS (SELECT greatest(1, (coalesce(sum(strlen(html)), 0) + 8388607) // 8388608) AS n FROM pages),
    r AS (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
            || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Date: 2020-01-01T00:00:00Z' || chr(13) || chr(10)
            || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
            || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
            || chr(13) || chr(10) || chr(13) || chr(10) AS t FROM pages),
    h AS (SELECT page_id, strlen(t)::BIGINT AS length, sha256('leaf:' || t) AS digest FROM r),
    d AS (SELECT h.*, ('0x' || substr(digest, 1, 8))::BIGINT % f.n::BIGINT AS file FROM h, f),
    e AS (SELECT file, sum(length)::BIGINT AS "offset", 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
            || 'WARC-Record-ID: <urn:page:' || (-1 - file) || '>' || chr(13) || chr(10) || 'WARC-Date: 2020-01-01T00:00:00Z' || chr(13) || chr(10)
            || 'WARC-Target-URI: ' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
            || 'Content-Length: 0' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) AS t FROM d GROUP BY file)
    SELECT page_id, file, row_number() OVER w - 1 AS place, (sum(length) OVER w - length)::BIGINT AS "offset", length, digest,
           CASE page_id % 97 WHEN 0 THEN 'missing' WHEN 1 THEN 'corrupt' ELSE 'ok' END AS status
    FROM d WINDOW w AS (PARTITION BY file ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT -1 - file, file, NULL, "offset", strlen(t)::BIGINT, sha256('leaf:' || t), 'extra' FROM e
    """,
)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout, replica = warc.drill(table(spark, sf_dir, "pages"))
    return warc.fixity(layout, replica).withColumnRenamed("id", "page_id")


@query(
    "op7_lines",
    """
    WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(text, chr(10)) AS ls FROM documents),
    w AS (SELECT doc_id, unnest(range(1, len(ls) - 1)) AS i, ls FROM l WHERE len(ls) >= 3),
    k AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS t FROM w),
    r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM k WHERE regexp_matches(t, '[^ \t\r\n\x0b\x0c]')),
    m AS (SELECT DISTINCT doc_id, i + d AS i FROM r, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1),
    g AS (SELECT doc_id, list(i) AS gone FROM m GROUP BY doc_id)
    SELECT l.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
           sha256(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(
               [ls[j] FOR j IN range(1, len(ls) + 1) IF NOT list_contains(gone, j)], chr(10)), '') END) AS kept_sha256
    FROM l LEFT JOIN g ON l.doc_id = g.doc_id
    """,
)
def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), kept.alias("kept_sha256"))


@query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "matched", "reworded")


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)))
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    model = quality.train(docs.where(~F.col("held_out")), labels)
    scored = quality.predict(docs, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
