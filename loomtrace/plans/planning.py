"""Queries that plan answers: containment, best questions, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import planner
from loomtrace.operators.ordered import token_windows
from loomtrace.plans.catalogue import query, table
from loomtrace.providers import embed

_LINES = "l AS (SELECT DISTINCT {g}, t AS text FROM (SELECT {g}, unnest(string_split(text, chr(10))) AS t FROM {t}) WHERE t <> '')"


def _lines(spark, sf, name, group):
    return table(spark, sf, name).select(group, F.explode(F.split("text", "\n", -1)).alias("text")).where("text <> ''").distinct()


@query(
    "containment_antijoin",
    f"WITH {_LINES.format(g='doc_id', t='documents')} SELECT doc_id, text FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.doc_id = a.doc_id AND b.text <> a.text AND contains(b.text, a.text))",
)
def containment_antijoin(spark, sf):
    return planner.not_contained(_lines(spark, sf, "documents", "doc_id"), "text", ["doc_id"]).select("doc_id", "text")


@query(
    "longest_container",
    f"""
    WITH {_LINES.format(g='source', t='documents')},
    b AS (SELECT a.source, a.text, arg_min(b.text, {{'n': -length(b.text), 't': b.text}}) AS best FROM l a JOIN l b ON a.source = b.source AND b.text <> a.text AND contains(b.text, a.text) GROUP BY a.source, a.text)
    SELECT l.source, md5(l.text) AS text, md5(coalesce(best, l.text)) AS best FROM l LEFT JOIN b ON l.source = b.source AND l.text = b.text
    """,
)
def longest_container(spark, sf):
    return planner.longest_container(_lines(spark, sf, "documents", "source"), "text", ["source"]).select("source", F.md5(F.col("text").cast("binary")).alias("text"), F.md5(F.col("best").cast("binary")).alias("best"))


@query(
    "best_question_assignment",
    "SELECT l_partkey, l_suppkey, l_extendedprice, l_orderkey, l_linenumber FROM lineitem QUALIFY l_suppkey = first_value(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
)
def best_question_assignment(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    return planner.best_question(rows, "l_partkey", "l_suppkey", "l_extendedprice", "l_suppkey")


@query(
    "top_n_groups_by_first",
    """
    WITH f AS (SELECT o_orderpriority, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) = 1)
    SELECT o_orderpriority AS topic, o_custkey AS question, o_totalprice AS confidence FROM f QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_custkey) <= 5
    """,
)
def top_n_groups_by_first(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("topic"), F.col("o_custkey").alias("question"), F.col("o_custkey").alias("q_ord"), F.col("o_orderkey").alias("rank"), F.col("o_totalprice").alias("confidence"))
    return planner.top_questions(rows, 5, ["topic"]).select("topic", "question", "confidence")


@query(
    "merge_contained_answers",
    """
    WITH a AS (SELECT user_id AS question, event_id AS rank, repeat('x', (event_id % 7 + 1)::INTEGER) || ' y ' || repeat('z', (user_id % 4)::INTEGER) AS sentence FROM events),
    s AS (SELECT DISTINCT sentence FROM a),
    b AS (SELECT x.sentence, arg_min(y.sentence, {'n': -length(y.sentence), 's': y.sentence}) AS best FROM s x JOIN s y ON y.sentence <> x.sentence AND contains(y.sentence, x.sentence) GROUP BY x.sentence),
    m AS (SELECT question, rank, coalesce(best, a.sentence) AS sentence FROM a LEFT JOIN b USING (sentence))
    SELECT question, rank, sentence FROM m QUALIFY row_number() OVER (PARTITION BY question, sentence ORDER BY rank) = 1
    """,
)
def merge_contained_answers(spark, sf):
    text = F.concat(F.expr("repeat('x', cast(event_id % 7 + 1 AS int))"), F.lit(" y "), F.expr("repeat('z', cast(user_id % 4 AS int))"))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("question"), F.col("event_id").alias("rank"), text.alias("sentence"))
    return planner.merge_contained(rows).select("question", "rank", "sentence")


@query(
    "prompt_contents",
    r"""
    WITH b AS (SELECT conv_id, turn, 'T' || turn || chr(10) || '- ' || text AS block FROM conversations),
    c AS (SELECT *, 5 + sum(len(regexp_extract_all(block, '[0-9A-Za-z_]+|[^0-9A-Za-z_\s]'))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM b)
    SELECT conv_id, string_agg(block, chr(10) || chr(10) ORDER BY turn) AS contents, max(used)::BIGINT AS used FROM c WHERE used <= 200 GROUP BY conv_id
    """,
)
def prompt_contents(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", F.concat(F.lit("T"), F.col("turn")).alias("question"), F.col("turn").alias("q_ord"), F.lit(0).alias("rank"), F.col("text").alias("sentence"))
    return planner.prompt_contents(rows, 200, 5, ["conv_id"])


@query("macroplan")
def macroplan(spark, sf):
    k = F.col("item_id")
    # Every twentieth item is a question; the ones up to the next are its further questions.
    items = table(spark, sf, "benchmark").select(F.floor(k / 20).alias("topic"), k.alias("query_id"), F.col("text").alias("question"), embed(F.col("text")).alias("q"), k.alias("q_ord"))
    # Joined before they become rows, as a row of tokens takes longer to copy than its text.
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.transform(token_windows(F.split("text", " ", -1)), lambda part: F.array_join(part, " "))).alias("i", "text"))
    name = F.concat_ws("-", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("i").cast("string"), 6, "0"))
    chunks = docs.select(name.alias("doc_id"), "text", (F.floor(F.col("i") / 4) + 1).cast("string").alias("page_id"))
    return planner.macroplan(items.where("query_id % 20 = 0"), items.where("query_id % 20 <> 0"), chunks, 5, 0.55, embed=embed).select("topic", "question", "rank", "sentence", "confidence")
