"""Queries over scores, ratings and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import ordered, scoring
from loomtrace.plans.catalogue import query, table
from loomtrace.plans.retrieval import _COS, _items

_BEST = f"""
    best AS (SELECT q.vec_id AS fact_id, q.label, d.vec_id AS source_id, {_COS.format(a='q.embedding', b='d.embedding')} AS score FROM embeddings q, embeddings d
      WHERE q.label >= 5 AND d.label < 5 AND {_COS.format(a='q.embedding', b='d.embedding')} >= 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, d.vec_id) = 1)
"""


def _support(spark, sf):
    items = _items(spark, sf)
    facts = items.where("label >= 5").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return scoring.support(facts, items.where("label < 5").select(F.col("id").alias("doc_id"), "v"))


@query("best_support_per_fact", f"WITH {_BEST} SELECT e.vec_id AS fact_id, source_id, score FROM embeddings e LEFT JOIN best ON fact_id = vec_id WHERE e.label >= 5")
def best_support_per_fact(spark, sf):
    return _support(spark, sf)


@query("support_max", f"WITH {_BEST} SELECT source_id, max(score) AS score FROM best GROUP BY source_id")
def support_max(spark, sf):
    return scoring.source_side(_support(spark, sf))


@query(
    "adherence_scores",
    f"""
    WITH {_BEST}, s AS (SELECT source_id, max(score) AS score FROM best GROUP BY source_id)
    SELECT label, count(score) AS fact_count, count(*) FILTER (score >= 0.4) AS supporting_facts, round(count(*) FILTER (score >= 0.4) / count(score), 6) AS fact_score, round(avg(score), 6) AS fact_score_fuzzy
    FROM s JOIN embeddings ON vec_id = source_id GROUP BY label
    """,
)
def adherence_scores(spark, sf):
    rows = scoring.source_side(_support(spark, sf)).join(_items(spark, sf).select(F.col("id").alias("source_id"), "label"), "source_id")
    return scoring.adherence(rows, ["label"], 0.4).select("label", "fact_count", "supporting_facts", F.round("fact_score", 6).alias("fact_score"), F.round("fact_score_fuzzy", 6).alias("fact_score_fuzzy"))


@query(
    "medians_quartiles",
    """
    SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3, count(*) AS n
    FROM lineitem GROUP BY l_returnflag
    """,
)
def medians_quartiles(spark, sf):
    out = scoring.quartiles(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3")), "n")


@query("mid_ranks", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rank FROM lineitem")
def mid_ranks(spark, sf):
    return ordered.mid_ranks(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "rank")


@query(
    "wilcoxon_z",
    """
    WITH d AS (SELECT l_returnflag, round((l_discount - l_tax) * 100)::INTEGER AS d FROM lineitem),
    r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_returnflag, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0)
    SELECT l_returnflag, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus,
           round((sum(CASE WHEN d > 0 THEN r ELSE 0 END) - sum(r) / 2) / (sqrt(sum(r * r)) / 2), 6) AS z FROM r GROUP BY l_returnflag
    """,
)
def wilcoxon_z(spark, sf):
    d = F.round((F.col("l_discount") - F.col("l_tax")) * 100).cast("int")
    return scoring.wilcoxon(table(spark, sf, "lineitem").select("l_returnflag", "l_discount", "l_tax"), d, ["l_returnflag"]).withColumn("z", F.round("z", 6))


@query(
    "wilcoxon_pratt",
    """
    WITH d AS (SELECT round((l_discount - l_tax) * 100)::INTEGER AS d FROM lineitem),
    r AS (SELECT *, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d)
    SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM r WHERE d <> 0
    """,
)
def wilcoxon_pratt(spark, sf):
    d = F.round((F.col("l_discount") - F.col("l_tax")) * 100).cast("int")
    return scoring.wilcoxon(table(spark, sf, "lineitem").select("l_discount", "l_tax"), d, pratt=True).drop("z")


@query(
    "mann_whitney_u",
    """
    WITH t AS (SELECT o_orderpriority AS g, o_orderstatus = 'F' AS x, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O')),
    r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS r FROM t),
    k AS (SELECT g, sum(t * t * t - t) AS ties FROM (SELECT g, v, count(*)::DOUBLE AS t FROM t GROUP BY g, v) GROUP BY g),
    s AS (SELECT g, sum(CASE WHEN x THEN r END) AS r, count(*) FILTER (x) AS n1, count(*) FILTER (NOT x) AS n2 FROM r GROUP BY g)
    SELECT g, n1, n2, r - n1 * (n1 + 1) / 2 AS u,
           round((r - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))), 6) AS z FROM s JOIN k USING (g)
    """,
)
def mann_whitney_u(spark, sf):
    rows = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O")).select(F.col("o_orderpriority").alias("g"), "o_orderstatus", "o_totalprice")
    return scoring.mann_whitney(rows, "o_totalprice", F.col("o_orderstatus") == "F", ["g"]).withColumn("z", F.round("z", 6))


@query(
    "cliffs_delta",
    "SELECT round((count(*) FILTER (a.v > b.v) - count(*) FILTER (a.v < b.v)) / count(*), 9) AS delta FROM (SELECT o_totalprice AS v FROM orders WHERE o_orderstatus = 'F') a, (SELECT o_totalprice AS v FROM orders WHERE o_orderstatus = 'O') b",
)
def cliffs_delta(spark, sf):
    rows = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O")).select("o_orderstatus", "o_totalprice")
    return scoring.cliffs_delta(rows, "o_totalprice", F.col("o_orderstatus") == "F").select(F.round("delta", 9).alias("delta"))


@query(
    "effect_sizes",
    """
    WITH t AS (SELECT n_nationkey::DOUBLE AS k, 2.0 + n_regionkey AS z, 100.0 + n_nationkey AS n FROM nation)
    SELECT k, round(z / sqrt(n), 9) AS dz, round(z / sqrt(n) - 1.959964 * sqrt(1 / n + z * z / n / (2 * n)), 9) AS low, round(z / sqrt(n) + 1.959964 * sqrt(1 / n + z * z / n / (2 * n)), 9) AS high,
           round(1 - 2 * z / (n * n), 9) AS rb, round((75 - 50) / sqrt(100 * 21 / 12.0) / sqrt(20), 9) AS r FROM t
    """,
)
def effect_sizes(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("double").alias("k"), (F.col("n_regionkey") + 2.0).alias("z"), (F.col("n_nationkey") + 100.0).alias("n"))
    dz = scoring.cohens_dz(F.col("z"), F.col("n"))
    ci = scoring.dz_interval(dz, F.col("n"))
    ten = F.lit(10.0)
    return rows.select("k", F.round(dz, 9).alias("dz"), F.round(ci["low"], 9).alias("low"), F.round(ci["high"], 9).alias("high"), F.round(scoring.rank_biserial(F.col("z"), F.col("n"), F.col("n")), 9).alias("rb"), F.round(scoring.r_of_u(F.lit(75.0), ten, ten), 9).alias("r"))


@query(
    "bootstrap_ci",
    """
    WITH r AS (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i, c_acctbal AS x, count(*) OVER () AS n FROM customer),
    g AS (SELECT b, k, (b * 7919 + k * 104729 + (b * k) * 0) % (SELECT max(n) FROM r) AS i FROM (SELECT unnest(range(200)) AS b), (SELECT unnest(range((SELECT max(n) FROM r))) AS k)),
    m AS (SELECT b, avg(x) AS v FROM g JOIN r USING (i) GROUP BY b)
    SELECT round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high FROM m
    """,
)
def bootstrap_ci(spark, sf):
    draws = scoring.bootstrap(table(spark, sf, "customer"), "c_acctbal", 200, (7919, 104729))
    return scoring.percentile_interval(draws).select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query(
    "group_means_pivot",
    """
    SELECT 'value' AS metric, user_id AS question, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view, count(DISTINCT event_id % 10) AS n FROM events GROUP BY user_id
    """,
)
def group_means_pivot(spark, sf):
    rows = table(spark, sf, "events").select(F.lit("value").alias("metric"), F.col("user_id").alias("question"), F.col("event_type").alias("strategy"), F.col("value").alias("score"), (F.col("event_id") % 10).alias("username"))
    out = scoring.question_means(rows, ["click", "view"])
    return out.select("metric", "question", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"), "n")


@query(
    "study_filter_all_ten",
    """
    WITH e AS (SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN 'java' WHEN 1 THEN 'python' ELSE 'other' END AS topic, event_id % 97 + 20 AS secs, 8 + event_id % 3 AS a, 8 + (event_id // 3) % 3 AS b FROM events),
    f AS (SELECT * FROM e WHERE topic <> 'other')
    SELECT user_id AS username, count(*)::INTEGER AS evaluations, sum(secs)::BIGINT AS seconds FROM f GROUP BY user_id
    HAVING sum(secs) >= 360 AND NOT (sum(CASE WHEN a = 10 AND b = 10 THEN 1 ELSE 0 END) >= count(*)) AND user_id % 5 <> 0
    """,
)
def study_filter_all_ten(spark, sf):
    k = F.col("event_id")
    dictionary = F.create_map(F.lit("Relevance"), F.create_map(F.lit("RAG"), (8 + k % 3).cast("int"), F.lit("GenAI"), (8 + F.floor(k / 3) % 3).cast("int")))
    topic = F.when(k % 3 == 0, "java").when(k % 3 == 1, "python").otherwise("other")
    one = F.struct(k.cast("string").alias("question"), topic.alias("topic"), dictionary.alias("evaluation_dict"), (k % 97 + 20).cast("int").alias("elapsed_seconds"))
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("username")).agg(F.collect_list(one).alias("evaluation_list"))
    rows = rows.withColumn("qualitative_feedback", F.when(F.col("username") % 5 == 0, F.lit(None)).when(F.col("username") % 7 == 0, "").otherwise("fine"))
    kept = scoring.study_rows(rows, ["java", "python"])
    return kept.select("username", F.size("evaluation_list").alias("evaluations"), F.aggregate("evaluation_list", F.lit(0).cast("long"), lambda s, e: s + e["elapsed_seconds"]).alias("seconds"))
