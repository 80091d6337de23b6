"""Queries over names, neighbourhoods of a graph, concepts and comparisons of systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import text as T
from loomtrace.functions import vocabulary as V
from loomtrace.operators import graph as G
from loomtrace.operators import ordered, questions, scoring
from loomtrace.operators import triples as R
from loomtrace.plans.catalogue import query, table, uid_sql
from loomtrace.plans.graph import taxonomy


def _tail_sql(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    q = f"exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return f"CASE WHEN {z} >= 0 THEN {q} ELSE 1 - {q} END"


@query("text_digests", f"SELECT p_partkey, {uid_sql('p_name')} AS uid, {uid_sql("p_name || ' ' || p_brand")} AS both_uid FROM part")
def text_digests(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.uid(F.col("p_name")).alias("uid"), T.uid(F.concat_ws(" ", "p_name", "p_brand")).alias("both_uid"))


@query(
    "language_names",
    "SELECT code, count(*) AS n, CASE code WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' WHEN 'zh-cn' THEN 'Chinese (Simplified)' WHEN 'zh-tw' THEN 'Chinese (Traditional)' ELSE '' END AS name FROM (SELECT CASE doc_id % 7 WHEN 0 THEN 'zh-cn' WHEN 1 THEN 'zh-tw' WHEN 2 THEN 'xx' ELSE lang END AS code FROM documents) GROUP BY code",
)
def language_names(spark, sf):
    k = F.col("doc_id") % 7
    code = F.when(k == 0, "zh-cn").when(k == 1, "zh-tw").when(k == 2, "xx").otherwise(F.col("lang"))
    return table(spark, sf, "documents").groupBy(code.alias("code")).agg(F.count("*").alias("n")).withColumn("name", T.language_name(F.col("code")))


@query(
    "address_forms",
    r"""
    WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN './' || page_id WHEN 1 THEN '//host/' || page_id WHEN 2 THEN 'a/b' WHEN 3 THEN ' ../x' ELSE url END AS u, CASE page_id % 2 WHEN 0 THEN html ELSE 'x' || html END AS h FROM pages)
    SELECT page_id, starts_with(trim(u), './') OR starts_with(trim(u), '../') OR starts_with(trim(u), '//') OR regexp_matches(trim(u), '^\w+:') AS is_url, starts_with(h, '<') AS is_html FROM u
    """,
)
def address_forms(spark, sf):
    k = F.col("page_id") % 5
    u = F.when(k == 0, F.concat(F.lit("./"), F.col("page_id"))).when(k == 1, F.concat(F.lit("//host/"), F.col("page_id"))).when(k == 2, "a/b").when(k == 3, " ../x").otherwise(F.col("url"))
    h = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.concat(F.lit("x"), F.col("html")))
    return table(spark, sf, "pages").select("page_id", T.is_url(u).alias("is_url"), T.is_html(h).alias("is_html"))


@query("bracketless_text", r"SELECT conv_id, turn, trim(regexp_replace(text || ' 【4†a】 (x (y) z) end', '【[^】]*】|\([^(]*\)', '', 'g')) AS t FROM conversations WHERE text NOT LIKE '%(%' AND text NOT LIKE '%)%'")
def bracketless_text(spark, sf):
    rows = table(spark, sf, "conversations").where("text not like '%(%' and text not like '%)%'")
    return rows.select("conv_id", "turn", T.without_brackets(F.concat("text", F.lit(" 【4†a】 (x (y) z) end"))).alias("t"))


@query(
    "p_value_texts",
    "SELECT event_id, CASE WHEN p < 0.001 THEN '<0.001' WHEN p > 0.999 THEN '>0.999' ELSE 'p=' || printf('%.3f', p) END AS said FROM (SELECT event_id, (event_id % 1000) / 999.0::DOUBLE AS p FROM events)",
)
def p_value_texts(spark, sf):
    return table(spark, sf, "events").select("event_id", T.p_value_text((F.col("event_id") % 1000) / F.lit(999.0)).alias("said"))


@query("chunk_numbers", "SELECT o_orderpriority AS g, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 100 AS chunk, o_orderkey FROM orders")
def chunk_numbers(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), "o_orderkey")
    return ordered.numbered_chunks(rows, [F.col("o_orderkey")], 100, ["g"]).select("g", "chunk", "o_orderkey")


@query(
    "documents_by_language",
    "SELECT lang, count(*) AS n, min(doc_id) AS first, max(n_chars) AS longest FROM documents GROUP BY lang",
)
def documents_by_language(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("n_chars").alias("longest"))


_LINKS = """
    links AS (SELECT 's' || s_suppkey AS s, CASE WHEN s_suppkey % 2 = 0 THEN '{subj} is in {obj}' ELSE 'my:in' END AS p, 'n' || s_nationkey AS o FROM supplier
      UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '{subj} lies in {obj}' ELSE 'my:in' END, 'r' || n_regionkey FROM nation)
"""


def _links(spark, sf):
    """Suppliers to nations to regions, every other link a clause."""
    rows = [("supplier", "s", "s_suppkey", "n", "s_nationkey", "is"), ("nation", "n", "n_nationkey", "r", "n_regionkey", "lies")]
    out = None
    for t, a, x, b, y, verb in rows:
        p = F.when(F.col(x) % 2 == 0, F.lit("{subj} " + verb + " in {obj}")).otherwise("my:in")
        part = table(spark, sf, t).select(F.concat(F.lit(a), F.col(x)).alias("s"), p.alias("p"), F.concat(F.lit(b), F.col(y)).alias("o"))
        out = part if out is None else out.unionByName(part)
    return out


@query("clauses_of_nodes", f"WITH {_LINKS} SELECT s AS node, s, p, o FROM links WHERE p LIKE '%{{obj}}%' AND s LIKE 'n%' UNION SELECT o, s, p, o FROM links WHERE p LIKE '%{{obj}}%' AND o LIKE 'n%'")
def clauses_of_nodes(spark, sf):
    nodes = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"))
    return R.clauses_of(_links(spark, sf), nodes)


@query(
    "sub_graph",
    f"""
    WITH {_LINKS}, a AS (SELECT DISTINCT s FROM links WHERE s LIKE 's%'),
    near AS (SELECT s FROM a UNION SELECT l.o FROM links l JOIN a USING (s) WHERE l.p NOT LIKE '%{{obj}}%')
    SELECT s, p, o FROM links WHERE s IN (SELECT s FROM near)
    """,
)
def sub_graph(spark, sf):
    start = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"))
    return G.neighbourhood(_links(spark, sf), start, 1)


@query(
    "equivalent_concepts",
    "WITH m AS (SELECT 'c' || c_custkey AS node, c_nationkey AS k FROM customer UNION SELECT 'n' || c_nationkey, c_nationkey FROM customer) SELECT node, min(node) OVER (PARTITION BY k) AS component FROM m",
)
def equivalent_concepts(spark, sf):
    edges = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("s"), F.lit(V.SAME).alias("p"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("o"))
    return G.equivalents(edges)


@query(
    "aspect_graph",
    """
    WITH f AS (SELECT 'r1' AS node UNION SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
      UNION SELECT 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1),
    tax AS (SELECT 'n' || n_nationkey AS s, 'rdfs:subClassOf' AS p, 'r' || n_regionkey AS o FROM nation UNION ALL SELECT 'c' || c_custkey, 'rdfs:subClassOf', 'n' || c_nationkey FROM customer
      UNION ALL SELECT 's' || s_suppkey, 'rdfs:subClassOf', 'n' || s_nationkey FROM supplier)
    SELECT DISTINCT s, p, o FROM tax WHERE s IN (SELECT node FROM f)
    """,
)
def aspect_graph(spark, sf):
    return G.aspect_graph(taxonomy(spark, sf), spark.createDataFrame([("r1",)], "node string"))


@query(
    "shared_span_labels",
    "SELECT min(label) AS label FROM (SELECT 'span ' || s_suppkey % 7 AS label, count(DISTINCT s_suppkey % 3) AS n FROM supplier GROUP BY 1) WHERE n = 3 AND length(label) = (SELECT min(length('span ' || s_suppkey % 7)) FROM supplier)",
)
def shared_span_labels(spark, sf):
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier")
    spans = rows.select(F.concat(F.lit("node"), k % 3).alias("s"), F.lit(V.SPAN).alias("p"), F.concat(F.lit("_:"), k).alias("o"))
    names = rows.select(F.concat(F.lit("_:"), k).alias("s"), F.lit(V.LABEL).alias("p"), F.concat(F.lit("span "), k % 7).alias("o"))
    return R.shared_span_label(spans.unionByName(names), "node0", "node1", "node2")


@query(
    "concept_descriptions",
    "SELECT lower(trim(p_type)) AS label, string_agg(u, ',' ORDER BY u) AS uris FROM (SELECT DISTINCT p_type, 'p' || p_partkey AS u FROM part WHERE p_partkey % 3 <> 0) GROUP BY 1",
)
def concept_descriptions(spark, sf):
    edges = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("s"), F.lit(V.LABEL).alias("p"), F.col("p_type").alias("o"))
    keep = F.substr("uri", F.lit(2)).cast("long") % 3 != 0
    return R.description_dictionary(edges, keep=keep).select("label", F.array_join("uris", ",").alias("uris"))


@query(
    "annotated_texts",
    r"""
    WITH t AS (SELECT doc_id, ' ' || array_to_string(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), ' ') || ' ' AS flat FROM documents),
    l AS (SELECT p_partkey, lower(word) AS name, word FROM (VALUES (1, 'The'), (2, 'of the'), (3, 'der'), (4, 'no such label'), (5, 'LICENSE')) v(p_partkey, word))
    SELECT DISTINCT doc_id, 'u' || p_partkey AS uri, word AS label FROM t JOIN l ON contains(flat, ' ' || name || ' ')
    """,
)
def annotated_texts(spark, sf):
    labels = spark.createDataFrame([("u1", "The"), ("u2", "of the"), ("u3", "der"), ("u4", "no such label"), ("u5", "LICENSE")], "uri string, label string")
    return questions.annotate(table(spark, sf, "documents").where("text is not null").select("doc_id", "text"), labels)


@query(
    "known_questions",
    "SELECT 'q' || c_custkey AS s, 'What is ' || c_name || '?' AS question, c_mktsegment AS answer, CASE WHEN c_custkey % 2 = 0 THEN 'because' END AS explanation FROM customer WHERE c_custkey % 3 <> 0",
)
def known_questions(spark, sf):
    k = F.col("c_custkey")
    rows = F.array(
        F.struct(F.lit("my:question_template").alias("p"), F.concat(F.lit("What is "), F.col("c_name"), F.lit("?")).alias("o")),
        F.struct(F.when(k % 3 != 0, "my:answer_template").otherwise("my:other").alias("p"), F.col("c_mktsegment").alias("o")),
        F.struct(F.when(k % 2 == 0, "my:explanatory_template").otherwise("my:other").alias("p"), F.lit("because").alias("o")),
    )
    return questions.known_questions(table(spark, sf, "customer").select(F.concat(F.lit("q"), k).alias("s"), F.inline(rows)))


@query(
    "statement_texts",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' is in ' || s_nationkey || '.' ELSE s_name || ' lies in ' || s_nationkey END AS said FROM supplier",
)
def statement_texts(spark, sf):
    p = F.when(F.col("s_suppkey") % 2 == 0, "{subj} is  in {obj} .").otherwise("my:LiesIn")
    return table(spark, sf, "supplier").select("s_suppkey", questions.sentence_of(F.col("s_name"), p, F.col("s_nationkey").cast("string")).alias("said"))


@query(
    "experiment_grid",
    "SELECT o_orderkey AS task, o_orderpriority AS title, s.strategy, s.extra FROM orders, (VALUES ('GenAI', 0), ('RAG', 0), ('RAG+CoI', 5)) s(strategy, extra) WHERE NOT (o_orderkey % 4 = 0 AND s.strategy = 'RAG')",
)
def experiment_grid(spark, sf):
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderpriority").alias("title"))
    done = tasks.where("task % 4 = 0").withColumn("strategy", F.lit("RAG"))
    return questions.experiment_grid(tasks, [("GenAI", 0), ("RAG", 0), ("RAG+CoI", 5)], done)


@query(
    "further_questions",
    """
    WITH b AS (SELECT 'What is ' || n_name || '?' AS q, 0 AS k, length(n_name) AS n, n_name AS m FROM nation UNION ALL SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower('What is ' || n_name || '?') ELSE 'Where is ' || n_name || '?' END, 1, n_nationkey, '' FROM nation)
    SELECT q AS question FROM (SELECT *, row_number() OVER (PARTITION BY lower(q) ORDER BY k, n, m) AS r FROM b) WHERE r = 1
    """,
)
def further_questions(spark, sf):
    nation = table(spark, sf, "nation")
    asked = F.when(F.col("n_nationkey") % 2 == 0, F.lower(F.concat(F.lit("What is "), F.col("n_name"), F.lit("?")))).otherwise(F.concat(F.lit("Where is "), F.col("n_name"), F.lit("?")))
    return questions.further_questions(nation.select(F.col("n_name").alias("label")), nation.select(asked.alias("question"), F.col("n_nationkey").alias("rank"))).select("question")


@query(
    "boxplot_rows",
    """
    WITH q AS (SELECT o_orderpriority AS g, o_orderstatus AS tool, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3, count(o_totalprice) AS n FROM orders GROUP BY 1, 2)
    SELECT g, tool, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, n, median = max(median) OVER (PARTITION BY g) AS best FROM q
    """,
)
def boxplot_rows(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderstatus").alias("tool"), "o_totalprice")
    out = questions.boxplot_rows(rows, "o_totalprice", "tool", ["g"])
    return out.select("g", "tool", *(F.round(c, 4).alias(c) for c in ("q1", "median", "q3")), "n", "best")


@query(
    "strategy_pairs",
    f"""
    WITH m AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS click, avg(value) FILTER (event_type = 'view') AS view, avg(value) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id),
    d AS (SELECT 'click' AS first, 'view' AS second, round(click - view, 9) AS d FROM m UNION ALL SELECT 'click', 'purchase', round(click - purchase, 9) FROM m UNION ALL SELECT 'view', 'purchase', round(view - purchase, 9) FROM m),
    r AS (SELECT *, rank() OVER (PARTITION BY first, second ORDER BY abs(d)) + (count(*) OVER (PARTITION BY first, second, abs(d)) - 1) / 2.0 AS r FROM d WHERE d IS NOT NULL),
    w AS (SELECT first, second, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, sqrt(sum(r * r)) / 2 AS sd FROM r WHERE d <> 0 GROUP BY first, second),
    z AS (SELECT *, (w_plus - (w_plus + w_minus) / 2) / sd AS z FROM w)
    SELECT 'value' AS metric, first, second, n, w_plus, w_minus, round(z, 6) AS z, round(1 - ({_tail_sql('z')}), 6) AS p FROM z
    """,
)
def strategy_pairs(spark, sf):
    rows = table(spark, sf, "events").select(F.lit("value").alias("metric"), F.col("user_id").alias("question"), F.col("event_type").alias("strategy"), F.col("value").alias("score"), F.col("user_id").alias("username"))
    out = scoring.strategy_pairs(rows, ["click", "view", "purchase"])
    return out.select("metric", "first", "second", "n", "w_plus", "w_minus", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query(
    "compare_models",
    f"""
    WITH t AS (SELECT o_orderpriority AS g, o_orderstatus = 'F' AS x, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O')),
    r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS r FROM t),
    k AS (SELECT g, sum(t * t * t - t) AS ties FROM (SELECT g, v, count(*)::DOUBLE AS t FROM t GROUP BY g, v) GROUP BY g),
    s AS (SELECT g, sum(CASE WHEN x THEN r END) AS r, count(*) FILTER (x) AS n1, count(*) FILTER (NOT x) AS n2 FROM r GROUP BY g),
    z AS (SELECT g, n1, n2, r - n1 * (n1 + 1) / 2 AS u, (r - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) AS z FROM s JOIN k USING (g))
    SELECT 'price' AS metric, g AS strategy, n1, n2, u, round(z, 6) AS z, round({_tail_sql('z')}, 6) AS p FROM z
    """,
)
def compare_models(spark, sf):
    rows = table(spark, sf, "orders").select(F.lit("price").alias("metric"), F.col("o_orderpriority").alias("strategy"), F.col("o_orderstatus").alias("model"), F.col("o_totalprice").alias("score"))
    out = scoring.compare_models(rows, "model", "F", "O")
    return out.select("metric", "strategy", "n1", "n2", "u", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query(
    "two_sample_bootstrap",
    """
    WITH r AS (SELECT c_acctbal AS x, c_custkey % 2 = 0 AS a, row_number() OVER (PARTITION BY c_custkey % 2 ORDER BY c_acctbal) - 1 AS i, count(*) OVER (PARTITION BY c_custkey % 2) AS n FROM customer),
    d AS (SELECT unnest(range(100)) AS b),
    g AS (SELECT d.b, r.a, r.n, (d.b * CASE WHEN r.a THEN 7919 ELSE 6007 END + r.i * CASE WHEN r.a THEN 104729 ELSE 15013 END) % r.n AS i FROM d, r),
    m AS (SELECT g.b, avg(r.x) FILTER (g.a) AS v0, avg(r.x) FILTER (NOT g.a) AS v1 FROM g JOIN r ON g.a = r.a AND g.i = r.i GROUP BY g.b)
    SELECT round(quantile_cont(v0 - v1, 0.025), 4) AS low, round(quantile_cont(v0 - v1, 0.975), 4) AS high FROM m
    """,
)
def two_sample_bootstrap(spark, sf):
    rows = table(spark, sf, "customer")
    draws = scoring.two_sample_bootstrap(rows, "c_acctbal", F.col("c_custkey") % 2 == 0, 100, lambda a, b: a - b, ((7919, 104729), (6007, 15013)))
    return scoring.percentile_interval(draws).select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))
