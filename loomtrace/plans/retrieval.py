"""Queries over vectors, windows of text and ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import ordered, planner, vectors
from loomtrace.plans.catalogue import query, table

_COS = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


def _items(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query(
    "topk_cosine",
    f"""
    SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {_COS.format(a='q.embedding', b='d.embedding')} AS similarity,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS.format(a='q.embedding', b='d.embedding')} DESC, d.vec_id) AS rank
    FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10 AND similarity >= 0
    """,
)
def topk_cosine(spark, sf):
    items = _items(spark, sf)
    queries = items.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return vectors.top_k(queries, items.select(F.col("id").alias("doc_id"), "v"), 10, 0.0, digits=6)


@query(
    "topk_inner_product",
    """
    SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS similarity,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) DESC, d.vec_id) AS rank
    FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0 QUALIFY rank <= 3 AND similarity >= 0.2
    """,
)
def topk_inner_product(spark, sf):
    items = _items(spark, sf)
    queries = items.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return vectors.top_k(queries, items.select(F.col("id").alias("doc_id"), "v"), 3, 0.2, inner_product=True, digits=6)


@query(
    "cosine_threshold_pairs",
    f"SELECT a.vec_id AS a, b.vec_id AS b, {_COS.format(a='a.embedding', b='b.embedding')} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS.format(a='a.embedding', b='b.embedding')} >= 0.5",
)
def cosine_threshold_pairs(spark, sf):
    return vectors.pairs_above(_items(spark, sf), 0.5, digits=6)


@query(
    "elementwise_similarity",
    f"SELECT a.vec_id AS id, coalesce({_COS.format(a='a.embedding', b='b.embedding')}, 0) AS similarity FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def elementwise_similarity(spark, sf):
    items = _items(spark, sf)
    return vectors.pairwise(items, items.select((F.col("id") - 1).alias("id"), "v"), "id").select("id", F.round("similarity", 6).alias("similarity"))


@query(
    "conformity_rank",
    """
    WITH u AS (SELECT vec_id AS id, [x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) FOR x IN embedding::DOUBLE[]] AS v FROM embeddings),
    t AS (SELECT a.id, round(sum(list_dot_product(a.v, b.v)), 4) AS total FROM u a, u b GROUP BY a.id)
    SELECT id, total, row_number() OVER (ORDER BY total DESC, id) AS rank FROM t
    """,
)
def conformity_rank(spark, sf):
    total = vectors.conformity(_items(spark, sf), 4)
    from pyspark.sql import Window

    # Ranks of the whole table: sorted in ranges, and numbered from each range's count.
    ranged = total.repartitionByRange(8, F.desc("total"), "id").sortWithinPartitions(F.desc("total"), "id").withColumn("part", F.spark_partition_id())
    inner = ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("total"), "id")))
    sizes = inner.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(F.broadcast(before), "part").select("id", "total", (F.col("n") + F.col("before")).alias("rank"))


@query("greedy_dedup_labels")  # its SQL takes too long on the whole table; tests compare it with a plain scan
def greedy_dedup_labels(spark, sf):
    items = _items(spark, sf).select("id", "v")
    return vectors.greedy_distinct(items, 0.3, digits=6).select("id")


@query("lsh_similar")
def lsh_similar(spark, sf):
    # At a cosine of 0.5 sign planes meet too few pairs or nearly all of them: the blocked join is exact, and makes no candidate rows.
    return vectors.pairs_above(_items(spark, sf), 0.5, digits=6)


@query(
    "token_windows",
    """
    WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(0, len(w), 75)) AS i FROM t)
    SELECT doc_id, (i // 75)::INTEGER AS chunk_idx, list_aggregate(w[i + 1 : i + 150], 'string_agg', ' ') AS text,
           CASE WHEN i // 300 = least(i + 149, len(w) - 1) // 300 THEN (i // 300 + 1)::VARCHAR
                ELSE (i // 300 + 1)::VARCHAR || ' - ' || (least(i + 149, len(w) - 1) // 300 + 1)::VARCHAR END AS page_id
    FROM s
    """,
)
def token_windows(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.split("text", " ", -1).alias("w"))
    rows = words.select("doc_id", F.size("w").alias("n"), F.posexplode(ordered.token_windows(F.col("w"))).alias("chunk_idx", "part"))
    start = F.col("chunk_idx") * 75
    page = lambda at: (F.floor(at / 300) + 1).cast("int")
    return rows.select("doc_id", "chunk_idx", F.array_join("part", " ").alias("text"), ordered.page_range(page(start), page(F.least(start + 149, F.col("n") - 1))).alias("page_id"))


@query(
    "token_budget_prefix",
    """
    WITH c AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS cost FROM conversations),
    r AS (SELECT conv_id, turn, (10 + sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM c)
    SELECT * FROM r WHERE used <= 150
    """,
)
def token_budget_prefix(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.size(F.split("text", " ", -1)).alias("cost"))
    return ordered.budget_prefix(rows, ["conv_id"], [F.col("turn")], "cost", F.lit(10), F.lit(150)).select("conv_id", "turn", "used")


@query("first_seen_dedup", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def first_seen_dedup(spark, sf):
    return ordered.first_seen(table(spark, sf, "documents"), ["text"], [F.col("doc_id")]).select("doc_id", "source")


@query(
    "last_seen_unique",
    "SELECT user_id, arg_max(event_id, ts) AS event_id, min(ts) AS first_ts FROM events GROUP BY user_id",
)
def last_seen_unique(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return ordered.last_seen(rows.withColumn("at", F.col("ts")), ["user_id"], "at").select("user_id", "event_id", F.col("_first").alias("first_ts"))


@query("casefold_dedup", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY conv_id, turn) = 1")
def casefold_dedup(spark, sf):
    return ordered.first_seen(table(spark, sf, "conversations"), [F.lower("text")], [F.col("conv_id"), F.col("turn")]).select("conv_id", "turn")


@query(
    "slice_per_group",
    "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) BETWEEN 3 AND 6",
)
def slice_per_group(spark, sf):
    return ordered.slice_per_group(table(spark, sf, "part").select("p_brand", "p_partkey"), ["p_brand"], [F.col("p_partkey")], 2, 4)


@query(
    "topk_coerce_then_filter",
    """
    WITH t AS (SELECT o_orderkey, o_totalprice, o_orderstatus, try_cast(left(o_orderpriority, 1) AS INTEGER) AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)
    SELECT o_orderkey, o_totalprice, p FROM t WHERE o_orderstatus <> 'F'
    """,
)
def topk_coerce_then_filter(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.expr("try_cast(left(o_orderpriority, 1) AS int)").alias("p"))
    return ordered.top_then_filter(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 50, F.col("o_orderstatus") != "F").drop("o_orderstatus")


@query(
    "running_heading",
    """
    WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'view' THEN event_id END AS h,
                      sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS part FROM events)
    SELECT user_id, event_id, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id, part ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS heading FROM e
    """,
)
def running_heading(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "view", F.col("event_id")).alias("h"))
    return ordered.running_heading(rows, ["user_id"], [F.col("event_id")], "h", F.col("event_type") == "error", "heading").select("user_id", "event_id", "heading")


@query(
    "page_glue",
    """
    WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    g AS (SELECT doc_id, (i - 1) // 4 AS page, i AS idx, text FROM p),
    f AS (SELECT *, CASE WHEN lag(page) OVER w IS NULL OR lag(page) OVER w = page THEN 1 ELSE 0 END AS new FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY page, idx)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page, idx ROWS UNBOUNDED PRECEDING) AS run FROM f)
    SELECT doc_id, run::BIGINT AS para_idx, CASE WHEN min(page) = max(page) THEN min(page)::VARCHAR ELSE min(page)::VARCHAR || ' - ' || max(page)::VARCHAR END AS page_id,
           string_agg(text, ' ' ORDER BY page, idx) AS text FROM r GROUP BY doc_id, run
    """,
)
def page_glue(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return ordered.glue_pages(rows.select("doc_id", F.floor(F.col("i") / 4).alias("page"), F.col("i").alias("idx"), "text"), "doc_id", "page", "idx", "text")


@query(
    "ask_questions",
    f"""
    WITH d AS (SELECT vec_id, embedding, 't' || (vec_id % 400) AS text, row_number() OVER (PARTITION BY vec_id % 400 ORDER BY vec_id) AS n FROM embeddings),
    h AS (SELECT q.vec_id AS query_id, d.text AS sentence, d.vec_id AS doc, {_COS.format(a='q.embedding', b='d.embedding')} AS confidence FROM embeddings q, d WHERE d.n = 1 AND q.vec_id % 20 = 0)
    SELECT 'q' || query_id AS question, sentence, confidence, (doc // 10)::VARCHAR AS page_id, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, doc) AS rank
    FROM h QUALIFY rank <= 10 AND confidence >= 0
    """,
)
def ask_questions(spark, sf):
    items = _items(spark, sf)
    questions = items.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.concat(F.lit("q"), F.col("id")).alias("question"), F.col("v").alias("q"))
    chunks = items.select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 400).alias("text"), F.floor(F.col("id") / 10).cast("string").alias("page_id"), "v")
    return planner.ask(questions, chunks)
