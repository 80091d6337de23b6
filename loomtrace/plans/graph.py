"""Queries over triples and graphs made of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import vocabulary as V
from loomtrace.operators import graph as G
from loomtrace.operators import triples as R
from loomtrace.plans.catalogue import query, table, uid_sql

_TAXONOMY = """
    tax AS (SELECT 'n' || n_nationkey AS s, 'rdfs:subClassOf' AS p, 'r' || n_regionkey AS o FROM nation
      UNION ALL SELECT 'c' || c_custkey, 'rdfs:subClassOf', 'n' || c_nationkey FROM customer
      UNION ALL SELECT 's' || s_suppkey, 'rdfs:subClassOf', 'n' || s_nationkey FROM supplier)
"""
_SMALL = """
    small AS (SELECT DISTINCT c_custkey AS s, c_nationkey::BIGINT AS o FROM customer WHERE c_custkey <> c_nationkey)
"""


def taxonomy(spark, sf):
    """Customers and suppliers below nations below regions."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    rows = [("nation", "n", "n_nationkey", "r", "n_regionkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey")]
    out = None
    for t, a, x, b, y in rows:
        part = table(spark, sf, t).select(name(a, x).alias("s"), F.lit(V.SUBCLASS).alias("p"), name(b, y).alias("o"))
        out = part if out is None else out.unionByName(part)
    return out


def small_graph(spark, sf):
    """Numbers that point to numbers: each customer's key to its nation's."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("s"), F.col("c_nationkey").cast("long").alias("o"))
    return rows.where("s <> o").distinct().select("s", F.lit("to").alias("p"), "o")


@query("triples_from_tables", f"WITH {_TAXONOMY} SELECT DISTINCT s, p, o FROM tax")
def triples_from_tables(spark, sf):
    return taxonomy(spark, sf).distinct()


@query(
    "predicate_dictionary",
    f"WITH {_TAXONOMY} SELECT o AS s, list_sort(list(s)) AS values FROM tax WHERE s LIKE 's%' OR s LIKE 'n%' GROUP BY o",
)
def predicate_dictionary(spark, sf):
    edges = taxonomy(spark, sf).where("s like 's%' or s like 'n%'")
    return G.predicate_dictionary(G.reverse(edges), V.SUBCLASS)


@query(
    "edge_dictionary",
    "SELECT s_nationkey AS s, string_agg(k, ',' ORDER BY k) AS edges FROM (SELECT s_nationkey, 'has' || s_suppkey AS k FROM supplier) GROUP BY s_nationkey",
)
def edge_dictionary(spark, sf):
    edges = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("s"), F.lit("has").alias("p"), F.col("s_suppkey").cast("string").alias("o"))
    return G.edge_dictionary(edges).select("s", F.array_join(F.transform("edges", lambda e: F.concat(e["p"], e["o"])), ",").alias("edges"))


@query("roots_leaves", f"WITH {_TAXONOMY} SELECT DISTINCT 'root' AS kind, s AS node FROM tax WHERE s NOT IN (SELECT o FROM tax) UNION ALL SELECT DISTINCT 'leaf', o FROM tax WHERE o NOT IN (SELECT s FROM tax)")
def roots_leaves(spark, sf):
    edges = taxonomy(spark, sf)
    return G.roots(edges).select(F.lit("root").alias("kind"), "node").unionByName(G.leaves(edges).select(F.lit("leaf").alias("kind"), "node"))


@query(
    "remove_leaves",
    f"WITH {_TAXONOMY} SELECT DISTINCT s, p, o FROM tax WHERE NOT (o NOT IN (SELECT s FROM tax))",
)
def remove_leaves(spark, sf):
    return G.without_leaves(taxonomy(spark, sf)).distinct()


@query(
    "reachability",
    f"""
    WITH RECURSIVE {_TAXONOMY},
    up(node, depth) AS (SELECT 'c5', 0 UNION ALL SELECT t.o, u.depth + 1 FROM up u JOIN tax t ON t.s = u.node WHERE u.depth < 5),
    down(node, depth) AS (SELECT 'r2', 0 UNION ALL SELECT t.s, d.depth + 1 FROM down d JOIN tax t ON t.o = d.node WHERE d.depth < 2)
    SELECT 'up' AS way, node, min(depth)::INTEGER AS depth FROM up GROUP BY node UNION ALL SELECT 'down', node, min(depth)::INTEGER FROM down GROUP BY node
    """,
)
def reachability(spark, sf):
    edges = taxonomy(spark, sf)
    start = lambda n: spark.createDataFrame([(n,)], "node string")
    up = G.super_classes(edges, start("c5")).select(F.lit("up").alias("way"), "node", "depth")
    return up.unionByName(G.sub_classes(edges, start("r2"), 2).select(F.lit("down").alias("way"), "node", "depth"))


@query(
    "connected_components",
    """
    WITH RECURSIVE e AS (SELECT DISTINCT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders),
    b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(node, seen) AS (SELECT a, a FROM b UNION SELECT r.node, b.b FROM r JOIN b ON b.a = r.seen)
    SELECT node, min(seen) AS component FROM r GROUP BY node
    """,
)
def connected_components(spark, sf):
    rows = table(spark, sf, "orders")
    return G.connected_components(rows.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("a"), F.concat(F.lit("c"), F.col("o_custkey")).alias("b")))


@query(
    "component_sizes",
    """
    WITH RECURSIVE e AS (SELECT DISTINCT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders),
    b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(node, seen) AS (SELECT a, a FROM b UNION SELECT r.node, b.b FROM r JOIN b ON b.a = r.seen),
    c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
    SELECT component, count(*) AS size FROM e JOIN c ON e.a = c.node GROUP BY component
    """,
)
def component_sizes(spark, sf):
    rows = table(spark, sf, "orders")
    edges = rows.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("s"), F.lit("of").alias("p"), F.concat(F.lit("c"), F.col("o_custkey")).alias("o")).distinct()
    return G.component_edges(edges).select("component", "size").distinct()


@query(
    "scc",
    f"""
    WITH RECURSIVE {_SMALL}, n AS (SELECT s AS node FROM small UNION SELECT o FROM small),
    r(a, b) AS (SELECT node, node FROM n UNION SELECT r.a, small.o FROM r JOIN small ON small.s = r.b)
    SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a
    """,
)
def scc(spark, sf):
    return G.strongly_connected(small_graph(spark, sf))


@query(
    "paths_to_target",
    f"""
    WITH RECURSIVE {_SMALL},
    f(node) AS (SELECT 5::BIGINT UNION SELECT small.o FROM f JOIN small ON small.s = f.node),
    b(node) AS (SELECT 2::BIGINT UNION SELECT small.s FROM b JOIN small ON small.o = b.node)
    SELECT s, 'to' AS p, o FROM small WHERE s IN (SELECT node FROM f) AND o IN (SELECT node FROM b)
    """,
)
def paths_to_target(spark, sf):
    one = lambda n: spark.createDataFrame([(n,)], "node long")
    return G.on_paths(small_graph(spark, sf), one(5), one(2))


@query(
    "rooted_edges",
    f"""
    WITH RECURSIVE {_SMALL}, f(node) AS (SELECT 5::BIGINT UNION SELECT small.o FROM f JOIN small ON small.s = f.node)
    SELECT s, 'to' AS p, o FROM small WHERE s IN (SELECT node FROM f)
    """,
)
def rooted_edges(spark, sf):
    return G.rooted(small_graph(spark, sf), spark.createDataFrame([(5,)], "node long"))


@query("betweenness")
def betweenness(spark, sf):
    return G.betweenness(small_graph(spark, sf)).select("node", F.round("score", 9).alias("score"))


@query(
    "provenance_chain",
    """
    SELECT DISTINCT 'part' || l_partkey AS node, 'o' || l_orderkey AS span, 'c' || o_custkey AS sentence, 'n' || c_nationkey AS paragraph, n_name AS content
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    """,
)
def provenance_chain(spark, sf):
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    part = lambda t, s, p, o: table(spark, sf, t).select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    edges = part("lineitem", name("part", "l_partkey"), V.SPAN, name("o", "l_orderkey")).union(part("orders", name("o", "o_orderkey"), V.SENTENCE, name("c", "o_custkey")))
    edges = edges.union(part("customer", name("c", "c_custkey"), V.PARAGRAPH, name("n", "c_nationkey"))).union(part("nation", name("n", "n_nationkey"), V.CONTENT, F.col("n_name")))
    nodes = table(spark, sf, "part").select(name("part", "p_partkey").alias("node"))
    return R.provenance(edges, nodes)


@query(
    "edge_builder",
    """
    WITH t AS (SELECT n_name AS subj, r_name AS obj FROM nation JOIN region ON r_regionkey = n_regionkey),
    u AS (SELECT *, 'my:' || regexp_replace(replace(trim(lower(subj)), ' ', '_'), '\\s', '', 'g') AS s, 'my:' || regexp_replace(replace(trim(lower(obj)), ' ', '_'), '\\s', '', 'g') AS o, subj || ' is in ' || obj AS sent FROM t),
    k AS (SELECT *, '_:' || UID1 AS span, '_:' || UID2 AS sid, '_:' || UID3 AS pid FROM u),
    e AS (SELECT unnest([{'s': s, 'p': '{subj} is in {obj}', 'o': o}, {'s': s, 'p': 'rdfs:label', 'o': subj}, {'s': o, 'p': 'rdfs:label', 'o': obj}, {'s': s, 'p': 'my:spanID', 'o': span},
      {'s': o, 'p': 'my:spanID', 'o': span}, {'s': '{subj} is in {obj}', 'p': 'my:spanID', 'o': span}, {'s': s || chr(1) || '{subj} is in {obj}' || chr(1) || o, 'p': 'my:spanID', 'o': span},
      {'s': span, 'p': 'rdfs:label', 'o': 'is in'}, {'s': span, 'p': 'my:sentID', 'o': sid}, {'s': sid, 'p': 'my:sentLabel', 'o': sent}, {'s': sid, 'p': 'my:paraID', 'o': pid},
      {'s': pid, 'p': 'my:content', 'o': 'All nations.'}, {'s': pid, 'p': 'my:docID', 'o': 'atlas'}, {'s': pid, 'p': 'my:language_id', 'o': 'en'}, {'s': '{subj} is in {obj}', 'p': 'my:verb', 'o': 'be'}]) AS e FROM k)
    SELECT DISTINCT e.s AS s, e.p AS p, e.o AS o FROM e
    """.replace("UID1", uid_sql("subj || ' is in ' || obj || ' ' || sent")).replace("UID2", uid_sql("sent")).replace("UID3", uid_sql("'All nations.'")),
)
def edge_builder(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    lit = lambda v, n: F.lit(v).alias(n)
    triplets = rows.select(
        F.col("n_name").alias("subj"), F.col("n_name").alias("subj_lemma"), lit("{subj} is in {obj}", "pred"), lit("is in", "pred_text"), lit("be", "verb"), F.col("r_name").alias("obj"), F.col("r_name").alias("obj_lemma"),
        F.concat_ws(" is in ", "n_name", "r_name").alias("sentence"), lit("All nations.", "paragraph"), lit("atlas", "doc"), lit("en", "language"),
    )
    return R.edge_list(triplets)


@query(
    "subclass_by_substring",
    """
    WITH c AS (SELECT DISTINCT p_name AS lemma, p_type AS g FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2), p_type FROM part)
    SELECT DISTINCT 'my:' || replace(a.lemma, ' ', '_') AS s, 'rdfs:subClassOf' AS p, 'my:' || replace(b.lemma, ' ', '_') AS o
    FROM c a JOIN c b ON a.g = b.g AND contains(a.lemma, b.lemma) AND a.lemma <> b.lemma
    """,
)
def subclass_by_substring(spark, sf):
    rows = table(spark, sf, "part")
    both = rows.select(F.col("p_name").alias("lemma"), F.col("p_type").alias("group")).union(rows.select(F.split_part("p_name", F.lit(" "), F.lit(2)), "p_type")).distinct()
    return R.subclass_edges(both.withColumn("id", F.col("lemma")))


@query(
    "label_shortest",
    "SELECT p_brand AS node, arg_min(p_name, {'n': length(p_name), 'p': p_name}) AS label FROM part GROUP BY p_brand",
)
def label_shortest(spark, sf):
    rows = table(spark, sf, "part")
    edges = rows.select(F.col("p_brand").alias("s"), F.lit(V.LABEL).alias("p"), F.col("p_name").alias("o"))
    return R.labels(edges, rows.select(F.col("p_brand").alias("node")).distinct())


@query(
    "taxonomical_view",
    f"""
    WITH {_TAXONOMY}, near AS (SELECT 'n3' AS node UNION SELECT o FROM tax WHERE s = 'n3' UNION SELECT s FROM tax WHERE o = 'n3')
    SELECT DISTINCT s, p, o FROM tax WHERE s IN (SELECT node FROM near) OR o IN (SELECT node FROM near)
    """,
)
def taxonomical_view(spark, sf):
    return G.taxonomical_view(taxonomy(spark, sf), spark.createDataFrame([("n3",)], "node string"))


@query(
    "sourced_clauses",
    """
    WITH t AS (SELECT n_name || ' is in ' || r_name AS sent, n_name FROM nation JOIN region ON r_regionkey = n_regionkey)
    SELECT DISTINCT 'is in' AS text, sent AS context FROM t WHERE length(sent) BETWEEN 5 AND 30 UNION SELECT 'is in', 'All nations.'
    """,
)
def sourced_clauses(spark, sf):
    return R.sourced_clauses(edge_builder(spark, sf), 5, 30).select("text", "context")


@query(
    "language_of_nodes",
    r"SELECT 'my:' || regexp_replace(replace(trim(lower(n_name)), ' ', '_'), '\s', '', 'g') AS node, 'en' AS language FROM nation UNION ALL SELECT 'my:none', NULL",
)
def language_of_nodes(spark, sf):
    nodes = table(spark, sf, "nation").select(F.concat(F.lit("my:"), F.regexp_replace(F.replace(F.trim(F.lower("n_name")), F.lit(" "), F.lit("_")), r"\s", "")).alias("node"))
    return R.language_of(edge_builder(spark, sf), nodes.union(spark.createDataFrame([("my:none",)], "node string")))


@query("prefix_names", "SELECT DISTINCT 'wn:' || p_type AS short, 'http://wordnet-rdf.princeton.edu/' || p_type AS long FROM part")
def prefix_names(spark, sf):
    long = R.expand_prefix(F.concat(F.lit("wn:"), F.col("p_type")))
    return table(spark, sf, "part").select("p_type").distinct().select(R.contract_prefix(long).alias("short"), long.alias("long"))


@query(
    "graph_counts",
    f"WITH {_TAXONOMY} SELECT count(DISTINCT (s, p, o)) AS edges, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects, count(*) FILTER (contains(p, '{{obj}}')) AS clauses FROM tax",
)
def graph_counts(spark, sf):
    return taxonomy(spark, sf).agg(F.countDistinct("s", "p", "o").alias("edges"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"), F.count_if(F.col("p").contains("{obj}")).alias("clauses"))
