import hashlib
"""Semantics pinned down by worked examples."""

import math

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import text as T
from loomtrace.operators import graph as G
from loomtrace.operators import linguistic as L
from loomtrace.operators import ordered as O
from loomtrace.operators import planner as P
from loomtrace.operators import scoring as S
from loomtrace.operators import triples as R
from loomtrace.operators import vectors as V


def one(spark, expr, **cols):
    cols = cols or {"x": 1}
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if None not in cols.values() else spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("r")).first().r


def test_token_windows(spark):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i)
    assert [(w[0], w[-1] + 1) for w in one(spark, O.token_windows(tokens, 4, 2))] == [(0, 4), (2, 6), (4, 8), (6, 10), (8, 10)]
    long = F.sequence(F.lit(0), F.lit(199))
    assert [(w[0], w[-1] + 1) for w in one(spark, O.token_windows(long))] == [(0, 150), (75, 200), (150, 200)]
    with pytest.raises(ValueError):
        O.token_windows(long, 5, 5)


def test_page_range(spark):
    assert one(spark, O.page_range(F.lit(7), F.lit(8))) == "7 - 8" and one(spark, O.page_range(F.lit(7), F.lit(7))) == "7"


def test_containment(spark):
    df = spark.createDataFrame([("a cat", 0.9), ("a cat sat", 0.5), ("dog", 0.7), ("x", 0.1), ("y x y", 0.2)], "text string, c double")
    assert sorted(map(tuple, P.not_contained(df).collect())) == [("a cat sat", 0.5), ("dog", 0.7), ("y x y", 0.2)]


def test_containment_inside_words(spark):
    """The first and the last word of the inner text may be pieces of longer words."""
    texts = ["og jumps ov", "the dog jumps over", "jumps", "og jumps", "ps o"]
    got = {(r.inner, r.outer) for r in P.containers(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {(a, b) for a in texts for b in texts if a != b and a in b}


def test_longest_container_and_best_question(spark):
    rows = [("Q1", 0, 0, "cat sat"), ("Q1", 0, 1, "dog"), ("Q2", 1, 0, "a cat sat"), ("Q2", 1, 1, "dog ran")]
    got = P.merge_contained(spark.createDataFrame(rows, "question string, q_ord int, rank int, sentence string"))
    assert sorted((r.question, r.sentence) for r in got.collect()) == [("Q1", "a cat sat"), ("Q1", "dog ran"), ("Q2", "a cat sat"), ("Q2", "dog ran")]
    rows = [("Q1", 0, "A", 0.8), ("Q1", 0, "B", 0.6), ("Q2", 1, "A", 0.9), ("Q2", 1, "B", 0.6)]
    got = P.best_question(spark.createDataFrame(rows, "question string, q_ord int, sentence string, confidence double"))
    assert sorted((r.question, r.sentence) for r in got.collect()) == [("Q1", "B"), ("Q2", "A")]


def test_top_questions_and_budget(spark):
    rows = [("Q1", 0, 0, 0.6), ("Q1", 0, 1, 0.95), ("Q3", 2, 0, 0.9)]
    got = P.top_questions(spark.createDataFrame(rows, "question string, q_ord int, rank int, confidence double"), 1)
    assert [r.question for r in got.collect()] == ["Q3"]
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 4, 9, 1])], "g int, i int, cost int")
    assert [r.i for r in O.budget_prefix(rows, ["g"], [F.col("i")], "cost", F.lit(10), F.lit(20)).orderBy("i").collect()] == [0, 1]


def test_greedy(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long").withColumn("v", F.array(F.lit(1.0)))
    pairs = spark.createDataFrame([(1, 2, 0.98), (2, 3, 0.98)], "a long, b long, similarity double")
    assert sorted(r.id for r in V.greedy_distinct(items, 0.97, pairs=pairs).collect()) == [1, 3]


def test_greedy_against_a_plain_scan(spark):
    import random

    rng = random.Random(8)
    vectors = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(80)]
    kept = []
    for i, v in enumerate(vectors):
        cos = lambda w, v=v: sum(a * b for a, b in zip(v, w)) / math.hypot(*v) / math.hypot(*w)
        if all(cos(vectors[k]) < 0.8 for k in kept):
            kept.append(i)
    items = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>")
    assert sorted(r.id for r in V.greedy_distinct(items, 0.8).collect()) == kept


def test_blocked_pairs_and_blocked_queries(spark, monkeypatch):
    import random

    rng = random.Random(1)
    items = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)], "id long, v array<double>")
    want = sorted((r.a, r.b) for r in V.pairs_above(items, 0.6, blocks=1).collect())
    assert want and sorted((r.a, r.b) for r in V.pairs_above(items, 0.6, blocks=5).collect()) == want
    q, d = items.select(F.col("id").alias("query_id"), F.col("v").alias("q")), items.select(F.col("id").alias("doc_id"), "v")
    whole = sorted(map(tuple, V.top_k(q, d, 3, digits=6).collect()))
    monkeypatch.setattr(V, "BLOCK", 16)
    assert sorted(map(tuple, V.top_k(q, d, 3, digits=6).collect())) == whole


def test_keep_last_first_and_mid_ranks(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("a", 3, 2)], "k string, v int, ord int")
    assert sorted((r.k, r.v) for r in O.last_seen(rows.withColumn("at", F.col("ord")), ["k"], "at").collect()) == [("a", 3), ("b", 2)]
    assert sorted((r.k, r.v) for r in O.first_seen(rows, ["k"], [F.col("ord")]).collect()) == [("a", 1), ("b", 2)]
    ranks = O.mid_ranks(spark.createDataFrame([(1,), (1,), (2,)], "v int"), "v")
    assert sorted(r["rank"] for r in ranks.collect()) == [1.5, 1.5, 3.0]


@pytest.mark.parametrize("word,kept", [("whole", False), ("class", True), ("However", False), ("what", False)])
def test_wh(spark, word, kept):
    assert one(spark, T.is_not_wh_word(F.lit(word))) is kept or word == "However" and one(spark, T.is_not_wh_word(F.lit(word), True))


def base36(digest):
    n, out = int(digest, 16), ""
    while n:
        n, k = divmod(n, 36)
        out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[k] + out
    return out


def test_digests_addresses_and_names(spark):
    s = lambda e: one(spark, e)
    for text in ("", "a", "ß é", "x" * 1000, *map(str, range(40))):
        assert s(T.uid(F.lit(text))) == base36(hashlib.md5(text.encode()).hexdigest())
    assert s(T.uri_of(F.lit(" Größe Ærø “Łódź” "))) == 'grosse_aero_"lodz"'
    assert [s(T.is_url(F.lit(x))) for x in ("http://a", "./b", "../c", "//d", "mailto:e", "f/g", "")] == [True] * 5 + [False] * 2
    assert [s(T.is_html(F.lit(x))) for x in ("<p>", "a <p>", "<a title='>'>x")] == [True, False, True]
    assert [s(T.explode_key(F.lit(x))) for x in ("a:b:cD", "X A B", "my:is_a", "")] == ["A:b:cD", "X A B", "Is a", ""]
    assert [s(T.language_name(F.lit(x))) for x in ("zh-cn", "zh-tw", "??")] == ["Chinese (Simplified)", "Chinese (Traditional)", ""]


def test_scalars(spark):
    s = lambda e: one(spark, e)
    assert [s(T.is_number(F.lit(x))) for x in ("-3.5", "1e5", "1.", "3a")] == [True, True, False, False]
    assert s(T.clean_content(F.lit("ab-\ncd\nef."))) == "abcd ef."
    assert s(T.uri_of(F.lit("Design Pattern"))) == "design_pattern" and s(T.uri_of(F.lit("x" * 25))) == base36(hashlib.md5(b"x" * 25).hexdigest())
    assert s(T.explode_key(F.lit("my:someURLName"))) == "SomeURL Name" and s(T.explode_key(F.lit("my:someUrlName"))) == "Some Url Name"
    assert s(T.balance_brackets(F.lit("f(x"))) == "f(x)" and s(T.balance_brackets(F.lit('say "hi'))) == 'say "hi"'
    assert round(s(T.syntactic_distance(F.lit("kitten"), F.lit("sitting"))), 6) == 0.428571
    assert s(T.labels_are_contained(F.lit("cat"), F.lit("a cat sat"))) is True
    assert tuple(s(T.qa_of_line(F.lit("1. Who is Al? - A hiker.")))) == ("Who is Al?", "A hiker.")
    assert s(T.qa_of_line(F.lit("no question"))) is None
    assert s(T.question_type(F.lit("Despite what did she go?"))) == "edu" and s(T.question_type(F.lit("Who is she?"))) == "amr"
    assert s(T.answer_text(F.lit("t"), F.lit("7 - 8"))) == "t (pp. 7 - 8)" and s(T.answer_text(F.lit("t"), F.lit(None).cast("string"))) == "t "
    assert s(T.count_words(F.lit("a  b"))) == 3
    assert s(T.sentence_pack(F.lit("Aa. Bb. Cc."), 8)) == ["Aa. Bb.", "Cc."]
    assert s(T.ascii_fold(F.lit(" Éa ﬁ "))) == "Ea fi"
    assert s(T.without_brackets(F.lit("see 【4】 this (note)"))) == "see  this"
    assert s(R.expand_prefix(F.lit("wn:cat"))).endswith("/cat") and s(R.contract_prefix(R.expand_prefix(F.lit("wn:cat")))) == "wn:cat"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, "p", b) for a, b in pairs], "s string, p string, o string")


def test_graph(spark):
    ring = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"))
    start = spark.createDataFrame([("a",)], "node string")
    reach = lambda depth: {r.node for r in G.reachable(ring, start, depth).collect()}
    assert reach(1) == {"a", "b"} and reach(None) == {"a", "b", "c"} and reach(0) == {"a"}
    found = G.strongly_connected(edges(spark, ("a", "b"), ("b", "a"), ("b", "c"), ("d", "d")))
    assert {(r.node, r.component) for r in found.collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}
    line = edges(spark, ("a", "b"), ("b", "c"))
    assert [r.node for r in G.roots(line).collect()] == ["a"] and [r.node for r in G.leaves(line).collect()] == ["c"]
    score = {r.node: r.score for r in G.betweenness(line).collect()}
    assert score == {"a": 0.0, "b": 0.5, "c": 0.0}
    assert {r.component for r in G.connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()} == {0}
    sub = R.subclass_edges(spark.createDataFrame([(1, "design pattern", 0), (2, "pattern", 0)], "id int, lemma string, group int"))
    assert [tuple(r) for r in sub.collect()] == [("my:design_pattern", "rdfs:subClassOf", "my:pattern")]


def test_graphml(spark, tmp_path):
    assert G.graphml(edges(spark, ("a<", "b")), str(tmp_path / "g.graphml")) == 1
    assert "a&lt;" in (tmp_path / "g.graphml").read_text()


def test_statistics(spark):
    rows = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 3.0)] + [("y", 2.0)] * 3, "g string, v double")
    assert S.cliffs_delta(rows, "v", F.col("g") == "x").first().delta == 0
    rows = spark.createDataFrame([("x", 3.0), ("x", 3.0), ("y", 1.0), ("y", 2.0)], "g string, v double")
    assert S.cliffs_delta(rows, "v", F.col("g") == "x").first().delta == 1
    dz = S.cohens_dz(F.lit(2.0), F.lit(100.0))
    ci = one(spark, S.dz_interval(dz, F.lit(100.0)))
    assert math.isclose(ci.low, 0.002053, abs_tol=1e-6) and math.isclose(ci.high, 0.397947, abs_tol=1e-6)
    assert one(spark, S.rank_biserial(F.lit(10.0), F.lit(10.0), F.lit(10.0))) == 0.8
    r = S.r_of_u(F.lit(75.0), F.lit(10.0), F.lit(10.0))
    assert math.isclose(one(spark, r), 0.422577, abs_tol=1e-6) and math.isclose(one(spark, S.d_of_r(r)), 0.932505, abs_tol=1e-6)
    scores = spark.createDataFrame([(0.9,), (0.7,), (0.5,)], "score double")
    got = S.adherence(scores).first()
    assert (got.supporting_facts, round(got.fact_score, 6), round(got.fact_score_fuzzy, 6)) == (2, 0.666667, 0.7)
    w, p = S.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert math.isclose(w, 0.79, abs_tol=0.005) and p < 0.01
    assert math.isclose(one(spark, S.normal_cdf(S.normal_quantile(F.lit(0.3)))), 0.3)


def test_study(spark):
    ev = lambda topic, secs, *m: (f"q{secs}", topic, {k: v for k, v in zip("abc", m)}, secs)
    ten, low = {"RAG": 10, "GenAI": 10}, {"RAG": 7, "GenAI": 9}
    rows = [
        ("tens", [ev("java", 400, ten, low, low)], "fine"),
        ("quick", [ev("java", 300, low, low, low), ev("design_patterns", 100, low, low, low)], "fine"),
        ("silent", [ev("java", 400, low, low, low)], None),
        ("good", [ev("java", 400, low, low, low)], "fine"),
    ]
    from loomtrace.sources.readers import STUDY

    got = S.study_rows(spark.createDataFrame(rows, STUDY), ["java", "python"])
    assert [r.username for r in got.collect()] == ["good"]
    assert S.study_ratings(got).count() == 6
    assert S.question_means(S.study_ratings(got), ["RAG", "GenAI"]).first().RAG == 7


def test_linguistic(spark):
    s = L.shallow_parse("The small parser creates a new tree for the user.")[0]
    got = L.sentence_triplets(s)
    assert any(t["subj"] == "small parser" and t["verb"] == "create" and t["obj"].startswith("new tree") and t["pred"] == "{subj} create {obj}" for t in got)
    core = next(t for t in s if t.text == "tree")
    assert [L.span_text(c) for c in L.concepts_of(s, core)][:2] == ["new", "tree"] or "new tree" in [L.span_text(c) for c in L.concepts_of(s, core)]
    rows = spark.createDataFrame([("d", 0, "The parser creates a tree. It reads texts.", "en"), ("e", 0, None, "en")], "doc string, para_idx int, text string, language string")
    triplets = L.extract_triplets(rows)
    graph = R.edge_list(triplets)
    assert graph.where("p = 'my:verb' and o = 'create'").count() == 1
    found = R.provenance(graph, spark.createDataFrame([("my:parser",)], "node string")).collect()
    assert {r.content for r in found} == {"The parser creates a tree. It reads texts."}
    assert R.labels(graph, spark.createDataFrame([("my:tree",), ("my:unknownThing",)], "node string")).where("node = 'my:unknownThing'").first().label == "Unknown Thing"
    valid = L.valid_sentences(spark.createDataFrame([("The parser creates a tree.",), ("A tree.",), ("It creates a tree.",)], "t string"), "t", avoid_coreferences=True)
    assert [r.t for r in valid.collect()] == ["The parser creates a tree."]
    assert L.word_dictionary(L.extract_concepts(rows)).where("concept = 'tree'").first()["count"] == 1
