"""Forms for many rows give what plain comparisons of all with all give, and plan no nested loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.operators import graph, planner, vectors
from loomtrace.plans import all_queries, catalogue  # noqa: F401  (the first registers the queries)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["levenshtein_similar", "containment_antijoin", "longest_container", "merge_contained_answers"])
def test_no_nested_loops(spark, name):
    text = plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("inner_product", [False, True])
def test_dealt_queries_find_what_sent_ones_find(spark, monkeypatch, inner_product):
    rng = np.random.default_rng(1)
    vector = lambda: [float(x) for x in rng.integers(-3, 4, 6)]
    queries = spark.createDataFrame([(i, vector()) for i in range(40)], "query_id long, q array<double>")
    docs = spark.createDataFrame([(i, vector()) for i in range(150)], "doc_id long, v array<double>")
    find = lambda: sorted(tuple(r) for r in vectors.top_k(queries, docs, 4, 0.1, inner_product, 6).collect())
    sent = find()
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "ROWS", 3)
    assert find() == sent and len(sent) > 100
    assert vectors.top_k(queries, docs.limit(0), 4).count() == 0


def test_similar_labels_same_as_all_pairs(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(250)} | {"", "a", "ab", "abcdefghijklmnopqrst", "abcdefghijklmnXpqrst", "bcdefghijklmnopqrst"}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    for threshold in (0.3, 0.2):
        want = {(a, b) for a in words for b in words if a < b and edits(a, b) / max(len(a), len(b)) < threshold}
        got = planner.similar_labels(spark.createDataFrame([(w,) for w in words], "label string"), threshold)
        assert {(r.a, r.b) for r in got.collect()} == want and want


@pytest.mark.parametrize("group", [[], ["g"]])
def test_containers_same_as_all_pairs(spark, group):
    rng = random.Random(9)
    text = lambda n: rng.choice(["", " ", "\t"]) + rng.choice([" ", "  "]).join("".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(text(rng.choice([0, 1, 1, 2, 2, 3, 5, 9])), rng.randint(0, 1)) for _ in range(150)] + [(None, 0), ("", 0), (" ", 1)]
    got = planner.containers(spark.createDataFrame(rows, "text string, g int"), "text", group)
    distinct = {(t, g if group else 0) for t, g in rows if t is not None}
    want = {(g, a, b) for a, g in distinct for b, h in distinct if g == h and a != b and a in b}
    assert {(r["g"] if group else 0, r.inner, r.outer) for r in got.collect()} == want


def test_betweenness_same_as_counting_shortest_paths(spark):
    rng = random.Random(2)
    edges = sorted({(f"n{rng.randint(0, 14)}", f"n{rng.randint(0, 14)}") for _ in range(34)})
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.score for r in graph.betweenness(spark.createDataFrame([(a, "p", b) for a, b in edges], "s string, p string, o string")).collect()}
    nodes = sorted({x for e in edges for x in e})
    out = {n: {b for a, b in edges if a == n} for n in nodes}

    def paths(a, b):
        layer, seen = [[a]], {a}
        while layer:
            done = [p for p in layer if p[-1] == b]
            if done:
                return done
            seen |= {p[-1] for p in layer}
            layer = [p + [x] for p in layer for x in out[p[-1]] if x not in seen]
        return []

    raw = dict.fromkeys(nodes, 0.0)
    for a in nodes:
        for b in nodes:
            if a != b and (found := paths(a, b)):
                for p in found:
                    for x in p[1:-1]:
                        raw[x] += 1 / len(found)
    top = next(n for n in nodes if raw[n] > 0)
    scale = got[top] / raw[top]
    assert all(abs(got[n] - raw[n] * scale) < 1e-9 for n in nodes)


def test_greedy_removal_makes_no_pairs(spark, monkeypatch):
    # Before, all near pairs became rows, and were joined anew in each round.
    rng = np.random.default_rng(3)
    rows = [(f"k{i}", int(rng.integers(0, 9)), [float(x) for x in v]) for i, v in enumerate(rng.integers(-3, 4, (300, 5)))] + [(f"z{i}", 4, [0.0] * 5) for i in range(3)]
    rows += [(f"c{i}", 3, [1.0, 2.0, 3.0, 1.0, 0.0]) for i in range(40)]
    items = spark.createDataFrame(rows, "id string, n int, v array<double>")
    monkeypatch.setattr(vectors, "pairs_above", None)
    for order in (("id",), ("n", "id"), ("n",)):
        kept = []
        for r in sorted(rows, key=lambda r: (r[1], r[0]) if "n" in order else r[0]):
            cos = lambda a, b: round(float(np.dot(a, b) / ((np.linalg.norm(a) * np.linalg.norm(b)) or 1)), 6)
            if all(cos(r[2], k[2]) < 0.6 for k in kept):
                kept.append(r)
        for block in (60, 4096):
            monkeypatch.setattr(vectors, "BLOCK", block)
            assert sorted(r.id for r in vectors.greedy_distinct(items, 0.6, order, digits=6).collect()) == sorted(k[0] for k in kept)
    assert vectors.greedy_distinct(items.limit(0), 0.6).count() == 0


def test_provenance_in_parts(spark, monkeypatch):
    from loomtrace.functions import vocabulary as V
    from loomtrace.operators import triples

    rng = random.Random(6)
    steps = [(V.SPAN, "n", "s"), (V.SENTENCE, "s", "t"), (V.PARAGRAPH, "t", "p"), (V.CONTENT, "p", "c")]
    rows = [(f"{a}{rng.randint(0, 5)}", p, f"{b}{rng.randint(0, 5)}") for p, a, b in steps for _ in range(14)] + [("n1", "other", "s1")]
    edges, nodes = spark.createDataFrame(rows, "s string, p string, o string"), spark.createDataFrame([(f"n{i % 4}",) for i in range(8)], "node string")
    want = {(f"n{i}",) for i in range(4)}
    for p, _, _ in steps:
        want = {(*w, o) for w in want for s, q, o in rows if q == p and s == w[-1]}
    monkeypatch.setattr(triples, "PART_ROWS", 3)
    got = triples.provenance(edges, nodes)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50
    # Before, all five columns were hashed at the end, in as many parts as any other table has.
    text = plan(got)
    assert "REPARTITION_BY_NUM" in text
    assert all("content" not in line for line in text.splitlines() if "HashAggregate" in line and "span" in line)
