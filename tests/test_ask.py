"""Questions to chunks whose vectors are made of their texts: the same answers, without moving the texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.operators import planner, vectors
from loomtrace.operators.ordered import token_windows
from loomtrace.providers import embed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_windows_are_worked_out_once(spark):
    # Before, a text was split anew for each of its windows.
    df = spark.createDataFrame([("a b c d e f g",)], "text string").select(F.explode(token_windows(F.split("text", " ", -1), 4, 2)).alias("w"))
    assert [" ".join(r.w) for r in df.collect()] == ["a b c d", "c d e f", "e f g", "g"]
    assert next(x for x in plan(df).splitlines() if "Generate explode" in x).count("split(") == 1
    empty = spark.createDataFrame([(None,)], "t array<string>").select(token_windows(F.col("t")).alias("a"), token_windows(F.array().cast("array<string>")).alias("b")).first()
    assert (empty.a, empty.b) == (None, None)


@pytest.mark.parametrize("block", [4096, 3])
def test_best_texts_as_all_with_all_give_them(spark, monkeypatch, block):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("red green blue cat dog sat ran".split()) for _ in range(n))
    # Few texts stand under many names, and many have the same words and so the same score.
    texts = [text(rng.randint(1, 4)) for _ in range(60)] + ["", ". ."]
    rows = [(f"d{i:04}", texts[rng.randrange(len(texts))], str(i % 9)) for i in rng.sample(range(5000), 900)]
    asked = [(i, f"{text(3)} {i}") for i in range(8)]
    chunks = spark.createDataFrame(rows, "doc_id string, text string, page_id string").repartition(7)
    questions = spark.createDataFrame(asked, "query_id long, question string").withColumn("q", embed(F.col("question")))
    first = {t: min(r for r in rows if r[1] == t) for t in {r[1] for r in rows}}
    v = {r.text: np.array(r.v) for r in spark.createDataFrame([(t,) for t in first], "text string").withColumn("v", embed(F.col("text"))).collect()}
    want = set()
    for r in questions.collect():
        scored = sorted((-round(float(np.dot(r.q, v[t])), 6), d, t, p) for t, (d, _, p) in first.items() if v[t].any() and np.dot(r.q, v[t]) >= 0.2)
        want |= {(r.question, k + 1, t, p, -s) for k, (s, d, t, p) in enumerate(scored[:5])}
    monkeypatch.setattr(vectors, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = planner.ask(questions, chunks, 0.2, 5, embed=embed)
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 30
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    if block > 8:
        # Before, all texts and vectors were dealt by text, and the texts once more by doc_id.
        assert not any("hashpartitioning(text" in x or "hashpartitioning(doc_id" in x for x in plan(got).splitlines())
    assert planner.ask(questions, chunks.limit(0), embed=embed).count() == 0 == planner.ask(questions.limit(0), chunks, embed=embed).count()


def test_plan_with_vectors_made_of_texts(spark):
    rows = [(f"d{i}", t, "1") for i, t in enumerate(["a cat sat", "cat sat", "the dog ran", "a red cat sat", "cat sat"])]
    chunks = spark.createDataFrame(rows, "doc_id string, text string, page_id string")
    items = spark.createDataFrame([(0, 0, "cat", 0), (0, 1, "red cat", 1), (0, 2, "dog ran", 2)], "topic long, query_id long, question string, q_ord long").withColumn("q", embed(F.col("question")))
    for n in (0, 1):
        run = lambda c, **how: sorted(map(tuple, planner.macroplan(items.where("query_id = 0"), items.where("query_id > 0"), c, n, 0.3, **how).select("topic", "question", "rank", "sentence", "confidence").collect()))
        got = run(chunks, embed=embed)
        assert got == run(chunks.withColumn("v", embed(F.col("text")))) and got
