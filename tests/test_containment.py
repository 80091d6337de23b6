"""Longest containers against comparing all texts, with tables of any fill, and what is moved for them."""

import random

import pytest

from loomtrace.operators import containment, planner


def held(texts, group):
    rows, best = containment.longest(texts, "text", group)
    return rows.join(best, "_id")


@pytest.mark.parametrize("group", [[], ["g"]])
def test_longest_same_as_all_pairs(spark, group):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))
    texts = [rng.choice(["", "\t"]) + rng.choice([" ", "  "]).join(word() for _ in range(n)) for n in [1] * 30 + [2] * 30 + [3] * 30 + [9] * 30 + [30] * 20 + [200] * 10]
    texts += [t[a : a + n] for t in texts[-30:] for n in (1, 4, 31, 32, 33, 63, 64, 65, 127, 128, 200, 400) for a in [rng.randint(0, max(0, len(t) - n))]]
    texts += ["x" * n for n in (31, 32, 33, 40, 64, 90)] + ["y", "y", "", "ab" * 40, "ba" * 40]
    rows = [(t, rng.choice([0, 1])) for t in texts] + [(None, 0), (None, 1), ("a", None), ("ab", None)]
    got = {(r["g"] if group else 0, r.text, r.best) for r in held(spark.createDataFrame(rows, "text string, g int"), group).collect()}
    distinct = {(t, g if group else 0) for t, g in rows if t is not None and (g is not None or not group)}
    want = set()
    for t, g in distinct:
        over = [u for u, h in distinct if g == h and u != t and t in u]
        if over:
            want.add((g, t, min(over, key=lambda u: (-len(u), u))))
    assert got == want and len(want) > 100


def test_full_tables_do_no_harm(spark, monkeypatch):
    monkeypatch.setattr(containment, "MOST", 4)
    monkeypatch.setattr(containment, "LEAST", 4)
    rows = [("the cat sat on the mat and looked at the dog that came in",), ("cat sat on the mat and looked at the dog",), ("a cat",), ("cat",), ("dog",)]
    got = {(r.text, r.best) for r in held(spark.createDataFrame(rows, "text string"), []).collect()}
    assert got == {("cat sat on the mat and looked at the dog", rows[0][0]), ("cat", rows[0][0]), ("dog", rows[0][0])}


def test_texts_are_not_repeated_for_their_words(spark):
    # Before, each text was moved once for each of its words: some 20 MB for these.
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(400))) for i in range(12)]
    plan = planner.not_contained(spark.createDataFrame(rows, "g int, text string"), "text", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
