import random
import re

import numpy as np
import pytest

from loomtrace.llm import components, neardup
from loomtrace.llm.neardup import Settings


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (k_, _) in enumerate(rows):
        if k_ is not None:
            least[find(i)] = min(least.get(find(i), k_), k_)
    return sorted((str(k_), len(sets[i]), str(None if k_ is None else least[find(i)]), k_ is None or least[find(i)] == k_) for i, (k_, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÉé") for _ in range(rng.randint(1, 6)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, 25)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = word()
            texts.append(rng.choice([" ", "\n", "\t "]).join(t))
    texts += [None, "", " \n", "one", "ONE", "one two", "one two", "\x1f", "x " * 50_000, "x " * 60_000]
    rng.shuffle(texts)
    return [(i + 5, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [4, 256])
@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_same_as_brute_force(spark, words, percent, block):
    rows = corpus(words) + [(None, "one two"), (7, "seven again and again " * 4), (7, "seven again and again " * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as key", "1 as n_shingles", "2 as bucket").repartition(4)
    s = Settings(words=words, percent=percent, rows=5, bands=38, block=block)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in neardup.near_duplicates(docs, s).collect())
    assert got == brute(rows, words, percent)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for n in (5, 50, 3000):
        for _ in range(20):
            all_ = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
            a, b = all_[: int(1.5 * n)], all_[n // 2 :]
            true = len(np.intersect1d(a, b)) / len(all_)
            x, y = neardup.sketch(a, 192), neardup.sketch(b, 192)
            assert (x != np.iinfo(np.uint64).max).all()
            errors.append((x == y).mean() - true)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(259, 3), (50, 51), (51, 50), (51, 51)]
    found, _ = components.components(spark.createDataFrame(edges, "a long, b long"))
    got = dict((r.node, r.component) for r in found.collect())
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 3 for i in [7, *range(200, 260)]}, 51: 50}


def test_many_repeated_rows_stay_one_class(spark):
    rows = [(1, "one text that comes again and again")] * 3000 + [(2, "another text of its own that stays"), (3, "one text that comes again and again")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id, r.kept, r["count"]) for r in got.groupBy("doc_id", "component_id", "kept").count().collect()) == [(1, 1, True, 3000), (2, 2, True, 1), (3, 1, False, 1)]


def test_a_large_group_sends_each_text_a_few_times(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    # A chain hangs on the group by its first link only, and a group of its own shares no word.
    rows += [(5000 + k, " ".join(base[: 120 - 6 * (k + 1)])) for k in range(3)] + [(6000 + k, " ".join(f"v{i}" for i in range(100 + k))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sent = []
    real = neardup._compared

    def counted(docs, places, s):
        sent.append(places.agg(F.sum(F.size("places"))).first()[0])
        return real(docs, places, s)

    neardup._compared = counted
    try:
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in neardup.near_duplicates(docs, Settings(block=16)).collect())
    finally:
        neardup._compared = real
    assert got == brute(rows, 3, 85)
    assert sum(sent) < 45 * len(rows)


def test_first_texts_move_alike_at_every_size(spark, monkeypatch):
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans, real = [], neardup._placed

    def seen(docs, places):
        found = real(docs, places)
        plans.append(found._jdf.queryExecution().sparkPlan().toString())
        return found

    monkeypatch.setattr(neardup, "_placed", seen)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == brute(rows, 3, 85)
    # A few rows, and still no broadcast: their disk says what that of more rows will be.
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
