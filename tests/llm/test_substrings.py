import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomtrace.llm import substrings
from loomtrace.llm.substrings import Settings


def brute(texts, n):
    count = Counter()
    for t in texts:
        count.update({}) if len(t) < n else count.update(t[i : i + n] for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(60):
        t = " ".join(word() for _ in range(rng.randint(0, 60)))
        for _ in range(rng.randint(0, 4)):
            a, b = sorted(rng.randrange(len(passage)) for _ in range(2))
            k = rng.randint(0, len(t))
            t = t[:k] + passage[a:b] + t[k:]
        texts.append(t)
    texts += [texts[0], texts[0], None, "", "ab" * 200, "a" * 300, passage, passage[:50]]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("rows", [37, 100_000])
def test_same_as_brute_force(spark, seed, rows):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as key", "'y' as spans", "1 as low").repartition(5)
    got = sorted(tuple(r)[:5] for r in substrings.removal_digests(docs, Settings(length=40, gram=24, bucket_rows=rows)).collect())
    want = [(i, *x) for i, x in enumerate(brute([(t or "").encode() for t in texts], 40))]
    assert got == want
    assert sum(x[2] > 0 for x in want) > 20 and sum(x[3] > 1 for x in want) > 3


def test_repeated_keys_null_keys_and_empty_table(spark):
    p = "".join(chr(97 + i * i % 26) for i in range(60)) * 1
    rows = [(1, p + "x"), (1, "y" + p), (None, p), (None, p), (2, "only here " * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = Settings(length=40, gram=24)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in substrings.removal_digests(docs, s).collect())
    assert got == sorted([("1", 61, 60), ("1", 61, 60), ("None", 60, 60), ("None", 60, 60), ("2", 20, 0)])
    assert substrings.removal_digests(docs.limit(0), s).count() == 0
    kept = substrings.remove_repeats(docs, substrings.kept_bytes, substrings.KEPT, s)
    assert sorted(bytes(r.kept) for r in kept.collect()) == [b"", b"", b"only here " * 2, b"x", b"y"]


@pytest.mark.parametrize("small", [2, 16, 4096])
def test_multikey_order(small):
    rng = np.random.default_rng(0)
    for n in (0, 1, 500, 3000):
        keys = [rng.integers(0, 4, n), rng.integers(-(2**62), 2**62, n) // 2**60, rng.integers(0, 9, n)]
        rows = np.stack(keys, axis=1)
        order = substrings.multikey_order(keys, small)
        assert sorted(order.tolist()) == list(range(n))
        assert rows[order].tolist() == sorted(rows.tolist())


def test_shared_passages(spark):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passage = text(60)
    rows = [(i, text(80) + " " + passage + " " + text(40)) for i in range(5)] + [(i, text(200)) for i in range(10, 30)] + [(40, None), (41, passage[:100]), (42, passage[:120] + text(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as gram")
    got = {r.doc_id: r.n_shared_passages for r in substrings.removal_digests(docs).collect()}
    assert {i for i, n in got.items() if n} == set(range(5)) and len(got) == len(rows)
