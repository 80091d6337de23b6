import hashlib
import random
import re

from loomtrace.llm import fingerprint


def pieces(t):
    if not t:
        return set()
    if len(t) < fingerprint.SHORT:
        return set(re.split(r"\s+", t, flags=re.ASCII))
    out = set()
    for part in re.split(r"\n|(?<=[.!?]) ", t):
        out.update(re.split(r"(?<=[a-e\W])\s", part, flags=re.ASCII) if len(part) > fingerprint.LONG else [part])
    return out


def likeness(a, b):
    x, y = pieces(a), pieces(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_same_as_brute_force(spark):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["ab", "é", "c", "𝄞d"]) for _ in range(rng.randint(0, 4)))
    texts = ["\n".join(line() for _ in range(rng.choice([1, 2, 5, 12, 30, 90]))) for _ in range(60)]
    texts += [" ".join(rng.choice(["ab. ", "é", "c!", "d", "xe"]) + str(rng.randint(0, 99)) for _ in range(n)) for n in (3, 30, 90, 400)]
    texts += [texts[0], None, "", "one", "\n".join(f"line {i}" for i in range(4000)), "\n".join(f"line {i}" for i in range(1, 4100)), "x" * 200_000]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(None, "last\nof all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as half", "'z' as next_keys").repartition(5)
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows[:-1], key=lambda r: -r[0]) + rows[-1:]
    prints = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - likeness(t, edited)) < 1e-12 and abs(r.near_next - likeness(t, after)) < 1e-12
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert (r.fingerprint == r.edited_fingerprint) == (pieces(t) == pieces(edited))
    assert len(set(prints.values())) == len({frozenset(pieces(t)) for t in prints})


def test_single_row_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "ab\ncd"), (1, "ab\ncd")], "doc_id long, text string")
    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == 2 and {r.near_next for r in got} == {1.0}
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0


def test_a_kept_half_is_nearer_than_a_stranger(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = fingerprint.fingerprints(docs).toPandas()
    assert (got.near_edited > got.near_next).mean() >= 0.985


def test_tables_that_fail_are_built_larger(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [([rng.getrandbits(63) for _ in range(n)], [rng.getrandbits(63) for _ in range(m)]) for n, m in ((0, 0), (1, 0), (11, 0), (30, 30), (500, 700), (6000, 5))]
    rows += [(a, a[: len(a) // 2] + b) for a, b in rows]
    # Hashes that share the bits that place them in the smallest size.
    rows += [([1 << 40 | i << 20 for i in range(20)], [])]
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = frame.select("a", "b", fingerprint.differing(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        assert sorted((x.k, x.s) for x in r.d) == sorted([(k, 1) for k in set(r.a) - set(r.b)] + [(k, -1) for k in set(r.b) - set(r.a)])


def test_differences_hold_no_empty_cells(spark):
    from pyspark.sql import functions as F

    keys = [3, -5, 1 << 40, -(1 << 62), 77]
    frame = spark.createDataFrame([(keys, keys), (keys, keys[:-1]), (keys[1:], keys), ([], [])], "a array<long>, b array<long>")
    left = fingerprint.subtract(fingerprint.cells(F.col("a")), fingerprint.cells(F.col("b")))
    got = frame.select(F.size(left).alias("n"), fingerprint.peel(left).alias("d")).collect()
    # A round takes time for the cells that are left, so what both texts have leaves none.
    assert [(r.n, [(x.k, x.s) for x in r.d]) for r in got] == [(0, []), (3, [(77, 1)]), (3, [(3, -1)]), (0, [])]
