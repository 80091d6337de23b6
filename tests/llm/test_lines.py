import random

from loomtrace.llm import lines


def brute(rows):
    seen, marked = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ls = (t or "").split("\n")
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if not any(x.strip(" \t\r\x0b\x0c") for x in w):
                continue
            if w in seen:
                marked.setdefault(i, set()).update((k, k + 1, k + 2))
            seen.add(w)
    out = []
    for i, t in rows:
        gone = marked.get(i, set())
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone)))
    return out


def test_same_as_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice("abcd  ") for _ in range(rng.randint(0, 12)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "\n\n\n\n\n"), (503, "z\n" * 50_000), (504, "only\nthree\nlines"), (None, "only\nthree\nlines\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as key", "1 as check", "array(2) as marked").repartition(3)
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "_n_lines", "_n_removed"]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(((r.doc_id, r.text, r._n_removed) for r in got.collect()), key=key) == sorted(brute(rows), key=key)
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_every_line_stays_somewhere(spark):
    text = "\n".join(f"line {i % 5}" for i in range(60))
    rows = [(i, text) for i in range(5)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert set("\n".join(r.text for r in got).split("\n")) - {""} == {f"line {i}" for i in range(5)}
