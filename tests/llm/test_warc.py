from loomtrace.llm import warc

SCHEMA = "page_id long, url string, html string"
COLUMNS = ["id", "file", "place", "offset", "length", "digest"]


def statuses(spark, layout, replica):
    """status by (id, offset) of a layout and a replica given as rows."""
    ours = spark.createDataFrame(layout, "id long, file long, place long, offset long, length long, digest string")
    theirs = spark.createDataFrame(replica, "id long, file long, offset long, length long, digest string")
    got = warc.fixity(ours, theirs).collect()
    assert len({(r.id, r.file, r.offset, r.status) for r in got}) == len(got)
    return {(r.id, r.offset): r.status for r in got if r.status != "ok"}, sum(r.status == "ok" for r in got)


def test_drill(spark):
    rows = [(i, f"http://x/{i}", f"<p>{'é' * (i % 50)}</p>") for i in range(600)] + [(700, None, None), (700, None, "x"), (None, "u", "h"), (701, "u", "long " * 300_000)]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as file", "'x' as digest", "2 as place", "'t' as text")
    layout, replica = warc.drill(pages)
    got = warc.fixity(layout, replica).collect()
    files = {r.file for r in got}
    extra = [r for r in got if r.status == "extra"]
    assert len(got) == len(rows) + len(files) and {r.id for r in extra} == {-1 - f for f in files}
    for r in got:
        if r.status != "extra":
            assert r.status == ("missing" if (r.id or 0) % 97 == 0 else "corrupt" if r.id % 97 == 1 else "ok")
    at = sorted((r.file, r.offset, r.length) for r in got)
    assert all(b[1] == a[1] + a[2] for a, b in zip(at, at[1:]) if a[0] == b[0])
    assert {r.status for r in warc.fixity(layout, layout).collect()} == {"ok"}


def test_extra_moved_and_shifted_records(spark):
    layout = [(i, i % 2, i // 2, i // 2 * 10_000, 10_000, f"d{i}") for i in range(400)]
    sound = [(i, f, o, n, d) for i, f, _, o, n, d in layout]
    extra = sound + [(900, 0, 2_000_000, 50, "new"), (901, 1, 15, 20, "within")]
    assert statuses(spark, layout, extra) == ({(900, 2_000_000): "extra", (901, 15): "extra"}, 400)
    # Two records change places.
    swapped = [(6, f, o, n, "d6") if i == 2 else (2, f, o, n, "d2") if i == 6 else (i, f, o, n, d) for i, f, o, n, d in sound]
    assert statuses(spark, layout, swapped) == ({(2, 10_000): "moved", (6, 30_000): "moved"}, 398)
    # All that follows a lost record of file 1 lies further ahead.
    shifted = [(i, f, o - 10_000 if f == 1 and o > 50_000 else o, n, d) for i, f, o, n, d in sound if not (f == 1 and o == 50_000)]
    found, ok = statuses(spark, layout, shifted)
    assert found.pop((11, 50_000)) == "missing" and set(found.values()) == {"moved"} and len(found) == 194 and ok == 205
    # Another length, bytes or no readable name at the same offset.
    broken = [(i, f, o, n + 1, d) if i == 3 else (None, f, o, n, "?") if i == 4 else (i, f, o, n, "?") if i == 5 else (i, f, o, n, d) for i, f, o, n, d in sound]
    assert statuses(spark, layout, broken) == ({(3, 10_000): "corrupt", (4, 20_000): "corrupt", (5, 20_000): "corrupt"}, 397)
    assert statuses(spark, layout, [r for r in sound if r[1]])[1] == 200


def test_same_as_comparing_all_records(spark):
    import random

    rng = random.Random(7)
    layout = [(i, i % 3, i // 3, i // 3 * 70_000, 70_000, f"d{i}") for i in range(300)]
    replica = []
    for i, f, _, o, n, d in layout:
        what = rng.random()
        if what > 0.05:
            replica.append((i, f, o, n, "bad" if what < 0.1 else d))
    got, ok = statuses(spark, layout, replica)
    have = {(f, o): d for _, f, o, _, d in replica}
    want = {(i, o): "missing" if (f, o) not in have else "corrupt" for i, f, _, o, _, d in layout if have.get((f, o)) != d}
    assert got == want and ok == 300 - len(want)


def test_roots_change_with_offset_length_and_bytes(spark):
    pages = spark.createDataFrame([(i, "u", "x" * 9000) for i in range(200)], SCHEMA)
    layout = warc.manifest(pages).cache()
    top = warc.height(layout)
    root = lambda t: warc.tree(t, top)[-1].first().digest
    assert top == 2 and len(warc.tree(layout, top)) == 3
    sound = root(layout)
    for change in ("offset + 1 as offset, length, digest", "offset, length + 1 as length, digest", "offset, length, 'x' as digest"):
        assert root(layout.selectExpr("id", "file", *change.split(", "))) != sound
    assert root(layout.repartition(3)) == sound


def test_empty_table(spark):
    pages = spark.createDataFrame([], SCHEMA)
    assert warc.fixity(*warc.drill(pages)).count() == 0
