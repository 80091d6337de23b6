import random

import regex

from loomtrace.llm import decontaminate as dc

ITEMS = [
    (1, "If Tom walks 12 km in 3 hours, how far does Tom walk in 7 hours when the road is flat"),
    (2, "the quick brown fox jumps over the lazy dog beside the quiet river bank"),
    (3, "two words"),
    (4, None),
    (5, ""),
    (6, "1 2 3 4 5 6 7 8 9 10"),
    (7, "What is 5?"),
    (8, "Compute 12 + 5 * 3 - 8"),
]


def find(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as template", "'x' as key")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "9 as size")
    return {(r.key, r.item): r for r in dc.leaks(docs, items, dc.Settings(**kw)).collect()}


ROWS = [
    (10, "Before it. If Tom walks 12 km in 3 hours, how far does Tom walk in 7 hours when the road is flat? After."),
    (11, "Here: If Ann walks 5 miles in 2 hours, how far does Ann walk in 9 hours when the road is flat"),
    (12, "Here: If Ann walks 5 miles in 2 hours, how far does Bob walk in 9 hours when the road is flat"),
    (13, "THE QUICK BROWN FOX, jumps over the lazy dog beside the quiet river bank"),
    (14, "the quick brown fox sleeps under the lazy dog near the quiet river bed"),
    (15, "we have two words here"),
    (16, None),
    (17, ""),
    (18, "1 2 3 4 5 6 7 8 9 10 11"),
    (19, "filler words go on " * 20_000 + "the quick brown fox jumps over the lazy dog beside the quiet river bank"),
    (None, "the quick brown fox jumps over the lazy dog beside the quiet river bank"),
    (20, "1,1" + ",1" * 50_000),
    (21, "Tell me: what is 5? And what is 6?"),
    (22, "what is 6"),
    (23, "compute 12 + 5 * 3 - 8 now"),
]


def test_hits_and_misses(spark):
    got = find(spark, ROWS, coverage=0.9)
    assert set(got) == {(10, 1), (11, 1), (13, 2), (15, 3), (18, 6), (19, 2), (None, 2), (21, 7), (23, 8)}
    assert got[11, 1].reworded and not got[10, 1].reworded and not got[13, 2].reworded
    assert got[10, 1].matched == got[10, 1].n_windows


def test_shuffled_join_finds_the_same(spark):
    assert set(find(spark, ROWS, coverage=0.9, broadcast_rows=0)) == set(find(spark, ROWS, coverage=0.9))


def test_filter_keeps_clean_rows_and_their_columns(spark):
    docs = spark.createDataFrame(ROWS + ROWS[:1] + ROWS[4:5], "doc_id long, text string").selectExpr("*", "1 as key", "2 as item_id")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dc.without_leaks(docs, items, dc.Settings(coverage=0.9))
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [12, 14, 14, 16, 17, 20, 22]
    assert dc.without_leaks(docs.limit(0), items).count() == 0
    assert dc.without_leaks(docs, items.limit(0)).count() == docs.count()


UNIT = dc.UNITS
TOKEN = regex.compile(dc._TOKEN)
MARK = regex.compile(dc._MARK)


def read(text):
    return TOKEN.findall(MARK.sub("\x01", text or ""))


def form(token):
    if token.startswith("\x01"):
        return "#name"
    if regex.match(r"\p{N}", token):
        return "#number" if regex.search(r"[\p{N}.,]$", token) else "#quantity"
    return token.lower()


def brute(docs, items, s):
    """Every (key, item) with windows and matches, by comparing all places of all texts with all places of all items."""
    out = {}
    for item, said in items:
        raw = read(said)
        if not raw:
            continue
        canon = list(map(form, raw))
        size = min(s.window, len(canon))
        spots = range(len(canon) - size + 1)
        own = [i for i in spots if sum(not x.startswith("#") for x in canon[i : i + size]) >= min(s.plain, size)]
        exact = not own
        shape = (lambda x: x.lstrip("\x01").lower()) if exact else form
        canon, own = list(map(shape, raw)), list(spots) if exact else own
        for key, text in docs:
            theirs = read(text)
            shapes = list(map(shape, theirs))
            matched, lines = set(), {}
            for at in range(len(shapes) - size + 1):
                for i in own:
                    if shapes[at : at + size] == canon[i : i + size]:
                        lines.setdefault(at - i, []).append(i)
            for shift, places in lines.items():
                at = {p for i in places for p in range(i, i + size)}
                values = {}
                good = True
                for p in at:
                    if canon[p].startswith("#"):
                        good &= values.setdefault((canon[p], raw[p]), theirs[p + shift]) == theirs[p + shift]
                if good:
                    matched.update(places)
            if matched and (len(matched) >= s.coverage * len(own) or len(matched) >= s.windows):
                out[key, item] = len(own), len(matched)
    return out


def test_same_as_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "cat", "Tom", "Ann", "sat", "3", "14", "5 km", "7 kg", "on", "mat", "and", "1,000", "Bob", "ran"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 6, 9, 14, 30])))) for i in range(40)] + [(99, None), (98, "5 6 7")]
    docs = []
    for k in range(150):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 2)):
            said = rng.choice(items)[1] or ""
            for old, new in rng.choice([[], [("Tom", "Sam")], [("3", "8"), ("Ann", "Tom")], [("cat", "dog")]]):
                said = regex.sub(rf"\b{old}\b", new, said)
            parts += [said, " ".join(word() for _ in range(rng.randint(0, 9)))]
        docs.append((k, " ".join(parts)))
    s = dc.Settings(coverage=0.7)
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), s)
    assert {(r.key, r.item): (r.n_windows, r.matched) for r in got.collect()} == brute(docs, items, s)
