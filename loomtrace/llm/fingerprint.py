"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is cut at content-defined places: at line ends and sentence ends, and where no such place comes for ``LONG``
characters, after words that end in one of some letters, and in texts under ``SHORT`` characters at white space. So texts of one line have several pieces, too.
The distinct pieces are hashed; each hash goes to one cell in each of three rows, and a cell keeps a
count, the XOR of its hashes and the XOR of their check values.
Subtracting the cells of two texts leaves the sketch of what differs, and peeling recovers the
differing hashes: a cell of count one or minus one whose check fits gives a hash, which then leaves
its other cells. If cells remain, both sketches are built again, larger: the hashes are dealt by their highest
bits to as many tables as their number asks for, so that time and memory grow in proportion to the
pieces, and a table that fails is built again with twice the cells, and with four times. Should the largest size fail as well, its hashes themselves are compared.

The likeness of two texts is the number of shared pieces over that of all pieces, the
shared ones being known from both counts and the recovered difference. Only DataFrame functions run.

Defined cases: a null text is empty; two empty texts have likeness 1, an empty and another text 0;
rows of equal keys follow each other in order of a hash of their texts; rows equal in key and text
count as one document listed twice; null keys come last; a single row is its own next row; texts of any
length are read whole; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm.common import row_partitions, written

#: Cells in each of a table's three rows, as bits that name them. The first size is that of a text's own sketch.
ROWS, BITS = 3, (3, 4, 5)
#: The lowest bit of a hash that places it, for each size; what deals hashes to tables are its highest bits.
_FROM = tuple(sum(ROWS * b for b in BITS[:n]) for n in range(len(BITS)))
#: Keys that a table takes on average.
LOAD = 12
#: Rounds of peeling after which a table is looked at again.
FEW = 4
#: Characters under which a text is cut into words, and above which a part without an end of line or sentence is.
SHORT, LONG = 200, 300
_KEYS = "array<struct<k:bigint,s:int>>"


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once. Unlike a transform of one element, this copies neither the value nor the result."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, lambda x: fn(x))


def paragraphs(text: Column) -> Column:
    """A 64-bit hash for each distinct piece."""
    parts = F.transform(F.split(text, r"\n|(?<=[.!?]) ", -1), lambda x: F.when(F.length(x) > LONG, F.split(x, r"(?<=[a-e\W])\s", -1)).otherwise(F.array(x)))
    pieces = F.when(F.length(text) < SHORT, F.split(text, r"\s+", -1)).otherwise(F.flatten(parts))
    return F.when(F.length(text) > 0, F.array_distinct(F.transform(pieces, lambda x: F.xxhash64(x)))).otherwise(F.array().cast("array<bigint>"))


def _places(size: int) -> Column:
    """The cells of a table: a key lies in those with ``k & m = v``, one in each row."""
    bits = [(_FROM[size] + r * BITS[size], j) for r in range(ROWS) for j in range(1 << BITS[size])]
    return F.array(*(F.struct(F.lit(((1 << BITS[size]) - 1) << low).cast("bigint").alias("m"), F.lit(j << low).cast("bigint").alias("v")) for low, j in bits))


def _inside(keys: Column, place: Column) -> Column:
    return F.filter(keys, lambda e: e["k"].bitwiseAND(place["m"]) == place["v"])


def _cell(n: Column, k: Column, h: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.alias("k"), h.alias("h"))


def _zero() -> Column:
    return _cell(F.lit(0), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))


def cells(keys: Column, size: int = 0) -> Column:
    """The table of distinct keys."""

    def cell(inside: Column) -> Column:
        k = F.aggregate(inside, F.lit(0).cast("bigint"), lambda a, k: a.bitwiseXOR(k))
        h = F.aggregate(inside, F.lit(0).cast("bigint"), lambda a, k: a.bitwiseXOR(F.xxhash64(k)))
        return F.when(F.size(inside) == 0, _zero()).otherwise(_cell(F.size(inside), k, h))

    return F.transform(_places(size), lambda p: _let(F.filter(keys, lambda k: k.bitwiseAND(p["m"]) == p["v"]), cell))


def _sparse(m: Column, v: Column, n: Column, k: Column, h: Column) -> Column:
    return F.struct(m.alias("m"), v.alias("v"), n.cast("int").alias("n"), k.alias("k"), h.alias("h"))


def _live(c: Column) -> Column:
    return (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0)


def _differences(keys: Column, size: int) -> Column:
    """The cells that aren't empty in the table of signed keys, with their places."""
    add = lambda a, e: _sparse(a["m"], a["v"], a["n"] + e["s"], a["k"].bitwiseXOR(e["k"]), a["h"].bitwiseXOR(F.xxhash64(e["k"])))
    zero = F.lit(0).cast("bigint")
    return F.filter(F.transform(_places(size), lambda p: F.aggregate(_inside(keys, p), _sparse(p["m"], p["v"], F.lit(0), zero, zero), add)), _live)


def subtract(a: Column, b: Column) -> Column:
    """The cells in which two tables of the first size differ, with their places."""
    differ = F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))
    return F.filter(F.zip_with(differ, _places(0), lambda c, p: _sparse(p["m"], p["v"], c["n"], c["k"], c["h"])), _live)


def peel(table: Column, size: int = 0) -> Column:
    """The keys that a table of differences holds, with their signs; null if cells remain."""

    def leave(c: Column, e: Column) -> Column:
        return _sparse(c["m"], c["v"], c["n"] - e["n"], c["k"].bitwiseXOR(e["k"]), c["h"].bitwiseXOR(e["h"]))

    def after(state: Column, pure: Column) -> Column:
        # Cells that are empty leave the list, so that a round takes time for those only that are left.
        left = F.filter(F.transform(state["cells"], lambda c: F.aggregate(_inside(pure, c), c, leave)), _live)
        found = F.concat(state["found"], F.transform(pure, lambda e: F.struct(e["k"].alias("k"), e["n"].alias("s"))))
        return F.struct(left.alias("cells"), found.alias("found"), (F.size(pure) > 0).alias("going"))

    def step(state: Column) -> Column:
        single = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["h"] == F.xxhash64(c["k"])))
        # A key may be alone in several rows.
        once = lambda x: F.filter(x, lambda c, i: ~F.exists(F.slice(x, 1, i), lambda d: d["k"] == c["k"]))
        return _let(_let(single, once), lambda pure: after(state, pure))

    def rounds(state: Column, n: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, lambda s, _: F.when(s["going"] & (F.size(s["cells"]) > 0), step(s)).otherwise(s))

    start = F.struct(table.alias("cells"), F.array().cast(_KEYS).alias("found"), F.lit(True).alias("going"))
    # Every round but the last takes out a key, and a table holds fewer keys than cells if it can be peeled. A round copies
    # the state, and most tables need few.
    end = _let(rounds(start, FEW), lambda s: F.when(s["going"] & (F.size(s["cells"]) > 0), rounds(s, (ROWS << BITS[size]) + 1 - FEW)).otherwise(s))
    return _let(end, lambda s: F.when(F.size(s["cells"]) == 0, s["found"]))


def _signed(keys: Column, sign: int) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(sign).alias("s")))


def _dealt(keys: Column) -> Column:
    """Signed keys in one list for each table that has any, in time in proportion to the keys (but for their sort)."""
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.size(keys) / F.lit(LOAD)))).cast("int")

    def lists(u: Column, n: Column) -> Column:
        table = lambda i: F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", F.get(u, i)["k"], F.lit(64) - n))
        # Sorted keys of a table are neighbours: cut where the table changes.
        starts = F.filter(F.sequence(F.lit(0), F.size(u) - 1), lambda i: (i == 0) | (table(i - 1) != table(i)))
        return _let(starts, lambda c: F.transform(c, lambda x, i: F.slice(u, x + 1, F.coalesce(F.get(c, i + 1), F.size(u)) - x)))

    return _let(F.sort_array(keys), lambda u: _let(bits, lambda n: lists(u, n)))


def differing(a: Column, b: Column) -> Column:
    """The pieces that only one text has, from tables of both texts' pieces, larger where these can't be peeled."""
    both = F.concat(_signed(a, 1), _signed(b, -1))

    def one(g: Column) -> Column:
        # A key of both texts stands twice in the list.
        alone = F.filter(g, lambda e: ~F.array_contains(g, F.struct(e["k"].alias("k"), (-e["s"]).alias("s"))))
        return F.coalesce(*(peel(_differences(g, n), n) for n in range(len(BITS))), alone)

    return F.when(F.size(both) == 0, F.array().cast(_KEYS)).otherwise(F.flatten(F.transform(_dealt(both), one)))


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """The differing pieces: from the smallest sketches, or larger ones where these fail or must fail."""
    small = F.abs(F.size(a) - F.size(b)) <= ROWS << BITS[0]
    return F.coalesce(F.when(small, peel(subtract(cells_a, cells_b))), differing(a, b))


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    n = (F.size(a) + F.size(b)).cast("double")
    return _let(F.size(difference(a, b, cells_a, cells_b)).cast("double"), lambda d: F.when(n + d == 0, F.lit(1.0)).otherwise((n - d) / (n + d)))


def written_out(table: Column) -> Column:
    """A sketch as text: count, hash and check of each cell."""
    return F.lower(F.array_join(F.transform(table, lambda c: F.concat(c["n"].cast("string"), F.lit(":"), F.hex(c["k"]), F.lit(":"), F.hex(c["h"]))), ","))


def next_rows(rows: DataFrame) -> DataFrame:
    """(key, check, half, next_key, next_check) of rows(key, check, n), in descending order of keys; the first follows the last.

    Keys are dealt to ranges, each range finds its own successors, and only the ends of ranges meet in
    one task: as many rows as there are ranges.
    """
    spark = rows.sparkSession
    rows = rows.groupBy("key", "check").agg(F.max("n").alias("n"))
    n = row_partitions(spark, 1, 1)
    order = [F.col("key").desc_nulls_last(), F.col("check").asc()]
    dealt, _ = written(rows.repartitionByRange(n, *order).withColumn("bucket", F.spark_partition_id()), "order")
    within = Window.partitionBy("bucket").orderBy(*order)
    after = F.lead(F.struct("key", "check")).over(within)
    dealt = dealt.withColumn("next", after).withColumn("place", F.row_number().over(within))
    heads = dealt.where("place = 1").select(F.col("bucket").alias("head"), F.struct("key", "check").alias("first"))
    ends = Window.orderBy("head")
    heads = heads.select("head", F.coalesce(F.lead("first").over(ends), F.first("first").over(ends)).alias("jump"))
    joined = dealt.join(F.broadcast(heads), F.col("bucket") == F.col("head"), "left")  # a row for each range
    to = F.coalesce("next", "jump")
    return joined.select("key", "check", F.floor(F.col("n") / 2).cast("int").alias("half"), to["key"].alias("next_key"), to["check"].alias("next_check"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has its last half replaced by the beginning of the next row's text.
    """
    docs = docs.select(docs[key].alias("key"), F.hash(docs[text]).alias("check"), F.coalesce(docs[text], F.lit("")).alias("text"))
    after = next_rows(docs.select("key", "check", F.length("text").alias("n")))
    # Structs are equal where both keys are null, and the same column deals the rows of the joins and of the distinct: texts move once, what is borrowed once.
    docs = docs.select(F.struct("key", "check").alias("id"), "text")
    after = after.select(F.struct("key", "check").alias("of"), F.struct(F.col("next_key").alias("key"), F.col("next_check").alias("check")).alias("next_id"), "half")
    # What a row needs of its successor: the beginning that it borrows, and the paragraph hashes.
    ahead = docs.join(after, docs["id"] == after["next_id"])
    ahead = ahead.select("of", "half", F.expr("left(text, half)").alias("borrowed"), paragraphs(F.col("text")).alias("next_keys"))
    ahead = ahead.dropDuplicates(["of"])
    own = docs.join(ahead, docs["id"] == ahead["of"])
    n = F.length("text")
    own = own.select(F.col("id")["key"].alias("key"), n.cast("long").alias("n_chars"), F.col("text"), F.concat(F.expr("left(text, length(text) - half)"), F.col("borrowed")).alias("edited"), "next_keys")
    own = own.select("key", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("a"), paragraphs(F.col("edited")).alias("e"), F.col("next_keys").alias("x"))
    own = own.select("*", *(cells(F.col(c)).alias(f"c{c}") for c in "aex"))
    return own.select(
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        written_out(F.col("ca")).alias("fingerprint"),
        written_out(F.col("ce")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e"), F.col("ca"), F.col("ce")).alias("near_edited"),
        likeness(F.col("a"), F.col("x"), F.col("ca"), F.col("cx")).alias("near_next"),
    )
