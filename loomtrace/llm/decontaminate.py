"""Benchmark decontamination by canonical templates.

Texts and benchmark items become tokens; numbers, numbers with a unit, and names (capitalised words
within a sentence) become typed placeholders. Windows of canonical tokens are hashed and joined
with the items' windows. An item whose windows a text holds, in part or whole, is then compared
token by token: placeholders may hold other values than the item's, but equal values must stay
equal, so a question asked again with other numbers or names is caught and a chance meeting of
common phrases is not.

Only DataFrame functions run here. The items' windows are broadcast if they are at most
``broadcast_rows`` and joined by shuffle otherwise, where hot windows can be split.

Windows with fewer than ``plain`` ordinary tokens say nothing as templates. An item without any other window is
matched in its own words, numbers and names: its windows of raw tokens, in lower case, are what is hashed, so verbatim
copies are found and other values are not.

Defined cases: null and empty texts and items match nothing; items shorter than a window are
matched whole; equal items are found together; rows equal in key
and text count as one document listed twice; null keys match like others; very long texts are read whole; empty tables
give an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of measure that may follow a number.
UNITS = "%|°C|°F|km/h|mph|km|cm|mm|m|kg|mg|g|lb|oz|l|ml|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|meters?|metres?|miles?|feet|inch(?:es)?|dollars?|euros?|cents?|pounds?|GB|MB|kB|TB|Hz|kHz|MHz|GHz|W|kW|V|A|Pa|J"

_NAME = "\x01"
_MARK = r"(?<=[\p{L}\p{N},;:] )(?=\p{Lu}\p{Ll})"
_TOKEN = _NAME + r"?\p{L}[\p{L}\p{M}]*+(?:['’]\p{L}++){0,3}+|\p{N}++(?:[.,]\p{N}++){0,8}+(?:[ -]?(?:" + UNITS + r")(?![\p{L}\p{N}]))?"


@dataclass(frozen=True)
class Settings:
    """window: tokens; plain: ordinary tokens a window needs; coverage: share of an item's windows that makes a hit, or so many windows."""

    window: int = 8
    plain: int = 4
    coverage: float = 0.5
    windows: int = 20
    broadcast_rows: int = 1_000_000


def tokens(text: Column) -> Column:
    """Words, names (marked) and numbers with their units, in order."""
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), _MARK, _NAME), F.lit(_TOKEN), F.lit(0))


def _is_number(x: Column) -> Column:
    return x.rlike(r"^\p{N}")


def canonical(x: Column) -> Column:
    """A token's canonical form: numbers, quantities and names by type, others in lower case."""
    first = F.substring(x, 1, 1)
    ascii_letter = first >= "A"
    number = F.when(x.rlike(r"[^\p{N}.,]$"), F.lit("#quantity")).otherwise(F.lit("#number"))
    return F.when(x.startswith(_NAME), F.lit("#name")).when(ascii_letter & (first <= "z"), F.lower(x)).when(_is_number(x), number).otherwise(F.lower(x))


def verbatim(x: Column) -> Column:
    """A token as it stands, in lower case and without its mark."""
    return F.lower(F.ltrim(x, F.lit(_NAME)))


def _slot(x: Column) -> Column:
    return x.startswith("#")


def _hashed_windows(hashed: DataFrame, size: int) -> DataFrame:
    """(key, check, at, h): one row for each window of ``size`` hashed tokens."""
    starts = F.when(F.size("h") >= size, F.sequence(F.lit(0), F.size("h") - size))
    each = F.transform(starts, lambda i: F.xxhash64(F.slice("h", i + 1, F.lit(size))))
    return hashed.select("key", "check", F.posexplode(each).alias("at", "h"))


def leaks(docs: DataFrame, items: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, check, item, n_windows, matched, reworded): texts that hold an item. ``reworded`` if a placeholder's value differs."""
    docs = docs.select(docs[key].alias("key"), F.hash(docs[text]).alias("check"), docs[text].alias("text"))
    base = items.select(items[item].alias("item"), tokens(items[item_text]).alias("raw")).where(F.size("raw") > 0)
    base = base.withColumn("canon", F.transform("raw", canonical))
    base = base.withColumn("size", F.least(F.lit(s.window), F.size("canon")))
    ordinary = lambda a: F.size(F.filter(a, lambda x: ~_slot(x)))
    starts = F.sequence(F.lit(0), F.size("canon") - F.col("size"))

    def windows(column: str) -> Column:
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice(column, i + 1, F.col("size")).alias("part")))

    hashes = lambda own: F.transform(own, lambda w: F.struct(w["at"].alias("at"), F.xxhash64(F.transform(w["part"], lambda x: F.xxhash64(x))).alias("h")))
    own = F.filter(windows("canon"), lambda w: ordinary(w["part"]) >= F.least(F.lit(s.plain), F.col("size")))
    base = base.withColumn("own", hashes(own)).withColumn("exact", F.size("own") == 0)
    base = base.withColumn("canon", F.when(F.col("exact"), F.transform("raw", verbatim)).otherwise(F.col("canon")))
    base = base.withColumn("own", F.when(F.col("exact"), hashes(windows("canon"))).otherwise(F.col("own"))).withColumn("n_windows", F.size("own"))
    base = base.withColumn("template", F.xxhash64("exact", "canon"))
    # Items of one template are joined once, and told apart later by their values.
    template = base.groupBy("template").agg(F.first("own").alias("own"), F.first("size").alias("size"), F.first("n_windows").alias("n_windows"), F.first("exact").alias("exact"))
    lookup = template.select("template", "size", "n_windows", "exact", F.explode("own").alias("w")).select("template", "size", "n_windows", "exact", F.col("w.at").alias("place"), "w.h")
    known = lookup.agg(F.count("*").alias("n"), F.collect_set(F.struct("size", "exact")).alias("kinds")).first()
    kinds = sorted((k["size"], k["exact"]) for k in known["kinds"]) or [(s.window, False)]
    if known["n"] <= s.broadcast_rows:
        lookup = F.broadcast(lookup)
    read = docs.select("key", "check", tokens(F.col("text")).alias("t"))
    hashed = {exact: read.select("key", "check", F.transform("t", lambda x: F.xxhash64(verbatim(x) if exact else canonical(x))).alias("h")) for exact in (False, True)}
    found = None
    for n, exact in kinds:  # at most twice as many as a window has tokens
        own = lookup.where((F.col("size") == n) & (F.col("exact") == exact))
        got = _hashed_windows(hashed[exact], n).join(own, "h")
        found = got if found is None else found.unionByName(got)
    by_line = found.groupBy("key", "check", "template", (F.col("at") - F.col("place")).alias("shift")).agg(F.collect_set("place").alias("places"), F.max("size").alias("size"), F.max("n_windows").alias("n_windows"))
    enough = lambda m: (m >= F.col("n_windows") * s.coverage) | (m >= s.windows)
    lists = by_line.groupBy("key", "check", "template").agg(
        F.collect_list(F.struct("shift", "places")).alias("lines"), F.max("size").alias("size"), F.max("n_windows").alias("n_windows")
    )
    lists = lists.where(enough(F.size(F.array_distinct(F.flatten("lines.places")))))
    # The texts concerned, once more, to compare the tokens themselves.
    texts = docs.alias("d").join(lists.alias("l"), F.col("d.key").eqNullSafe(F.col("l.key")) & (F.col("d.check") == F.col("l.check")))
    texts = texts.select("d.key", "d.check", "template", "lines", "size", "n_windows", tokens(F.col("text")).alias("theirs")).dropDuplicates(["key", "check", "template"])
    pairs = texts.join(base.select("template", "item", "raw", "canon", "exact"), "template")
    pair = lambda p, shift: F.struct(F.get("raw", p).alias("ours"), F.get("theirs", p + shift).alias("theirs"), F.get("canon", p).alias("kind"))

    def compared(line):
        at = F.array_distinct(F.flatten(F.transform(line["places"], lambda p: F.sequence(p, p + F.col("size") - 1))))
        return F.transform(at, lambda p: pair(p, line["shift"]))

    checked = F.transform("lines", lambda x: F.struct(x["places"].alias("places"), compared(x).alias("pairs")))
    pairs = pairs.withColumn("checked", checked)
    slots = lambda c: F.filter(c["pairs"], lambda x: _slot(x["kind"]))
    same = lambda c: F.forall(c["pairs"], lambda x: F.when(F.col("exact"), verbatim(x["theirs"])).otherwise(canonical(x["theirs"])) == x["kind"])

    def consistent(c):
        values = F.array_distinct(F.transform(slots(c), lambda x: F.struct(x["kind"].alias("kind"), x["ours"].alias("ours"), x["theirs"].alias("theirs"))))
        return F.size(values) == F.size(F.array_distinct(F.transform(values, lambda x: F.struct(x["kind"].alias("kind"), x["ours"].alias("ours")))))

    pairs = pairs.withColumn("good", F.filter("checked", lambda c: same(c) & consistent(c)))
    pairs = pairs.withColumn("matched", F.size(F.array_distinct(F.flatten("good.places")))).where(enough(F.col("matched")))
    reworded = F.exists("good", lambda c: F.exists(slots(c), lambda x: x["ours"] != x["theirs"]))
    return pairs.select("key", "check", "item", F.col("n_windows").cast("long").alias("n_windows"), F.col("matched").cast("long").alias("matched"), reworded.alias("reworded"))


def without_leaks(docs: DataFrame, items: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """The rows of docs that hold no item, all columns as they are."""
    bad = leaks(docs, items, s, key, text, **names).select(F.col("key").alias("_key"), F.col("check").alias("_check")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["_key"]) & (F.hash(docs[text]) == bad["_check"]), "left_anti")
