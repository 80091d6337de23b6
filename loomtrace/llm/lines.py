"""Line dedup over windows of three consecutive lines.

Every three consecutive lines of a text are hashed (128 bits) as one window. A window that occurs
more than once anywhere keeps its first occurrence, in order of key and position, and every later
one marks its three lines; overlapping marks merge, and marked lines go. As a removed line always
has an equal line further ahead, no line's content vanishes from the corpus.

Defined cases: a null text stays null; texts under three lines, and windows of blank lines only,
are left alone; rows equal in key and text count as one document listed twice; null keys come first; texts of any length are
read whole; an empty table gives an empty one; other columns pass through, unless called _n_lines or _n_removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _windows(docs: DataFrame) -> DataFrame:
    """(key, check, at, h1, h2) of every window; ``at`` counts from 0."""
    hashed = docs.select("key", "check", F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= WINDOW)
    one = lambda seed: F.transform("lines", lambda x: F.xxhash64(F.lit(seed), x))
    hashed = hashed.select("key", "check", one(1).alias("a"), one(2).alias("b"), F.transform("lines", lambda x: x.rlike("[^ \t\r\x0b\x0c]")).alias("ink"))
    each = F.transform(
        F.sequence(F.lit(0), F.size("a") - WINDOW),
        lambda i: F.struct(
            F.xxhash64(*(F.get("a", i + k) for k in range(WINDOW))).alias("h1"),
            F.xxhash64(*(F.get("b", i + k) for k in range(WINDOW))).alias("h2"),
            (F.get("ink", i) | F.get("ink", i + 1) | F.get("ink", i + 2)).alias("ink"),
        ),
    )
    return hashed.select("key", "check", F.posexplode(each).alias("at", "w")).where("w.ink").select("key", "check", "at", "w.h1", "w.h2")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Of docs(key, check, text): (key, check, marked), the sorted numbers of the lines to remove."""
    windows = _windows(docs)
    place = F.struct("key", "check", "at")
    # Counts and first places are combined before the shuffle, so a window of any frequency costs a task one row.
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    later = windows.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    marks = later.groupBy("key", "check").agg(F.collect_set("at").alias("at"))
    covered = F.flatten(F.transform("at", lambda i: F.array(*(i + k for k in range(WINDOW)))))
    return marks.select("key", "check", F.array_sort(F.array_distinct(covered)).alias("marked"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of every row with the marked lines gone from its text, plus _n_lines and _n_removed."""
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), docs[key].alias("key"), F.hash(docs[text]).alias("check"), docs[text].alias("text"))
    marks = repeated_lines(keyed.select("key", "check", "text"))
    joined = keyed.join(marks, keyed["key"].eqNullSafe(marks["key"]) & (keyed["check"] == marks["check"]), "left")
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "marked")
    kept = F.when(F.col("marked").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    joined = joined.select("row", "text", "marked", lines.alias("lines"))
    n = F.coalesce(F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines")), F.lit(0)).cast("long")
    out = [kept.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*out, n.alias("_n_lines"), F.when(F.col("marked").isNull(), F.lit(0)).otherwise(F.size("marked")).cast("long").alias("_n_removed"))
