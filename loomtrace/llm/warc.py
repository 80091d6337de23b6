"""WARC records and a Merkle fixity audit of replicas.

Pages become WARC resource records, laid out in files one after the other. Each record's bytes are
hashed as a leaf. The records that begin in one ``RANGE`` of a file's offsets, with their own offsets and
lengths, are hashed in order into a node; ``FAN`` neighbouring nodes are hashed into
their parent, up to one root for each file. Each replica's tree is built from the records, offsets and lengths found in
that replica alone. An audit compares the roots of a file and, level by level, only the children of nodes
that differ, so that sound files cost one row and damage as many rows as its tree is high, times ``FAN``.

What differs in the end is named: ``corrupt`` (other bytes at the same offset), ``moved`` (the same record at another
offset of its file), ``missing``, and ``extra`` (a record that only the replica has).

Defined cases: null pages and addresses are empty; equal ids are laid out in order of
their digests; null ids come first; records alike in id and bytes are told apart by their offsets only; records of any
length are hashed whole; an empty table gives no file, and no damage; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm.common import written

FAN = 16
#: Bytes of offsets that a node of the lowest level covers.
RANGE = 64 << 10
#: Bytes that a file aims at.
FILE_BYTES = 8 << 20


def record(page_id: Column, url: Column, body: Column) -> Column:
    """The text of one resource record."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(F.lit("leaf:"), text).cast("binary"), 256)


def manifest(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", seen: Column | None = None) -> DataFrame:
    """(id, file, place, offset, length, digest) of every page's record; with ``seen``, made of a column ``text``, that as well.

    A digest's leading bits name the file, so rows of one id spread over files, and a file's layout is found within it.
    """
    own = pages.select(pages[page_id].alias("id"), record(pages[page_id], pages[url], pages[body]).alias("text"))
    size = pages.agg(F.sum(F.octet_length(body)).alias("n")).first()["n"] or 0
    files = max(1, -(-size // FILE_BYTES))
    more = [] if seen is None else [seen.alias("seen")]
    own = own.select("id", F.octet_length("text").cast("long").alias("length"), leaf(F.col("text")).alias("digest"), *more)
    own = own.withColumn("file", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % F.lit(files))
    order = Window.partitionBy("file").orderBy("id", "digest")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = (F.row_number().over(order) - 1).cast("long").alias("place")
    return own.select("id", "file", place, (before - F.col("length")).alias("offset"), "length", "digest", *(["seen"] if more else []))


def _node(parts: Column) -> Column:
    return F.sha2(F.concat(F.lit("node:"), F.array_join(F.array_sort(parts), ";")).cast("binary"), 256)


def ranges(records: DataFrame) -> DataFrame:
    """(file, node, digest) for each range of offsets in which a record of records(file, offset, length, digest) begins."""
    # Padded offsets sort as numbers do.
    part = F.concat(F.lpad(F.col("offset").cast("string"), 19, "0"), F.lit(":"), F.col("length").cast("string"), F.lit(":"), F.coalesce("digest", F.lit("")))
    return records.groupBy("file", F.floor(F.col("offset") / RANGE).alias("node")).agg(_node(F.collect_list(part)).alias("digest"))


def parents(nodes: DataFrame) -> DataFrame:
    part = F.concat(F.lpad(F.col("node").cast("string"), 19, "0"), F.lit(":"), F.col("digest"))
    return nodes.groupBy("file", F.floor(F.col("node") / FAN).alias("node")).agg(_node(F.collect_list(part)).alias("digest"))


def tree(records: DataFrame, height: int) -> list[DataFrame]:
    """The nodes of each level, the ranges first and the roots last."""
    levels = [written(ranges(records), "ranges")[0]]
    for _ in range(height):
        levels.append(parents(levels[-1]))
    return levels


def height(*replicas: DataFrame) -> int:
    """Levels above the ranges of the largest file."""
    most = max([r.agg(F.max("offset").alias("n")).first()["n"] or 0 for r in replicas])
    n = 0
    while RANGE * FAN**n <= most:
        n += 1
    return n


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(file, node) of the ranges that differ between two trees, found from the roots down."""
    bad = None
    for a, b in zip(reversed(ours), reversed(theirs)):
        a, b = a.withColumnRenamed("digest", "a"), b.withColumnRenamed("digest", "b")
        if bad is not None:
            above = bad.withColumnRenamed("node", "parent")
            a, b = (t.withColumn("parent", F.floor(F.col("node") / FAN)).join(above, ["file", "parent"], "left_semi").drop("parent") for t in (a, b))
        bad = a.join(b, ["file", "node"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node")
    return bad


def fixity(layout: DataFrame, replica: DataFrame) -> DataFrame:
    """The manifest's rows with ``status``: ok, corrupt, moved or missing in replica(id, file, offset, length, digest).

    A record that only the replica has is a row more, with no place and the status extra.
    """
    replica, _ = written(replica.select("id", "file", "offset", "length", "digest"), "replica")
    top = height(layout, replica)
    bad = audit(tree(layout, top), tree(replica, top))
    at = F.floor(F.col("offset") / RANGE).alias("node")
    x, y = (t.select("*", at).join(bad, ["file", "node"], "left_semi").drop("node") for t in (layout.select("id", "file", "place", "offset", "length", "digest"), replica))
    y = y.select("file", "offset", F.col("id").alias("their_id"), F.col("length").alias("their_length"), F.col("digest").alias("their_digest"), F.lit(True).alias("there"))
    found = x.withColumn("here", F.lit(True)).join(y, ["file", "offset"], "full_outer")
    same = F.col("digest").eqNullSafe(F.col("their_digest")) & F.col("length").eqNullSafe(F.col("their_length")) & F.col("here").eqNullSafe(F.col("there"))
    corrupt = F.coalesce(F.col("here") & F.col("there"), F.lit(False)) & (F.col("id").eqNullSafe(F.col("their_id")) | F.col("their_id").isNull())
    found, _ = written(found.where(~same).withColumn("corrupt", corrupt), "differences")
    lost, new = found.where("here and not corrupt"), found.where("there and not corrupt")
    keys = lambda t, i, d: t.select(F.col("file").alias("of"), F.col(i).alias("of_id"), F.col(d).alias("of_digest")).distinct()
    match = lambda i, d: (F.col("file") == F.col("of")) & F.col(i).eqNullSafe(F.col("of_id")) & F.col(d).eqNullSafe(F.col("of_digest"))
    moved = lost.join(keys(new, "their_id", "their_digest"), match("id", "digest"), "left")
    states = found.where("corrupt").select("file", "place", F.lit("corrupt").alias("state"))
    states = states.unionByName(moved.select("file", "place", F.when(F.col("of").isNotNull(), "moved").otherwise("missing").alias("state")))
    extra = new.join(keys(lost, "id", "digest"), match("their_id", "their_digest"), "left_anti")
    extra = extra.select(F.col("their_id").alias("id"), "file", F.lit(None).cast("long").alias("place"), "offset", F.col("their_length").alias("length"), F.col("their_digest").alias("digest"), F.lit("extra").alias("status"))
    out = layout.join(states, ["file", "place"], "left").select("id", "file", "place", "offset", "length", "digest", F.coalesce("state", F.lit("ok")).alias("status"))
    return out.unionByName(extra)


def drill(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", every: int = 97) -> tuple[DataFrame, DataFrame]:
    """A layout and the records of a damaged replica.

    Of ``every`` ids one has lost its record and one has its first byte changed, and each file ends with a record more.
    """
    turn = F.pmod(F.coalesce("id", F.lit(0)), F.lit(every))
    seen = leaf(F.when(turn == 1, F.regexp_replace("text", "^W", "X")).otherwise(F.col("text")))
    laid, _ = written(manifest(pages, page_id, url, body, seen), "layout")
    kept = laid.where(turn != 0).select("id", "file", "offset", "length", F.col("seen").alias("digest"))
    ends = laid.groupBy("file").agg(F.sum("length").alias("offset")).withColumn("id", -1 - F.col("file"))
    late = ends.withColumn("text", record(F.col("id"), F.lit(None), F.lit(None)))
    late = late.select("id", "file", "offset", F.octet_length("text").cast("long").alias("length"), leaf(F.col("text")).alias("digest"))
    return laid.drop("seen"), kept.unionByName(late)
