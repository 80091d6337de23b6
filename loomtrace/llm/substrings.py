"""Exact repeated substrings by a distributed, sparse suffix array.

A byte goes if it lies in a ``length``-byte string that also starts anywhere else. Sorting every
suffix of a corpus would move hundreds of times its size, so only anchored suffixes are sorted:

1. Each run of ``length``-byte windows that share the smallest ``gram``-byte hash is one *block*; the
   place of that gram is its anchor. The choice depends on a window's bytes alone, so equal windows
   have equal anchors, and windows whose gram occurs at one anchor only can't repeat.
2. The suffixes at the anchors are range-partitioned by their leading bytes with sampled splitters,
   every bucket is sorted by multikey quicksort, and neighbours are compared, the last row of a
   bucket with the first of the next. The key of a suffix is its first eight bytes, then digests of
   its gram and of its block, which stand for the bytes further on. A block that repeats whole is
   removed; a block whose gram repeats with other bytes around it is looked at again,
3. window by window, by the same sort: its windows are suffixes whose key is their first eight
   bytes and a 128-bit digest of all ``length`` bytes.

Shorter passages are not removed but counted: ``shared_passages`` takes the anchors of ``passage`` byte strings
(some 50 words) and counts, for each text, those whose gram also stands in another row.

Rows of one key may lie in several buckets: splitters also hold a hash of the row, so a passage that
a third of all documents share is sorted by many tasks, and only neighbours are ever compared.

Defined cases: a null text is empty; texts under ``length`` bytes lose nothing; rows that repeat are
occurrences of their own, and all of them lose what they share; a null key is a key like others; texts of any
length are read whole; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import drop, share_below, small_batches, text_bytes, written

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


@dataclass(frozen=True)
class Settings:
    """length: bytes of a string that must not repeat; gram: bytes of an anchor's hash; bucket_rows: aimed at for a sorted bucket;
    small: rows that the quicksort leaves to a plain sort; passage, passage_gram: the same as length and gram for passages that are only counted."""

    length: int = 400
    gram: int = 256
    bucket_rows: int = 100_000
    sample_rows: int = 40_000
    small: int = 4096
    passage: int = 272
    passage_gram: int = 128


class _Powers:
    """Powers of the rolling hash's base and of its inverse modulo 2**64, as far as texts have needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            inverse = pow(_BASE, -1, 1 << 64)
            steps = np.full(size, _BASE, _U), np.full(size, inverse, _U)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position."""
    n = len(data)
    up, down = _POWERS.upto(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h * _U(0xD6E8FEB86659FD93)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, in time that does not depend on the width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, _U)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def blocks(data: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of each block of a text."""
    if len(data) < s.length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    h = gram_hashes(data, s.gram)
    # The leftmost of the smallest: the position breaks ties, and moves as the window moves.
    marked = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
    least = (sliding_min(marked, s.length - s.gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(least)) + 1
    low = np.concatenate(([0], cut))
    return least[low], low, np.concatenate((cut, [len(least)])) - 1


def _leads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number that sorts as they do."""
    out = np.zeros(len(at), _U)
    for k in range(8):
        out = (out << _U(8)) | data[at + k].astype(_U)
    return (out ^ _U(1 << 63)).view(np.int64)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, _U).view(np.int64)


def multikey_order(keys: list[np.ndarray], small: int = Settings.small) -> np.ndarray:
    """The order that sorts rows by several keys: multikey quicksort.

    A part is split by a pivot of its current key into lesser, equal and greater rows; only the equal
    ones go on to the next key. Parts of at most ``small`` rows are sorted at once by all keys that are left.
    """
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        if depth == len(keys) or high - low < 2:
            continue
        rows = order[low:high]
        if high - low <= small:
            order[low:high] = rows[np.lexsort(tuple(k[rows] for k in keys[:depth - 1 if depth else None : -1]))]
            continue
        x = keys[depth][rows]
        pivot = np.sort(x[:: max(1, len(x) // 255)])
        pivot = pivot[len(pivot) // 2]
        less, more = x < pivot, x > pivot
        a, b = int(less.sum()), int(more.sum())
        order[low:high] = np.concatenate((rows[less], rows[~(less | more)], rows[more]))
        todo += [(low, low + a, depth), (low + a, high - b, depth + 1), (high - b, high, depth)]
    return order


def _ties(check: np.ndarray, place: np.ndarray) -> np.ndarray:
    x = (check.astype(np.int64).view(_U) << _U(32)) ^ place.astype(np.int64).view(_U)
    x *= _U(_BASE)
    return (x ^ (x >> _U(29))).view(np.int64)


def bucket_of(keys: list[np.ndarray], splitters: list[tuple[int, ...]]) -> np.ndarray:
    """The bucket of each row: how many splitters are not above its key."""
    first = np.array([x[0] for x in splitters], np.int64)
    left = np.searchsorted(first, keys[0], side="left")
    out = np.searchsorted(first, keys[0], side="right")
    for i in np.flatnonzero(left < out):
        out[i] = bisect.bisect_right(splitters, tuple(int(k[i]) for k in keys), int(left[i]), int(out[i]))
    return out.astype(np.int32)


_KEYS = ("lead", "first", "second")


def split_points(rows: DataFrame, share: float, s: Settings) -> tuple[list[tuple[int, ...]], int]:
    """Splitters from a sample of the suffix rows, for buckets of about ``bucket_rows``."""
    table = rows.select(*_KEYS, "check", "place").toArrow()
    if not table.num_rows:
        return [], 1
    cols = [table.column(c).to_numpy() for c in _KEYS]
    cols.append(_ties(table.column("check").to_numpy(), table.column("place").to_numpy()))
    buckets = max(2, int(table.num_rows / share) // s.bucket_rows + 1)
    order = multikey_order(cols)
    picks = np.unique(np.linspace(0, len(order) - 1, min(buckets, len(order)) + 1).astype(int)[1:-1])
    found = [tuple(int(c[order[p]]) for c in cols) for p in picks]
    return sorted(set(found)), len(set(found)) + 1


def _neighbours(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of a bucket's rows, and for each but the first whether its gram, or all of its key, is its predecessor's."""
    cols = [table.column(c).to_numpy() for c in _KEYS]
    order = multikey_order(cols)
    near = [c[order] for c in cols]
    gram = np.zeros(len(order) + 1, bool)
    whole = np.zeros(len(order) + 1, bool)
    if len(order) > 1:
        gram[1:-1] = (near[0][1:] == near[0][:-1]) & (near[1][1:] == near[1][:-1])
        whole[1:-1] = gram[1:-1] & (near[2][1:] == near[2][:-1])
    return order, gram, whole


def compare(rows: DataFrame, sample: DataFrame, share: float, s: Settings, tag: str) -> tuple[DataFrame, list[str]]:
    """Of suffix rows (key, check, place, low, high, lead, first, second): those whose whole key repeats
    (``covered``) and those next to a row of the same gram with other bytes around it (``open``)."""
    spark = rows.sparkSession
    kind = rows.schema["key"].dataType.simpleString()
    splitters, buckets = split_points(sample, share, s)
    shared = spark.sparkContext.broadcast(splitters)
    own = f"key {kind}, check int, place int, low int, high int"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            keys = [col[c].to_numpy() for c in _KEYS]
            keys.append(_ties(col["check"].to_numpy(), col["place"].to_numpy()))
            to = bucket_of(keys, shared.value) if shared.value else np.zeros(b.num_rows, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.int32())], names=[*b.schema.names, "bucket"])

    names = ["key", "check", "place", "low", "high", "covered", "open", "bucket", "side", *_KEYS]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        order, gram, whole = _neighbours(table)
        covered = whole[:-1] | whole[1:]
        open_ = (gram & ~whole)[:-1] | (gram & ~whole)[1:]
        # 1: first of its bucket, 2: last, 3: both; the driver compares these with the next bucket's.
        side = np.zeros(len(order), np.int32)
        side[0] += 1
        side[-1] += 2
        keep = np.flatnonzero(covered | open_ | (side > 0))
        got = table.take(pa.array(order[keep]))
        made = {"covered": pa.array(covered[keep]), "open": pa.array(open_[keep]), "side": pa.array(side[keep])}
        out = pa.table([made[n] if n in made else got.column(n) for n in names], names=names)
        yield from out.to_batches(max_chunksize=20_000)

    dealt = rows.mapInArrow(assign, f"{own}, lead long, first long, second long, bucket int")
    marks = dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(sort, f"{own}, covered boolean, open boolean, bucket int, side int, lead long, first long, second long")
    marks, path = written(marks, tag)
    # At most two rows for each bucket.
    ends = sorted(marks.where("side > 0").collect(), key=lambda r: (r.bucket, r.side == 2))
    mended = [[r.key, r.check, r.place, r.low, r.high, r.covered, r.open] for r in ends]
    for i in range(1, len(ends)):
        a, b = ends[i - 1], ends[i]
        if a.bucket != b.bucket and (a.lead, a.first) == (b.lead, b.first):
            for k in (i - 1, i):
                mended[k][5 if a.second == b.second else 6] = True
    chosen = marks.where("side = 0").select("key", "check", "place", "low", "high", "covered", "open")
    if mended:
        chosen = chosen.unionByName(spark.createDataFrame([tuple(m) for m in mended], chosen.schema))
    return chosen.where("covered or open"), [path]


def _per_text(fn: Callable[[np.ndarray, int], tuple[np.ndarray, ...]], names: list[str]):
    """An Arrow function that makes suffix rows of whole texts: fn gives place, low, high, lead, first, second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            held, rows, size = [], [], 0
            for i in range(batch.num_rows):
                got = fn(data[offsets[i] : offsets[i + 1]], batch, i)
                if len(got[0]):
                    held.append(got)
                    rows.append(np.full(len(got[0]), i))
                    size += len(got[0])
                if held and (size > 50_000 or i + 1 == batch.num_rows):
                    at = pa.array(np.concatenate(rows))
                    cols = [np.concatenate(c) for c in zip(*held)]
                    arrays = [pa.array(c, pa.int32() if k < 3 else pa.int64()) for k, c in enumerate(cols)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *arrays], names=names)
                    held, rows, size = [], [], 0
            if held:
                at = pa.array(np.concatenate(rows))
                cols = [np.concatenate(c) for c in zip(*held)]
                arrays = [pa.array(c, pa.int32() if k < 3 else pa.int64()) for k, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *arrays], names=names)

    return run


def _block_rows(s: Settings):
    def rows(data: np.ndarray, batch, i):
        at, low, high = blocks(data, s)
        if not len(at):
            return at, low, high, at, at, at
        raw = memoryview(np.ascontiguousarray(data))
        first = _signed([xxhash.xxh3_64_intdigest(raw[a : a + s.gram]) for a in at.tolist()])
        second = _signed([xxhash.xxh3_64_intdigest(raw[lo : hi + s.length], seed=a - lo) for a, lo, hi in zip(at.tolist(), low.tolist(), high.tolist())])
        return at, low, high, _leads(data, at), first, second

    return rows


def _window_rows(s: Settings):
    def rows(data: np.ndarray, batch, i):
        starts = batch.column(3)[i].as_py()
        at = np.unique(np.concatenate([np.arange(x["low"], x["high"] + 1) for x in starts])) if starts else np.zeros(0, np.int64)
        if not len(at):
            return at, at, at, at, at, at
        raw = memoryview(np.ascontiguousarray(data))
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a : a + s.length]) for a in at.tolist()]), ">u8").astype(_U).view(np.int64)
        return at, at, at, _leads(data, at), digests[0::2], digests[1::2]

    return rows


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by [start, end) intervals."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ends) - 1]))]


_SPANS = "array<struct<low:int,high:int>>"
Finish = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple]


def _finish(finish: Finish, names: list[str], kinds: list[pa.DataType], last: bool):
    """Arrow function over (key, check, text, spans, starts or more): ``finish`` of each row whose spans are complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            lists = batch.column(3), batch.column(4)
            parts = [(x.offsets.to_numpy(), *(x.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))) for x in lists]
            later = np.diff(parts[1][0]) > 0 if not last else np.zeros(batch.num_rows, bool)
            spans, values = [], []
            for i in range(batch.num_rows):
                take = parts if last else parts[:1]
                low, high = (np.concatenate([p[k][p[0][i] : p[0][i + 1]] for p in take]) for k in (1, 2))
                low, high = merge_spans(low, high)
                spans.append([{"low": a, "high": b} for a, b in zip(low.tolist(), high.tolist())])
                values.append((None,) * len(kinds) if later[i] else finish(data[offsets[i] : offsets[i + 1]], low, high))
            cols = [pa.array(v, k) for v, k in zip(zip(*values), kinds)] if values else [pa.array([], k) for k in kinds]
            spans = pa.array(spans, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))
            if last:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans, *cols], names=["key", "check", "spans", *names])
            else:
                text = pa.compute.if_else(pa.array(later), batch.column(2), pa.scalar(None, batch.column(2).type))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, spans, batch.column(4), *cols], names=["key", "check", "text", "spans", "starts", *names])

    return run


def remove_repeats(docs: DataFrame, finish: Finish, fields: list[tuple[str, str, pa.DataType]], s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row as ``key``, ``check`` (a hash of its text), ``spans`` (the sorted, separate byte intervals that repeat) and what ``finish`` makes of its bytes and these.

    fields: name, SQL type and Arrow type of each value that ``finish`` returns.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    docs = docs.withColumn("check", F.hash("text")).select("key", "check", "text")
    kind = docs.schema["key"].dataType.simpleString()
    own = f"key {kind}, check int, place int, low int, high int, lead long, first long, second long"
    names = ["key", "check", "place", "low", "high", *_KEYS]
    made = ", ".join(f"`{n}` {t}" for n, t, _ in fields)
    made_names, made_kinds = [n for n, _, _ in fields], [k for _, _, k in fields]

    def drawn(frame: DataFrame, rows: float) -> tuple[DataFrame, float]:
        share = min(1.0, s.sample_rows / max(rows, 1))
        return frame.where(F.xxhash64("key", "check") <= share_below(share)), share

    blocks_of = _per_text(_block_rows(s), names)
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    sample, share = drawn(docs, 2 * size / (s.length - s.gram + 2))
    marks, paths = compare(docs.mapInArrow(blocks_of, own), sample.mapInArrow(blocks_of, own), share, s, "blocks")
    lists = marks.groupBy("key", "check").agg(
        F.collect_list(F.when(F.col("covered"), F.struct("low", (F.col("high") + s.length).alias("high")))).alias("spans"),
        F.collect_list(F.when(F.col("open"), F.struct("low", "high"))).alias("starts"),
    )
    same = lambda a, b: a["key"].eqNullSafe(b["key"]) & a["check"].eqNullSafe(b["check"])
    whole = lambda c: F.coalesce(F.col(c).cast(_SPANS), F.array().cast(_SPANS)).alias(c)
    joined = docs.join(lists, same(docs, lists), "left").select(docs["key"], docs["check"], "text", whole("spans"), whole("starts"))
    # Texts are written only where windows still have to be compared; all others are finished here.
    held, path = written(joined.mapInArrow(_finish(finish, made_names, made_kinds, False), f"key {kind}, check int, text string, spans {_SPANS}, starts {_SPANS}, {made}"), "spans")
    drop(spark, *paths)
    opened = held.where(F.size("starts") > 0).select("key", "check", "text", "spans", "starts")
    n = opened.select(F.sum(F.expr("aggregate(starts, 0L, (a, x) -> a + x.high - x.low + 1)")).alias("n")).first()["n"] or 0
    windows_of = _per_text(_window_rows(s), names)
    windows = opened.select("key", "check", "text", "starts")
    sample, share = drawn(windows, n)
    hits, _ = compare(windows.mapInArrow(windows_of, own), sample.mapInArrow(windows_of, own), share, s, "windows")
    found = hits.where("covered").groupBy("key", "check").agg(F.collect_list(F.struct("low", (F.col("high") + s.length).alias("high"))).alias("more"))
    rest = opened.join(found, same(opened, found), "left").select(opened["key"], opened["check"], "text", "spans", whole("more"))
    rest = rest.mapInArrow(_finish(finish, made_names, made_kinds, True), f"key {kind}, check int, spans {_SPANS}, {made}")
    return held.where(F.size("starts") == 0).select("key", "check", "spans", *made_names).unionByName(rest)


def _pieces(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[bytes]:
    at = 0
    for a, b in zip(low.tolist(), high.tolist()):
        yield data[at:a].tobytes()
        at = b
    yield data[at:].tobytes()


def kept_bytes(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    """What is left of a text, as bytes: a cut may part the bytes of one character."""
    return (b"".join(_pieces(data, low, high)),)


def digests(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    h = hashlib.sha256()
    for part in _pieces(data, low, high):
        h.update(part)
    return len(data), int((high - low).sum()), len(low), h.hexdigest()


KEPT = [("kept", "binary", pa.binary())]
DIGESTS = [("n_bytes", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("n_spans", "long", pa.int64()), ("kept_sha256", "string", pa.string())]


def shared_passages(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, check, n_shared_passages) of the rows that share an anchored gram of a passage with another row."""
    short = Settings(length=s.passage, gram=s.passage_gram)
    small_batches(docs.sparkSession)
    docs = docs.select(docs[key].alias("key"), F.hash(docs[text]).alias("check"), docs[text].alias("text"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            found = []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                at = blocks(own, short)[0]
                found.append(np.unique(gram_hashes(own, short.gram)[at]) if len(at) else np.zeros(0, _U))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
            flat = np.concatenate(found) if found else np.zeros(0, _U)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(flat.view(np.int64))], names=["key", "check", "gram"])

    rows = docs.mapInArrow(grams, f"key {docs.schema['key'].dataType.simpleString()}, check int, gram long")
    often = rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(often, "gram", "left_semi").groupBy("key", "check").agg(F.count_distinct("gram").alias("n_shared_passages"))


def removal_digests(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of every row, then n_shared_passages."""
    done = remove_repeats(docs, digests, DIGESTS, s, key, text).alias("d")
    shared = shared_passages(docs, s, key, text).alias("p")
    joined = done.join(shared, F.col("d.key").eqNullSafe(F.col("p.key")) & F.col("d.check").eqNullSafe(F.col("p.check")), "left")
    return joined.select(F.col("d.key").alias(key), *(n for n, _, _ in DIGESTS), F.coalesce("n_shared_passages", F.lit(0).cast("long")).alias("n_shared_passages"))
