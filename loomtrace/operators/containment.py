"""The longest text of a group that holds each text, by grams of bytes.

A text of up to ``SHORT`` bytes is held by the longer texts that have it as a gram. A longer one has
a key: of its first q + 1 grams of q bytes the smallest hash, where q is the power of two from a quarter of its
length to half of it. A text that holds it has the same q + 1 grams in a row, so the same smallest hash. Grams and keys
that no text asks for are dropped by a bit table of bounded size before anything is moved; what it lets pass by chance does no harm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.state import stored

#: Bytes of a text that is looked up as it is, at most, and of texts that are hashed at once. Grams that a task gathers before it passes them on.
SHORT, CHUNK, GATHERED = 32, 1 << 15, 200_000
#: Bits of a table, as a power of two: at least, at most, and of one slice that a task fills.
LEAST, MOST, SLICE = 16, 26, 20
#: A gram of more bytes than these is sought only where its first ones are asked for.
STARTS = (4, 8)
_BYTES = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP, _ONE, _TWO, _START = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x5851F42D4C957F2D))
_PLAIN, _MASK = _BYTES.tolist(), (1 << 64) - 1


def _grown(h: np.ndarray, more: np.ndarray, at: int) -> np.ndarray:
    """Hashes of grams, from those of their first and second parts; ``at`` is the length of the second."""
    return h[: len(more)] * np.uint64(pow(int(_STEP), at, 1 << 64)) + more


def _slots(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Two places of each key in a table."""
    shift = np.uint64(64 - bits)
    yield (keys * _ONE) >> shift
    yield ((keys ^ (keys >> np.uint64(29))) * _TWO) >> shift


def _asked(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of the keys that the table may have."""
    bits = len(table).bit_length() - 1
    some = np.flatnonzero(table[next(_slots(keys, bits))])
    return some[table[list(_slots(keys[some], bits))[1]]]


def _smallest(h: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n hashes in a row."""
    size = 1
    while size < n:
        step = min(size, n - size)
        h = np.minimum(h[:-step], h[step:])
        size += step
    return h


def _hash(b: np.ndarray, q: int) -> np.ndarray:
    h = _BYTES[b]
    size = 1
    while size < q:
        h = _grown(h, h[size:], size)
        size *= 2
    return h


def _width(n: int) -> int:
    return 1 << ((n // 2).bit_length() - 1)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _own(group: int, text: bytes) -> list[int]:
    """The key by which a text is asked for, and for a short one those of its first bytes."""
    g = group * int(_STEP) & _MASK
    if len(text) > SHORT:
        q = _width(len(text))
        return [_signed(int(_hash(np.frombuffer(text[: 2 * q], np.uint8), q).min()) ^ g)]
    h, starts = 0, []
    for k, c in enumerate(text, 1):
        h = h * int(_STEP) + _PLAIN[c] & _MASK
        if k in STARTS and k < len(text):
            starts.append(_signed(h ^ g ^ int(_START)))
    return [_signed(h ^ g), *starts]


def _found(groups: np.ndarray, texts: list[bytes], short: np.ndarray, long: np.ndarray) -> Iterator[tuple[int, bytes | None, int]]:
    """(row, gram, key) of the grams of texts, shorter than them, that may be asked for, and of their keys."""
    sizes = np.array([len(t) for t in texts])
    whole, ends = b"".join(texts), np.cumsum(sizes)
    b, row = np.frombuffer(whole, np.uint8), np.repeat(np.arange(len(texts)), sizes)
    left, g = ends[row] - np.arange(len(b)), (groups * _STEP)[row]
    one = _BYTES[b]
    spots, h = np.arange(len(b)), one
    for q in range(1, SHORT + 1):
        if q > 1:
            fit = left[spots] >= q
            spots, h = spots[fit], h[fit]
            h = _grown(h, one[spots + (q - 1)], 1)
        keys = h ^ g[spots]
        at = spots[_asked(keys, short)]
        at = at[sizes[row[at]] > q]
        yield from ((i, gram, 0) for i, gram in {(i, whole[k : k + q]) for i, k in zip(row[at].tolist(), at.tolist())})
        if q in STARTS:
            some = _asked(keys ^ _START, short)
            spots, h = spots[some], h[some]
        if not len(spots):
            break
    q = _width(SHORT + 1)
    h = _hash(b, q) if len(b) >= q else one[:0]
    while (sizes > 2 * q).any():
        keys = _smallest(h, q + 1)
        keys = keys ^ g[: len(keys)]
        at = np.flatnonzero((left[: len(keys)] >= 2 * q) & np.r_[True, (keys[1:] != keys[:-1]) | (row[1 : len(keys)] != row[: len(keys) - 1])])
        at = at[_asked(keys[at], long)]
        yield from {(i, None, k) for i, k in zip(row[at].tolist(), keys[at].astype(np.int64).tolist())}
        h = _grown(h, h[q:], q)
        q *= 2


def _table(keys: DataFrame, n: int) -> np.ndarray:
    """The bit table of keys(keys), packed: it is filled in slices, and its size is bounded however many keys there are."""
    bits = min(MOST, max(LEAST, (64 * n).bit_length()))
    width = min(SLICE, bits)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in _slots(batch["key"].to_numpy().astype(np.uint64), bits):
                yield pd.DataFrame({"part": (at >> np.uint64(width)).astype(np.int32), "at": (at & np.uint64((1 << width) - 1)).astype(np.int32)})

    def fill(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << width, bool)
        out[batch["at"].to_numpy()] = True
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(out).tobytes()]})

    table = np.zeros(1 << bits - 3, np.uint8)
    for r in keys.select(F.explode("keys").alias("key")).distinct().mapInPandas(places, "part int, at int").groupBy("part").applyInPandas(fill, "part int, bits binary").toLocalIterator():
        table[r.part << width - 3 : (r.part + 1) << width - 3] = np.frombuffer(r.bits, np.uint8)
    return table


def longest(texts: DataFrame, text: str = "text", group: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of texts with a number (``_id``), and (_id, best) of those whose text another text of their group holds: the longest of these, the first of equally long ones."""
    base = stored(texts.withColumn("_id", F.monotonically_increasing_id()))
    full = " and ".join(f"`{c}` is not null" for c in [*group, text])
    plain = base.where(full).select("_id", F.struct(F.lit(0), *group).alias("_g"), F.col(text).alias("_t"))
    rows = plain.select("_id", F.xxhash64("_g").alias("g"), F.encode("_t", "UTF-8").alias("b"), F.length("_t").alias("n"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"], "g": batch["g"], "gram": [t if len(t) <= SHORT else None for t in batch["b"]], "keys": [_own(g, t) for g, t in zip(batch["g"].tolist(), batch["b"])], "n": batch["n"]})

    # An empty text is held by all others.
    inner = stored(rows.where("octet_length(b) > 0").mapInPandas(ask, "_id long, g long, gram binary, keys array<long>, n int"))
    few, many = inner.where("gram is not null"), inner.where("gram is null")
    tables = base.sparkSession.sparkContext.broadcast([_table(part, part.count()) for part in (few, many)])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        short, long = (np.unpackbits(t).view(bool) for t in tables.value)
        tops: dict[tuple[int, bytes], tuple[int, list[int]]] = {}

        def passed() -> pd.DataFrame:
            out = [(i, g, gram, 0, n) for (g, gram), (n, ids) in tops.items() for i in ids]
            tops.clear()
            return pd.DataFrame(out, columns=["_id", "g", "gram", "key", "n"])

        for batch in batches:
            parts = np.cumsum(batch["b"].map(len).to_numpy()) // CHUNK
            for _, part in batch.groupby(parts, sort=False):
                ids, groups, sizes, keys = part["_id"].tolist(), part["g"].tolist(), part["n"].tolist(), []
                for i, gram, key in _found(part["g"].to_numpy().astype(np.uint64), part["b"].tolist(), short, long):
                    if gram is None:
                        keys.append((ids[i], groups[i], None, key, sizes[i]))
                        continue
                    # Only the longest texts that have a gram matter.
                    n, known = tops.get((groups[i], gram), (0, []))
                    if sizes[i] > n:
                        tops[groups[i], gram] = (sizes[i], [ids[i]])
                    elif sizes[i] == n:
                        known.append(ids[i])
                yield pd.DataFrame(keys, columns=["_id", "g", "gram", "key", "n"])
            if len(tops) >= GATHERED:
                yield passed()
        yield passed()

    hits = stored(rows.mapInPandas(probe, "_id long, g long, gram binary, key long, n int"))
    # Of a short text the longest holders are told by their lengths alone; equally long ones are told apart by their texts.
    asked = few.select("g", "gram", F.col("_id").alias("inner"))
    whole = hits.where("gram is not null")
    tops = whole.groupBy("g", "gram").agg(F.max("n").alias("n")).join(asked, ["g", "gram"])
    short = whole.join(tops, ["g", "gram", "n"]).select("inner", F.col("_id").alias("outer"), "n")
    asked = many.select(F.col("keys")[0].alias("key"), F.col("_id").alias("inner"), F.col("n").alias("m"))
    near = hits.where("gram is null").join(asked, "key").where("n > m").select("inner", F.col("_id").alias("outer"), "n")
    empty = plain.where("_t = ''").select("_g", F.col("_id").alias("inner"))
    size = plain.where("_t <> ''").groupBy("_g").agg(F.max(F.length("_t")).alias("n"))
    rest = empty.join(size, "_g").join(plain.select("_g", F.col("_id").alias("outer"), F.length("_t").alias("n")), ["_g", "n"]).select("inner", "outer", "n")
    held = stored(short.unionByName(near).unionByName(rest).distinct())
    # All texts move once, by a merge at every size, to leave those that are asked for.
    wanted = held.select(F.explode(F.array("inner", "outer")).alias("_id")).distinct()
    known = stored(plain.join(wanted.hint("merge"), "_id", "left_semi"))
    left = held.join(known.select(F.col("_id").alias("inner"), F.col("_g").alias("_h"), F.col("_t").alias("_in")), "inner")
    left = left.join(known.select(F.col("_id").alias("outer"), "_g", "_t"), "outer").where((F.col("_g") == F.col("_h")) & F.col("_t").contains(F.col("_in")) & (F.col("_t") != F.col("_in")))
    return base, left.groupBy(F.col("inner").alias("_id")).agg(F.min_by("_t", F.struct(-F.col("n"), "_t")).alias("best"))
