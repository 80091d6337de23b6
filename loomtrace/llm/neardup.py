"""Near duplicates by fast similarity sketching, banding and exact verification.

Every text becomes the set of its word shingles and a sketch of it. In round after round each
shingle is hashed to a bin with a value that grows from round to round; in the second half of the
rounds the bin is given by the round. So every coordinate fills after at most twice as many rounds
as there are bins, and for larger sets after a few. Rows of coordinates make bands, and texts that
share a band are candidates. Bands are so many that a pair at the threshold is missed with a
chance under one in a million; what the bands bring together is verified on the full sets.

Equal sets are one class first, so exact copies cost nothing more. Buckets with the same members
are compared once. No task holds a large bucket, and none writes all pairs, as a forest that spans the links found is
enough: in a first round the members of a large bucket are cut into blocks by a hash, each member in
the largest of its large buckets only, and compared within their block. Components follow, from
alternating star steps on the class representatives. In a second round only those members that are outside
the bucket's largest component are compared with all other members, block by block; what is in one
component already needs no further link. So a group of m near copies sends its texts a few times, not m times.

Defined cases: a text without words, empty or null has an empty set and links with nothing; with
fewer words than a shingle the whole sequence is its one shingle; rows that repeat are exact copies;
of rows with equal keys each keeps its own set; a row whose key is null links with nothing and is kept; of a
group the smallest key stays; very long texts are read whole; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import drop, small_batches, text_bytes, written
from loomtrace.llm.components import components
from loomtrace.llm.substrings import _POWERS

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FULL = np.iinfo(np.uint64).max


@dataclass(frozen=True)
class Settings:
    """words: of a shingle; percent: link if 100 * intersection >= percent * union; rows and bands of the sketch.

    A pair at the threshold is missed with a chance of (1 - (percent / 100) ** rows) ** bands.
    block: members that one task holds at once, twice in the second round; block_shingles: the same for their shingles.
    """

    words: int = 3
    percent: int = 85
    rows: int = 6
    bands: int = 32
    block: int = 128
    block_shingles: int = 1_000_000


#: Five words and a similarity of 0.8, for the pipeline.
FIVE_WORDS = Settings(words=5, percent=80, rows=5, bands=38)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def shingles(data: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text's bytes."""
    gap = _SPACE[data]
    edge = np.diff(np.concatenate(([True], gap, [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, _U)
    n = len(data)
    up, down = _POWERS.upto(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum((_LOWER[data].astype(_U) + _U(1)) * up[:n], out=sums[1:])
    w = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))
    if len(w) < words:
        h = np.array([len(w)], _U)
        for x in w:
            h = _mix(h * _U(3) + x)
        return h
    h = w[: len(w) - words + 1].copy()
    for k in range(1, words):
        h = _mix(h) + w[k : len(w) - words + 1 + k]
    return np.unique(_mix(h))


def sketch(found: np.ndarray, size: int) -> np.ndarray:
    """The fast similarity sketch of a set: ``size`` coordinates, equal in two sets with a chance of their similarity."""
    out = np.full(size, _FULL, _U)
    done = 0
    while done < 2 * size:
        # Rounds beyond those that fill the last bin change nothing: their values are larger.
        some = min(2 * size - done, max(1, -(-4 * size // len(found))))
        rounds = np.arange(done, done + some, dtype=_U)
        x = _mix(found[None, :] ^ _mix(rounds + _U(0x51ED270B))[:, None])
        bins = ((x >> _U(32)) * _U(size)) >> _U(32)
        late = rounds >= size
        if late.any():
            bins[late] = (rounds[late] - _U(size))[:, None]
        value = (rounds[:, None] << _U(52)) | ((x & _U(0xFFFFFFFF)) << _U(20))
        np.minimum.at(out, bins.ravel().astype(np.int64), value.ravel())
        done += some
        if not (out == _FULL).any():
            break
    return out


def band_keys(coordinates: np.ndarray, s: Settings) -> np.ndarray:
    rows = coordinates.reshape(s.bands, s.rows)
    h = np.arange(1, s.bands + 1, dtype=_U)
    for k in range(s.rows):
        h = _mix(h * _U(0x9E3779B97F4A7C15) ^ rows[:, k])
    return h.view(np.int64)


def _features(s: Settings):
    names = ["key", "check", "n_shingles", "d1", "d2", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            n, digest, bands = [], [], []
            for i in range(batch.num_rows):
                found = shingles(data[offsets[i] : offsets[i + 1]], s.words)
                n.append(len(found))
                digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                bands.append(band_keys(sketch(found, s.rows * s.bands), s) if len(found) else np.zeros(0, np.int64))
            d = np.frombuffer(b"".join(digest), ">u8").astype(_U).view(np.int64)
            flat = pa.array(np.concatenate(bands)) if bands else pa.array([], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(b) for b in bands]))), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d[0::2]), pa.array(d[1::2]), lists], names=names)

    return run


def links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest that spans the links among sets."""
    size = np.array([len(x) for x in sets], np.int64)
    m = len(sets)
    both = np.zeros((m, m), np.int64)
    if m == 2:
        both[0, 1] = both[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True)) if 100 * size.min() >= percent * size.max() else 0
    else:
        owner = np.repeat(np.arange(m), size)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        column = np.cumsum(np.concatenate(([False], flat[1:] != flat[:-1])))
        often = np.bincount(column)[column] > 1
        column, owner = column[often], owner[often]
        if len(column):
            column = np.cumsum(np.concatenate(([False], column[1:] != column[:-1])))
            step = max(1, 8_000_000 // m)
            for low in range(0, int(column[-1]) + 1, step):
                a, b = np.searchsorted(column, [low, low + step])
                part = np.zeros((m, int(column[b - 1]) - low + 1), np.float32)
                part[owner[a:b], column[a:b] - low] = 1
                both += np.rint(part @ part.T).astype(np.int64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    forest, left = [], np.ones(m, bool)
    for root in range(m):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            near = np.flatnonzero(linked[at] & left)
            left[near] = False
            forest += [(at, int(x)) for x in near]
            queue += near.tolist()
    return forest


def _verify(s: Settings):
    """Rows (bucket, one, two, key, body), sorted by the first three, to links (a, b). Only two blocks are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, texts, out = None, [], [], []

        def close():
            if len(keys) > 1:
                found = links([shingles(np.frombuffer(t, np.uint8), s.words) for t in texts], s.percent)
                out.extend((min(keys[i], keys[j]), max(keys[i], keys[j])) for i, j in found)

        def give():
            a, b = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            groups = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for i, group in enumerate(groups):
                if group != now:
                    close()
                    now, keys, texts = group, [], []
                keys.append(batch.column(3)[i].as_py())
                texts.append(batch.column(4)[i].as_py())
            if len(out) > 10_000:
                yield give()
        close()
        if out:
            yield give()

    return run


def _blocks(members: Column, shingles: Column, s: Settings) -> Column:
    """How many blocks hold so many members with so many shingles."""
    return F.greatest(F.ceil(members / s.block), F.ceil(shingles / s.block_shingles)).cast("int")


def _block(seed: int, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("key")), blocks).cast("int")


def _place(bucket: Column, one: Column, two: Column) -> Column:
    return F.struct(bucket.alias("bucket"), one.cast("int").alias("one"), two.cast("int").alias("two"))


def _first_places() -> Column:
    """The blocks of (key, groups) in which a text is compared first: its small buckets, and its block of its largest bucket."""
    small = F.transform(F.filter("groups", lambda g: g["blocks"] == 1), lambda g: _place(g["bucket"], F.lit(0), F.lit(0)))
    large = F.array_max(F.transform(F.filter("groups", lambda g: g["blocks"] > 1), lambda g: F.struct(g["m"].alias("m"), g["bucket"].alias("bucket"), g["blocks"].alias("blocks"))))
    own = _block(0, large["blocks"])
    return F.concat(small, F.when(large.isNotNull(), F.array(_place(large["bucket"], own, own))).otherwise(F.array().cast("array<struct<bucket:bigint,one:int,two:int>>")))


def _second_places(groups: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """(key, check, places) of the members of large buckets that more than one component has: blocks of those outside the
    largest component against blocks of all."""
    large = groups.select("key", "check", "n_shingles", F.explode(F.filter("groups", lambda g: g["blocks"] > 1)).alias("g"))
    large = large.select("key", "check", "n_shingles", "g.bucket", "g.blocks").join(found, F.col("key") == F.col("node"), "left")
    large = large.select("key", "check", "n_shingles", "bucket", "blocks", F.coalesce("component", "key").alias("component"))
    tally = large.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    tally = tally.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "shingles", "component")).alias("lead")).where(F.col("n") > F.col("lead.n"))
    outside = _blocks(F.col("n") - F.col("lead.n"), F.col("shingles") - F.col("lead.shingles"), s)
    tally = tally.select("bucket", F.col("lead.component").alias("lead"), outside.alias("columns"))
    large = large.join(tally, "bucket")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    among_all = F.transform(upto(F.col("columns")), lambda i: _place(F.col("bucket"), _block(1, F.col("blocks")), i))
    among_outside = F.transform(upto(F.col("blocks")), lambda i: _place(F.col("bucket"), i, _block(2, F.col("columns"))))
    places = F.when(F.col("component") == F.col("lead"), among_all).otherwise(F.array_distinct(F.concat(among_all, among_outside)))
    return large.groupBy("key", "check").agg(F.flatten(F.collect_list(places)).alias("places"))


def _placed(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Each text that has places, once."""
    return docs.join(places, ["key", "check"]).dropDuplicates(["key", "check"])


def _compared(docs: DataFrame, places: DataFrame, s: Settings) -> tuple[DataFrame, str]:
    """The links (a, b) among the texts that meet in one of their places, as a written table, and its path.

    The text itself travels: compressed, it is half the size of its shingles' hashes.
    """
    dealt = _placed(docs, places).select(F.explode("places").alias("p"), "key", F.col("text").cast("binary").alias("body")).select("p.bucket", "p.one", "p.two", "key", "body")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["bucket", "one", "two"]
    return written(dealt.repartition(4 * n, *order).sortWithinPartitions(*order).mapInArrow(_verify(s), "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row as key, n_shingles, component_id (the smallest key it is linked with) and kept.

    The key must be a whole number.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(docs[key].cast("long").alias("key"), F.hash(docs[text]).alias("check"), docs[text].alias("text"))
    features, features_path = written(docs.mapInArrow(_features(s), "key long, check int, n_shingles long, d1 long, d2 long, bands array<long>"), "features")
    linkable = features.where("n_shingles > 0 and key is not null")
    classes = linkable.groupBy("d1", "d2", "n_shingles").agg(F.min("key").alias("rep"), F.min_by("check", "key").alias("rep_check"))
    classes, classes_path = written(classes, "classes")
    reps = classes.select(F.col("rep").alias("key"), F.col("rep_check").alias("check"), "d1", "d2")
    # One row stands for a class, also where rows repeat; the join has dealt and sorted by these columns.
    bands = linkable.join(reps, ["key", "check", "d1", "d2"], "left_semi").dropDuplicates(["key", "check", "d1", "d2"]).select("key", "check", "n_shingles", "bands")
    banded = bands.select("key", "check", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("shingles"), F.bit_xor(F.xxhash64("key", "check")).alias("who"), F.min("key").alias("least")).where("m > 1")
    # Pairs of texts share many bands: of buckets with the same members one is enough.
    buckets = buckets.groupBy("m", "who", "shingles", "least").agg(F.min("bucket").alias("bucket"))
    blocks = _blocks(F.col("m"), F.col("shingles"), s)
    groups = banded.join(buckets.select("bucket", "m", blocks.alias("blocks")), "bucket")
    groups = groups.groupBy("key", "check", "n_shingles").agg(F.collect_list(F.struct("bucket", "m", "blocks")).alias("groups"))
    groups, groups_path = written(groups, "groups")
    # The first places are as many as the candidates and outgrow any broadcast, so they are joined by a merge at every size, and disk follows the input.
    first = groups.select("key", "check", _first_places().alias("places")).hint("merge")
    edges, edges_path = _compared(docs, first, s)
    found, found_path = components(edges)
    places, places_path = written(_second_places(groups, found, s), "places")
    if not places.isEmpty():
        more, more_path = _compared(docs, places, s)
        # The stars found so far stand for the links of the first round.
        edges = more.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        found, _ = components(edges)
        drop(spark, more_path, found_path)
    drop(spark, edges_path, groups_path, places_path)
    member = classes.join(found, classes["rep"] == found["node"], "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = features.select("key", "check", "n_shingles", "d1", "d2").join(member, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("key").isNull() | (F.col("n_shingles") == 0), F.col("key")).otherwise(F.col("component"))
    return out.select(
        F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"), "check"
    )
