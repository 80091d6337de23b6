"""Quality classifier: a generalised additive model with pairwise interactions.

Whole texts become a few numbers about their characters, words, lines and repeats. Each number is
binned; boosting goes round the features in turn and adds, each time, a tree of at most three leaves
over one feature's bins, fitted to the current gradient, to that feature's lookup table. Then the
pairs of features whose bins explain most of what is left get tables of two dimensions in the same
way, from trees of at most four leaves. A text scores the sum of its bins' entries, put through a
logistic curve that is calibrated on rows kept out of the training.

The sample of labelled rows is bounded and drawn by a hash of the key; only its numbers, never its
texts, go to the driver.

Defined cases: a null text is empty; an empty text has a score like any other; without labels of
both kinds every score is the share of label 1 (0.5 without labels); of a key's several labels all
count; repeated rows give repeated rows; very long texts are read whole; an empty table gives an empty one; other columns are
ignored unless named in ``keep``, and no kept column may be called score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import share_below, small_batches, text_bytes
from loomtrace.llm.html import STOP_WORDS
from loomtrace.llm.neardup import _mix
from loomtrace.llm.substrings import _POWERS

_U = np.uint64
FEATURES = (
    "log_bytes log_words word_bytes capitals digits punctuation symbols exclamations other_bytes spaces stop_words distinct_words "
    "repeated_pairs repeated_triples log_line_bytes short_lines repeated_lines words_per_stop long_words top_word odd_ends"
).split()


@dataclass(frozen=True)
class Settings:
    """rows: most labelled rows used; bins: of a feature; coarse: bins of a feature in a pair; pairs: how many are learnt."""

    rows: int = 8000
    bins: int = 32
    coarse: int = 8
    pairs: int = 8
    rounds: int = 120
    pair_rounds: int = 60
    rate: float = 0.1
    ridge: float = 2.0
    seed: int = 11


def _classes() -> np.ndarray:
    """A class for each byte: 1 capital, 2 small, 3 digit, 4 space, 5 end of sentence, 6 other punctuation, 7 symbol, 8 beyond ASCII."""
    c = np.full(256, 8, np.uint8)
    c[:128] = 7
    c[65:91], c[97:123], c[48:58] = 1, 2, 3
    c[[0x20, *range(0x09, 0x0E)]] = 4
    c[[ord(x) for x in ".!?"]] = 5
    c[[ord(x) for x in ",;:'\"()-"]] = 6
    return c


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDY = (_CLASS <= 3) | (_CLASS == 8)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)
    up, down = _POWERS.upto(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:n], out=sums[1:])
    return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def _stops() -> np.ndarray:
    out = []
    for w in sorted(STOP_WORDS):
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(_hashes(b, np.array([0]), np.array([len(b)]))[0])
    return np.sort(np.array(out, _U))


_STOP = _stops()


def _edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _repeated(x: np.ndarray) -> float:
    return 1 - len(np.unique(x)) / len(x) if len(x) else 0.0


def features(data: np.ndarray) -> np.ndarray:
    """FEATURES of one text's bytes."""
    n = len(data)
    if not n:
        return np.zeros(len(FEATURES))
    kinds = _CLASS[data]
    count = np.bincount(kinds, minlength=9)
    letters = count[1] + count[2] + count[8] // 2
    start, end = _edges(_WORDY[data])
    w = len(start)
    low = _LOWER[data]
    found = _hashes(low, start, end) if w else np.zeros(0, _U)
    known = _STOP[np.minimum(np.searchsorted(_STOP, found), len(_STOP) - 1)] == found
    unique, often = np.unique(found, return_counts=True)
    two = _mix(found[:-1]) + found[1:]
    three = _mix(two[:-1]) + found[2:] if w > 2 else found[:0]
    lines_from, lines_to = _edges(data != 10)
    size = lines_to - lines_from
    length = end - start
    ends = count[5]
    # Chunks between white space that end in a sign which is none of a sentence's.
    gap = kinds == 4
    _, chunk_end = _edges(~gap)
    odd = (kinds[chunk_end - 1] == 7).mean() if len(chunk_end) else 0.0
    return np.array(
        [
            np.log1p(n),
            np.log1p(w),
            length.mean() if w else 0.0,
            count[1] / max(1, letters),
            count[3] / n,
            count[6] / n,
            count[7] / n,
            (data == 33).sum() / n,
            count[8] / n,
            count[4] / n,
            known.mean() if w else 0.0,
            len(unique) / w if w else 0.0,
            _repeated(two),
            _repeated(three),
            np.log1p(size.mean()) if len(size) else 0.0,
            (size < 20).mean() if len(size) else 0.0,
            _repeated(_hashes(data, lines_from, lines_to)) if len(size) else 0.0,
            w / (ends + 1),
            (length > 14).mean() if w else 0.0,
            often.max() / w if w else 0.0,
            odd,
        ]
    )


def feature_rows(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    rows = [features(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return np.array(rows).reshape(len(rows), len(FEATURES))


@dataclass
class Model:
    """cuts: the bins' borders of each feature, and of its coarse bins; tables: log odds of each bin."""

    base: float
    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    slope: float
    shift: float


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)], axis=1) if len(cuts) else np.zeros((len(x), 0), np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _leaf(g, h, ridge):
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """The step of each bin from the best tree of at most three leaves over ordered bins."""
    gs, hs = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    n = len(g)
    i, j = np.triu_indices(n + 1)
    keep = (i > 0) & (j >= i)
    i, j = i[keep], j[keep]
    gain = _leaf(gs[i], hs[i], ridge) + _leaf(gs[j] - gs[i], hs[j] - hs[i], ridge) + _leaf(gs[n] - gs[j], hs[n] - hs[j], ridge)
    k = int(np.argmax(gain))
    out = np.zeros(n)
    for a, b in ((0, i[k]), (i[k], j[k]), (j[k], n)):
        if b > a:
            out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The step of each cell from the best tree of two levels over a pair's bins, and its gain."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        total = _leaf(gg.sum(), hh.sum(), ridge)
        for cut in range(1, len(gg)):
            step, gain = np.zeros_like(gg), -total
            for part in (slice(0, cut), slice(cut, None)):
                gs, hs = np.cumsum(gg[part].sum(axis=0)), np.cumsum(hh[part].sum(axis=0))
                inner = _leaf(gs, hs, ridge) + _leaf(gs[-1] - gs, hs[-1] - hs, ridge)
                k = int(np.argmax(inner))
                gain += inner[k]
                step[part, : k + 1] = gs[k] / (hs[k] + ridge)
                step[part, k + 1 :] = (gs[-1] - gs[k]) / (hs[-1] - hs[k] + ridge)
            if gain > best:
                best, out = gain, step.T if flip else step
    return out, best


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Model:
    """Train on rows of FEATURES and labels 0 or 1."""
    y = y.astype(float)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Model(base, [], [], [], [], [], 1.0, 0.0)
    rng = np.random.default_rng(s.seed)
    held = rng.random(len(y)) < 0.2
    if y[~held].min() == y[~held].max() or y[held].size == 0 or y[held].min() == y[held].max():
        held = np.zeros(len(y), bool)
    quantiles = lambda n: [np.unique(np.quantile(x[~held][:, k], np.linspace(0, 1, n + 1)[1:-1])) for k in range(x.shape[1])]
    cuts, coarse = quantiles(s.bins), quantiles(s.coarse)
    b, cb = _bins(x, cuts), _bins(x, coarse)
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(len(y), base)
    train = np.flatnonzero(~held)
    for _ in range(s.rounds):
        for k, t in enumerate(tables):
            p = _sigmoid(z[train])
            g = np.bincount(b[train, k], y[train] - p, len(t))
            h = np.bincount(b[train, k], p * (1 - p), len(t))
            step = s.rate * _tree(g, h, s.ridge)
            t += step
            z += step[b[:, k]]

    def cell_sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        cell = cb[:, i] * shape[1] + cb[:, j]
        p = _sigmoid(z[train])
        size = shape[0] * shape[1]
        return np.bincount(cell[train], y[train] - p, size).reshape(shape), np.bincount(cell[train], p * (1 - p), size).reshape(shape), cell, shape

    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            g, h, _, shape = cell_sums(i, j)
            if min(shape) > 1:
                gains.append((_pair_tree(g, h, s.ridge)[1], i, j))
    pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[: s.pairs]]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(s.pair_rounds):
        for (i, j), t in zip(pairs, pair_tables):
            g, h, cell, _ = cell_sums(i, j)
            step = s.rate * _pair_tree(g, h, s.ridge)[0]
            t += step
            z += step.ravel()[cell]
    # Calibrate log odds on the rows kept out: a few Newton steps for slope and shift.
    check = np.flatnonzero(held) if held.any() else train
    a, c = 1.0, 0.0
    for _ in range(25):
        p = _sigmoid(a * z[check] + c)
        w = p * (1 - p)
        g = np.array([((y[check] - p) * z[check]).sum() - (a - 1), (y[check] - p).sum() - c])
        m = np.array([[(w * z[check] ** 2).sum() + 1, (w * z[check]).sum()], [(w * z[check]).sum(), w.sum() + 1]])
        da, dc = np.linalg.solve(m, g)
        a, c = float(np.clip(a + da, 0.05, 3)), float(np.clip(c + dc, -5, 5))
    return Model(base, cuts, coarse, tables, pairs, pair_tables, a, c)


def score(x: np.ndarray, m: Model) -> np.ndarray:
    """The chance of label 1 for rows of FEATURES, by adding up entries of tables."""
    b, cb = _bins(x, m.cuts), _bins(x, m.coarse)
    z = np.full(len(x), m.base)
    for k, t in enumerate(m.tables):
        z += t[b[:, k]]
    for (i, j), t in zip(m.pairs, m.pair_tables):
        z += t[cb[:, i], cb[:, j]]
    return _sigmoid(m.slope * z + m.shift)


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on at most about ``rows`` labelled rows; docs holds the rows that may be learnt from."""
    small_batches(docs.sparkSession)
    known = labels.where(labels[label].isNotNull() & labels[key].isNotNull()).select(labels[key].alias("_key"), labels[label].cast("int").alias("label"))
    n = known.count()
    share = min(1.0, 1.25 * s.rows / max(n, 1))
    drawn = known.where(F.xxhash64(F.col("_key").cast("string"), F.lit("quality")) <= share_below(share))
    # The bound on the rows drawn bounds what is broadcast.
    rows = docs.select(docs[key].alias("_own"), docs[text].alias("text")).join(F.broadcast(drawn), F.col("_own") == F.col("_key")).select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_rows(batch.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["label", "x"])

    got = rows.mapInArrow(run, "label int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, len(FEATURES))
    y = got.column("label").to_numpy()
    order = np.lexsort((*x.T, y))
    return fit(x[order], (y[order] > 0).astype(int), s)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the score of every whole text."""
    small_batches(docs.sparkSession)
    if "score" in {c.lower() for c in keep}:
        raise ValueError("no column to keep may be called score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = score(feature_rows(batch.column(batch.num_columns - 1)), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got)], names=[*keep, "score"])

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, f"{fields}, score double")
