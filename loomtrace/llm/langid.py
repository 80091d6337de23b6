"""Language identification with averaged hashed subword embeddings.

A text is the average of the embeddings of its subwords (byte n-grams of lower-cased words with
their borders), each looked up by hash. A linear softmax on top gives the language. Both are
trained together by stochastic gradient descent in numpy on a bounded, documented sample: about
``per_language`` labelled rows of each language, all languages together about ``rows`` (one each at least), drawn by a
hash of the key; of a row's text at most ``chars`` characters, from a place that a hash chooses; and a short span of each
so that short texts are not read with too much confidence. No language is left out, however many there are. A part of the sample stays out of the
training and calibrates the softmax's temperature and the scores below which a text is rejected: the
``reject`` quantile of about ``spans`` spans of that part, by length, so that small samples act like
large ones. With a single language every text with a letter gets the score 1, and none is rejected.

Since the model is linear after the lookup, embeddings and softmax weights fold into one weight per
subword and language, and a text of any length is scored whole from its subword counts.

Defined cases: a null text or one without a letter is ``und`` with score 0 and is rejected; without
any labelled row every text is ``und``; repeated rows give repeated rows; of languages with equal scores the first by
name is given; very long texts are scored whole; an empty table gives an empty one; other columns are ignored
unless named in ``keep``, and kept columns must not be called lang_pred, score or rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import share_below, small_batches, text_bytes

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint32(0x9E3779B1)


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    for c in range(26):
        t[65 + c] = t[97 + c] = 97 + c
    return t


_FOLD = _table()


@dataclass(frozen=True)
class Settings:
    """buckets: hashed subwords; dims: of an embedding; per_language: labelled rows of a language that are used, about; rows: of all languages together; chars: of a row's text; reject: share of spans of known languages that may be rejected; spans: drawn for that; lengths: in subwords, from which thresholds differ."""

    buckets: int = 1 << 13
    dims: int = 16
    grams: tuple[int, ...] = (1, 2, 3, 4)
    per_language: int = 800
    rows: int = 8000
    chars: int = 8192
    epochs: int = 5
    batch: int = 64
    rate: float = 2.0
    reject: float = 0.001
    spans: int = 4000
    lengths: tuple[int, ...] = (120, 480)
    seed: int = 7


@dataclass
class Model:
    """weights: (buckets, languages) of folded embeddings; a text scores softmax((counts @ weights / n + bias) / temperature)."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    thresholds: list[float]
    settings: Settings


def subwords(data: np.ndarray, s: Settings) -> np.ndarray:
    """Bucket numbers of all subwords of one text's bytes."""
    x = _FOLD[data]
    late = np.flatnonzero(data[:-1] == 0xC3) + 1  # capitals of the Latin-1 letters
    if len(late):
        second = x[late]
        x[late] = np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), second + 0x20, second)
    x = np.concatenate(([np.uint8(32)], x, [np.uint8(32)]))
    space = x == 32
    x = x[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint32)
    shift = np.uint32(32 - int(s.buckets).bit_length() + 1)
    out, h = [], np.zeros(len(x), np.uint32)
    for n in range(1, max(s.grams) + 1):
        h = (h[: len(x) - n + 1] ^ x[n - 1 :]) * _MIX if n > 1 else (x + np.uint32(1)) * _MIX
        h ^= h >> np.uint32(15)
        if n in s.grams:
            out.append((h * np.uint32(0x85EBCA6B)) >> shift)
    return np.concatenate(out)


def counts(data: np.ndarray, s: Settings) -> tuple[np.ndarray, int]:
    found = subwords(data, s)
    return np.bincount(found, minlength=s.buckets), len(found)


def sample(docs: DataFrame, s: Settings, key: str, text: str, lang: str) -> pd.DataFrame:
    """About per_language labelled texts of each language, drawn by a hash of the key."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = labelled.groupBy(F.col(lang).alias("lang")).count().orderBy("lang").collect()
    if not sizes:
        return pd.DataFrame({"lang": [], "text": []})
    bounds = drawn_below({r["lang"]: r["count"] for r in sizes}, s)
    bounds = _bounds_table(docs.sparkSession, bounds)
    labelled = labelled.select(F.col(key).cast("string").alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    # A row for each language.
    drawn = labelled.join(F.broadcast(bounds), F.col("lang") == F.col("_lang")).where(F.xxhash64(F.col("key"), F.lit("language")) <= F.col("_below"))
    place = F.pmod(F.xxhash64(F.col("key"), F.lit("place")), F.greatest(F.length("text") - s.chars, F.lit(0)) + 1) + 1
    drawn = drawn.select("key", "lang", F.substring(F.col("text"), place.cast("int"), F.lit(s.chars)).alias("text"))
    return drawn.toPandas().sort_values(["key", "lang", "text"], ignore_index=True)


def _bounds_table(spark: SparkSession, bounds: dict[str, int]) -> DataFrame:
    """(_lang, _below) as a local table: one made of Python rows would start more Python workers in the executors, which stay there."""
    columns = [pa.array([str(x) for x in bounds], pa.string()), pa.array(list(bounds.values()), pa.int64())]
    return spark.createDataFrame(pa.table(columns, names=["_lang", "_below"]))


def drawn_below(sizes: dict[str, int], s: Settings) -> dict[str, int]:
    """For each language the largest hash of a key that is drawn."""
    each = min(s.per_language, max(1, s.rows // max(1, len(sizes))))
    return {lang: share_below(each / n) for lang, n in sizes.items()}


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], s: Settings = Settings()) -> Model | None:
    """Train on labelled texts; None without any."""
    rng = np.random.default_rng(s.seed)
    names = sorted(set(langs))
    if not names:
        return None
    index = {n: i for i, n in enumerate(names)}
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    label, held, kept = [], [], []
    for k, (t, lang) in enumerate(zip(texts, langs)):
        words = t.split()
        if not words or not _LETTER.search(t):
            continue
        kept.append((k % 5 == 4, words))
        start = int(rng.integers(0, len(words)))
        for part in (t, " ".join(words[start : start + int(rng.integers(1, 21))])):
            if _LETTER.search(part):
                ids, n = np.unique(subwords(np.frombuffer(part.encode(), np.uint8), s), return_counts=True)
                bags.append((ids, (n / n.sum()).astype(np.float32)))
                label.append(index[lang])
                held.append(k % 5 == 4)
    if not bags:
        return None
    label, held = np.array(label), np.array(held)
    embed = (rng.standard_normal((s.buckets, s.dims)) * 0.1).astype(np.float32)
    soft = np.zeros((s.dims, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), s.buckets), np.float32)
        for i, r in enumerate(rows):
            x[i, bags[r][0]] = bags[r][1]
        return x

    train = np.flatnonzero(~held)
    if not len(train):
        train = np.arange(len(bags))
    soft += (rng.standard_normal(soft.shape) * 0.1).astype(np.float32)
    steps, done = max(1, s.epochs * -(-len(train) // s.batch)), 0
    for _ in range(s.epochs):
        for rows in np.array_split(rng.permutation(train), -(-len(train) // s.batch)):
            x, rate = dense(rows), s.rate * (1 - done / steps)
            h = x @ embed
            d = _softmax(h @ soft + bias)
            d[np.arange(len(rows)), label[rows]] -= 1
            d /= len(rows)
            back = d @ soft.T
            soft -= rate * (h.T @ d)
            bias -= rate * 0.1 * d.sum(axis=0)
            # A text spreads its gradient over thousands of subwords: embeddings take longer steps.
            embed -= rate * 50 * (x.T @ back)
            done += 1
    weights = (embed @ soft).astype(np.float32)
    check = np.flatnonzero(held) if held.any() else train
    logits = np.concatenate([dense(r) @ weights + bias for r in np.array_split(check, -(-len(check) // 256))])
    truth = label[check]
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.clip(_softmax(logits / t)[np.arange(len(check)), truth], 1e-12, None)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    known = [w for h, w in kept if h] or [w for _, w in kept]
    thresholds = _thresholds(known, weights, bias, temperature, s)
    return Model(names, weights, bias, temperature, thresholds, s)


def _thresholds(texts: list[list[str]], weights: np.ndarray, bias: np.ndarray, temperature: float, s: Settings) -> list[float]:
    """The score below which a text is rejected, for each range of lengths."""
    rng = np.random.default_rng(s.seed + 1)
    best, size = [], []
    for words in texts:
        parts = [words]
        for _ in range(-(-s.spans // len(texts))):
            start = int(rng.integers(0, len(words)))
            parts.append(words[start : start + int(rng.integers(1, 41))])
        for part in map(" ".join, parts):
            if _LETTER.search(part):
                ids, n = np.unique(subwords(np.frombuffer(part.encode(), np.uint8), s), return_counts=True)
                size.append(int(n.sum()))
                best.append(_softmax((n @ weights[ids] / n.sum() + bias) / temperature).max())
    best, at = np.array(best), np.searchsorted(s.lengths, size, "right")
    # Never above the middle between an even spread over the languages and certainty.
    most = (1 + 1 / len(bias)) / 2
    return [float(min(most, np.quantile(best[at == k] if (at == k).any() else best, s.reject))) for k in range(len(s.lengths) + 1)]


def train(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    found = sample(docs, s, key, text, lang)
    return fit(list(found["text"]), list(found["lang"]), s)


def score_batch(texts: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    langs, scores, reject = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
    if model is None:
        return langs, scores, reject
    s = model.settings
    for i in range(n):
        own = data[offsets[i] : offsets[i + 1]]
        if not len(own):
            continue
        if not ((own | 32) - 97 < 26).any() and not _LETTER.search(own.tobytes().decode("utf-8", "replace")):
            continue
        c, total = counts(own, s)
        p = _softmax((c @ model.weights / total + model.bias) / model.temperature)
        best = int(np.argmax(p))
        langs[i], scores[i] = model.languages[best], float(p[best])
        reject[i] = scores[i] < model.thresholds[int(np.searchsorted(s.lengths, total, "right"))]
    return langs, scores, reject


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, then lang_pred, score and rejected, of every row."""
    small_batches(docs.sparkSession)
    schema = docs.select(*keep).schema
    names = [*keep, "lang_pred", "score", "rejected"]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("columns to keep must not be called lang_pred, score or rejected")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, reject = score_batch(batch.column(batch.num_columns - 1), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores), pa.array(reject)], names=names)

    chosen = docs.select(*keep, docs[text].alias("_text"))
    return chosen.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")
