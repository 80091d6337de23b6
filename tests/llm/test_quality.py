import numpy as np
import pyarrow as pa
import pytest

from loomtrace.llm import quality as q
from loomtrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op10_quality"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and len(held) > 40
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].score.min() > held[held.quality == 0].score.median()
    assert got.score.between(0, 1).all()


def test_defined_cases(spark):
    rows = [(1, "a good text with words."), (2, None), (3, ""), (4, "x" * 300_000), (1, "a good text with words."), (None, "!!! $$$")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as label")
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (9, None)], "doc_id long, quality int")
    model = q.train(docs, labels)
    got = q.predict(docs, model, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert q.predict(docs.limit(0), model, ["doc_id"]).count() == 0
    none = q.train(docs, labels.limit(0))
    assert {r.score for r in q.predict(docs, none, ["doc_id"]).collect()} == {0.5}


def test_pairs_learn_what_single_tables_cannot():
    rng = np.random.default_rng(5)
    x = np.zeros((3000, len(q.FEATURES)))
    x[:, 3:5] = rng.random((3000, 2))
    y = ((x[:, 3] > 0.5) ^ (x[:, 4] > 0.5)).astype(int)
    model = q.fit(x[:2000], y[:2000])
    assert ((q.score(x[2000:], model) > 0.5) == y[2000:]).mean() > 0.9
    assert (3, 4) in model.pairs


def test_features_do_not_depend_on_the_batch():
    texts = ["One two. Two one!", "", None, "É é\nline\nline\n", "$$$ a%%%"]
    assert np.allclose(q.feature_rows(pa.array(texts)), np.concatenate([q.feature_rows(pa.array([t], pa.string())) for t in texts]))
    assert np.isfinite(q.feature_rows(pa.array(texts))).all()


def plain_score(row, m):
    """The model's score by one lookup at a time."""
    z = m.base
    for k, t in enumerate(m.tables):
        z += t[sum(row[k] >= c for c in m.cuts[k])]
    for (i, j), t in zip(m.pairs, m.pair_tables):
        z += t[sum(row[i] >= c for c in m.coarse[i])][sum(row[j] >= c for c in m.coarse[j])]
    return 1 / (1 + np.exp(-(m.slope * z + m.shift)))


def test_scores_equal_plain_lookups():
    rng = np.random.default_rng(2)
    x = rng.random((400, len(q.FEATURES))).round(1)
    model = q.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(int))
    assert np.allclose(q.score(x, model), [plain_score(r, model) for r in x])


def test_clashing_names_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, score int")
    with pytest.raises(ValueError):
        q.predict(docs, q.fit(np.zeros((0, len(q.FEATURES))), np.zeros(0)), ["doc_id", "score"])
