import numpy as np

from loomtrace.plans import all_queries  # noqa: F401
from loomtrace.plans.catalogue import QUERIES


def test_no_pair_is_missed(spark, tmp_path):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((150, 32))
    v = np.concatenate([a, 0.6 * a + 0.8 * rng.standard_normal(a.shape)]).astype(np.float32)  # about 0.6 by pairs
    rows = [(i, [float(y) for y in x], 0) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = {(int(x), int(y)) for x, y in zip(*np.nonzero(np.triu(s >= 0.5, 1)))}
    got = [(r.a, r.b) for r in QUERIES["lsh_similar"](spark, str(tmp_path)).collect()]
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want
