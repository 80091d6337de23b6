import numpy as np
import pyarrow as pa

from loomtrace.llm import langid
from loomtrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_rejection(spark):
    got = QUERIES["op1_language"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars").toPandas()
    both = got.merge(docs, on="doc_id")
    held = both[both.held_out & both.lang.notna()]
    assert len(got) == len(docs) and len(held) > 200
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert both.score.between(0, 1).all()
    assert both[both.n_chars > 100].rejected.mean() < 0.01


def test_defined_cases(spark):
    rows = [(1, "the house and the tree " * 5, "en"), (2, "la maison et le chat " * 5, "fr"), (2, "la maison et le chat " * 5, "fr")]
    rows += [(3, None, "en"), (4, "", None), (5, "12 !! 34", None), (6, "the " * 200_000, None), (None, "la maison", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as score", "true as rejected")
    model = langid.train(docs)
    got = langid.predict(docs, model, ["doc_id"]).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (3, 4, 5)] == ["und"] * 3 and all(by[k].rejected and by[k].score == 0 for k in (3, 4, 5))
    assert by[6].lang_pred == "en" and by[2].lang_pred == "fr"
    assert langid.train(docs.where("lang is null")) is None
    assert {r.lang_pred for r in langid.predict(docs, None, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model, ["doc_id"]).count() == 0


def test_scores_do_not_depend_on_the_batch():
    model = langid.fit(["the house and the tree"] * 10 + ["la maison et le chat"] * 10, ["en"] * 10 + ["fr"] * 10)
    texts = ["the tree", "LE CHAT", None, "É", "x"]
    alone = [langid.score_batch(pa.array([t], pa.string()), model)[1][0] for t in texts]
    assert np.allclose(alone, langid.score_batch(pa.array(texts), model)[1])


def test_small_samples_reject_unseen_languages():
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/documents.parquet", columns=["text", "lang"]).to_pandas().dropna()
    other = ["to jest zdanie po polsku o domu i lesie oraz o rzece która płynie przez miasto " * 3, "ez egy magyar nyelvű szöveg a házról és az erdőről " * 5]
    odd = pa.array(other)
    for n in (500, 700, 1000):
        model = langid.fit(list(t.text[:n]), list(t.lang[:n]))
        assert langid.score_batch(odd, model)[2].all()
        long = [x for x in t.text if len(x) > 100]
        assert langid.score_batch(pa.array(long), model)[2].mean() < 0.005


def test_every_language_is_drawn_at_any_size():
    s = langid.Settings()
    sizes = {f"l{i}": n for i, n in enumerate([1, 10**9, 10**11, 10**15] + [5000] * 600)}
    found = langid.drawn_below(sizes, s)
    for lang, n in sizes.items():
        share = (found[lang] + 2**63 + 1) / 2**64
        assert n * share >= 0.9 * min(n, 1) and n * share <= s.per_language * 1.01
        if n >= 5000:
            assert abs(n * share - s.rows // len(sizes)) <= 1


def test_more_languages_than_any_list_holds(spark):
    rows = [(i, f"{'abcdefghij'[i // 30 % 10]}{'klmnopqrst'[i // 300]} {'uvwxyzabcd'[i // 300]}{'efghijklmn'[i // 30 % 10]} " * 4, f"l{i // 10}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == 300


def test_bounds_start_no_python_workers(spark):
    found = langid._bounds_table(spark, {"en": 5, "é": -(2**63)})
    assert sorted(map(tuple, found.collect())) == [("en", 5), ("é", -(2**63))]
    plan = found._jdf.queryExecution().toString()
    assert "RDD" not in plan and "LocalTableScan" in plan
