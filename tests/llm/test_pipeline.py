import hashlib
import sys
from pathlib import Path

from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline as cp  # noqa: E402
from loomtrace.llm.queries import vocabulary  # noqa: E402

from .test_decontaminate import ITEMS  # noqa: E402
from .test_lines import brute as brute_lines  # noqa: E402
from .test_neardup import brute as brute_near  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = spark.createDataFrame([(9001, "12 34 !!", None, "s", 8), (9002, None, "en", "s", 0), (9003, "It was here. " + ITEMS[1][1] + " So it goes.", "en", "s", 90)], docs.schema)
    docs = docs.unionByName(planted)
    sf = str(tmp_path)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(9000, ITEMS[1][1])], "item_id long, text string"))
    items.write.parquet(f"{sf}/benchmark.parquet")
    texts = {r.item_id: r.text for r in items.collect()}
    kept = {}
    for name, stage in cp.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf)
        if name != "tokens":
            assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        after = docs.collect()
        docs = spark.createDataFrame(after, docs.schema)
        ids, old = {r.doc_id for r in after}, {r.doc_id: r for r in before}
        kept[name] = ids
        if name == "language":
            assert set(old) - ids >= {9001, 9002} and len(set(old) - ids) <= 3
        elif name == "repeated_lines":
            want = {i: t for i, t, _ in brute_lines([(r.doc_id, r.text) for r in before])}
            assert {r.doc_id: r.text for r in after} == want
        elif name == "near_copies":
            assert ids == {int(i) for i, _, _, k in brute_near([(r.doc_id, r.text) for r in before], 5, 80) if k}
        elif name == "benchmark_passages":
            holds = {i for i, r in old.items() if any(t in r.text for t in texts.values())}
            assert 9003 in holds and not holds & ids and set(old) - ids == holds
        else:
            library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
            for r in after:
                want = library.encode(old[r.doc_id].text, add_special_tokens=False).ids
                assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


def test_defined_cases(spark, tmp_path):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    real = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 300").limit(60)
    one = real.first()
    odd = [(9001, None, None, "s", 0), (9002, "", "en", "s", 0), (None, one.text + " more of it", "en", "s", 9), (9003, one.text, one.lang, "s", 1), (9003, one.text, one.lang, "s", 1), (9004, one.text * 200, one.lang, "s", 1)]
    docs = real.unionByName(spark.createDataFrame(odd, real.schema)).selectExpr("*", "'x' as check", "1 as key", "'t' as score", "2 as n_tokens")
    for start in (docs, docs.limit(0)):
        at = start
        for name, stage in cp.STAGES:
            at = stage(spark, at, str(tmp_path))
            rows = at.collect()
            at = spark.createDataFrame(rows, at.schema)
            if name != "tokens":
                assert at.columns == docs.columns
        left = {r.doc_id for r in rows}
        if start is docs:
            # Line dedup takes the repeated windows out of 9003, both of whose rows then go or stay together.
            assert not left & {9001, 9002} and None in left and len(left) > 40
            assert sum(r.doc_id == 9003 for r in rows) in (0, 2)
        else:
            assert not rows
