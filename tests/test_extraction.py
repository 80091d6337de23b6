"""Knowledge extraction over documents: every row, line and source counts."""

from loomtrace.operators import linguistic as L
from loomtrace.plans import all_queries  # noqa: F401
from loomtrace.plans.catalogue import QUERIES


def tables(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "The dog makes a house.")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_all_documents_with_their_language(spark, tmp_path):
    sf = tables(spark, tmp_path, [(7, "Nothing\n\n The parser creates a tree. \nThe reader makes texts", "en"), (8, "The parser sends a list.", "de"), (9, None, "fr"), (10, "The tool adds a row.", None)])
    got = {(r.doc, r.subj, r.obj) for r in QUERIES["extract_triplets"](spark, sf).collect()}
    assert got == {("7", "parser", "tree"), ("7", "reader", "texts"), ("8", "parser", "list"), ("10", "tool", "row")}
    edges = QUERIES["sourced_graph"](spark, sf)
    assert {r.o for r in edges.where("p like '%anguage%'").collect()} == {"en", "de"}
    assert edges.where("o = 'The parser creates a tree.'").count() >= 1
    words = {r.concept: r["count"] for r in QUERIES["word_dictionary"](spark, sf).collect()}
    assert words["parser"] == 2 and words["row"] == 1 and "dog" not in words


def test_hot_lemma_keeps_all_sources(spark, tmp_path):
    rows = [(i, f"The parser creates a tree{i}. The parser creates a tree{i}.", "en") for i in range(50)]
    got = {r.concept: r for r in QUERIES["word_dictionary"](spark, tables(spark, tmp_path, rows)).collect()}
    assert got["parser"]["count"] == 100 and got["parser"].sources == 50 and got["tree7"].sources == 1


def test_near_cores_are_all_pairs_that_hold():
    text = "The owner of the house by the river and the friend of the owner make a map and a plan for the town in the hills with the help of the guide and send it to you. A of b of c of d in e"
    for s in L.shallow_parse(text):
        cores = [t for t in s if L.is_core(s, t)]
        found = [L.triplet(s, a, b, cores) for k, a in enumerate(cores) for b in cores[k + 1 :]]
        assert L.sentence_triplets(s) == [t for t in found if t]


def test_names_are_worked_out_once_for_each_triplet(spark, tmp_path):
    # Before, each of some 16 edges worked out the digests of its ends anew.
    sf = tables(spark, tmp_path, [(1, "The parser creates a tree. The tree holds a leaf. The reader makes texts.\nThe tool adds a row.", "en")])
    plan = QUERIES["sourced_graph"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate inline" in line and "_span" in line)
    assert "md5" not in generate
    edges = QUERIES["sourced_graph"](spark, sf)
    sentences = {r.o for r in edges.where("p = 'my:sentLabel'").collect()}
    assert sentences == {"The parser creates a tree.", "The tree holds a leaf.", "The reader makes texts.", "The tool adds a row."}
    assert edges.where("p = 'my:paraID'").count() == 4 and edges.where("p = 'my:content'").count() == 2
    assert edges.where("p = 'my:docID'").count() == 2


def test_paragraphs_leave_python_once(spark, monkeypatch):
    text = "The parser creates a tree. " * 40
    rows = spark.createDataFrame([("d", 0, text, "en"), ("e", 1, "Nothing", None), ("f", 2, None, "en")], "doc string, para_idx int, text string, language string")
    whole = sorted(tuple(r) for r in L.extract_triplets(rows).drop("part").collect())
    assert len(whole) == 40 and {r[2] for r in whole} == {text}
    assert [r.part for r in L.extract_triplets(rows).collect()] == [0] + [1] * 39
    assert "Generate inline(found" in L.extract_triplets(rows)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(L, "RESULT_CHARS", 500)
    assert sorted(tuple(r) for r in L.extract_triplets(rows).drop("part").collect()) == whole


def test_digest_without_loops(spark):
    from pyspark.sql import functions as F

    from loomtrace.functions.text import uid

    # Before, long divisions in nested loops: 98 us a row.
    rows = spark.range(300).select(F.concat(F.lit("x"), "id").alias("x"))
    out = rows.select("x", uid(F.col("x")).alias("u"))
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for r in out.collect():
        import hashlib

        n, text = int(hashlib.md5(r.x.encode()).hexdigest(), 16), ""
        while n:
            n, d = divmod(n, 36)
            text = digits[d] + text
        assert r.u == text


def test_only_asked_columns_leave_python(spark, tmp_path):
    # Before, sentences, paragraphs, lemmas and texts of predicates left Python for each triplet, and were dropped then.
    sf = tables(spark, tmp_path, [(1, "The parser creates a tree. The tree holds a leaf.\nThe tool adds a row.", "en")])
    plan = QUERIES["extract_triplets"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "sentence" not in plan and "pred_text" not in plan
    rows = L.paragraphs(spark.read.parquet(f"{sf}/documents.parquet"))
    for columns in (["obj", "doc"], ["part", "sentence", "paragraph", "verb"]):
        assert sorted(map(tuple, L.extract_triplets(rows, columns=columns).collect())) == sorted(map(tuple, L.extract_triplets(rows).select(*columns).collect()))


def test_words_are_counted_without_their_sentences(spark, tmp_path, monkeypatch):
    # Before, a sentence's text was moved once for each concept.
    said = "The owner of the small house makes a map and a plan. The house holds the owner. "
    rows = [(1, said + said, "en"), (2, said + "\n\nThe house holds the  owner.", "fr"), (3, None, "en"), (4, "It is ½ made", None)]
    sf = tables(spark, tmp_path, rows)
    assert "sentence" not in QUERIES["word_dictionary"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    lines = L.paragraphs(spark.read.parquet(f"{sf}/documents.parquet"))
    for size, pronouns in ((20_000, False), (3, True)):
        monkeypatch.setattr(L, "RESULT_ROWS", size)
        want = sorted(map(tuple, L.word_dictionary(L.extract_concepts(lines, pronouns=pronouns)).collect()))
        assert sorted(map(tuple, L.count_words(lines, pronouns=pronouns).collect())) == want and len(want) > 5
