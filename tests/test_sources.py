import json

from pyspark.sql import functions as F

from loomtrace.providers import DEFAULT
from loomtrace.sources import readers
from loomtrace.sources.memo import Memo, load_or_create
from loomtrace.streaming import jobs


def test_read_path(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.txt").write_text("One line\nwrapped.\n\n\n\nTwo\n\n  \n")
    (tmp_path / "in" / "b.html").write_text("<h1>Top</h1><h2>Sub</h2><p>Text &amp; more<p>Text &amp; more</p><h1>New</h1><p>Last<script>x</script></p>")
    (tmp_path / "c.json").write_text(json.dumps({"@id": "x", "p": ["a", "b"], "q": {"r": {"@value": "long text"}}}))
    (tmp_path / "d.akn").write_text("<akn><article eId='art_1'><list><intro>If:</intro><point><p>it rains</p></point></list></article></akn>")
    (tmp_path / "e.bin").write_text("ignored")
    (tmp_path / "bad.json").write_text("{")
    paragraphs, triples = readers.read_path(spark, str(tmp_path))
    texts = {r.text: r.annotation for r in paragraphs.collect()}
    assert {"One line wrapped.", "Two", "If: it rains", "a", "b", "long text", "Text & more", "Last"} == set(texts)
    assert json.loads(texts["Text & more"]) == ["Top", "Sub"] and json.loads(texts["Last"]) == ["New"]
    got = {(r.s, r.p, r.o) for r in triples.collect()}
    assert {("x", "p", "a"), ("x", "p", "b")} <= got and any(p == "r" and o == "long text" for _, p, o in got)


def test_pages_glue_and_chunks(spark):
    pages = spark.createDataFrame([("d", 1, "A one\n\nB two"), ("d", 2, "three\n\nC four")], "doc_id string, page int, text string")
    got = readers.page_paragraphs(pages).orderBy("para_idx").collect()
    assert [(r.page_id, r.text) for r in got] == [("1", "A one"), ("1 - 2", "B two three"), ("2", "C four")]
    rows = readers.from_rows(spark, ["a b c", {"id": "x", "text": "d e"}])
    assert [r.text for r in readers.chunks(rows, 2, 1).where("doc_id = 'x'").orderBy("chunk_idx").collect()] == ["d e", "e"]


def test_tables(spark, tmp_path):
    csv = tmp_path / "q.csv"
    csv.write_text('Title,Body,AnswerBody,ViewCount\nA,"b, ""x""\ny",a1,10\nB,b,,90\nC,b,a2,oops\nA,b2,a3,5\n')
    got = readers.top_viewed(readers.read_questions(spark, str(csv)), 3).collect()
    assert {(r.Title, r.AnswerBody) for r in got} == {("A", "a3")}
    rows = spark.createDataFrame([("RAG", ["x", "y"])], "tool string, labels array<string>")
    readers.write_results(rows, str(tmp_path / "out"))
    assert spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "out")).first().labels == '["x","y"]'


def test_memo_and_streams(spark, tmp_path):
    memo = Memo(spark, str(tmp_path / "memo"))
    asked = []

    def fetch(misses):
        asked.extend(r.key for r in misses.collect())
        return misses.withColumn("value", F.upper("key"))

    requests = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "ord int, key string")
    assert [(r.ord, r.value) for r in memo.get(requests, "t", fetch).orderBy("ord").collect()] == [(0, "B"), (1, "A"), (2, "B")]
    memo.get(requests, "t", fetch).count()
    assert sorted(asked) == ["a", "b"] and memo.size() == 2
    src = str(tmp_path / "src")
    spark.createDataFrame([("a", "1", 5), ("z", "2", 6), ("a", "3", 7)], "key string, value string, version long").write.parquet(src)
    stream = spark.readStream.schema("key string, value string, version long").parquet(src)
    jobs.upsert_stream(stream, memo, "t", str(tmp_path / "c1")).awaitTermination(60)
    assert {r.key: r.value for r in memo.latest().collect()} == {"a": "3", "b": "B", "z": "2"}
    jobs.process_once(stream.select("key"), memo, "other", fetch, str(tmp_path / "c2")).awaitTermination(60)
    assert {r.key for r in memo.latest().where("type = 'other'").collect()} == {"a", "z"}
    assert load_or_create(spark, str(tmp_path / "t"), lambda: requests).count() == 3 == load_or_create(spark, str(tmp_path / "t"), lambda: 1 / 0).count()


def test_providers(spark):
    row = spark.createDataFrame([("The cat was on the mat and it is good",)], "t string").select(DEFAULT.language(F.col("t")).alias("l"), DEFAULT.tagger(F.col("t")).alias("v"), F.size(DEFAULT.embedding(F.col("t"))).alias("n"), DEFAULT.generation(F.lit("x Contents: yes")).alias("g")).first()
    assert (row.l, row.v, row.n, row.g) == ("en", True, 64, "yes")


def test_long_documents_leave_in_parts(spark, monkeypatch):
    from loomtrace.sources import readers

    docs = spark.createDataFrame([(str(i), f"<h1>Head</h1><p>first {i}</p><p>second {i}</p><p>first {i}</p>".encode()) for i in range(40)], "doc_id string, content binary").coalesce(1)
    whole = sorted(tuple(r) for r in readers.html_text(docs).collect())
    assert len(whole) == 80
    # Before, 10,000 documents were taken at once, whatever their length.
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
    monkeypatch.setattr(readers, "RESULT_CHARS", 300)
    assert sorted(tuple(r) for r in readers.html_text(docs).collect()) == whole
