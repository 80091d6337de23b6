"""Reading documents into paragraphs, and results and study files into typed rows.

Files are found and read by Spark's own readers, so any file system that Spark knows will do; only
what parses one document's text runs as a function over it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.functions.text import clean_content, is_url
from loomtrace.functions.vocabulary import LABEL
from loomtrace.operators.ordered import first_seen, glue_pages, token_windows

PARAGRAPHS = "doc_id string, para_idx int, text string, annotation string"
TRIPLES = "doc_id string, s string, p string, o string"
TEXT_KINDS = ("txt", "log", "md", "html", "htm", "json", "akn", "pdf")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, kind, content) of every file below a path whose kind is known."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select(F.col("path").alias("doc_id"), kind.alias("kind"), "content").where(F.col("kind").isin(*TEXT_KINDS))


def _decoded(content) -> str:
    raw = bytes(content)
    for code in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(code)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


#: Characters that a batch of results holds at most, beyond one row; rows and bytes of a batch of documents.
RESULT_CHARS = 4_000_000
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def _each(docs: DataFrame, parse: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for d, c in zip(batch["doc_id"], batch["content"]):
                for r in parse(d, _decoded(c)):
                    rows.append((d, *r))
                    size += 200 + sum(len(x) for x in r if isinstance(x, str))
                    if size >= RESULT_CHARS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    # Documents may be long: a batch holds few of them.
    for key, most in BATCH.items():
        docs.sparkSession.conf.set(key, str(most))
    return docs.select("doc_id", "content").mapInPandas(run, schema)


def plain_text(docs: DataFrame) -> DataFrame:
    """Paragraphs of plain or Markdown texts: parts between blank lines that aren't empty."""
    text = F.decode("content", "UTF-8")
    rows = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n\n+")).alias("para_idx", "text"))
    rows = rows.select("doc_id", "para_idx", clean_content(F.col("text")).alias("text"), F.lit(None).cast("string").alias("annotation"))
    return rows.where("text <> ''")


class _Sections(HTMLParser):
    """Paragraphs with the chapter, section and article that they stand under."""

    HEADS = {"h1": 0, "h2": 1, "h3": 2, "h4": 2, "h5": 2, "h6": 2}

    def __init__(self, classes: dict[str, int]):
        super().__init__(convert_charrefs=True)
        self.classes, self.skip, self.text, self.rows = classes, 0, [], []
        self.heads: list[str | None] = [None, None, None]
        self.level: int | None = None

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if not text:
            return
        if self.level is not None:
            self.heads[self.level] = text
            self.heads[self.level + 1 :] = [None] * (2 - self.level)
        else:
            self.rows.append((text, json.dumps([h for h in self.heads if h], ensure_ascii=False)))

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag in ("p", "li", "table", "tr", "div", "ul", "ol", "br", *self.HEADS):
            if tag != "br":
                self.flush()
                named = next((self.classes[c] for c in (dict(attrs).get("class") or "").split() if c in self.classes), None)
                self.level = named if named is not None else self.HEADS.get(tag)
            else:
                self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag in ("p", "li", "table", "tr", "div", "ul", "ol", *self.HEADS):
            self.flush()
            self.level = None

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def html_text(docs: DataFrame, chapters: tuple[str, ...] = (), sections: tuple[str, ...] = (), articles: tuple[str, ...] = ()) -> DataFrame:
    """Paragraphs of web pages, each text once a page, with the headings above it as ``annotation``."""
    classes = {**dict.fromkeys(chapters, 0), **dict.fromkeys(sections, 1), **dict.fromkeys(articles, 2)}

    def parse(doc: str, text: str) -> Iterator[tuple]:
        p = _Sections(classes)
        p.feed(text)
        p.close()
        p.flush()
        for i, (t, a) in enumerate(p.rows):
            yield i, t, a

    return first_seen(_each(docs, parse, PARAGRAPHS), ["doc_id", "text"], [F.col("para_idx")])


def flatten_jsonld(value, base: str) -> Iterator[tuple[str, str, str]]:
    """Triples of a JSON-LD value; nodes without an id are numbered in order."""
    count = 0

    def node(v) -> Iterator[tuple]:
        nonlocal count
        own = v.get("@id")
        if own is None:
            own = f"_:{base}_{count}"
            count += 1
        yield own
        for p, x in v.items():
            if p != "@id":
                for one in x if isinstance(x, list) else [x]:
                    if isinstance(one, dict) and "@value" in one:
                        yield own, p, str(one["@value"])
                    elif isinstance(one, dict):
                        inner = node(one)
                        name = next(inner)
                        yield own, p, name
                        yield from inner
                    elif one is not None:
                        yield own, p, one if isinstance(one, str) else json.dumps(one)

    for v in value if isinstance(value, list) else [value]:
        if isinstance(v, dict):
            found = node(v)
            next(found)
            yield from found


def jsonld_triples(docs: DataFrame) -> DataFrame:
    """Triples of JSON-LD documents. A text that is no JSON gives none."""

    def parse(doc: str, text: str) -> Iterator[tuple]:
        try:
            value = json.loads(text)
        except ValueError:
            return
        yield from flatten_jsonld(value, re.sub(r"\W+", "_", doc.rsplit("/", 1)[-1]))

    return _each(docs, parse, TRIPLES)


def jsonld_texts(triples: DataFrame) -> DataFrame:
    """Objects that are texts, as paragraphs: neither addresses nor values of labels or types."""
    rows = triples.where(~is_url(F.col("o")) & ~F.col("p").isin("@type", LABEL))
    return rows.select("doc_id", F.lit(0).alias("para_idx"), F.col("o").alias("text"), F.col("s").alias("annotation"))


def legal_xml(docs: DataFrame, headings: bool = False) -> DataFrame:
    """Paragraphs of legal XML: each p with its list's introduction before it and the ids of what it stands in."""
    import xml.etree.ElementTree as ET

    wanted = ("paragraph", "article", "recital", "section", "chapter")
    plain = lambda tag: tag.rsplit("}", 1)[-1]

    def parse(doc: str, text: str) -> Iterator[tuple]:
        try:
            root = ET.fromstring(text)
        except ET.ParseError:
            return
        i = 0

        def walk(e, ids: dict, intro: str):
            nonlocal i
            tag = plain(e.tag)
            if tag in wanted:
                ids = {**ids, tag: e.get("eId") or e.get("id") or ""}
            if tag in ("p", "block") or headings and tag == "heading":
                body = " ".join("".join(e.itertext()).split())
                if body:
                    yield i, f"{intro} {body}".strip(), json.dumps(ids)
                    i += 1
                return
            own = next((" ".join("".join(c.itertext()).split()) for c in e if plain(c.tag) in ("intro", "listIntroduction")), "")
            for c in e:
                if not (own and plain(c.tag) in ("intro", "listIntroduction")):
                    yield from walk(c, ids, f"{intro} {own}".strip())

        yield from walk(root, {}, "")

    return _each(docs, parse, PARAGRAPHS)


def pdf_pages(docs: DataFrame, provider: Callable[[bytes], list[list[tuple[float, float, str]]]]) -> DataFrame:
    """(doc_id, page, text) from a provider that gives each page's blocks as (top, left, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, n, "\n\n".join(t for _, _, t in sorted(blocks))) for d, c in zip(batch["doc_id"], batch["content"]) for n, blocks in enumerate(provider(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text"])

    return docs.select("doc_id", "content").mapInPandas(run, "doc_id string, page int, text string")


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """Paragraphs of pages(doc_id, page, text); the first of a page joins the last of the page before."""
    rows = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n\n+")).alias("idx", "text"))
    rows = rows.withColumn("text", clean_content(F.col("text"))).where("text <> ''")
    return glue_pages(rows, "doc_id", "page", "idx", "text")


def chunks(paragraphs: DataFrame, size: int = 150, overlap: int = 75) -> DataFrame:
    """(doc_id, chunk_idx, text): overlapping windows of a document's words over all its paragraphs."""
    words = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "text"))), lambda x: F.split(x["text"], " ")))
    rows = paragraphs.groupBy("doc_id").agg(words.alias("w"))
    return rows.select("doc_id", F.posexplode(token_windows(F.col("w"), size, overlap)).alias("chunk_idx", "part")).select("doc_id", "chunk_idx", F.array_join("part", " ").alias("text"))


def read_path(spark: SparkSession, path: str, pdf: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Paragraphs and triples of all files below a path; kinds that aren't known are left out."""
    docs = documents(spark, path)
    of = lambda *kinds: docs.where(F.col("kind").isin(*kinds))
    triples = jsonld_triples(of("json"))
    out = plain_text(of("txt", "log", "md")).unionByName(html_text(of("html", "htm"))).unionByName(legal_xml(of("akn"))).unionByName(jsonld_texts(triples))
    if pdf is not None:
        pages = page_paragraphs(pdf_pages(of("pdf"), pdf))
        out = out.unionByName(pages.select("doc_id", F.col("para_idx").cast("int").alias("para_idx"), "text", F.col("page_id").alias("annotation")))
    return out, triples


def from_rows(spark: SparkSession, rows: list) -> DataFrame:
    """Paragraphs of texts in memory; a bare text is its own id."""
    made = [(r, 0, r, None) if isinstance(r, str) else (r.get("id", r["text"]), 0, r["text"], json.dumps(r["annotation"]) if r.get("annotation") else None) for r in rows]
    return spark.createDataFrame(made, PARAGRAPHS)


# Tables of the study and its results.

QUESTIONS = "Title string, Body string, AnswerBody string, ViewCount string"
RESULTS = (
    "tool string, title string, body string, stackoverflow_answer string, explanation string, explanation_words int, faithfulness_supporting_facts int, faithfulness_fact_score double, "
    "faithfulness_fact_score_fuzzy double, fact_score double, fact_score_fuzzy double, supporting_facts int, supporting_facts_labels string, supported_facts_labels string, "
    "prompt_tokens int, rag_context_tokens int, output_tokens int, processed_extra_questions_count int, extra_questions string"
)
STUDY = (
    "username string, evaluation_list array<struct<question:string,topic:string,evaluation_dict:map<string,map<string,int>>,elapsed_seconds:int>>, qualitative_feedback string"
)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def top_viewed(questions: DataFrame, k: int) -> DataFrame:
    """The k most viewed questions, less those without an answer; of equal titles the last stays."""
    views = F.expr("try_cast(ViewCount AS bigint)")
    top = questions.withColumn("views", views).orderBy(F.desc_nulls_last("views"), "Title").limit(k).where("AnswerBody is not null")
    return top.groupBy("Title").agg(F.min_by(F.struct("Body", "AnswerBody", "views"), "views").alias("r")).select("Title", "r.*")


def read_study(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STUDY).option("multiLine", "true").json(path)


def read_results(spark: SparkSession, paths: dict[tuple[str, str], str]) -> DataFrame:
    """Result tables by (topic, llm), as one."""
    out = None
    for (topic, llm), path in paths.items():
        part = spark.read.schema(RESULTS).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
        part = part.withColumn("topic", F.lit(topic)).withColumn("llm", F.lit(llm))
        out = part if out is None else out.unionByName(part)
    return out


def write_results(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header; arrays as JSON."""
    cols = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in rows.schema]
    rows.select(*cols).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
