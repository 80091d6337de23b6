from pyspark.sql import functions as F

from loomtrace.operators import questions as Q
from loomtrace.providers import embed


def test_concepts_and_questions(spark):
    corpus = spark.createDataFrame([("my:design_pattern", "design pattern"), ("my:class", "class")], "uri string, label string")
    words = spark.createDataFrame([("design pattern",), ("weather",)], "concept string")
    near = Q.nearest_concepts(words, corpus, embed)
    got = {r.concept: [x.uri for x in r.similar_to] for r in near.collect()}
    assert got == {"design pattern": ["my:design_pattern"], "weather": []}
    assert [r.concept for r in Q.missing_concepts(near).collect()] == ["weather"]
    related = {r.label for r in Q.related_concepts(near).collect()}
    assert related == {"design pattern", "weather"}
    asked = Q.further_questions(Q.related_concepts(near), spark.createDataFrame([(1, "WHAT IS WEATHER?"), (2, "Why?")], "rank int, question string"))
    assert [r.question for r in asked.orderBy("at").collect()] == ["What is weather?", "What is design pattern?", "Why?"]
    assert Q.hinge(spark.createDataFrame([("my:dp", "design pattern")], "uri string, label string"), corpus, embed).first().s == "my:design_pattern"


def test_records_and_similar_questions(spark):
    answers = spark.createDataFrame([("p1", "s", "1. What is a class? - A type.\nno question\nWhy? Why not?"), ("p2", "s", None)], "source_id string, sentence string, text string")
    rows = Q.question_records(answers).collect()
    assert [(r.source_id, r.question, r.answer, r.type) for r in rows] == [("p1", "What is a class?", "A type.", "amr")]
    records = spark.createDataFrame([("What is a class?", "amr"), ("what is a class", "amr"), ("Despite what is it?", "edu")], "question string, type string")
    got = Q.similar_questions(records, spark.createDataFrame([(1, "what class is it")], "query_id int, question string"), embed, 5).collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and len([r for r in got if "class" in r.question]) == 1


def test_annotation_and_rendering(spark):
    texts = spark.createDataFrame([(1, "A Design-Pattern here"), (2, "designs")], "doc_id int, text string")
    labels = spark.createDataFrame([("my:dp", "design pattern"), ("my:d", "design")], "uri string, label string")
    assert {(r.doc_id, r.uri) for r in Q.annotate(texts, labels).collect()} == {(1, "my:dp"), (1, "my:d")}
    page = '<p title="class">A class and <a>class</a> of design pattern</p>'
    assert Q.annotate_html(page, [("u", "class"), ("v", "design pattern"), ("w", "design")]) == '<p title="class">A <span data-uri="u">class</span> and <a>class</a> of <span data-uri="v">design pattern</span></p>'
    edges = spark.createDataFrame([("my:red_cat", "rdfs:subClassOf", "my:cat")], "s string, p string, o string")
    one = spark.range(1).select(Q.subclass_replacer(edges, "my:cat")(F.lit("A Red cat sat")).alias("x"), Q.sentence_of(F.lit("a"), F.lit("{subj} uses {obj} ."), F.lit("b")).alias("y"), Q.sentence_of(F.lit("a"), F.lit("my:partOf"), F.lit("b")).alias("z")).first()
    assert (one.x, one.y, one.z) == ("A cat sat", "a uses b.", "a part of b")


def test_grid_and_known(spark):
    tasks = spark.createDataFrame([("java", "t1"), ("java", "t2")], "task string, title string")
    done = spark.createDataFrame([("java", "t1", "RAG")], "task string, title string, strategy string")
    assert Q.experiment_grid(tasks, [("GenAI", 0), ("RAG", 0), ("RAG+CoI", 5)], done).count() == 5
    edges = spark.createDataFrame([("a", "my:question_template", "q"), ("a", "my:answer_template", "x"), ("b", "my:question_template", "q")], "s string, p string, o string")
    assert [(r.s, r.question, r.answer, r.explanation) for r in Q.known_questions(edges).collect()] == [("a", "q", "x", None)]
    rows = spark.createDataFrame([("g", "a", 1.0), ("g", "a", 3.0), ("g", "b", 5.0)], "g string, tool string, v double")
    assert {(r.tool, r.median, r.best) for r in Q.boxplot_rows(rows, "v", "tool", ["g"]).collect()} == {("a", 2.0, False), ("b", 5.0, True)}
