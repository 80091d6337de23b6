"""Concepts and questions around a text: nearest concepts, annotation, question records, the experiment grid."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import text as T
from loomtrace.operators.ordered import first_seen, top_per_group
from loomtrace.operators.vectors import greedy_distinct, top_k


def nearest_concepts(words: DataFrame, corpus: DataFrame, embed: Callable[[Column], Column], k: int = 1, threshold: float = 0.75, keep: Column | None = None) -> DataFrame:
    """words(concept, ...) with ``similar_to``: the k nearest labels of corpus(uri, label); ``keep`` is tested after the k are chosen."""
    queries = words.select(F.col("concept").alias("query_id"), embed(F.col("concept")).alias("q"))
    labels = first_seen(corpus, ["label"], [F.col("uri")])
    hits = top_k(queries, labels.select(F.col("label").alias("doc_id"), embed(F.col("label")).alias("v")), k, threshold, digits=6)
    named = hits.join(labels.select(F.col("label").alias("doc_id"), "uri"), "doc_id")
    if keep is not None:
        named = named.where(keep)
    each = F.struct("rank", F.col("doc_id").alias("label"), "uri", "similarity")
    found = named.groupBy(F.col("query_id").alias("concept")).agg(F.array_sort(F.collect_list(each)).alias("similar_to"))
    empty = F.array().cast("array<struct<rank:int,label:string,uri:string,similarity:double>>")
    return words.join(found, "concept", "left").withColumn("similar_to", F.coalesce("similar_to", empty))


def missing_concepts(words: DataFrame) -> DataFrame:
    """Concepts without a neighbour."""
    return words.where(F.size("similar_to") == 0)


def hinge(labels: DataFrame, corpus: DataFrame, embed: Callable[[Column], Column], threshold: float = 0.75) -> DataFrame:
    """Edges (target, my:inSynset, source) from each label(uri, label) to its nearest other concept."""
    near = nearest_concepts(labels.select(F.col("label").alias("concept"), F.col("uri").alias("source")), corpus, embed, 1, threshold)
    rows = near.select(F.explode("similar_to").alias("x"), "source").where("x.uri <> source")
    return rows.select(F.col("x.uri").alias("s"), F.lit("my:inSynset").alias("p"), F.col("source").alias("o")).distinct()


def related_concepts(words: DataFrame, n: int = 1) -> DataFrame:
    """(uri, label): the first n neighbours of each concept, and the concept itself, once for each uri."""
    near = words.select(F.explode(F.slice("similar_to", 1, n)).alias("x")).select("x.uri", "x.label", F.lit(0).alias("own"))
    own = words.select(F.concat(F.lit("my:"), T.uri_of(F.col("concept"))).alias("uri"), F.col("concept").alias("label"), F.lit(1).alias("own"))
    return first_seen(near.unionByName(own), ["uri"], [F.col("own"), F.length("label"), F.col("label")]).select("uri", "label")


def annotate(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, uri, label): labels that texts(doc_id, text) hold as words, whatever their case.

    Labels are joined on their first word, so a text is compared with those only that begin with one of its words.
    """
    split = lambda c: F.split(F.lower(F.col(c)), r"[^\p{L}\p{N}]+")
    # Words travel without their text; a text comes back once, to those labels that begin with one of its words.
    words = texts.select("doc_id", F.explode(F.array_distinct(split("text"))).alias("word"))
    keyed = labels.select("uri", "label", F.array_join(split("label"), " ").alias("name"), F.get(split("label"), 0).alias("word")).where("word <> ''")
    near = words.join(keyed, "word").groupBy("doc_id").agg(F.collect_set(F.struct("uri", "label", "name")).alias("near"))
    flat = F.concat(F.lit(" "), F.array_join(split("text"), " "), F.lit(" "))
    held = texts.join(near, "doc_id").select("doc_id", "near", flat.alias("flat"))
    held = held.select("doc_id", F.explode(F.filter("near", lambda x: F.col("flat").contains(F.concat(F.lit(" "), x["name"], F.lit(" "))))).alias("x"))
    return held.select("doc_id", "x.uri", "x.label").distinct()


def annotate_html(page: str, labels: Sequence[tuple[str, str]]) -> str:
    """A page in which each label stands in a span with its uri: the longest first, never within tags, anchors or each other."""
    wanted = {}
    for uri, label in labels:
        wanted.setdefault(label.lower(), uri)
    if not wanted:
        return page
    names = "|".join(re.escape(w) for w in sorted(wanted, key=lambda w: (-len(w), w)))
    token = re.compile(rf"(?is)(<a\b.*?</a\s*>|<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>)|\b({names})\b")
    return token.sub(lambda m: m[1] if m[1] is not None else f'<span data-uri="{wanted[m[2].lower()]}">{m[2]}</span>', page)


def subclass_replacer(edges: DataFrame, superclass: str, most: int = 10_000) -> Callable[[Column], Column]:
    """A function that writes the name of a class for the names of its direct subclasses, the longest first."""
    name = lambda uri: uri.split(":", 1)[-1].replace("_", " ")
    rows = edges.where((F.col("p") == "rdfs:subClassOf") & (F.col("o") == superclass)).select("s").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} subclasses")
    names = sorted({name(r.s) for r in rows}, key=lambda n: (-len(n), n))
    if not names:
        return lambda x: x
    quoted = "|".join(re.sub(r"([^\w\s])", r"\\\1", n) for n in names)
    return lambda x: F.regexp_replace(x, rf"(?i)\b({quoted})\b", name(superclass))


def sentence_of(subject: Column, predicate: Column, obj: Column) -> Column:
    """A statement in English: slots of its predicate filled, or the three in a row."""
    filled = F.replace(F.replace(predicate, F.lit("{subj}"), subject), F.lit("{obj}"), obj)
    plain = F.concat_ws(" ", subject, F.lower(T.explode_key(predicate)), obj)
    return F.trim(F.regexp_replace(F.regexp_replace(F.when(T.is_clause(predicate), filled).otherwise(plain), r"\s+", " "), r" ([.,;:!?])", "$1"))


def question_records(answers: DataFrame) -> DataFrame:
    """(source_id, sentence, question, answer, type, abstract) of answers(source_id, sentence, text): a line each, with one question mark.

    The source's id goes with each text, so answers can't shift between sources.
    """
    lines = answers.select("source_id", "sentence", F.explode(F.split("text", "\n")).alias("line"))
    rows = lines.select("source_id", "sentence", T.qa_of_line(F.col("line")).alias("qa")).where("qa is not null and qa.answer <> ''")
    return rows.select("source_id", "sentence", "qa.question", "qa.answer", T.question_type(F.col("qa.question")).alias("type"), F.concat_ws(" ", "qa.question", "qa.answer").alias("abstract"))


def similar_questions(records: DataFrame, questions: DataFrame, embed: Callable[[Column], Column], k: int = 25, types: Sequence[str] = ("edu", "amr"), longest: int = 200, same: float = 0.95, threshold: float = 0.0) -> DataFrame:
    """The k nearest of the generated questions for each of questions(query_id, question): filtered, distinct, near-equal ones once."""
    kept = records.where(F.col("type").isin(*types) & (F.length("question") <= longest)).select("question").distinct()
    kept = kept.select(F.col("question").alias("id"), F.length("question").alias("n"), embed(F.col("question")).alias("v"))
    alone = greedy_distinct(kept, same, order=("n", "id"))
    asked = questions.select("query_id", embed(F.col("question")).alias("q"))
    return top_k(asked, alone.select(F.col("id").alias("doc_id"), "v"), k, threshold, digits=6).select("query_id", "rank", F.col("doc_id").alias("question"), "similarity")


def further_questions(concepts: DataFrame, questions: DataFrame) -> DataFrame:
    """(at, question): "What is X?" for each label, the shortest first, then the generated ones; once whatever the case."""
    place = lambda kind, n, name: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"), name.alias("name")).alias("at")
    what = concepts.select(F.concat(F.lit("What is "), F.col("label"), F.lit("?")).alias("question"), place(0, F.length("label"), F.col("label")))
    both = what.unionByName(questions.select("question", place(1, F.col("rank"), F.col("question"))))
    return first_seen(both.withColumn("fold", F.lower("question")), ["fold"], [F.col("at")]).select("at", "question")


def experiment_grid(tasks: DataFrame, strategies: Sequence[tuple[str, int]], done: DataFrame | None = None) -> DataFrame:
    """tasks with each strategy and its number of further questions, less what results already hold (task, title, strategy)."""
    grid = tasks.withColumn("s", F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), F.lit(k).alias("extra")) for n, k in strategies))))
    grid = grid.select(*tasks.columns, "s.strategy", "s.extra")
    return grid if done is None else grid.join(done.select("task", "title", "strategy").distinct(), ["task", "title", "strategy"], "left_anti")


def known_questions(edges: DataFrame) -> DataFrame:
    """(s, question, answer, explanation) of subjects that have a question and an answer template."""
    wanted = {"question": "my:question_template", "answer": "my:answer_template", "explanation": "my:explanatory_template"}
    cols = [F.max(F.when(F.col("p") == p, F.col("o"))).alias(n) for n, p in wanted.items()]
    return edges.where(F.col("p").isin(*wanted.values())).groupBy("s").agg(*cols).where("question is not null and answer is not null")


def boxplot_rows(scores: DataFrame, value: str, tool: str, groups: Sequence[str]) -> DataFrame:
    """The numbers that a box plot shows: quartiles of each tool in each group, beside the group's best median."""
    from pyspark.sql import Window

    from loomtrace.operators.scoring import quartiles

    rows = quartiles(scores, value, [*groups, tool])
    return top_per_group(rows, [*groups, tool], [F.col("median")], 1).withColumn("best", F.col("median") == F.max("median").over(Window.partitionBy(*groups)))
