"""Planning an answer: contained answers, best questions, budgets, plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.text import answer_block, count_tokens, labels_are_similar, syntactic_distance
from loomtrace.operators import vectors
from loomtrace.operators.containment import longest
from loomtrace.operators.state import cut
from loomtrace.operators.ordered import budget_prefix, first_seen, top_per_group
from loomtrace.operators.vectors import top_k, top_k_texts


def containers(texts: DataFrame, text: str = "text", group: Sequence[str] = ()) -> DataFrame:
    """(group, inner, outer): pairs of different texts of a group of which one holds the other.

    Texts of white-space words are joined on a word of the inner text that few texts have, so that
    contained pairs meet without comparing all: any text that holds another also has, as a piece of
    itself, each of its middle words. Inner texts of fewer than three words have no such word for
    certain: one word lies within a word of the outer text and is found by its first letters among all letter
    runs of that word; of two words the first ends a word of the outer text and is found by its last letters.
    """
    words = F.split(F.trim(F.col(text)), r"\s+")
    base = texts.select(*group, text).distinct().where(F.col(text).isNotNull())
    each = base.select(*group, F.col(text).alias("outer"), F.explode(F.array_distinct(words)).alias("word"))
    common = each.groupBy(*group, "word").agg(F.count("*").alias("n"))
    middle = base.select(*group, F.col(text).alias("inner"), F.explode(F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))).alias("word"))
    rare = middle.join(common, [*group, "word"]).groupBy(*group, "inner").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    found = rare.join(each, [*group, "word"]).where(F.col("outer").contains(F.col("inner")) & (F.col("outer") != F.col("inner"))).select(*group, "inner", "outer")
    # Distinct words stand for the texts until a word is known to fit.
    known = each.select(*group, "word").distinct()
    runs = F.flatten(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda g: F.when(F.length("word") >= g, F.transform(F.sequence(F.lit(1), F.length("word") - g + 1), lambda i: F.concat(F.lit("in "), F.substring(F.col("word"), i, g)))).otherwise(F.array().cast("array<string>"))))
    ends = F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda g: F.concat(F.lit("end "), F.right(F.col("word"), g)))
    pieces = known.where("word <> ''").select(*group, "word", F.explode(F.array_distinct(F.concat(runs, ends))).alias("piece"))
    one, two = F.get(words, 0), F.size(words) == 2
    piece = F.when(two, F.concat(F.lit("end "), F.right(one, F.least(F.lit(3), F.length(one))))).otherwise(F.concat(F.lit("in "), F.substring(one, F.lit(1), F.lit(3))))
    short = base.where(F.size(words) < 3).select(*group, F.col(text).alias("inner"), one.alias("one"), two.alias("two"), piece.alias("piece"))
    fits = F.when(F.col("two"), F.col("word").endswith(F.col("one"))).otherwise(F.col("word").contains(F.col("one")))
    holds = F.col("outer").contains(F.col("inner")) & (F.col("outer") != F.col("inner"))
    few = short.where("one <> ''").join(pieces, [*group, "piece"]).where(fits).select(*group, "inner", "word").join(each, [*group, "word"]).where(holds)
    # White space alone has no word, and is found by its first sign.
    blank = short.where("one = ''").select(*group, "inner", F.substring("inner", 1, 1).alias("sign"))
    signs = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.col(text), F.lit(r"\s"), F.lit(0))))
    rest = blank.join(base.select(*group, F.col(text).alias("outer"), F.explode(signs).alias("sign")), [*group, "sign"]).where(holds)
    pairs = lambda t: t.select(*group, "inner", "outer")
    return found.unionByName(pairs(few)).unionByName(pairs(rest)).distinct()


def similar_labels(labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(a, b, distance) of the distinct labels(label) a < b whose edit distance is under ``threshold`` of the longer length.

    With at most t edits between them, one of t + 1 pieces of the shorter label stands unchanged in the
    longer one, at most t places off. Labels meet on such pieces, so no two labels are compared without one.
    """
    names = labels.select("label", F.length("label").alias("n")).where("n > 0").distinct()
    edits = lambda n: F.ceil(F.lit(threshold) * n).cast("int") - 1
    start = lambda i, n, t: F.floor(i * n / (t + 1)).cast("int")
    longest = F.ceil(F.col("n") / F.lit(1 - threshold)).cast("int") + 1
    kept = names.select("label", "n", F.explode(F.array_distinct(F.transform(F.sequence("n", longest), lambda m: F.when(m - F.col("n") <= edits(m), edits(m))))).alias("t")).where("t > 0")
    kept = kept.select("label", "n", "t", F.explode(F.sequence(F.lit(0), F.col("t"))).alias("i"))
    size = start(F.col("i") + 1, F.col("n"), F.col("t")) - start(F.col("i"), F.col("n"), F.col("t"))
    kept = kept.select(F.col("label").alias("short"), "n", "t", "i", F.substring(F.col("label"), start(F.col("i"), F.col("n"), F.col("t")) + 1, size).alias("piece"))
    asked = names.select("label", F.col("n").alias("m"), edits(F.col("n")).alias("t")).where("t > 0")
    asked = asked.select("label", "m", "t", F.explode(F.sequence(F.col("m") - F.col("t"), F.col("m"))).alias("n")).where("n > 0")
    asked = asked.select("label", "m", "t", "n", F.explode(F.sequence(F.lit(0), F.col("t"))).alias("i"))
    at = start(F.col("i"), F.col("n"), F.col("t"))
    spots = F.filter(F.sequence(at - F.col("t"), at + F.col("t")), lambda x: (x >= 0) & (x + size <= F.col("m")))
    asked = asked.select("label", "t", "n", "i", F.explode(F.array_distinct(F.transform(spots, lambda x: F.substring(F.col("label"), x + 1, size)))).alias("piece"))
    met = asked.join(kept, ["t", "n", "i", "piece"]).where("label <> short").select(F.least("label", "short").alias("a"), F.greatest("label", "short").alias("b")).distinct()
    return met.where(labels_are_similar(F.col("a"), F.col("b"), threshold)).select("a", "b", syntactic_distance(F.col("a"), F.col("b")).alias("distance"))


def not_contained(texts: DataFrame, text: str = "text", group: Sequence[str] = ()) -> DataFrame:
    """Rows whose text no other text of the group holds."""
    rows, held = longest(texts, text, group)
    return rows.join(held.hint("merge"), "_id", "left_anti").drop("_id")


def longest_container(texts: DataFrame, text: str = "text", group: Sequence[str] = ()) -> DataFrame:
    """(group, text, best): the longest text of the group that holds each text, else itself."""
    rows, held = longest(texts.select(*group, text).distinct(), text, group)
    return rows.join(held.hint("merge"), "_id", "left").select(*group, text, F.coalesce("best", F.col(text)).alias("best"))


def merge_contained(answers: DataFrame) -> DataFrame:
    """answers(question, q_ord, rank, sentence, ...): sentences replaced by the longest that holds them, once for each question."""
    best = longest_container(answers, "sentence")
    out = answers.join(best, "sentence").withColumn("sentence", F.col("best")).drop("best")
    return first_seen(out, ["question", "sentence"], [F.col("rank")])


def best_question(answers: DataFrame, answer: str = "sentence", question: str = "question", confidence: str = "confidence", order: str = "q_ord") -> DataFrame:
    """Rows of the question under which each answer has its highest confidence; ties go to the first question."""
    w = Window.partitionBy(answer)
    win = F.max_by(question, F.struct(F.col(confidence), -F.col(order))).over(w)
    return answers.withColumn("_win", win).where(F.col("_win") == F.col(question)).drop("_win")


def top_questions(answers: DataFrame, n: int, group: Sequence[str] = ()) -> DataFrame:
    """The n questions whose first answers have the highest confidence, ties by order: (group, question, q_ord, confidence)."""
    first = first_seen(answers, [*group, "question"], [F.col("rank")]).select(*group, "question", "q_ord", "confidence")
    order = [F.col("confidence").desc(), F.col("q_ord")]
    return top_per_group(first, group, order, n) if group else first.orderBy(*order).limit(n)


def prompt_contents(answers: DataFrame, budget: int, prompt_tokens: Column | int = 0, group: Sequence[str] = ()) -> DataFrame:
    """(group, contents, used): blocks of questions and answers in order, as many as the token budget takes."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"])
    blocks = answers.groupBy(*group, "question", "q_ord").agg(answer_block(F.col("question"), lists).alias("block"))
    start = F.lit(prompt_tokens) if isinstance(prompt_tokens, int) else prompt_tokens
    kept = budget_prefix(blocks.withColumn("cost", count_tokens(F.col("block"))), group, [F.col("q_ord")], "cost", start, F.lit(budget))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("q_ord", "block"))), lambda x: x["block"])
    return kept.groupBy(*group).agg(F.array_join(parts, "\n\n").alias("contents"), F.max("used").alias("used"))


def ask(questions: DataFrame, chunks: DataFrame, threshold: float = 0.0, horizon: int = 10, fetch: int = 50, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(question, rank, sentence, page_id, confidence): the best chunks of distinct text for each question.

    questions(query_id, question, q), chunks(doc_id, text, page_id, v). Equal texts count once, with the vector of the
    first: they are made distinct before they are searched. Where ``embed`` makes the vectors, chunks need no v and equal texts have
    equal ones, so up to ``BLOCK`` questions are asked without moving the texts.
    """
    if embed is not None and questions.count() <= vectors.BLOCK:
        hits = top_k_texts(questions.select("query_id", "q"), chunks.select("doc_id", "text", "page_id").withColumn("v", embed(F.col("text"))), horizon, threshold, digits=6)
        return hits.join(questions.select("query_id", "question"), "query_id").select("question", "rank", F.col("text").alias("sentence"), "page_id", F.col("similarity").alias("confidence"))
    distinct = first_seen(chunks, ["text"], [F.col("doc_id")])
    if embed is not None:
        distinct = distinct.withColumn("v", embed(F.col("text")))
    hits = top_k(questions.select("query_id", "q"), distinct.select("doc_id", "v"), horizon, threshold, digits=6)
    return hits.join(questions.select("query_id", "question"), "query_id").join(distinct.select("doc_id", "text", "page_id"), "doc_id").select(
        "question", "rank", F.col("text").alias("sentence"), "page_id", F.col("similarity").alias("confidence")
    )


def macroplan(questions: DataFrame, extra: DataFrame, chunks: DataFrame, n: int, threshold: float = 0.55, horizon: int = 10, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Answers of each question and of its n best further questions.

    questions and extra have (topic, query_id, question, q, q_ord); chunks and ``embed`` are those of ``ask``. Without further questions (n = 0)
    the question is answered alone; else contained answers merge, each stays under its best
    question, and the questions with the best first answers are kept.
    """
    if n == 0:
        return ask(questions, chunks, 0.0, horizon, embed=embed).join(questions.select("question", "topic", "q_ord"), "question")
    both = questions.select("topic", "query_id", "question", "q", "q_ord").unionByName(extra.select("topic", "query_id", "question", "q", "q_ord"))
    distinct = first_seen(both.withColumn("_fold", F.lower("question")), ["topic", "_fold"], [F.col("q_ord")]).drop("_fold")
    # Answers are few for each question and feed several joins: compute them once.
    answers = cut(ask(distinct, chunks, threshold, horizon, embed=embed).join(distinct.select("question", "topic", "q_ord"), "question"))
    best = cut(best_question(merge_contained(answers)))
    kept = top_questions(best, n, ["topic"])
    return best.join(kept.select("topic", "question"), ["topic", "question"], "left_semi")
