"""Queries over text: cleaning, names, labels, lines of questions, languages, words."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions import text as T
from loomtrace.operators import planner
from loomtrace.plans.catalogue import query, table, uid_sql

# Frequent words of four languages.
VOTES = {
    "en": "the of and to in is that for with was",
    "fr": "le la les des et une est dans pour que",
    "de": "der die und das den von mit ist nicht ein",
    "es": "el los las del que por con una para como",
}


@query("stopword_filter", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w NOT IN ('the','of','and','to','in','is','') GROUP BY w")
def stopword_filter(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), " ", -1)).alias("word"))
    return words.where(~F.col("word").isin("the", "of", "and", "to", "in", "is", "")).groupBy("word").agg(F.count("*").alias("n"))


@query("wh_filter", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE NOT regexp_matches(w, '(?i)^(why|how|what|where|when|who|which|whose|whom)') GROUP BY w")
def wh_filter(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", " ", -1)).alias("word"))
    return words.where(T.is_not_wh_word(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@query("number_filter", r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \n]')) AS w FROM documents) WHERE regexp_matches(w, '^-?\d+(\.\d+)?(e[-+]?\d+)?$') GROUP BY w")
def number_filter(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", "[ \n]", -1)).alias("word"))
    return words.where(T.is_number(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@query("length_filter", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 100 AND 400")
def length_filter(spark, sf):
    return table(spark, sf, "documents").where(F.length("text").between(100, 400)).select("doc_id")


def _vote_sql() -> str:
    parts = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(v) for v in words.split())}))) AS {lang}" for lang, words in VOTES.items())
    return f"""
    WITH t AS (SELECT doc_id, lang, string_split(lower(text), ' ') AS w FROM documents), v AS (SELECT doc_id, lang, {parts} FROM t)
    SELECT doc_id, lang, CASE WHEN greatest(en, fr, de, es) = 0 THEN NULL WHEN en = greatest(en, fr, de, es) THEN 'en' WHEN fr = greatest(en, fr, de, es) THEN 'fr'
           WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS vote FROM v
    """


def stop_word_vote(text):
    """The language with most stop words; null without any, ties to the first named."""
    words = F.split(F.lower(text), " ", -1)
    votes = {lang: F.size(F.filter(words, _among(known.split()))) for lang, known in VOTES.items()}
    most = F.greatest(*votes.values())
    out = F.when(most == 0, F.lit(None).cast("string"))
    for lang, n in votes.items():
        out = out.when(n == most, F.lit(lang))
    return out


def _among(words):
    return lambda x: x.isin(*words)


@query("language_vote", _vote_sql())
def language_vote(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", stop_word_vote(F.col("text")).alias("vote"))


@query(
    "word_counts_merge",
    "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents UNION ALL SELECT unnest(string_split(lower(text), ' ')) FROM benchmark) GROUP BY w",
)
def word_counts_merge(spark, sf):
    def counts(name):
        return table(spark, sf, name).select(F.explode(F.split(F.lower("text"), " ", -1)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    return counts("documents").unionByName(counts("benchmark")).groupBy("word").agg(F.sum("n").alias("n"))


@query(
    "levenshtein_similar",
    """
    WITH n AS (SELECT DISTINCT p_name FROM part)
    SELECT a.p_name AS a, b.p_name AS b, round(levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS distance
    FROM n a JOIN n b ON a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) < 0.3
    """,
)
def levenshtein_similar(spark, sf):
    found = planner.similar_labels(table(spark, sf, "part").select(F.col("p_name").alias("label")))
    return found.select("a", "b", F.round("distance", 6).alias("distance"))


@query(
    "most_similar_label",
    """
    WITH n AS (SELECT DISTINCT p_brand, p_name FROM part), s AS (SELECT DISTINCT p_brand, lower(p_type) AS label FROM part)
    SELECT p_brand, label, arg_min(p_name, {'d': levenshtein(label, p_name), 'p': p_name}) AS best FROM s JOIN n USING (p_brand) GROUP BY p_brand, label
    """,
)
def most_similar_label(spark, sf):
    parts = table(spark, sf, "part")
    both = parts.select("p_brand", "p_name").distinct().join(parts.select("p_brand", F.lower("p_type").alias("label")).distinct(), "p_brand")
    return both.groupBy("p_brand", "label").agg(F.min_by("p_name", F.struct(F.levenshtein("label", "p_name"), "p_name")).alias("best"))


@query(
    "label_containment",
    """
    WITH n AS (SELECT DISTINCT p_name AS a, split_part(p_name, ' ', 1) AS b FROM part)
    SELECT a, b, 1 + (levenshtein(a, b) - greatest(length(a), length(b))) / least(length(a), length(b)) < 0.3 AS inside FROM n
    """,
)
def label_containment(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("a"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("b")).distinct()
    return names.select("a", "b", T.labels_are_contained(F.col("a"), F.col("b")).alias("inside"))


@query(
    "uri_from_text",
    r"""
    WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' of the brand ' || p_brand WHEN 1 THEN ' Größe é' ELSE '' END AS n FROM part),
    u AS (SELECT p_partkey, regexp_replace(replace(trim(lower(strip_accents(replace(n, 'ß', 'ss')))), ' ', '_'), '\s', '', 'g') AS n FROM t)
    SELECT p_partkey, CASE WHEN length(n) < 25 THEN n ELSE """
    + uid_sql("n")
    + """ END AS uri FROM u
    """,
)
def uri_from_text(spark, sf):
    turn = F.col("p_partkey") % 3
    name = F.concat("p_name", F.when(turn == 0, F.concat(F.lit(" of the brand "), F.col("p_brand"))).when(turn == 1, " Größe é").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", T.uri_of(name).alias("uri"))


@query(
    "explode_key",
    r"""
    SELECT DISTINCT p_brand, 'Part Name ' || replace(p_brand, '#', '') AS words, 'A:b:' || replace(p_brand, '#', '') AS whole FROM part
    """,
)
def explode_key(spark, sf):
    key = F.concat(F.lit("my:partName_"), F.replace("p_brand", F.lit("#"), F.lit("")))
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    close = lambda x: F.regexp_replace(x, r" (\d)", "$1")
    whole = F.replace(close(T.explode_key(F.concat(F.lit("a:b:"), brand))), F.lit(" Brand"), F.lit("Brand"))
    return table(spark, sf, "part").select("p_brand").distinct().select("p_brand", close(T.explode_key(key)).alias("words"), whole.alias("whole"))


@query(
    "balance_brackets",
    """
    WITH l AS (SELECT doc_id, replace(replace(text, 'in', '('), 'on', ')') AS t FROM documents)
    SELECT doc_id, CASE WHEN len(t) - len(replace(t, '(', '')) > len(t) - len(replace(t, ')', '')) THEN t || ')' ELSE t END || CASE WHEN (len(t) - len(replace(t, '"', ''))) % 2 = 1 THEN '"' ELSE '' END AS t FROM l
    """,
)
def balance_brackets(spark, sf):
    t = F.replace(F.replace("text", F.lit("in"), F.lit("(")), F.lit("on"), F.lit(")"))
    plain = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    return plain.select("doc_id", T.balance_brackets(F.col("t")).alias("t"))


@query(
    "clean_text",
    r"""
    WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[\r ]*\n[\r ]*', chr(10), 'g') AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\t', ' ', 'g'), '  +', ' ', 'g') AS t FROM a),
    c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\(cid:173\) *\n+', '', 'g'), '- *\n+', '', 'g') AS t FROM b)
    SELECT doc_id, regexp_replace(regexp_replace(t, '\n+', ' ', 'g'), ' +', ' ', 'g') AS t FROM c
    """,
)
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_content(F.col("text"), remove_newlines=True).alias("t"))


@query(
    "html_paragraphs",
    r"""
    SELECT page_id, i::INTEGER AS i, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]+>', '', 'g'),
           '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS t
    FROM (SELECT page_id, unnest(string_split(html, '</p>')) AS x, generate_subscripts(string_split(html, '</p>'), 1) - 1 AS i FROM pages)
    """,
)
def html_paragraphs(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(F.split("html", "</p>", -1)).alias("i", "x"))
    return rows.select("page_id", "i", T.strip_tags(F.col("x")).alias("t"))


@query(
    "qa_line_parse",
    r"""
    WITH l AS (SELECT conv_id, turn, unnest(string_split('1. ' || replace(text, '. ', '? - '), chr(10))) AS line FROM conversations),
    c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(line, '^\s*(\d+\.|\(\w+\)|\w\)|\d+\)|\d*\-|\w\-)\s*', ''), '\?\s*-', '?', 'g') AS line FROM l),
    p AS (SELECT conv_id, turn, string_split(line, '?') AS p FROM c)
    SELECT conv_id, turn, trim(p[1]) || '?' AS question, trim(p[2]) AS answer, CASE WHEN regexp_matches(lower(p[1]), 'despite what|after what|in what manner|while what|in what case|before what|since when|until when|instead of what|except when|unless what') THEN 'edu' ELSE 'amr' END AS type FROM p WHERE len(p) = 2
    """,
)
def qa_line_parse(spark, sf):
    text = F.concat(F.lit("1. "), F.replace("text", F.lit(". "), F.lit("? - ")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split(text, "\n", -1)).alias("line"))
    rows = rows.select("conv_id", "turn", T.qa_of_line(F.col("line")).alias("qa")).where("qa is not null")
    return rows.select("conv_id", "turn", "qa.question", "qa.answer", T.question_type(F.col("qa.question")).alias("type"))


@query(
    "prompt_text",
    """
    WITH a AS (SELECT conv_id, string_agg(text, chr(10) || '- ' ORDER BY turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
    q AS (SELECT conv_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id)
    SELECT conv_id, 'Question: ' || q || chr(10) || 'Contents: ' || q || chr(10) || '- ' || t AS prompt FROM q JOIN a USING (conv_id)
    """,
)
def prompt_text(spark, sf):
    rows = table(spark, sf, "conversations")
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda x: x["text"])
    both = rows.groupBy("conv_id").agg(said.alias("answers"), F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("q"))
    both = both.where("q is not null and size(answers) > 0")
    return both.select("conv_id", T.fill(F.lit("Question: {question}\nContents: {contents}"), {"question": F.col("q"), "contents": T.answer_block(F.col("q"), F.col("answers"))}).alias("prompt"))


@query(
    "answer_text",
    "SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' (pp. ' || doc_id || ' - ' || (doc_id + 1) || ')' WHEN doc_id % 3 = 1 THEN ' (p. ' || doc_id || ')' ELSE ' ' END AS t FROM documents",
)
def answer_text(spark, sf):
    k = F.col("doc_id")
    page = F.when(k % 3 == 0, F.concat_ws(" - ", k, k + 1)).when(k % 3 == 1, k.cast("string"))
    return table(spark, sf, "documents").select("doc_id", T.answer_text(F.col("text"), page).alias("t"))


@query(
    "text_length_stats",
    "SELECT lang, max(length(text))::INTEGER AS most, min(length(text))::INTEGER AS least, round(avg(length(text)), 6) AS mean, sum(len(string_split(text, ' ')))::BIGINT AS words FROM documents GROUP BY lang",
)
def text_length_stats(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.max(F.length("text")).alias("most"), F.min(F.length("text")).alias("least"), F.round(F.avg(F.length("text")), 6).alias("mean"), F.sum(T.count_words(F.col("text"))).alias("words")
    )


@query("sentence_pack")
def sentence_pack(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentence_pack(F.col("text"), 500)).alias("i", "t"))


@query(
    "cache_keys",
    "SELECT c_custkey, c_name || '_' || c_mktsegment || CASE WHEN c_acctbal > 5000 THEN '_' || c_nationkey ELSE '' END AS key FROM customer",
)
def cache_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.cache_key(F.col("c_name"), F.col("c_mktsegment"), F.when(F.col("c_acctbal") > 5000, F.col("c_nationkey").cast("string"))).alias("key"))
