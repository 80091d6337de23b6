"""Column functions over text: cleaning, names, labels, question lines, prompts."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WH_WORDS = ("why", "how", "what", "where", "when", "who", "which", "whose", "whom")
EDU_PHRASES = ("despite what", "after what", "in what manner", "while what", "in what case", "before what", "since when", "until when", "instead of what", "except when", "unless what")
NUMBER = r"^-?\d+(\.\d+)?(e[-+]?\d+)?$"
CLAUSE = "{obj}"
# Codes of a language detector and their names.
LANGUAGES = {
    "af": "Afrikaans", "ar": "Arabic", "bg": "Bulgarian", "bn": "Bengali", "ca": "Catalan", "cs": "Czech", "cy": "Welsh", "da": "Danish", "de": "German", "el": "Greek", "en": "English",
    "es": "Spanish", "et": "Estonian", "fa": "Persian", "fi": "Finnish", "fr": "French", "gu": "Gujarati", "he": "Hebrew", "hi": "Hindi", "hr": "Croatian", "hu": "Hungarian", "id": "Indonesian",
    "it": "Italian", "ja": "Japanese", "kn": "Kannada", "ko": "Korean", "lt": "Lithuanian", "lv": "Latvian", "mk": "Macedonian", "ml": "Malayalam", "mr": "Marathi", "ne": "Nepali", "nl": "Dutch",
    "no": "Norwegian", "pa": "Punjabi", "pl": "Polish", "pt": "Portuguese", "ro": "Romanian", "ru": "Russian", "sk": "Slovak", "sl": "Slovenian", "so": "Somali", "sq": "Albanian", "sv": "Swedish",
    "sw": "Swahili", "ta": "Tamil", "te": "Telugu", "th": "Thai", "tl": "Tagalog", "tr": "Turkish", "uk": "Ukrainian", "ur": "Urdu", "vi": "Vietnamese", "zh-cn": "Chinese (Simplified)", "zh-tw": "Chinese (Traditional)",
}


def is_number(x: Column) -> Column:
    return x.rlike(NUMBER)


def is_not_wh_word(x: Column, whole_words: bool = False) -> Column:
    """False for question words. By default any word that begins with one counts, as in "whole"."""
    end = r"\b" if whole_words else ""
    return ~x.rlike(f"(?i)^({'|'.join(WH_WORDS)}){end}")


def is_clause(x: Column) -> Column:
    return x.contains(CLAUSE)


def is_url(x: Column) -> Column:
    """Whether a text begins like an address: with a scheme, or as a path from here or from the server."""
    return F.trim(x).rlike(r"^(\w+:|\.\.?/|//)")


def is_html(x: Column) -> Column:
    """Whether a text begins with a tag."""
    return x.rlike(r"""^<("[^"]*"['"]*|'[^']*'['"]*|[^'">])+>""")


# Letters that no decomposition gives, and what they become.
_LETTERS = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ı": "i", "ﬁ": "fi", "ﬂ": "fl"}


def _folds() -> tuple[str, str, str]:
    """Signs with a one-letter ASCII form, these forms, and combining marks, which vanish."""
    signs = [chr(c) for c in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFF01, 0xFF5F))]
    forms = {c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in signs if c not in _LETTERS}
    forms = {c: f for c, f in forms.items() if len(f) == 1 and f != c and f.isascii()}
    # Quotation marks and dashes.
    forms |= dict(zip("‘’“”–—", "''\"\"--"))
    return "".join(forms), "".join(forms.values()), "".join(map(chr, range(0x300, 0x370)))


_SIGNS, _FORMS, _MARKS = _folds()


def ascii_fold(x: Column) -> Column:
    """Trimmed, Latin letters and full-width signs in their ASCII form, accents dropped. Signs of other scripts stay."""
    x = F.translate(F.trim(x), _SIGNS + _MARKS, _FORMS)
    for sign, form in _LETTERS.items():
        if len(form) > 1:
            x = F.replace(x, F.lit(sign), F.lit(form))
    ones = {k: v for k, v in _LETTERS.items() if len(v) == 1}
    return F.translate(x, "".join(ones), "".join(ones.values()))


def clean_content(x: Column, remove_footnote: bool = False, remove_newlines: bool = False) -> Column:
    """White space, hyphen breaks and wrapped lines repaired by ordered rewrites.

    With ``remove_footnote`` a text that doesn't end in a full stop loses its last line.
    """
    # Patterns and what they become.
    first = [(r"^\s+|\s+$", ""), (r"[\r ]*\n[\r ]*", "\n"), (r"\t", " "), (r"  +", " ")]
    breaks = [(r"\(cid:173\) *\n+", ""), (r"- *\n+", "")]
    paragraphs = [(r"([^A-Z\n ])\n\n([^A-Z\n ])", "$1\n$2"), (r"([^\n.])\n([^\n])", "$1 $2")]
    rules = [*first, *([] if remove_newlines else [(r"\n\n+", "\n\n")]), *breaks]
    for pattern, to in rules:
        x = F.regexp_replace(x, pattern, to)
    if remove_footnote:
        x = F.when(x.endswith("."), x).otherwise(F.regexp_replace(x, r"(^|\n)[^\n]*$", ""))
    for pattern, to in [*([(r"\n+", " ")] if remove_newlines else paragraphs), (r" +", " ")]:
        x = F.regexp_replace(x, pattern, to)
    return x


def strip_tags(x: Column) -> Column:
    """Text of markup without tags, common references decoded."""
    x = F.regexp_replace(x, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    x = F.regexp_replace(x, r"<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def uid(x: Column) -> Column:
    """The MD5 digest of a text in base 36, without leading zeros."""
    digest = F.md5(x.cast("binary"))
    words = F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in (3, 2, 1, 0)))
    five = 36**5

    def digits(w: Column) -> Column:
        # The four 32-bit words times what their places are in base 36 ** 5: no sum reaches 2 ** 61. Then what is over goes to the next place.
        out, over = [], F.lit(0).cast("bigint")
        for place in range(5):
            total = sum((F.get(w, k) * F.lit(c).cast("bigint") for k in range(4) if (c := (1 << 32 * k) // five**place % five)), over)
            out.append(F.lpad(F.conv((total % five).cast("string"), 10, 36), 5, "0"))
            over = F.call_function("div", total, F.lit(five).cast("bigint"))
        return F.concat(*out[::-1])

    # A variable of a lambda is worked out once.
    text = F.get(F.transform(F.array(words), digits), 0)
    return F.when(x.isNotNull(), F.regexp_replace(text, "^0+(?=.)", ""))


def uri_of(x: Column, most: int = 25) -> Column:
    """A text's name: ASCII, lower case, blanks as underscores; long texts by digest."""
    name = F.regexp_replace(F.regexp_replace(F.trim(F.lower(ascii_fold(x))), " ", "_"), r"\s", "")
    return F.when(F.length(name) < most, name).otherwise(uid(name))


def explode_key(x: Column) -> Column:
    """A name as words: underscores and camel case split, a prefix dropped where there is one, single capitals kept together."""
    x = F.regexp_replace(x, r"[_-]", " ")
    x = F.when(F.size(F.split(x, ":", -1)) == 2, F.get(F.split(x, ":", -1), 1)).otherwise(x)
    x = F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2)))
    parts = F.regexp_extract_all(x, F.lit("([0-9A-Z][^A-Z]*)"), F.lit(1))
    # A single capital goes to the word before it.
    joined = F.aggregate(parts, F.lit(""), lambda a, p: F.when((F.length(p) == 1) | (a == ""), F.concat(a, p)).otherwise(F.concat(a, F.lit(" "), p)))
    return F.trim(F.regexp_replace(joined, " +", " "))


def balance_brackets(x: Column) -> Column:
    """At most one missing closing sign of each kind is added."""
    for a, b in (("(", ")"), ("[", "]"), ("{", "}")):
        count = lambda t, c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
        x = F.when(count(x, a) > count(x, b), F.concat(x, F.lit(b))).otherwise(x)
    quotes = F.length(x) - F.length(F.replace(x, F.lit('"'), F.lit("")))
    return F.when(quotes % 2 == 1, F.concat(x, F.lit('"'))).otherwise(x)


def single_line(x: Column) -> Column:
    return F.replace(F.trim(x), F.lit("\n"), F.lit(" "))


def syntactic_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def labels_are_similar(a: Column, b: Column, threshold: float = 0.3) -> Column:
    return syntactic_distance(a, b) < threshold


def labels_are_contained(a: Column, b: Column, threshold: float = 0.3, ordered: bool = False) -> Column:
    """Whether the shorter label is, but for a few edits, part of the longer one."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    found = F.when(short == 0, F.lit(True)).otherwise(1 + (F.levenshtein(a, b) - long) / short < threshold)
    return found & (F.length(a) <= F.length(b)) if ordered else found


# Fixed value: how a line of a list begins.
_MARKER = r"^\s*(\d+\.|\(\w+\)|\w\)|\d+\)|\d*\-|\w\-)\s*"


def qa_of_line(line: Column) -> Column:
    """struct(question, answer) of a line with exactly one question mark, else null."""
    clean = F.regexp_replace(F.regexp_replace(line, _MARKER, ""), r"\?\s*-", "?")
    parts = F.split(clean, r"\?")
    pair = F.struct(F.concat(F.trim(F.get(parts, 0)), F.lit("?")).alias("question"), F.trim(F.get(parts, 1)).alias("answer"))
    return F.when(F.size(parts) == 2, pair)


def question_type(question: Column) -> Column:
    return F.when(F.lower(question).rlike("|".join(EDU_PHRASES)), F.lit("edu")).otherwise(F.lit("amr"))


def answer_text(sentence: Column, page_id: Column) -> Column:
    """A sentence with its page or pages."""
    page = F.when(page_id.contains("-"), F.concat(F.lit("(pp. "), page_id, F.lit(")"))).otherwise(F.concat(F.lit("(p. "), page_id, F.lit(")")))
    return F.concat(sentence, F.lit(" "), F.coalesce(page, F.lit("")))


def answer_block(question: Column, answers: Column) -> Column:
    """A question and its answers as a list."""
    return F.concat_ws("\n- ", question, answers)


def count_words(x: Column) -> Column:
    """Parts between single spaces; empty parts count."""
    return F.size(F.split(x, " ", -1))


def count_tokens(x: Column) -> Column:
    """Words and single signs: an offline stand-in for a model's tokens."""
    return F.size(F.regexp_extract_all(x, F.lit(r"\w+|[^\w\s]"), F.lit(0)))


def cache_key(*parts: Column) -> Column:
    """Parts that are set, joined by underscores."""
    return F.concat_ws("_", *parts)


def fill(template: Column, values: Mapping[str, Column]) -> Column:
    """``{name}`` in a template replaced by each value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def p_value_text(p: Column) -> Column:
    return F.when(p < 0.001, F.lit("<0.001")).when(p > 0.999, F.lit(">0.999")).otherwise(F.format_string("p=%.3f", p))


def language_name(code: Column) -> Column:
    """A language's name, empty for an unknown code."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in LANGUAGES.items() for v in pair)), code), F.lit(""))


def without_brackets(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "【[^】]*】", ""), r"\([^(]*\)", ""))


def sentence_pack(x: Column, most: int = 5000) -> Column:
    """Sentences packed, in order, into pieces of at most ``most`` characters; a longer sentence stands alone."""
    start = F.array().cast("array<string>")

    def add(parts: Column, s: Column) -> Column:
        last = F.element_at(parts, -1)
        longer = F.concat(last, F.lit(" "), s)
        fits = (F.size(parts) > 0) & (F.length(longer) <= most)
        return F.when(fits, F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(parts, F.array(s)))

    return F.aggregate(F.split(x, r"(?<=[.!?]) +"), start, add)
