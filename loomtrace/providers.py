"""What stands for models: embedding, tokens, language, tagging, parsing, generation.

Each has a deterministic offline form. These approximate models; the operators that use them are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtrace.functions.text import count_tokens
from loomtrace.operators.linguistic import Parser, shallow_parse
from loomtrace.operators.vectors import hashed_vector


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def embed(text: Column, size: int = 64) -> Column:
    return hashed_vector(words(text), size)


def language(text: Column) -> Column:
    from loomtrace.plans.text import stop_word_vote

    return stop_word_vote(text)


def has_verb(text: Column) -> Column:
    """Whether a word of a sentence is an auxiliary or has a verb's ending."""
    return F.lower(text).rlike(r"\b(is|are|was|were|be|been|has|have|had|do|does|did|can|could|may|might|must|shall|should|will|would)\b|\w{3,}(ed|ing|izes|ates|ifies)\b")


def generate(prompt: Column) -> Column:
    """Echo the contents that a prompt brings."""
    return F.coalesce(F.nullif(F.regexp_extract(prompt, r"(?s)Contents:\s*(.*)", 1), F.lit("")), F.lit(""))


@dataclass(frozen=True)
class Providers:
    embedding: Callable[[Column], Column] = embed
    tokens: Callable[[Column], Column] = count_tokens
    language: Callable[[Column], Column] = language
    tagger: Callable[[Column], Column] = has_verb
    parser: Parser = shallow_parse
    generation: Callable[[Column], Column] = generate
    #: Prompts around a text for models that tell questions from passages.
    templates: dict[str, str] = field(default_factory=lambda: {"question": "query: {text}", "passage": "passage: {text}"})


DEFAULT = Providers()
