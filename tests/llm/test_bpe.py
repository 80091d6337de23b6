import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomtrace.llm import bpe
from loomtrace.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("aabcdehinorst'  \n\t.,<|>0129éßÉİΣσ\x1c\x00\u0301中ก_-") + ["<|endoftext|>"]), max_size=40).map("".join))
def test_same_ids_as_the_library(text):
    library = Tokenizer.from_file(PATH) if not hasattr(test_same_ids_as_the_library, "t") else test_same_ids_as_the_library.t
    test_same_ids_as_the_library.t = library
    enc = bpe.encoder(PATH)
    ids = library.encode(text, add_special_tokens=False).ids
    assert enc.encode(text) == ids
    assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_query_shape_nulls_and_repeats(spark, library):
    rows = [(1, "The cat’s 12 hats."), (2, None), (3, ""), (3, ""), (4, "word " * 30_000), (5, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n_tokens", "1 as ids_sha256")
    got = sorted(map(tuple, bpe.encode_digests(docs, PATH).collect()))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_digests(docs.limit(0), PATH).count() == 0
    texts = {r.doc_id: r for r in bpe.encode_texts(docs, PATH).collect()}
    assert list(texts[1].ids) == library.encode(rows[0][1], add_special_tokens=False).ids


def test_a_worker_keeps_few_words(monkeypatch, library):
    monkeypatch.setattr(bpe, "STORE", 40)
    monkeypatch.setattr(bpe, "STEPS", 30, raising=False)
    enc = bpe.Encoder(PATH)
    words = [f"{a}{b}{c}" for a in "bdfgKé" for b in "aeiou" for c in "lmnrß"]
    text = " ".join(f"{w} {w}, ({w})' {w}12" for w in words * 2)
    assert enc.encode(text) == library.encode(text, add_special_tokens=False).ids
    stores = [store for pair in vars(enc).values() if isinstance(pair, tuple) for store in pair]
    assert 0 < sum(map(len, stores)) <= 2 * bpe.STORE
    assert len(enc.pairs) <= 30 and len(enc.automaton.moves) <= 30
