"""BPE encoding and decoding by dynamic programming over prefixes.

A greedy merger applies merges in order of rank. The same ids come from a scan: every prefix of a
word has exactly one last token, namely the only vocabulary token that ends there, whose own start
is a reachable prefix, and which may follow the last token of that prefix. Suffix links of an
automaton over the vocabulary give all tokens ending at a position; a pair test that undoes merges
decides whether two tokens may stand side by side; back-pointers give the ids.

Words repeat, so a worker keeps the ids of the words and of the chunks between white space that it has met, in one
store. It is bounded: it holds two generations and forgets the older one. Spark uses a worker again for other tasks, so
what the store holds counts in their memory, too.

Defined cases: a null text is empty; an empty text has no ids; strings of special tokens in a text
become these tokens, as in the tokenizers library; rows that repeat give repeated rows; texts of any length are encoded whole;
an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomtrace.llm.common import slices, small_batches

#: Chunks and words that one generation of a worker's store holds together, and what other stores hold.
STORE = 200_000
STEPS = 500_000
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next free code point."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


class VocabularyAutomaton:
    """A trie of the vocabulary with suffix links: its states are prefixes of tokens, and say which tokens end where a text has been read."""

    def __init__(self, tokens: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        own: list[tuple[int, int] | None] = [None]
        for token, i in tokens.items():
            state = 0
            for letter in token:
                to = self.next[state].get(letter)
                if to is None:
                    to = self.next[state][letter] = len(self.next)
                    self.next.append({})
                    own.append(None)
                state = to
            own[state] = (i, len(token))
        self.link = [0] * len(self.next)
        #: For each state the (token, length) of all tokens that are suffixes of it, longest first.
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        queue = [0]
        for state in queue:
            for letter, to in self.next[state].items():
                if state:
                    back = self.link[state]
                    while back and letter not in self.next[back]:
                        back = self.link[back]
                    self.link[to] = self.next[back].get(letter, 0)
                self.ends[to] = (*((own[to],) if own[to] else ()), *self.ends[self.link[to]])
                queue.append(to)

        #: Steps taken so far that leave the trie, so that each is looked up once.
        self.moves: dict[tuple[int, str], int] = {}

    def step(self, state: int, letter: str) -> int:
        """The next state where the trie has no edge: that of the longest suffix that can go on."""
        to = self.moves.get((state, letter))
        if to is None:
            at = state
            while at and letter not in self.next[at]:
                at = self.link[at]
            if len(self.moves) >= STEPS:
                self.moves.clear()
            to = self.moves[state, letter] = self.next[at].get(letter, 0)
        return to


class Encoder:
    """Ids and decoded text of a vocabulary file of the word-end BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.names = {i: token for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: s for s, i in self.special.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for k, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            whole = vocab[a + b]
            self.rank[pair] = k
            self.parts[whole] = pair
            self.made[whole] = k
        self.letters = byte_letters()
        # One sign stands for the word's end, so that "g" and "g</w>" are texts of one and two signs.
        self.sign = "\x00"
        written = {}
        for token, i in vocab.items():
            closed = bool(self.end) and token.endswith(self.end) and len(token) > len(self.end)
            written[token[: -len(self.end)] + self.sign if closed else token] = i
        self.automaton = VocabularyAutomaton({t: i for t, i in written.items() if self._whole(i)})
        self.pairs: dict[int, bool] = {}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: tuple[dict, dict] = ({}, {})

    def _whole(self, i: int) -> bool:
        """Whether merging a token's own letters gives the token; others are never produced."""
        return i not in self.parts or (self.fits(*self.parts[i], self.made[i]) and all(map(self._whole, self.parts[i])))

    def fits(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether merging leaves a and b side by side, looking only at merges of a rank under ``before``.

        Undo the youngest merge at the border again and again: if the two tokens that then meet
        there could have merged earlier than the part that swallowed one of them, they would have.
        """
        while True:
            k = self.rank.get((a, b))
            if k is not None and k < before:
                return False
            made_a, made_b = self.made.get(a, -1), self.made.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            # Of two merges of the same rank the left one is done first.
            if made_a > made_b:
                before, a = made_a, self.parts[a][1]
            else:
                # A merge at the left border of b may tie with (a, b) of that rank, which lies further left.
                before, b = made_b + 1, self.parts[b][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the pre-tokenizer's."""
        text = "".join([self.letters[b] for b in word.encode()]) + self.sign * bool(self.end)
        edges, step, ends, pairs, state = self.automaton.next, self.automaton.step, self.automaton.ends, self.pairs, 0
        last: list[int] = [-1] * (len(text) + 1)
        size: list[int] = [0] * (len(text) + 1)
        at = 0
        for letter in text:
            at += 1
            to = edges[state].get(letter)
            state = step(state, letter) if to is None else to
            for token, n in ends[state]:
                if at > n:
                    before = last[at - n]
                    if before < 0:
                        continue
                    pair = before << 32 | token
                    good = pairs.get(pair)
                    if good is None:
                        if len(pairs) >= STEPS:
                            pairs.clear()
                        good = pairs[pair] = self.fits(before, token)
                    if not good:
                        continue
                last[at] = token
                size[at] = n
                break
        at, out = len(text), []
        while at:
            if last[at] < 0:
                raise ValueError(f"no token of the vocabulary ends {word!r}")
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _keep(self, name: str, found: tuple[str, int, str]) -> None:
        if len(name) <= 64:
            if len(self.known[0]) >= STORE:
                self.known = {}, self.known[0]
            self.known[0][name] = found

    def _word(self, word: str) -> tuple[str, int, str]:
        """The ids as decimals joined by spaces, how many they are, and the tokens joined by spaces."""
        # ASCII letters in lower case are the same word as a chunk; any other word goes by a name that no chunk has.
        name = word if word.isascii() and word.isalpha() else " " + word
        young, old = self.known
        found = young.get(name)
        if found is None:
            found = old.get(name)
            if found is None:
                ids = self.encode_word(word)
                found = " ".join(map(str, ids)), len(ids), " ".join([self.names[i] for i in ids])
            self._keep(name, found)
        return found

    def _chunk(self, chunk: str) -> tuple[str, int, str]:
        """The same of a text without white space."""
        young, old = self.known
        found = young.get(chunk)
        if found is None:
            found = old.get(chunk)
            if found is None:
                if chunk.isascii():
                    low = chunk.lower()
                else:
                    # str.lower() alone would look at a sigma's neighbours.
                    low = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
                words = (low,) if low.isascii() and low.isalpha() else self.words.findall(low)
                if len(words) == 1:
                    found = self._word(words[0])
                else:
                    parts = [self._word(w) for w in words]
                    found = " ".join([x[0] for x in parts]), sum([x[1] for x in parts]), " ".join([x[2] for x in parts])
            self._keep(chunk, found)
        return found

    def pieces(self, text: str) -> list[tuple[str, int, str]]:
        found = []
        for k, part in enumerate(self.cut.split(text) if self.cut and "<|" in text else (text,)):
            if k % 2:
                i = self.special[part]
                found.append((str(i), 1, part))
                continue
            # split() also cuts at four control characters that the vocabulary's pattern keeps.
            chunks = _SPACE.split(part) if _ODD_SPACE.search(part) else part.split()
            get = self.known[0].get
            found += [get(c) or self._chunk(c) for c in chunks]
        return found

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, n, _ in self.pieces(text or "") if n for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, as the library does for a vocabulary without a decoder."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def digests(self, text: str | None) -> tuple[int, str, str]:
        ids, n, decoded = zip(*found) if (found := [x for x in self.pieces(text or "") if x[1]]) else ((), (), ())
        return sum(n), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(decoded).encode()).hexdigest()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder for a vocabulary file, built once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, "text"):
            found = [enc.digests(t) for t in batch.column(1).to_pylist()]
            n, ids, decoded = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = docs.select(docs[key], docs[text].alias("text"))
    return chosen.mapInArrow(run, f"`{key}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the ids themselves and the text they decode to."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, "text"):
            ids = [enc.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(i) for i in ids], pa.string())],
                names=[key, "ids", "decoded"],
            )

    chosen = docs.select(docs[key], docs[text].alias("text"))
    return chosen.mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>, decoded string")
