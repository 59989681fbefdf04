"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The tokens that end at a place of a word are the vocabulary's matches that are suffixes of the
prefix up to it, which an Aho-Corasick automaton over the vocabulary, in place of a suffix
automaton, yields in one pass; the matches are the same. Exactly one of them can be the last token of the prefix's encoding: the one that fits the last token of the
prefix before it, which means that merging the two tokens' strings would end in these two tokens
again. The last token of every prefix is stored, and back-pointers give the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex
from tokenizers.normalizers import Lowercase
from tokenizers.pre_tokenizers import Split

from tallybook.llm.common import carried, once, prepare, passed, passed_schema, restored, quoted, spread

RESULTS = ["ids", "decoded"]

# How the tokenizer splits text into words, and what letters and numbers are below U+0250.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\s{letters}{digits}]+"
_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"


def encode_texts(
    docs: DataFrame, vocabulary: bytes, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True
) -> DataFrame:
    """The columns of ``docs`` with ``ids`` and ``decoded``.

    ``vocabulary`` is the content of a tokenizers file with a lower-casing word-end BPE. ``ids`` (binary,
    little-endian unsigned 32-bit integers) equal what the tokenizers library gives without adding
    special tokens; strings of special tokens in a text become their ids. ``decoded`` is the text
    of the ids, special tokens kept. A null text is empty. Repeated rows each come out; input
    columns of these names are replaced, and without ``keep_text`` the text is left out.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    texts = carried(docs, id_col, text_col, RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once(f"bpe_{hashlib.md5(shared.value).hexdigest()}", lambda: Coder(shared.value))
        for rows in batches:
            ids, decoded = zip(*[coder.both(t or "") for t in rows.column("text").to_pylist()] or [((), ())])
            yield passed(
                rows, keep_text, ids=pa.array(ids[: len(rows)], pa.binary()), decoded=pa.array(decoded[: len(rows)], pa.string())
            )

    schema = passed_schema(texts, keep_text, "ids binary, decoded string")
    found = spread(texts, F.col("id"), F.col("text")).select("text", "rest").mapInArrow(run, schema)
    return found.select(*restored(docs, text_col, RESULTS, keep_text))


class Coder:
    """One vocabulary: words to ids by dynamic programming, ids to text.

    Words and pairs of tokens that were met before are remembered, up to a bounded number.
    """

    def __init__(self, vocabulary: bytes, held: int = 1 << 18):
        content = json.loads(vocabulary)
        model = content["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in self.ids.items()}
        self.halves: dict[int, tuple[int, int, int]] = {}  # Token: rank of its merge, its two halves.
        self.merged: dict[tuple[int, int], int] = {}  # Two tokens: rank of their merge.
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = self.ids[a], self.ids[b]
            self.merged[pair] = rank
            self.halves.setdefault(self.ids[a + b], (rank, *pair))
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.ending: dict[str, int] = {}  # Tokens that end a word, without the mark of the end.
        self.inner: dict[str, int] = {}
        for s, i in self.ids.items():
            if self.suffix and s.endswith(self.suffix):
                self.ending[s[: -len(self.suffix)]] = i
            else:
                self.inner[s] = i
        if not self.suffix:
            self.ending = self.inner
        self.held = held
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        # A line feed, which no symbol stands for, ends a word; tokens for its end are keyed with it.
        self.automaton = ahocorasick.Automaton()
        for tokens, end in ((self.inner, ""), (self.ending, "\n")):
            for string, i in tokens.items():
                if self.stands(i):
                    self.automaton.add_word(string + end, (len(string + end), i))
        self.automaton.make_automaton()
        self.packed = {i: np.array([i], dtype="<u4").tobytes() for i in self.strings}
        self.symbols = byte_symbols()
        self.lowered = _lowered()
        letters, digits = (_members(c) for c in (r"\p{L}", r"\p{N}"))
        self.words = regex.compile(_WORDS.format(letters=letters, digits=digits), regex.V1).findall
        self.plain_words = re.compile(_WORDS.format(letters=_LETTERS, digits=_DIGITS)).findall
        self.plain = re.compile("[\0-\x1b -\u024f]*").fullmatch
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, tuple[bytes, str]] = {}

    def both(self, text: str) -> tuple[bytes, str]:
        """Ids and decoded text."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        found: list[tuple[bytes, str]] = []
        for part in parts:
            if part in self.special:
                found.append((self.packed[self.special[part]], part))
                continue
            normal = unicodedata.normalize("NFC", part)
            normal = "".join(map(str.lower, normal)) if "Σ" in normal else normal.lower()
            if self.plain(normal):
                words = self.plain_words(normal)
            else:
                words = self.words(normal.translate(self.lowered))
            known = list(map(self.known.get, words))
            if None in known:
                new = {word for word, i in zip(words, known) if i is None}
                if len(self.known) + len(new) > self.held:
                    self.known.clear()
                    new = set(words)
                self.learn(list(new))
                known = map(self.known.__getitem__, words)
            found += known
        # Tokens are joined by one space, and no word is without tokens.
        return b"".join([i for i, _ in found]), " ".join([s for _, s in found])

    def learn(self, words: list[str]) -> None:
        """Encode words: the last token of each prefix, then the way back from each word's end."""
        spelled = [w.encode().decode("latin-1").translate(self.symbols) for w in words]
        joined = "\n".join(spelled) + "\n"
        last = [-1] * (len(joined) + 1)  # Last token of the prefix of its word up to here.
        size = [0] * (len(joined) + 1)
        begins = [0, *accumulate(len(s) + 1 for s in spelled)]
        begin = bytearray(len(joined) + 1)
        for i in begins:
            begin[i] = 1
        fits = self.fits
        for place, (length, token) in self.automaton.iter(joined):
            place += 1
            if last[place] >= 0:
                continue
            start = place - length
            if not begin[start]:
                before = last[start]
                if before < 0:
                    continue
                fit = fits.get(before << 32 | token)
                if not (self.fit(before, token) if fit is None else fit):
                    continue
            last[place], size[place] = token, length
        packed, strings = self.packed, self.strings
        for word, first, place in zip(words, begins, begins[1:]):
            ids = []
            while place > first:
                ids.append(last[place])
                place -= size[place]
            ids.reverse()
            self.known[word] = b"".join([packed[i] for i in ids]), " ".join([strings[i] for i in ids])

    def stands(self, token: int) -> bool:
        """True if a token's own string is encoded as that token alone."""
        found = self.whole.get(token)
        if found is None:
            half = self.halves.get(token)
            found = half is None or (
                self.stands(half[1]) and self.stands(half[2]) and self._meet(half[1], half[2]) == half[0]
            )
            self.whole[token] = found
        return found

    def fit(self, a: int, b: int) -> bool:
        """True if the strings of two tokens, joined, are encoded as these two tokens."""
        if len(self.fits) >= 4 * self.held:
            self.fits.clear()
        found = self.fits[a << 32 | b] = self._meet(a, b) is None
        return found

    def _meet(self, a: int, b: int) -> int | None:
        """Rank of the first merge across the border of two tokens, None if they stay apart.

        Undoes the two tokens' merges at the border, the later one first. A merge across happens if
        its rank is below those of the merges that take its two sides away; of equal ranks, the
        one further left goes first.
        """
        found = None
        above_a = above_b = 1 << 60  # Ranks of the merges that have just been undone.
        while True:
            rank = self.merged.get((a, b))
            if rank is not None and rank < above_a and rank <= above_b:
                found = rank
            half_a, half_b = self.halves.get(a), self.halves.get(b)
            if half_a is None and half_b is None:
                return found
            if half_b is None or (half_a is not None and half_a[0] >= half_b[0]):
                above_a, _, a = half_a
            else:
                above_b, b, _ = half_b


def _members(category: str) -> str:
    """Ranges of the characters the tokenizers library counts in a category, asked of itself.

    Its tables are older or newer than those of other libraries, and differ in over 1500 characters.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    split = Split(Regex(category), behavior="removed")
    begin, ranges = 0, []
    for _, (first, last) in [*split.pre_tokenize_str(every), ("", (len(every), len(every)))]:
        if first > begin:
            ranges.append(f"\\U{ord(every[begin]):08x}-\\U{ord(every[first - 1]):08x}")
        begin = last
    return "".join(ranges)


def _lowered() -> dict[int, str]:
    """Characters the tokenizers library lower-cases otherwise than this Python, asked of itself."""
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)] if c != 10]
    theirs = Lowercase().normalize_str("\n".join(every)).split("\n")
    return {ord(c): low for c, low in zip(every, theirs) if low != c.lower()}


def byte_symbols() -> dict[int, str]:
    """One printable character for each byte: itself where it is printable, the next free one else."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    symbols, free = [], 256
    for b in range(256):
        symbols.append(chr(b) if b in plain else chr(free))
        free += b not in plain
    return dict(enumerate(symbols))
