"""Byte-pair encoding and decoding with forced boundaries.

A pair of neighbouring bytes that stands inside no token of the vocabulary can never be
covered by one token, so every text may be cut there before any merge is tried. The
fragments between such certain cuts are encoded independently and concatenated.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated
rows give equal rows; an empty table gives an empty table; columns other than the id and
the text are ignored, so clashing names do not matter; null ids are returned as they are.
Texts are never cut short: a word without white space of any length goes through a heap
of merge candidates in n log n steps.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabular_insights.llm.common import find_package, slices

#: Entries of the caches of encoded words and pieces in each Python worker; a cache is
#: emptied beyond that. Words and pieces beyond ``LONG`` are not kept.
WORDS, PIECES = 250_000, 250_000
LONG = 64
#: Rows that are encoded or decoded and handed on at a time.
ROWS = 250
#: The pattern of the tokenizer file, and the byte alphabet of byte-level
#: vocabularies (printable bytes stand for themselves, the others follow from 256 on).
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_LATIN = re.compile("[!-~\xa1-\u024f]*")
_SEPARATORS = re.compile("[\x1c-\x1f]")


class Codec:
    """A byte-level vocabulary with word ends, read from a public tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.vocabulary.values(), *self.special.values()]) + 1)
        for token, number in [*self.vocabulary.items(), *self.special.items()]:
            self.tokens[number] = token
        bodies = [t.removesuffix(self.suffix) for t in self.vocabulary if t not in self.special]
        #: Byte pairs, in the byte alphabet of the vocabulary, that stand inside some token.
        self.inner = {pair for body in bodies for pair in zip(body, body[1:])}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.space = regex.compile(r"[^\s\x1c-\x1f]*(?:[\x1c-\x1f]+[^\s\x1c-\x1f]*)*")
        self.words: dict[str, bytes] = {}
        self.known_pieces: dict[str, bytes] = {}

    def fragments(self, piece: str) -> list[str]:
        """``piece`` cut at every byte pair that no token contains."""
        inner = self.inner
        cuts = [0, *[i for i, pair in enumerate(zip(piece, piece[1:]), 1) if pair not in inner], len(piece)]
        return [piece[a:b] for a, b in zip(cuts, cuts[1:])] if len(cuts) > 2 else [piece]

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge neighbours by rank, the leftmost of equal ranks first."""
        if len(symbols) > LONG:
            return self._merge_long(symbols)
        ranks, none = self.ranks.get, len(self.ranks)
        found = [ranks(pair, none) for pair in zip(symbols, symbols[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del found[i]
            if i < len(found):
                found[i] = ranks((symbols[i], symbols[i + 1]), none)
            if i:
                found[i - 1] = ranks((symbols[i - 1], symbols[i]), none)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        count = len(symbols)
        after = [*range(1, count), -1]
        before = [-1, *range(count - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        live: list[str | None] = list(symbols)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if live[i] != a or j < 0 or live[j] != b:
                continue
            live[i], live[j] = a + b, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0:
                    pair = (live[left], live[right])
                    if (r := self.ranks.get(pair)) is not None:
                        heapq.heappush(heap, (r, left, *pair))
        return [s for s in live if s is not None]

    def pieces(self, part: str) -> list[str]:
        """Pre-tokens in the byte alphabet. Latin text, where every version of Unicode
        agrees, is cut here; all other text by the normalizer of the file."""
        if _LATIN.fullmatch(part) and is_normalized("NFC", part):
            found = _PIECE.findall(part.lower())
            return found if part.isascii() else [p.encode().decode("latin-1").translate(_ALPHABET) for p in found]
        return [p for p, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))]

    def encode_piece(self, piece: str) -> bytes:
        fragments = self.fragments(piece)
        last = list(fragments[-1])
        last[-1] += self.suffix
        merged = [self.merge(list(f)) for f in fragments[:-1]] + [self.merge(last)]
        ids = [self.vocabulary[t] for tokens in merged for t in tokens]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_word(self, word: str) -> bytes:
        ids, known = [], self.known_pieces
        for part in self.split_special.split(word) if self.split_special and "<|" in word else (word,):
            if part in self.special:
                ids.append(struct.pack("<I", self.special[part]))
                continue
            for piece in self.pieces(part):
                found = known.get(piece)
                if found is None:
                    found = self.encode_piece(piece)
                    if len(piece) <= LONG:
                        known[piece] = found
                ids.append(found)
        return b"".join(ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words = text.split()
        if _SEPARATORS.search(text):  # white space to Python, but not to the vocabulary
            words = [w for w in self.space.findall(text) if w]
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        for cache, most in ((known, WORDS), (self.known_pieces, PIECES)):
            if len(cache) > most:
                cache.clear()
        out = []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(word) <= LONG:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """The tokens of packed ids, joined as a vocabulary without a decoder joins them."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids or b"", "<u4").tolist()])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoder(path: str, names: list[str]):
    """Batches ``(id, text)`` become ``(id, n_tokens, ids)``."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in slices(batches, ROWS):
            ids = [coder.encode(t) for t in batch.column(1).to_pylist()]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], names)

    return encoded


def _decoder(path: str, at: int, names: list[str]):
    """Batches get the text of the ids in column ``at`` as their last column."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in slices(batches, ROWS):
            texts = pa.array([coder.decode(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names)

    return decoded


def _encoded_schema(df: DataFrame, id_col: str) -> T.StructType:
    return T.StructType(
        [df.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, n_tokens, ids)``; ``ids`` are packed little-endian 32-bit integers."""
    find_package(df.sparkSession)
    schema = _encoded_schema(df, id_col)
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(_encoder(path, schema.names), schema)


def decode_documents(df: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the packed ids of ``ids_col`` decoded into the column ``into``.

    A column of that name in ``df`` is replaced.
    """
    find_package(df.sparkSession)
    rest = [c for c in df.columns if c != into]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(into, T.StringType())])
    return df.select(*rest).mapInArrow(_decoder(path, rest.index(ids_col), schema.names), schema)


def encode_and_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, n_tokens, ids, decoded)`` of :func:`encode_documents` and :func:`decode_documents`.

    Both run in one Python worker of a task, which holds the vocabulary once; one after the
    other they take two workers, which stay, idle, beside what the executor does next.
    """
    find_package(df.sparkSession)
    half = _encoded_schema(df, id_col)
    schema = T.StructType([*half, T.StructField("decoded", T.StringType())])
    encoded, decoded = _encoder(path, half.names), _decoder(path, half.names.index("ids"), schema.names)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoded(encoded(batches))

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(both, schema)
