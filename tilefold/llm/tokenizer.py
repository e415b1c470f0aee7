"""Sizes of texts in tokens of a public byte-level tokenizer, in Arrow batches.

The vocabulary file is a parameter: ``vocabulary`` is a path, or the name of a file of the installed package
``public_tokenizers``. Every worker loads it once. A text counts as ordinary text, whole; special tokens do not exist.
A null text has null size, an empty one 0.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Texts longer than this are cut into words here: the library's own matcher recurses over long runs of white space.
DIRECT_CHARS = 20_000


class Tokenizer:
    """Counts tokens, and gives the words (the tokenizer's own pre-tokens) of a text with the tokens of each."""

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        path = vocabulary if Path(vocabulary).exists() else public_tokenizers.path(vocabulary)
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                word, rank = line.split()
                ranks[base64.b64decode(word)] = int(rank)
        self._encoding = tiktoken.Encoding("tilefold", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._piece = self._encoding._core_bpe.encode_single_piece
        self._words = regex.compile(public_tokenizers.PATTERN)
        self._known: dict[str, int] = {}

    def word_size(self, word: str) -> int:
        n = self._known.get(word)
        if n is None:
            n = len(self._piece(word.encode("utf-8", "replace")))
            if len(self._known) > 500_000:
                self._known.clear()
            if len(word) <= 64:
                self._known[word] = n
        return n

    def words(self, text: str) -> list[tuple[int, int]]:
        """(end offset in characters, tokens) of each word in order; the words tile the text."""
        return [(m.end(), self.word_size(m.group())) for m in self._words.finditer(text)]

    def count(self, text: str) -> int:
        if len(text) <= DIRECT_CHARS:
            return len(self._encoding.encode_ordinary(text))
        return sum(self.word_size(m.group()) for m in self._words.finditer(text))

    def at_most(self, text: str, limit: int) -> bool:
        """Whether the size is within ``limit``; a token is at least one byte, so short texts need no encoding."""
        return len(text) * 4 <= limit or len(text.encode("utf-8", "replace")) <= limit or self.count(text) <= limit


@lru_cache(maxsize=4)
def load(vocabulary: str = VOCABULARY) -> Tokenizer:
    return Tokenizer(vocabulary)


def sizes(texts: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, *keep, n_tokens): one pass over the texts, which leave the worker as a number."""
    src = texts.select(id_col, *keep, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(vocabulary)
        for batch in batches:
            n = [None if x is None else tok.count(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            names = [*batch.schema.names[:-1], "n_tokens"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=names)

    return src.mapInArrow(run, schema)
