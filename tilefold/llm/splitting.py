"""Splitting oversized blocks at natural boundaries, with overlap.

A block is cut into the tokenizer's words, whose ends are the candidates: the end of a sentence is the strongest, then
the end of a line, of a word, and the inside of a word. A sparse table over these strengths answers, for each window of
permissible lengths, which cut is the strongest, the rightmost among equals. The next piece starts a given overlap
before the cut, at a word. Each piece is measured as its own text, and the window is narrowed until it is in the limit.

All of it happens per page inside an Arrow batch: no shuffle, no state between pages.

Defined results: a null or empty text, and one without letters or digits, has no block. A block within the limit is
one piece without overlap. A word longer than the limit is cut inside, at characters; a limit below the four tokens that
one character can have is refused where such a character stands. Repeats of a ``doc_id`` are split
each. Pieces of a block cover it: each begins at or before the end of the one before it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tilefold.llm.tokenizer import VOCABULARY, Tokenizer, load

INSIDE, WORD, LINE, SENTENCE = 0, 1, 2, 3
NAMES = ("inside", "word", "line", "sentence", "end")
_OUT = "doc_id bigint, block_no bigint, piece_no bigint, n_pieces bigint, start bigint, end bigint, n_tokens bigint, overlap_tokens bigint, cut string, piece string"


@lru_cache(maxsize=1)
def _patterns():
    import regex

    return regex.compile(r"[\p{L}\p{N}]"), regex.compile(r"""[.!?…][)\]"'»”’]*\s*\Z""")


def blocks(text: str) -> list[str]:
    """Maximal runs of lines that each hold a letter or digit."""
    letter = _patterns()[0].search
    out: list[str] = []
    run: list[str] = []
    for line in text.split("\n"):
        if letter(line):
            run.append(line)
        elif run:
            out.append("\n".join(run))
            run = []
    if run:
        out.append("\n".join(run))
    return out


class SparseMax:
    """Range maximum over fixed values: levels of power-of-two windows, any range is the union of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            low = self.levels[-1]
            self.levels.append(np.maximum(low[:-step], low[step:]))
            step *= 2

    def max(self, lo: int, hi: int) -> int:
        """The largest value in [lo, hi]."""
        level = (hi - lo + 1).bit_length() - 1
        row = self.levels[level]
        return max(int(row[lo]), int(row[hi + 1 - (1 << level)]))


def boundaries(text: str, tok: Tokenizer, limit: int) -> tuple[list[int], list[int], list[int]]:
    """(end offsets, running tokens, strengths) of the candidate cuts, rising."""
    ends, tokens, strength = [], [], []
    total, at = 0, 0
    sentence = _patterns()[1].search
    for end, n in tok.words(text):
        if n > limit:  # cut the word into parts of characters that cannot exceed the limit
            step = max(1, limit // 4)
            for cut in range(at + step, end, step):
                total += len(tok._piece(text[cut - step : cut].encode("utf-8", "replace")))
                ends.append(cut)
                tokens.append(total)
                strength.append(INSIDE)
            total += tok.word_size(text[at if end - at <= step else end - ((end - at - 1) % step + 1) : end])
        else:
            total += n
        word = text[at:end]
        follows = text[end : end + 1]
        if (follows == "" or follows.isspace() or word.isspace()) and sentence(text, max(at - 4, 0), end):
            strength.append(SENTENCE)
        elif follows in ("\n", "") or word.endswith("\n"):
            strength.append(LINE)
        elif follows.isspace() or word.isspace():
            strength.append(WORD)
        else:
            strength.append(INSIDE)
        ends.append(end)
        tokens.append(total)
        at = end
    return ends, tokens, strength


def split_block(text: str, tok: Tokenizer, limit: int, overlap: int, least: float) -> list[tuple[int, int, int, int, str]]:
    """(start, end, tokens, overlap tokens, kind of cut) of the pieces of a block over the limit."""
    ends, tokens, strength = boundaries(text, tok, limit)
    n, at = len(ends), np.array(ends)
    table = SparseMax(np.array(strength, dtype=np.int64) * n + np.arange(n))
    upto = np.array(tokens)
    out: list[tuple[int, int, int, int, str]] = []
    first, shared = 0, 0  # the piece starts after cut first - 1, or at the character inside, which is before that cut
    inside = None
    while True:
        base = tokens[first - 1] if first else 0
        start = ends[first - 1] if first else 0
        done = out[-1][1] if out else 0
        if inside is not None:
            base, start = base - shared, inside
        high = int(np.searchsorted(upto, base + limit, side="right")) - 1
        bound = int(np.searchsorted(at, done, side="right"))  # a piece ends after the one before it
        while True:
            high = max(high, bound)
            if high >= n - 1:
                cut, kind = n - 1, "end"
            else:
                low = max(bound, min(high, int(np.searchsorted(upto, base + least * limit, side="left"))))
                cut = table.max(low, high) % n
                kind = NAMES[strength[cut]]
            size = tok.count(text[start : ends[cut]])
            if size <= limit:
                break
            if cut > bound:  # the piece as a text of its own has more tokens than its part of the block
                high = cut - 1
            elif inside is not None and start < done:
                start += 1
                shared = tok.count(text[start:done])
            elif first < bound:  # give up some of the overlap
                first += 1
                base, start = tokens[first - 1], ends[first - 1]
                shared = tok.count(text[start:done])
            else:
                raise ValueError(f"a single character has more than {limit} tokens")
        out.append((start, ends[cut], size, shared, kind))
        if cut == n - 1:
            return out
        back = int(np.searchsorted(upto, tokens[cut] - overlap, side="left")) + 1
        nearest = back = min(max(back, first + 1), cut + 1)
        while back <= cut and not (text[ends[back - 1] : ends[back - 1] + 1].isspace() or strength[back - 1] > INSIDE):
            back += 1  # an overlap begins at a word
        if back > cut:  # no word begins in it: at the token or character nearest the given overlap
            back = nearest
            while back <= cut and tok.count(text[ends[back - 1] : ends[cut]]) > overlap:
                back += 1
        first, inside = back, None
        if back > cut and overlap:  # no cut either, inside a very long word
            at_char = bisect_left(range(ends[cut]), -overlap, lo=start + 1, key=lambda i: -tok.count(text[i : ends[cut]]))
            while at_char < ends[cut] and tok.count(text[at_char : ends[cut]]) > overlap:
                at_char += 1
            inside = at_char if at_char < ends[cut] else None
        begins = ends[first - 1] if inside is None else inside
        shared = tok.count(text[begins : ends[cut]]) if begins < ends[cut] else 0


def split(
    pages: DataFrame,
    limit: int = 512,
    overlap: int = 32,
    least: float = 0.5,
    only_split: bool = False,
    with_text: bool = True,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """The pieces of every block of (doc_id, text); ``only_split`` leaves out blocks that stay whole.

    ``least`` is the smallest permissible length of a piece but the last, as a part of ``limit``.
    """
    if not 0 <= overlap < least * limit:
        raise ValueError("the overlap must be shorter than the shortest piece")
    schema = _OUT if with_text else _OUT.rsplit(",", 1)[0]
    arrow = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                for b, block in enumerate(blocks(text) if text else ()):
                    if tok.at_most(block, limit):
                        if not only_split:
                            row = (doc_id, b, 0, 1, 0, len(block), tok.count(block), 0, "end")
                            rows.append((*row, block) if with_text else row)
                        continue
                    cuts = split_block(block, tok, limit, overlap, least)
                    for i, (s, e, size, shared, kind) in enumerate(cuts):
                        row = (doc_id, b, i, len(cuts), s, e, size, shared, kind)
                        rows.append((*row, block[s:e]) if with_text else row)
                if len(rows) >= 20_000:
                    yield _batch(rows, arrow)
                    rows = []
            yield _batch(rows, arrow)

    return pages.select(pages["doc_id"].cast("bigint").alias("doc_id"), pages["text"].cast("string").alias("text")).mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)
