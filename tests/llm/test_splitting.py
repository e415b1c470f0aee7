"""Problem 8: blocks, limits, overlap, cover, strongest cuts, and the tokenizer on hard texts."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tilefold.llm import splitting
from tilefold.llm.tokenizer import load

WORDS = "the quick brown fox. jumps\n over lazy dogs! and naïve cœur? 12,345 ∆∂ 日本語 x".split(" ")


def text_of(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "  ", ""]) for _ in range(n))


def brute_blocks(text):
    out, run = [], []
    for line in [*text.split("\n"), ""]:
        if any(c.isalpha() or c.isnumeric() for c in line):
            run.append(line)
        elif run:
            out.append("\n".join(run))
            run = []
    return out


def check(block, limit, overlap, least=0.5):
    tok = load()
    cuts = splitting.split_block(block, tok, limit, overlap, least)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(block)
    for s, e, size, shared, _ in cuts:
        assert s < e and size == tok.count(block[s:e]) <= limit
    for a, b in zip(cuts, cuts[1:]):
        assert a[0] < b[0] <= a[1] < b[1] and b[3] == tok.count(block[b[0] : a[1]])
    return cuts


@pytest.mark.parametrize("seed", range(12))
def test_random_texts(seed):
    block = text_of(seed, 900)
    cuts = check(block, [64, 100, 512][seed % 3], [0, 8, 20][seed % 3 - 1])
    for (s, e, _, _, kind), nxt in zip(cuts, cuts[1:]):
        assert nxt[3] <= [0, 8, 20][seed % 3 - 1]
        if kind == "sentence":
            assert re.search(r"[.!?]\s*$", block[s:e])
        elif kind == "line":
            assert block[e : e + 1] == "\n" or block[e - 1] == "\n"


def test_strongest_cut_rightmost():
    block = ("one two three. " * 20 + "four five six " * 12).strip()
    cuts = check(block, 100, 10)
    assert block[: cuts[0][1]].endswith("three.") and cuts[0][4] == "sentence"
    words = " ".join(["alpha"] * 600)
    assert [c[4] for c in check(words, 100, 10)][:-1] == ["word"] * (len(check(words, 100, 10)) - 1)
    lines = "\n".join(["alpha beta gamma"] * 200)
    assert {c[4] for c in check(lines, 100, 10)[:-1]} == {"line"}


@pytest.mark.parametrize("block", ["a" * 20_000, "é" * 5_000, "日本語" * 3_000, "x" + " " * 30_000 + "y", "𝔘" * 4_000, "ab1" * 9_000, "." * 9_000 + "z", "a\n" * 5_000, "é" * 3000])
def test_hard_blocks(block):
    check(block, 512, 32)


@pytest.mark.parametrize("block", ["a" * 20_000, "日本語" * 3_000, "ab1" * 9_000, "é" * 5_000])
def test_overlap_without_words(block):
    cuts = check(block, 512, 32)
    assert all(24 <= c[3] <= 32 for c in cuts[1:])


def test_sparse_maximum():
    rng = np.random.default_rng(5)
    v = rng.integers(0, 50, 257)
    t = splitting.SparseMax(v)
    for _ in range(500):
        a, b = sorted(int(x) for x in rng.integers(0, 257, 2))
        assert t.max(a, b) == v[a : b + 1].max()


def test_blocks_are_maximal_runs():
    for seed in range(20):
        rng = random.Random(seed)
        text = "\n".join(rng.choice(["", "  ", "a", "---", "Ⅷ", "é.", "·", "5", "\t", "\r"]) for _ in range(40))
        assert splitting.blocks(text) == brute_blocks(text)
    assert splitting.blocks("\n\n") == [] and splitting.blocks("x") == ["x"]


@pytest.mark.parametrize("text", ["", "a", " \n ", "Hello,  world's  best\n\n", "x" * 30_000, "a " * 20_000, " " * 200_000, "é́ 日本語 ㊀ ½" * 3000, "\r\n\t " * 9000 + "e"])
def test_tokenizer_paths_agree(text):
    tok = load()
    by_words = sum(n for _, n in tok.words(text))
    assert tok.count(text) == by_words and (not text or tok.words(text)[-1][0] == len(text))
    if len(text) < 100_000:
        assert by_words == len(tok._encoding.encode_ordinary(text))
    assert tok.at_most(text, 512) == (by_words <= 512)


def test_operator_edge_cases(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, "---\n\n", "c"), (4, "short\n\nnext", "c"), (4, "short\n\nnext", "c"), (None, "word " * 700, "c"), (5, text_of(1, 60_000), "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    out = splitting.split(df, 512, 32).collect()
    whole = [(r["doc_id"], r["block_no"], r["piece"]) for r in out if r["n_pieces"] == 1]
    assert sorted(x for x in whole if x[0] == 4) == [(4, 0, "short")] * 2 + [(4, 1, "next")] * 2
    assert {r["doc_id"] for r in out} == {4, None, 5}
    for r in out:
        assert r["piece"] is not None and load().count(r["piece"]) == r["n_tokens"] <= 512
    assert splitting.split(spark.createDataFrame([], df.schema)).count() == 0
    with pytest.raises(ValueError):
        splitting.split(df, 512, 400)


def test_documents(spark, small):
    from tilefold.llm import queries

    tok = load()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = {(r["doc_id"], i) for r in docs for i, b in enumerate(brute_blocks(r["text"] or "")) if tok.count(b) > 512}
    assert {tuple(r) for r in queries.p8_found(spark, small).collect()} == want and want


def test_limit_below_one_character_is_refused():
    tok = load()
    with pytest.raises(ValueError):
        splitting.split_block("\U00013000" * 5, tok, 1, 0, 0.5)
