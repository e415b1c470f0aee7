"""Tilings, predicates and views against plain loops over lines, on random texts made of telling pieces."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tilefold.functions import handles as H
from tilefold.functions import predicates as P
from tilefold.functions import text as T
from tilefold.operators import commands, documents, structural, tiles

PIECES = [
    "", "", " ", "\t", "\r", "def f(x):", "class A:", "  def g(self):", "fn main() {", "}", "});", "test a ... ok", "Compiling x v1", "warning: unused", "error[E0382]: moved", "running 3 tests",
    "x = foo(bar(1), baz.qux(2))", "    return compute(a, b, c) + other(d)", "# Heading", "####### seven", "- item", "12) item", "> quote", "```", "```js", "plain prose " * 9, "p" * 520, "import os",
    "const f = (a) => {", "let x = 1;", "if (a) {", "  at foo (a.js:1:2)", "Traceback (most recent call last):", '  File "a.py", line 3', "Caused by: x", "PASS ✗ mark", "npm ERR! code", "* Try:", "é naïve 𝔘 12", "--- a", "// c", "b\r",
]


def make(seed):
    r = random.Random(seed)
    body = "\n".join(r.choice(PIECES) for _ in range(r.choice([0, 1, 3, 12, 30, 80])))
    return body + r.choice(["", "\n", "\n\n"])


TEXTS = [*(make(i) for i in range(150)), "", "\n", "\r\n\r\n", "\r", "a", "\x00\x00\n\x00", "﻿x\n", "x" * 200_000, "\n" * 5_000, "a\n" * 5_000]


def split(t):
    out = t.split("\n")
    return [x + "\n" for x in out[:-1]] + ([out[-1]] if out[-1] else [])


def blank(x):
    return not x.strip(" \t\r\n")


def anchor(x):
    y = x.lstrip(" \t").rstrip("\r\n")
    return y.startswith(P.LOG_ANCHORS) or any(s in y for s in P.LOG_ANCHORS_INSIDE)


def log_blocks(t):
    out = []
    for x in split(t):
        if out and not (blank(x) or blank(out[-1][-1]) or anchor(x) or len(out[-1]) == 6):
            out[-1].append(x)
        else:
            out.append([x])
    return ["".join(b) for b in out]


def code_blocks(t):
    lines = split(t)
    if any(x.startswith(P.DEFINITIONS) for x in lines):
        cut = lambda i: lines[i].startswith(P.DEFINITIONS)
    else:
        cut = lambda i: blank(lines[i - 1])
    out = []
    for i, x in enumerate(lines):
        if out and not cut(i):
            out[-1] += x
        else:
            out.append(x)
    return out


def estimate(t):
    units = t.encode("utf-16-be")
    codes = [int.from_bytes(units[i : i + 2], "big") for i in range(0, len(units), 2)]
    a = sum(65 <= u <= 90 or 97 <= u <= 122 for u in codes)
    d = sum(48 <= u <= 57 for u in codes)
    s = sum(u in (32, 9, 10, 13) for u in codes)
    return math.ceil(a * 0.196 + d * 0.699 + (len(codes) - a - d - s) * 0.65 + s * 0.433)


def handle(t):
    return "ks2_" + hashlib.sha256(t.encode()).hexdigest()[:32]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(8).cache()


def column(df, expr):
    return [r[1] for r in sorted(df.select("id", expr.alias("x")).collect())]


def test_blocks_and_lines(texts):
    t = F.col("text")
    assert column(texts, T.tile_lines(t)) == [split(x) for x in TEXTS]
    assert column(texts, tiles.log_blocks(t)) == [log_blocks(x) for x in TEXTS]
    assert column(texts, tiles.code_blocks(t)) == [code_blocks(x) for x in TEXTS]
    assert column(texts, T.count_lines(t)) == [len(split(x)) for x in TEXTS]
    assert column(texts, T.log_lines(t)) == [[re.sub(r"\r?\n\Z", "", y) for y in split(x)] for x in TEXTS]
    assert column(texts, F.array_join(tiles.sections(t), "")) == TEXTS
    assert column(texts, T.tokens(t)) == [estimate(x) for x in TEXTS]
    assert [structural.estimate(x) for x in TEXTS] == [estimate(x) for x in TEXTS]


def test_bytes_tile_exactly(spark):
    rng = random.Random(7)
    blobs = [bytes(rng.choice(b"\n\r\x00\xff\xc3\xa9a {}") for _ in range(n)) for n in (0, 1, 7, 300, 3000)]
    df = spark.createDataFrame(list(enumerate(blobs)), "id int, b binary")
    for tiler in (tiles.log_blocks, tiles.code_blocks, tiles.sections):
        assert [b"".join(bytes(p) for p in x) for x in column(df, tiles.byte_tiles(F.col("b"), tiler))] == blobs


def important(x):
    low = x.lower()
    left, low_left = x.lstrip(), low.lstrip()
    return (
        any(w in low for w in P.SEVERITY) or any(g in x for g in P.GLYPHS) or low_left.startswith(("traceback (most recent call last)", "caused by:", "error[e"))
        or (low_left.startswith('file "') and '", line ' in low) or (left.startswith("at ") and ":" in left)
        or left.startswith(("* What went wrong", "* Try:")) or any(w in low for w in ("npm err!", "npm warn", ": error ts", ": warning ts"))
    )


def text_of(x):
    return x.rstrip("\n").rstrip("\r")


def log_view(t):
    lines = split(t)
    if len(lines) <= 24:
        return "\n".join(map(text_of, lines)), []
    mid = lines[10:-6]
    body, keys = "".join(mid), [text_of(x) for x in mid if important(text_of(x))][:12]
    marker = f"[Tilefold: {len(mid)} lines elided · ~{estimate(body)} tok · recall {handle(body)}]"
    label = ["[Tilefold: key lines from the elided middle]"] if keys else []
    return "\n".join([*map(text_of, lines[:10]), *label, *keys, marker, *map(text_of, lines[-6:])]), [(handle(body), body)]


def sig(y):
    return y.startswith(P.SIGNATURES) or (y.startswith(("const ", "let ", "var ")) and "=" in y and ("function" in y or "=>" in y or y.rstrip().endswith("{")))


def method(y):
    y = y.rstrip()
    name = re.match(r"[^\W]*", y.replace("$", "_")).group()
    return y.endswith("{") and bool(name) and y[: len(name)] not in P.CONTROL and "(" in y and ")" in y


def closer(x):
    y = x.rstrip()
    return bool(y) and not y[0].isspace() and all(c in "}]);," for c in y) and any(c in "}])" for c in y)


def structural_line(x):
    y = x.lstrip()
    return not y or y.startswith(("//", "#", "*", "/*", "--")) or sig(y) or closer(x) or method(y)


def hint(body):
    out = []
    for m in re.finditer(r"[^\W\d][\w$]*|\$[\w$]*", body):
        before = body[m.start() - 1 : m.start()]
        if before == "." or re.match(r"[\w$]", before) or not body[m.end() :].lstrip(" ").startswith("("):
            continue
        if m.group() not in P.BODY_WORDS and m.group() not in out and len(out) < 3:
            out.append(m.group())
    return f" · calls {', '.join(out)}" if out else ""


def code_view(t):
    out, gone, run = [], [], []

    def flush():
        body = "".join(run)
        marker = f"[Tilefold: {len(run)}-line body{hint(body)} · recall {handle(body)}]"
        if len(run) >= 4 and estimate(body) > estimate(marker):
            gone.append((handle(body), body))
            out.append(marker)
        else:
            out.extend(map(text_of, run))
        run.clear()

    for x in split(t):
        if structural_line(text_of(x)):
            if run:
                flush()
            out.append(text_of(x))
        else:
            run.append(x)
    if run:
        flush()
    return "\n".join(out), gone


@pytest.mark.parametrize("name", ["log_view", "code_view"])
def test_views(texts, name):
    got = column(texts, getattr(structural, name)(F.col("text")))
    for g, t in zip(got, TEXTS):
        view, gone = globals()[name](t)
        assert g["view"] == view and [(e["handle"], e["text"]) for e in g["elided"]] == gone


def test_line_predicates(spark):
    lines = sorted({text_of(x) for t in TEXTS for x in split(t) if len(x) < 1000} | {"caf(é) {", "ünï_$(a) { ", "function_x = 1", "do {", "doit() {", "}},;", ";;", "at x", "AT x:", "   * Try:", "1. x", "1.x", "+ x"})
    df = spark.createDataFrame(list(enumerate(lines)), "id int, x string")
    left = F.regexp_replace("x", rf"\A{T.WS}++", "")
    checks = {
        "sig": (P.is_sig(left), lambda x: sig(x.lstrip())), "method": (P.is_method(left), lambda x: method(x.lstrip())), "closer": (P.is_closer(F.col("x")), closer),
        "anchor": (P.is_log_anchor(F.col("x")), anchor), "important": (P.important(F.col("x")), important), "structural": (P.is_structural(F.col("x")), structural_line),
        "definition": (P.is_definition_start(F.col("x")), lambda x: x.startswith(P.DEFINITIONS)),
        "heading": (P.is_heading(left), lambda x: bool(re.match("#{1,6} ", x.lstrip()))), "list": (P.is_list_item(left), lambda x: bool(re.match(r"([-*+]|\d+[.)]) ", x.lstrip()))),
    }
    rows = sorted(df.select("id", *(c.alias(k) for k, (c, _) in checks.items())).collect())
    for r, x in zip(rows, lines):
        for k, (_, want) in checks.items():
            assert r[k] == bool(want(x)), (k, x)


def test_json_tiles_and_view(spark):
    big = '{"name": "x", "deps": {' + ",".join(f'"p{i}": "^{i}"' for i in range(60)) + '}, "esc\\"k": [' + "1," * 200 + '2], "s": "a,{b"}\n'
    cases = [big, "[1, [2, 3], {}]", "", " {", '{"a": "}', "5", "[]", ' [ ] tail', '{"a":1}}', None]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    got = column(df, tiles.json_blocks(F.col("text")))
    assert [None if g is None else "".join(g) for g in got] == cases and [len(g) for g in got[:9]] == [7, 5, 0, 1, 1, 1, 2, 4, 4]
    view = column(df, structural.json_view(F.col("text")))
    assert len(view[0]["elided"]) == 2 and '"deps": [Tilefold: section omitted' in view[0]["view"] and '"esc\\"k": [' in view[0]["view"]
    assert all(e["handle"] == handle(e["text"]) and e["text"] in big for e in view[0]["elided"]) and view[1]["view"] == cases[1] and view[9]["view"] is None


def test_detect(spark):
    code = "\n".join(["import a", "x = 1"] * 10)
    cases = [("{}", None, "json"), ('{"a"', None, "log"), (code, None, "code"), ("x\n" * 20, None, "log"), ("x", "a/B.PY", "code"), ("x", "a.json", "json"), ("[1] tail", None, "json"), ("", None, "log"), ("x", "py", "log")]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], "id int, text string, path string")
    assert column(df, P.detect(F.col("text"), F.col("path"))) == [k for _, _, k in cases]


def test_documents(texts):
    label = F.lit("notes.md")
    packed = column(texts, documents.pack_document(label, F.encode("text", "UTF-8")))
    read = column(texts, documents.manifest(documents.pack_document(label, F.encode("text", "UTF-8"))["view"]))
    rows = column(texts, documents.section_rows(F.col("text")))
    for t, p, m, ss in zip(TEXTS, packed, read, rows):
        assert p["raw_tokens"] == estimate(t) and p["packed_tokens"] == estimate(p["view"]) and p["handle"] == handle(t) == m["handle"] and m["source"] == "notes.md"
        gone = [s for s in ss if s["elide"]]
        lines = t.split("\n")
        assert [(x["first_line"], x["last_line"]) for x in m["markers"]] == [(s["first_line"], s["first_line"] + s["n_lines"] - 1) for s in gone]
        assert all("\n".join(lines[s["first_line"] - 1 : s["first_line"] + s["n_lines"] - 1]) == s["text"] for s in ss)
    stripped = column(texts, documents.strip_header(documents.pack_document(label, F.encode("text", "UTF-8"))["view"]))
    assert all(p["view"].endswith(s) and not s.startswith("<!-- tf-pack") for p, s in zip(packed, stripped))


def test_manifest_is_tolerant(spark):
    text = "<!-- tf-pack source=a handle=h1 -->\n<!-- tf-pack source=b handle=h2 -->\nx <!-- tf-recall handle=q lines=3-x tokens=9 --> y\n<!-- tf-recall lines=1-2 -->\n<!-- tf-recall handle=z"
    m = spark.range(1).select(documents.manifest(F.lit(text)).alias("m")).first()["m"]
    assert (m["source"], m["handle"]) == ("b", "h2") and [tuple(x) for x in m["markers"]] == [("q", 3, 0, 9)]


def test_handles(spark):
    b = "hello"
    s1, s2 = hashlib.sha1(b.encode()).hexdigest(), hashlib.sha256(b.encode()).hexdigest()
    cases = {
        "ks2_" + s2[:32]: (True, True), "ks2_" + s2[:31]: (False, False), "ks2_" + s2[:33]: (False, False), ("ks2_" + s2[:32].upper()): (True, False), "ks_" + s1[:10]: (True, True),
        "ks_" + s1[:16]: (True, True), "ks_" + s1[:11]: (False, False), "ks2_" + "0" * 32: (True, False), "": (False, False), "ks2_" + s2[:32] + "\n": (False, False),
    }
    df = spark.createDataFrame([(i, h) for i, h in enumerate(cases)], "id int, h string")
    assert list(zip(column(df, H.is_valid(F.col("h"))), column(df, H.verify(F.col("h"), F.lit(b))))) == list(cases.values())
    text = f"x{'ks2_' + s2[:32]}y ks_{s1[:10]} ks_{s1[:11]} ks2_{s2[:40]} ks_{s1[:16]}"
    assert spark.range(1).select(H.handles_in(F.lit(text))).first()[0] == [("ks2_" + s2[:32]), f"ks_{s1[:10]}", f"ks_{s1[:16]}"]


def test_names_and_formats(spark):
    row = spark.range(1).select(
        H.session_file(F.lit("  ")).alias("a"), H.session_file(F.lit("a/b é")).alias("b"), H.session_file(F.lit("x" * 200)).alias("c"), H.sidecar_path(F.lit("d.x/name")).alias("d"), H.sidecar_path(F.lit("d/n.v1.md")).alias("e"),
        T.commafy(F.lit(-1234567)).alias("f"), T.human_bytes(F.lit(1536)).alias("g"), T.human_bytes(F.lit(3 << 30)).alias("h"), T.reduction_pct(F.lit(-7), F.lit(2)).alias("i"), T.reduction_pct(F.lit(5), F.lit(0)).alias("j"),
        T.parse_range(F.lit(" 3 - 9")).alias("k"), T.parse_range(F.lit("3")).alias("l"), T.parse_range(F.lit("-3-4")).alias("m"), H.shard(F.lit("ks2_ab12")).alias("n"), H.shard(F.lit("_")).alias("o"), T.short(F.lit("abcdef"), 4).alias("p"),
    ).first()
    tail = hashlib.sha1(b"x" * 200).hexdigest()[:16]
    assert tuple(row) == ("default.tsv", "a_b__.tsv", "x" * 111 + "_" + tail + ".tsv", "d.x/name.tilefold.md", "d/n.v1.tilefold.md", "-1,234,567", "1 KB", "3.0 GB", -350, None, (3, 9), None, None, "ab", "00", "abc…")


@pytest.mark.parametrize("cmd, want", [
    ("npm test", "npm"), ("cd x && cargo build", "cargo"), ("A=1 B='x y' sudo -E npm i", None), ("A=1 B='x y' sudo npm i", "npm"), ("/usr/bin/env time /opt/go build", "go"), ("cat a.txt", None), ("cat a.log", "cat"),
    ("npm test | tee x", None), ("npm test > x", None), ("echo 'a | b' ; make", "make"), ("make &", None), ("make && ls & ", None), ("make # now", None), ("echo '#' ; rg x", "rg"), ("", None), ("   ", None), ("echo \"&& npm\"", None),
    (r"C:\tools\node x", "node"), ("tilefold pack", None), ("X=\"unterminated npm", None), (";;make", "make"), ("npx jest", "jest"),
])
def test_commands(spark, cmd, want):
    assert spark.range(1).select(commands.matched_program(F.lit(cmd))).first()[0] == want
