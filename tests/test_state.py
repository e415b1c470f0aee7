"""Ledgers, packing, the store, recall, transcripts, savings and retention: known values and plain loops."""

from __future__ import annotations

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tilefold.operators import conditional, decisions, ledger, recall, retention, savings, store, transcripts
from tilefold.reports import retention_report, savings_report, summary_report, transcript_report

METRICS = "line_id bigint, t bigint, event string, session string, raw bigint, shown bigint, saved bigint, delta_hits bigint, evicted bigint, tokens bigint, ok boolean"


def compress(i, session, raw, shown, saved, hits=0, evicted=0, t=0):
    return (i, t, "compress", session, raw, shown, saved, hits, evicted, None, None)


def expand(i, session, tokens, ok):
    return (i, 0, "expand", session, None, None, None, None, None, tokens, ok)


def test_savings_of_two_sessions(spark):
    df = spark.createDataFrame([compress(1, "s1", 3440, 31, 3409, 50), expand(2, "s1", 120, True), compress(3, "s2", 2000, 400, 1600, 2, 1), expand(4, "s2", 1900, True), expand(5, "s2", 0, False)], METRICS)
    rows = {r["session"]: r for r in savings.sessions(df, total=True).collect()}
    assert (rows[None]["net"], rows[None]["delta_hits"], rows[None]["evicted"], rows[None]["failed_expands"]) == (2989, 52, 1, 1)
    assert [r["session"] for r in savings.ranked(savings.sessions(df)).collect()] == ["s1", "s2"] and rows["s2"]["net"] == -300 and rows["s2"]["verdict"] == "negative"
    text = savings_report(df)
    assert "2,989" in text and "saves more" in text and text.index("s1") < text.index("s2")
    short = savings_report(df, 1)
    assert "s2" not in short and "(1 more)" in short and "-300" in short and "2,989" in short


def test_two_accounting_rules(spark):
    rows = [compress(1, None, 10, 4, None), compress(2, "a", -5, -1, -7), (3, 1, "other", "only", *[None] * 7), expand(4, None, None, None), (5, 1, None, None, *[None] * 7)]
    df = spark.createDataFrame(rows, METRICS)
    got = {r["session"]: r for r in savings.sessions(df).collect()}
    assert set(got) == {"(no session)", "a", "only"} and got["(no session)"]["saved"] == 6 and got["only"]["verdict"] == "none" and got["a"]["raw"] == -5
    s = savings.summary(df).first()
    assert (s["raw"], s["shown"], s["saved"], s["expand_calls"], s["refetched"]) == (10, 4, -7, 1, 0)
    assert savings.latest_session(df).collect() == [("a", 0)]


def test_summary_values(spark):
    rows = [compress(i, "s1", 100, 30, 70, 5) for i in range(3)] + [expand(i, "s1", 10, True) for i in range(2)] + [expand(9, "s1", 0, False), compress(10, "s2", 80, 30, 50, 2, 1)]
    df = spark.createDataFrame(rows, METRICS)
    assert tuple(savings.summary(df).first()) == (4, 380, 120, 260, 17, 1, 3, 1, 20, 240)
    assert savings.summary(df, "s1").first()["net"] == 190 and "saves more" in summary_report(df, "s2")
    none = spark.createDataFrame([], METRICS)
    assert savings.summary(none).first()["net"] == 0 and savings.latest_session(none).count() == 0 and "nothing measured" in savings_report(none)


LEDGER = "line_id bigint, session string, handle string, code tinyint, step bigint, tokens bigint"


def test_ledger_last_line_wins(spark):
    rows = [(1, "s", "a", 0, 1, 5), (2, "s", "a", 1, 2, 6), (3, "s", "a", None, 3, 7), (4, "s", None, 0, 1, 1), (5, None, "a", 0, 1, 2), (6, "s", "b", 0, 1, None), (7, "s", "c", 5, 1, 4)]
    state = {(r["session"], r["handle"]): tuple(r)[2:] for r in ledger.state(spark.createDataFrame(rows, LEDGER)).collect()}
    assert state == {("s", "a"): (1, 2, 6), (None, "a"): (0, 1, 2), ("s", "c"): (5, 1, 4)}


@pytest.mark.parametrize("budget, gone", [(250, 3), (1000, 0), (0, 5), (500, 0), (499, 1)])
def test_budget_evicts_oldest(spark, budget, gone):
    rows = [("s", f"h{i}", 0, i, 100) for i in range(1, 6)] + [("s", "x", 1, 0, 900)]
    out = ledger.enforce_budget(spark.createDataFrame(rows, "session string, handle string, code int, step bigint, tokens bigint"), budget)
    assert sorted(r["step"] for r in out.collect() if r["code"] == 1 and r["handle"] != "x") == list(range(1, gone + 1))


def test_budget_against_loop(spark):
    rng, rows = random.Random(4), []
    for s in "abc":
        rows += [(s, f"h{i:03}", rng.choice([0, 0, 0, 1]), rng.randrange(0, 40_000), rng.randrange(0, 50)) for i in range(200)]
    out = ledger.enforce_budget(spark.createDataFrame(rows, "session string, handle string, code int, step bigint, tokens bigint"), 2000)
    want = {}
    for s in "abc":
        mine = [list(r) for r in rows if r[0] == s]
        over = sum(r[4] for r in mine if r[2] == 0) - 2000
        for r in sorted((r for r in mine if r[2] == 0), key=lambda r: (r[3], r[1])):
            if over > 0:
                r[2] = 1
                over -= r[4]
        want |= {(s, r[1]): r[2] for r in mine}
    assert {(r["session"], r["handle"]): r["code"] for r in out.collect()} == want


def test_ledger_updates(spark):
    schema = "session string, handle string, code int, step bigint, tokens bigint"
    base = spark.createDataFrame([("s", "a", 1, 1, 5), ("s", "b", 0, 1, 5)], schema)
    noted = ledger.record_residency(base, spark.createDataFrame([("s", "a", 7), ("s", "a", 9), ("t", "c", 1)], "session string, handle string, step bigint"))
    rows = {(r["session"], r["handle"]): tuple(r)[2:] for r in ledger.evict(noted, spark.createDataFrame([("s", "b"), ("s", "zz")], "session string, handle string")).collect()}
    assert rows == {("s", "a"): (0, 9, 0), ("t", "c"): (0, 1, 0), ("s", "b"): (1, 1, 5)}


TEXTS = "id bigint, session string, step bigint, text string, content_type string"


def session_texts(seed, n=14):
    rng = random.Random(seed)
    parts = [f"para {i} " + "word " * rng.randrange(3, 20) for i in range(9)] + ["error: x", "plain", "test a ... ok"]
    return "\n\n".join(rng.choice(parts) for _ in range(rng.randrange(0, n)))


def known_by_loop(rows, blocks_of, budget=None):
    """Residency of each block of each row, replayed run by run."""
    out = {}
    for s in {r[1] for r in rows}:
        led = {}
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0])):
            new, known = [], []
            for b in blocks_of(r[3] or ""):
                if led.get(b, [1])[0] == 0:
                    for x in new:
                        led[x] = [0, r[2]]
                    new = []
                    known.append(True)
                else:
                    known.append(False)
                    new.append(b)
            for x in new:
                led[x] = [0, r[2]]
            if budget is not None:
                from test_text import estimate, handle

                live = sum(estimate(b) for b, e in led.items() if e[0] == 0)
                for b in sorted((b for b, e in led.items() if e[0] == 0), key=lambda b: (led[b][1], handle(b))):
                    if live <= budget:
                        break
                    led[b][0] = 1
                    live -= estimate(b)
            out[r[0]] = known
    return out


@pytest.mark.parametrize("budget", [None, 60])
def test_pack_against_replay(spark, budget):
    from test_text import estimate, handle, log_blocks, log_view

    rows = [(i, ["a", "b", None][i % 3], i, session_texts(i), "log") for i in range(60)] + [(100, "a", 200, None, "log"), (101, "b", 201, "", "log"), (102, "a", 202, "x\n\n" * 300, "log")]
    df = spark.createDataFrame(rows, TEXTS)
    out = {r["id"]: r for r in (conditional.pack(df) if budget is None else conditional.session_fold(df, budget)).collect()}
    assert set(out) == {r[0] for r in rows}
    for r in rows:
        known, text = known_by_loop(rows, log_blocks, budget)[r[0]], r[3] or ""
        bs, views, runs = log_blocks(text), [], []
        for b, k in zip(bs, known):
            if runs and runs[-1][0] == k:
                runs[-1][1].append(b)
            else:
                runs.append((k, [b]))
        for k, part in runs:
            run = "".join(part)
            views.append(f"[Tilefold: {len(run.splitlines())} lines unchanged · recall {handle(run)}]" if k else log_view(run)[0])
        cond, raw = "\n".join(views), estimate(text)
        view, hits = cond, sum(known)
        if len(runs) > 1 and estimate(log_view(text)[0]) < estimate(cond):
            view, hits = log_view(text)[0], 0
        if estimate(view) > raw:
            view, hits = text, 0
        got = out[r[0]]
        assert got["view"] == view and got["delta_hits"] == hits and got["shown_tokens"] == estimate(view) <= raw and got["blocks"] == len(bs)


def test_pack_gate_and_ledger(spark):
    df = spark.createDataFrame([(1, "s", 0, "one", "log"), (2, "s", 1, "one", "log"), (3, "t", 0, "one", "log")], TEXTS)
    blocks = conditional.block_rows(df)
    h = blocks.first()["handle"]
    held = spark.createDataFrame([("t", h, 0), ("s", h, 1)], "session string, handle string, code int")
    assert {r["id"]: (r["seen"], r["evicted"]) for r in conditional.residency(blocks, held).collect()} == {1: (False, True), 2: (True, False), 3: (True, False)}
    packed = {r["id"]: (r["delta_hits"], r["evicted_resends"]) for r in conditional.pack(df, held).collect()}
    assert {i: n for i, (_, n) in packed.items()} == {1: 1, 2: 0, 3: 0}
    proof = spark.createDataFrame([("s", True, "ks2_other"), ("t", False, None)], "session string, ok boolean, handle string")
    rows = {r["id"]: (r["seen"], r["gated"]) for r in conditional.residency(blocks, held, proof).collect()}
    assert rows == {1: (False, False), 2: (False, True), 3: (True, False)}
    assert {r["id"]: r["evicted_resends"] for r in conditional.pack(df, held, proof).collect()} == {1: 1, 2: 1, 3: 0}


def packed_by_loop(text, led, proved):
    """(known, resends) of the blocks of one text on a ledger handle to code; ``proved`` is None without a gate."""
    from test_text import handle, log_blocks

    known, resends, new = [], 0, []
    for b in log_blocks(text):
        h = handle(b)
        held, shown = led.get(h) == 0, proved is None or h in proved
        if held and shown:
            led |= dict.fromkeys(new, 0)
            new = []
            known.append(True)
        else:
            resends += led.get(h) == 1 or (held and not shown)
            known.append(False)
            new.append(h)
    led |= dict.fromkeys(new, 0)
    return known, resends


@pytest.mark.parametrize("gated", [False, True])
def test_resends_against_replay(spark, gated):
    from test_text import handle, log_blocks

    rows = [(i, "s", i, session_texts(i + 500, 30), "log") for i in range(25)]
    hs = sorted({handle(b) for r in rows for b in log_blocks(r[3])})
    led = {h: i % 2 for i, h in enumerate(hs) if i % 3}
    proved = {h for i, h in enumerate(hs) if i % 4} if gated else None
    held = spark.createDataFrame([("s", h, c) for h, c in led.items()], "session string, handle string, code int")
    proof = spark.createDataFrame([("s", True, h) for h in proved], "session string, ok boolean, handle string") if gated else None
    df = spark.createDataFrame(rows, TEXTS)
    blocks = conditional.block_rows(df)
    folded = conditional.statuses(conditional.residency(blocks, held, proof)).select("id", conditional.fold_repeats(F.col("_b")).alias("s")).collect()
    got = {r["id"]: ([x["known"] for x in r["s"]], sum(x["resent"] for x in r["s"])) for r in folded}
    want = {r[0]: packed_by_loop(r[3], led, proved) for r in rows}
    assert got == {i: w for i, w in want.items() if w[0]} and sum(w[1] for w in want.values()) > 20


def test_every_printed_handle_is_stored(spark):
    from test_text import handle

    rows = [(i, "ab"[i % 2], i, session_texts(i, 40) + "\n".join(f"line {j}" for j in range(40 * (i % 3))), ["log", "code"][i % 5 == 0]) for i in range(30)]
    out = conditional.pack(spark.createDataFrame(rows, TEXTS)).collect()
    for r in out:
        stored = {x["handle"]: x["text"] for x in r["stored"]}
        assert all(handle(t) == h and t in rows[r["id"]][3] for h, t in stored.items()) and set(r["handles"]) == set(stored)
        assert set(re.findall("ks2_[0-9a-f]{32}", r["view"])) <= set(stored)
    assert sum("unchanged" in r["view"] for r in out) >= 3 and sum("elided" in r["view"] for r in out) >= 3


def test_code_delta_shows_one_changed_function(spark):
    from tilefold.sources.generate import edit_loop

    texts = edit_loop(spark)
    packed = {r["id"]: r for r in conditional.pack(texts).collect()}
    assert packed[0]["delta_hits"] == 0 and packed[2]["delta_hits"] == 40 and packed[2]["shown_tokens"] < packed[0]["shown_tokens"] / 5
    assert sum(r["shown_tokens"] for r in packed.values()) < 0.3 * sum(r["raw_tokens"] for r in packed.values())
    lines = texts.filter("id = 0").first()["text"].split("\n")
    assert lines[0] == "// service.js — request handlers" and lines[11] == "    acc += w * 0 * (it.factor || 1);" and len(lines) == 2 + 40 * 17


def test_store(spark):
    blocks = spark.createDataFrame([(2, "late", bytearray(b"x")), (1, "first", bytearray(b"x")), (3, "c", bytearray(b"\xff\x00")), (4, "d", None), (5, "e", bytearray(b""))], "seq bigint, session string, bytes binary")
    rows = store.put(blocks)
    by = {bytes(r["bytes"]): r for r in rows.collect()}
    assert set(by) == {b"x", b"\xff\x00", b""} and by[b"x"]["first_session"] == "first" and by[b"x"]["handle"] == "ks2_" + hashlib.sha256(b"x").hexdigest()[:32]
    assert store.put(blocks, rows).count() == 0
    meta = store.meta_of(rows, 100)
    h = by[b"x"]["handle"]
    asked = spark.createDataFrame([(h, "caller"), ("ks2_" + "0" * 32, "caller")], "handle string, session string")
    assert {r["handle"]: r["bytes"] and bytes(r["bytes"]) for r in store.get(rows, asked, meta).collect()} == {h: b"x", "ks2_" + "0" * 32: None}
    spoiled = meta.withColumn("sha256", F.lit("0" * 64))
    assert all(r["bytes"] is None for r in store.get(rows, asked, spoiled).collect())
    lines = {r["handle"]: (r["session"], r["tokens"], r["ok"]) for r in store.expand(rows, asked, meta).collect()}
    assert lines == {h: ("first", 1, True), "ks2_" + "0" * 32: ("caller", 0, False)}
    looked = {r["n_bytes"]: r for r in store.inspect(rows).collect()}
    assert looked[2]["utf8"] is False and looked[2]["preview"] is None and looked[0]["n_lines"] == 0
    assert store.size(rows).first()["bytes"] == 3 and store.delete(rows, asked).count() == 2
    touched = store.touch(spark.createDataFrame([(1, 50), (2, 10), (3, None)], "k int, accessed bigint"), 100).collect()
    assert [r["accessed"] for r in touched] == [50, 100, 100]


def recalled(spark, b, **how):
    return bytes(spark.createDataFrame([(bytearray(b),)], "b binary").select(recall.expand(F.col("b"), **how)).first()[0])


@pytest.mark.parametrize("rng, want", [((2, 4), b"l2\nl3\nl4"), ((0, 2), b"l1\nl2"), ((3, 999), b"l3\nl4\nl5"), ((4, 2), b""), ((50, 60), b""), ((1, 1), b"l1")])
def test_line_ranges(spark, rng, want):
    assert recalled(spark, b"l1\nl2\nl3\nl4\nl5", lines=rng) == want


def test_recall(spark):
    text = b"a\nERR one\nb\r\nc\nd\nerr two\n"
    assert recalled(spark, text) == text and recalled(spark, b"\xff\n", lines=(1, 1)) == b"\xff\n"
    assert recalled(spark, text, pattern="err") == b"ERR one\nerr two" and recalled(spark, text, lines=(3, 7), pattern="err", context=1) == b"d\nerr two\n"
    assert recalled(spark, text, lines=(1, 3), pattern="^b", context=5) == b"a\nERR one\nb\r" and recalled(spark, b"x(y|z\nX(Y|", pattern="(y|") == b"x(y|z\nX(Y|"


PATTERNS = [
    ("a.c", "abc", True), ("a.c", "a\nc", False), ("^ab$", "ab", True), ("^$", "", True), ("a$b", "a$b", True), ("a^b", "a^b", True), (r"x\$", "x$", True), ("*a", "*a", True), ("a+?", "aa?", True), ("a+?", "aa", False),
    ("[]", "a", False), ("[^]", "a", True), ("[z-a]", "m", False), ("[a-]", "-", True), (r"[\]]", "]", True), (r"\d+", "no", False), (r"\w", "é", False), (r"\S", " ", False), (r"[^0-9]", "5", False), ("]", "]", True),
    ("A.B", "xaxb", True), (r"\E", "e", False), (r"\D", "5", False), ("é", "É", True), ("a&&b", "a&&b", True), ("[a&&b]", "&", True), ("a#b", "A#B", True), ("", "x", True), ("a*", "", True), (r"[\d\w]", "_", True),
]


def test_patterns(spark):
    df = spark.createDataFrame([(1,)], "i int")
    got = df.select(*(recall.line_matches(F.lit(t), p).alias(f"c{i}") for i, (p, t, _) in enumerate(PATTERNS))).first()
    assert list(got) == [w for _, _, w in PATTERNS]
    for bad in ("(", "a|b", "a{2}", "a\\", "[a", r"[\D]", "[\\"):
        with pytest.raises(recall.PatternError):
            recall.translate(bad)


LINES = "session string, line_no bigint, line string"


def test_transcripts(spark):
    h = ["ks2_" + f"{i:032x}" for i in range(9)]
    rows = [("a", 1, json.dumps({"content": h[0]})), ("a", 2, '{"subtype": "Compact"}'), ("a", 3, h[1] + " " + h[2] + "f " + h[1]), ("b", 1, h[3]), ("b", 2, '{"message": {"content": " /clear "}}'), ("c", 1, None), ("c", 2, "  "), ("d", 1, 'x "/clear" y'), ("d", 2, " ".join(h))]
    got = {r["session"]: r for r in transcripts.scan(spark.createDataFrame(rows, LINES)).collect()}
    assert (got["a"]["last_boundary"], got["a"]["boundary_line"], got["a"]["n_resident"], got["a"]["sample"]) == ("compaction", 2, 1, h[1])
    assert (got["b"]["last_boundary"], got["b"]["n_resident"]) == ("/clear", 0) and got["c"]["ok"] is False and got["c"]["n_resident"] == 0
    assert got["d"]["n_resident"] == 9 and got["d"]["sample"].split() == h[:5]
    df = spark.createDataFrame([(*r, 0) for r in [('{"type":"restart"}',), ('{"type":5,"event":"clear"}',), ('{"kind":"x"}',), ("[]",), ('{"content":"/clear\\n"}',), ('{"content":["/clear"]}',), ("plain /clear",)]], "l string, k int")
    assert [r[0] for r in df.select(transcripts.boundary(F.col("l"))).collect()] == ["session restart", "/clear", None, None, "/clear", "/clear", None]
    text = transcript_report(transcripts.scan(spark.createDataFrame(rows, LINES)), "d")
    assert "9 handles" in text and "and 4 more" in text and "cannot be read" in transcript_report(transcripts.scan(spark.createDataFrame(rows, LINES)), "c")


def test_retention(spark):
    new = "ks2_" + "a" * 32
    rows = [(new, 1, True, 900, 1, 5), (new, 2, True, 0, 950, 5), (new, 4, False, None, None, 970), ("ks_old", 8, False, None, None, 970), (new, 16, True, None, None, 100), (new, 32, False, None, None, None), (new, 64, True, 1100, 1, 1)]
    df = spark.createDataFrame(rows, "handle string, len bigint, has_meta boolean, accessed bigint, created bigint, mtime bigint")
    report = retention.report(retention.judged(df, 1000, 30)).first()
    # ages: 100, 50, 30 (kept below 60), 30, 900, none, -100
    assert (report["scanned"], report["deleted"], report["bytes_freed"], report["meta_present"]) == (7, 4, 1 + 2 + 8 + 16, 4)
    cache = retention.judged_cache(spark.createDataFrame([(7, 10), (9, None)], "len bigint, mtime bigint"), 1000, 30)
    both = retention.judged(df, 1000, 30).select("len", "kind", "covered", "stale").unionByName(cache)
    total = retention.report(both).first()
    assert (total["read_cache_scanned"], total["read_cache_deleted"], total["meta_missing"]) == (2, 1, 5)
    assert retention.survivors(retention.judged(df, 1000, 30)).count() == 3 and "dry run" in retention_report(retention.report(both), 30)
    assert retention.report(retention.judged(df.limit(0), 1000, 30)).first()["bytes_freed"] == 0


def test_decisions(spark):
    base = {"gate": True, "path": "/p", "sliced": False, "n_bytes": 9000, "digest": "d" * 64, "raw_tokens": 1000, "view_tokens": 100, "cached": False, "healthy": True}
    cases = [({"gate": False}, "gate-disabled"), ({"path": " "}, "bad-input"), ({"path": None}, "bad-input"), ({"sliced": True}, "slicing-requested"), ({"n_bytes": None}, "file-unreadable"), ({"n_bytes": 8191}, "too-small"), ({"n_bytes": 8192}, "redirect-emitted"), ({"n_bytes": 4194305}, "too-large"),
             ({"view_tokens": 751}, "worse-than-raw"), ({"view_tokens": 750}, "redirect-emitted"), ({"raw_tokens": 0}, "worse-than-raw"), ({"cached": True}, "cache-hit"), ({"cached": True, "healthy": False}, "redirect-emitted"), ({"view_tokens": 2000}, "worse-than-raw")]
    schema = "gate boolean, path string, sliced boolean, n_bytes bigint, digest string, raw_tokens bigint, view_tokens bigint, cached boolean, healthy boolean"
    rows = decisions.decide(spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema)).collect()
    assert [r["reason"] for r in rows] == [w for _, w in cases] and rows[12]["note"] == "regenerated" and re.fullmatch(r"d{32}_[0-9a-f]{8}\.md", rows[11]["redirect_to"])
    log = spark.createDataFrame([(i, i if i != 3 else None, "cache-hit" if i != 4 else "what") for i in range(6)], "entry_id bigint, t bigint, reason string")
    assert [r["entry_id"] for r in decisions.tail(log, 3).collect()] == [1, 2, 5]
