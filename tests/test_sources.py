"""Readers and writers on files, the engine's public functions, and streams."""

from __future__ import annotations

import hashlib
import json
import re
import shutil

import pytest
from pyspark.sql import functions as F

from tilefold.api import Engine
from tilefold.config import EngineConfig
from tilefold.operators import ledger as ledgers
from tilefold.operators import savings, transcripts
from tilefold.reports import decisions_report
from tilefold.sources import records
from tilefold.streaming import sessions


def test_metrics_file(spark, tmp_path):
    lines = ['{"t":1.9,"event":"compress","session":"s","raw":10.7,"shown":3}', "not json", '{"event":', "", '{"event":"expand","tokens":4,"extra":[1]}\r']
    (tmp_path / "m.jsonl").write_bytes("\n".join(lines).encode())
    rows = records.metrics(spark, str(tmp_path / "m.jsonl")).orderBy("line_id").collect()
    assert [(r["event"], r["raw"], r["t"]) for r in rows] == [("compress", 10, 1), ("expand", None, None)]
    assert savings.sessions(records.metrics(spark, str(tmp_path / "m.jsonl")), total=True).filter("session is null").first()["net"] == 3
    (tmp_path / "bad.jsonl").write_bytes(b'{"event":"compress","raw":5}\n\xff')
    assert records.metrics(spark, str(tmp_path / "bad.jsonl")).count() == 0 and records.metrics(spark, str(tmp_path / "none")).count() == 0


def test_odd_metrics_lines(spark, tmp_path):
    deep = '{"event":"x","a":' + "[" * 300 + "]" * 300 + "}"
    lines = ['{"event":"compress","session":"a","raw":7,"raw":9}', '{"event":"compress","session":5,"raw":"8"}', '{"event":"expand"} tail', deep, '{"event":"e","session":"s","session":{"x":1}}\r']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    rows = records.metrics(spark, str(tmp_path / "m.jsonl")).orderBy("line_id").collect()
    assert [(r["line_id"], r["event"], r["session"], r["raw"]) for r in rows if r["event"] != "x"] == [(0, "compress", "a", 7), (1, "compress", None, None), (2, "expand", None, None), (4, "e", "s", None)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    for name, n in (("a.jsonl", 3000), ("b.jsonl", 10), ("c.jsonl", 0)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    (tmp_path / "d.jsonl").write_bytes(b"ok\n" * 2000 + b"\xff\n" + b"ok\n" * 10)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = records._lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["line"], r["line_no"]) for r in rows) == sorted((f"{n} {i}", i) for n, k in (("a.jsonl", 3000), ("b.jsonl", 10)) for i in range(k))


def test_set_key(spark):
    from tilefold.functions import json_fields

    df = spark.createDataFrame([('{"a": 1, "b": {"c": 2}, "a": 3}',), ("[1]",), ("{bad",), (None,), ("{}",)], "r string")
    got = [r[0] for r in df.select(json_fields.set_key(F.col("r"), "b", F.lit('"x"'))).collect()]
    assert got == ['{"a":1,"b":"x"}', None, None, None, '{"b":"x"}']


def test_ledger_file(spark, tmp_path):
    text = "a\t0\t1\t5\nb\t1\t2\t6\textra\nshort\t1\nc\t256\t1\t1\nd\t-1\t1\t1\ne\t 0\t1\t1\nf\t+0\t1\t1\na\t1\t3\t7\n"
    (tmp_path / "s.tsv").write_text(text)
    rows = records.ledger(spark, str(tmp_path / "s.tsv")).orderBy("line_id").collect()
    assert [(r["session"], r["handle"], r["code"]) for r in rows] == [("s", "a", 0), ("s", "b", 1), ("s", "f", 0), ("s", "a", 1)]
    records.save_ledger(records.ledger(spark, str(tmp_path / "s.tsv")).limit(1), str(tmp_path / "out"))
    assert [p.read_text() for p in (tmp_path / "out").rglob("*.txt")] == ["a\t0\t1\t5\n"]


def test_other_files(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"t":5,"reason":"cache-hit"}\n{"reason":"cache-hit"}\n{"t":6,"reason":"odd"}\n')
    assert records.decisions(spark, str(tmp_path / "log.jsonl")).count() == 1
    (tmp_path / "x.meta").write_text('{"sha256":"ab","len":3.0,"ct":"log"}\n{"sha256":"ab"}')
    meta = records.meta(spark, str(tmp_path / "x.meta")).collect()
    assert [(r["len"], r["created"], r["content_type"]) for r in meta] == [(3, 0, "log")]
    (tmp_path / "t.jsonl").write_text('{"a":1}\r\n\n')
    assert [tuple(r) for r in records.transcript(spark, str(tmp_path / "t.jsonl")).collect()] == [("t", 0, '{"a":1}'), ("t", 1, "")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("# t\n" + "prose " * 200 + "\n")
    (tmp_path / "d" / "b.md").write_text("short\n")
    docs = records.blobs(spark, str(tmp_path / "d"))
    made = {r["path"][-4:]: r for r in records.sidecars(docs).collect()}
    assert made["a.md"]["written"] and not made["b.md"]["written"] and made["a.md"]["out_path"].endswith("a.tilefold.md")
    records.write_sidecars(docs, str(tmp_path / "side"))
    written = [p.read_text() for p in (tmp_path / "side").rglob("*.txt")]
    assert len(written) == 1 and "exact recall available" in written[0]


def test_engine(spark, tmp_path):
    engine = Engine(spark, EngineConfig(root=str(tmp_path / "root"), budget=10_000))
    text = "\n\n".join(f"paragraph {i} " + "word " * 20 for i in range(12))
    schema = "id bigint, session string, step bigint, text string"
    first = engine.pack_output(spark.createDataFrame([(1, "s", 0, text)], schema)).collect()[0]
    again = engine.pack_output(spark.createDataFrame([(2, "s", 1, text), (3, "t", 1, text)], schema)).collect()
    by = {r["id"]: r for r in again}
    assert first["delta_hits"] == 0 and by[2]["delta_hits"] == by[2]["blocks"] and by[3]["delta_hits"] == 0 and by[2]["shown_tokens"] < first["shown_tokens"] / 3
    block = engine.store().first()
    assert engine.expand_handle(block["handle"]) == bytes(block["bytes"]) and engine.expand_handle("ks2_" + "0" * 32, session="me") is None
    printed = {h for r in [first, *again] for h in re.findall("ks2_[0-9a-f]{32}", r["view"])}
    stored = {r["handle"]: bytes(r["bytes"]) for r in engine.store().collect()}
    assert printed and printed <= set(stored) and all("ks2_" + hashlib.sha256(b).hexdigest()[:32] == h for h, b in stored.items())
    whole = re.search("unchanged . recall (ks2_[0-9a-f]{32})", by[2]["view"])[1]
    assert engine.expand_handle(whole, session="other") == text.encode()
    assert engine.expand_handle(whole, (1, 2)) == b"\n".join(text.encode().split(b"\n")[:2]) and b"paragraph 7" in engine.expand_handle(whole, pattern="paragraph 7", caller="cli")
    lines = engine.metrics().collect()
    assert [(r["session"], r["mode"], r["caller"]) for r in lines if r["event"] == "expand" and r["handle"] == whole] and {r["mode"] for r in lines if r["event"] == "expand"} == {"whole", "lines", "grep"}
    assert {r["session"] for r in lines if r["event"] == "expand" and r["ok"]} == {"s"} and sum(r["event"] == "compress" for r in lines) == 3
    assert engine.meta().filter("session = 's'").count() > 0 and savings.sessions(engine.metrics()).filter("session = 's'").first()["refetched"] > 0
    assert "no such handle" in engine.call("inspect", handle="ks2_x") and "n_lines: 23" in engine.call("inspect", handle=whole) and "net" in engine.call("metrics") and engine.call("expand", handle=whole) == text
    assert engine.status().first()["latest_session"] in ("s", "t") and engine.packs().count() == 3
    gone = engine.ledger().filter("session = 's'").select("session", "handle").limit(1)
    handle = gone.first()["handle"]
    engine.evict(spark.createDataFrame([("s", handle)], "session string, handle string"))
    assert engine.ledger().filter(F.col("session") == "s").filter("code = 1").count() == 1
    engine.record_residency(spark.createDataFrame([("s", handle, 9)], "session string, handle string, step bigint"))
    assert engine.ledger().filter("code = 1").count() == 0
    kept, state = engine.version(), engine.ledger().orderBy("session", "handle").collect()
    true, ledgers.enforce_budget = ledgers.enforce_budget, None
    try:
        with pytest.raises(TypeError):
            engine.pack_output(spark.createDataFrame([(9, "s", 3, "lost " * 100)], schema))
    finally:
        ledgers.enforce_budget = true
    assert engine.version() == kept and engine.ledger().orderBy("session", "handle").collect() == state and engine.packs().filter("id = 9").isEmpty() and engine.metrics().filter("line_id = 9 and event = 'compress'").isEmpty()
    tight = Engine(spark, EngineConfig(root=str(tmp_path / "root"), budget=10))
    tight.pack_output(spark.createDataFrame([(4, "s", 2, "new text")], schema))
    assert tight.ledger().filter("session = 's' and code = 0").agg(F.sum("tokens")).first()[0] <= 10


def test_evicted_and_unproved_blocks_are_sent_again(spark, tmp_path):
    engine = Engine(spark, EngineConfig(root=str(tmp_path)))
    schema = "id bigint, session string, step bigint, text string"
    text = "\n\n".join(f"part {i} " + "word " * 20 for i in range(3))
    engine.pack_output(spark.createDataFrame([(1, "s", 0, text)], schema))
    engine.evict(engine.ledger().select("session", "handle"))
    again = engine.pack_output(spark.createDataFrame([(2, "s", 1, text)], schema)).first()
    assert again["delta_hits"] == 0 and again["evicted_resends"] == again["blocks"] and engine.ledger().filter("code = 1").isEmpty()
    lines = spark.createDataFrame([("s", 0, json.dumps({"content": engine.ledger().first()["handle"]})), ("s", 1, '{"type":"clear"}')], "session string, line_no bigint, line string")
    gated = engine.pack_output(spark.createDataFrame([(3, "s", 2, text)], schema), transcripts.proof(lines)).first()
    assert gated["delta_hits"] == 0 and gated["evicted_resends"] == gated["blocks"]
    assert engine.pack_output(spark.createDataFrame([(4, "s", 3, text)], schema)).first()["delta_hits"] == gated["blocks"]


def test_redirected_reads(spark, tmp_path):
    engine = Engine(spark, EngineConfig(root=str(tmp_path)))
    log = "\n".join(f"step {i} done in {i * 7} ms" for i in range(900)).encode()
    prose = ("# Title\n\n" + "A long paragraph of prose. " * 500 + "\n").encode()
    schema = "id bigint, session string, path string, bytes binary, sliced boolean"
    reads = [(1, "s", "/a/run.log", log, False), (2, None, "/a/doc.md", prose, False), (3, "s", "/a/none", None, False), (4, "s", "/a/small", b"x", False), (5, "s", "/a/run.log", log, True), (6, "s", "/b/random", bytes(range(256)) * 40, False)]
    first = {r["id"]: r for r in engine.redirect_reads(spark.createDataFrame(reads, schema), now=100).collect()}
    assert [first[i]["reason"] for i in range(1, 6)] == ["redirect-emitted", "redirect-emitted", "file-unreadable", "too-small", "slicing-requested"]
    for i, source in ((1, log), (2, prose)):
        handles = set(re.findall("ks2_[0-9a-f]{32}", first[i]["view"]))
        assert handles and all(engine.expand_handle(h) for h in handles) and engine.expand_handle("ks2_" + hashlib.sha256(source).hexdigest()[:32]) == source
    shutil.rmtree(tmp_path / "store")
    second = {r["id"]: r for r in engine.redirect_reads(spark.createDataFrame(reads[:2], schema), now=200).collect()}
    assert {r["reason"] for r in second.values()} == {"cache-hit"} and second[1]["view"] == first[1]["view"] and second[1]["redirect_to"] == first[1]["redirect_to"]
    assert engine.expand_handle("ks2_" + hashlib.sha256(log).hexdigest()[:32]) == log
    lines = engine.metrics().collect()
    assert sum(r["event"] == "compress" and r["saved"] > 0 for r in lines) == 5 and {r["session"] for r in lines if r["event"] == "compress"} == {"s", "read-hook"}
    assert sum(r["caller"] == "hook" and r["mode"] == "lines" and r["ok"] for r in lines) == 2
    assert engine.decisions().count() == 8 and "cache-hit" in decisions_report(engine.decisions())
    assert Engine(spark, EngineConfig(root=str(tmp_path), read_gate=False)).redirect_reads(spark.createDataFrame(reads[:1], schema)).first()["reason"] == "gate-disabled"


def test_commands(spark, tmp_path, monkeypatch, capsys):
    from tilefold import cli

    monkeypatch.setenv("TILEFOLD_ROOT", str(tmp_path / "root"))

    def run(*args):
        code = cli.main(list(args), spark)
        return code, capsys.readouterr().out.rstrip("\n")

    text = "\n\n".join(f"part {i} " + "word " * 20 for i in range(4))
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log").write_text(text + "\n\nmore")
    assert run("pack", str(tmp_path / "a.log"), "--session=s") == (0, "\n".join(x.rstrip("\n") for x in text.split("\n")))
    code, view = run("pack", str(tmp_path / "a.log"), "--session", "s", "--step", "1")
    named = re.search("recall (ks2_[0-9a-f]{32})", view)[1]
    assert run("expand", named) == (0, text) and run("expand", named, "--lines", "1-1") == (0, text.split("\n")[0]) and "part 2" in run("expand", named, "--grep=part 2")[1]
    assert run("expand", "ks2_none")[0] == 1 and run("expand", named, "--lines", "x")[0] == 2 and run("pack", str(tmp_path / "gone"))[0] == 2 and run("what")[0] == 2
    assert "n_lines" in run("inspect", named)[1] and run("inspect", str(tmp_path / "a.log")) == (1, "not a packed file")
    assert "blocks unchanged" in run("delta", str(tmp_path / "a.log"), str(tmp_path / "b.log"))[1]
    assert run("store", "put", str(tmp_path / "b.log"))[1] == "ks2_" + hashlib.sha256((text + "\n\nmore").encode()).hexdigest()[:32]
    assert "latest session s" in run("status")[1] and "net" in run("metrics", "--session", "s")[1] and "all sessions" in run("ab")[1] and "none" in run("why-last")[1]
    monkeypatch.setattr("sys.stdin", type("In", (), {"buffer": __import__("io").BytesIO(b"from stdin")}))
    assert run("pack", "-", "--type", "log")[1] == "from stdin" and run("pack", "--type", "odd")[0] == 2
    (tmp_path / "t.jsonl").write_text(json.dumps({"content": named}) + "\n")
    assert "1 handles" in run("transcript", str(tmp_path / "t.jsonl"))[1]
    assert "deleted" in run("gc")[1] and run("expand", named)[0] == 0
    run("gc", "--older-than", "0", "--live")
    assert run("expand", named)[0] in (0, 1) and cli.flag(["--a", "1", "--a=2"], "a") == "1" and cli.flag(["--a"], "a") is None


def test_config():
    c = EngineConfig.from_env({"TILEFOLD_BUDGET": "7", "TILEFOLD_READ_GATE": "OFF", "TILEFOLD_ROOT": "/r"})
    assert (c.budget, c.read_gate, c.path("store")) == (7, False, "/r/store")
    assert EngineConfig.from_env({"TILEFOLD_BUDGET": "x"}).budget == 120_000 and EngineConfig.from_env({}).read_gate and not EngineConfig.from_env({"TILEFOLD_READ_GATE": ""}).read_gate


def run_stream(spark, df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streaming_savings(spark, small, tmp_path):
    metrics = spark.read.parquet(f"{small}/metrics.parquet")
    metrics.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(metrics.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_stream(spark, sessions.running_savings(stream), "complete", tmp_path, "running")
    want = savings.sessions(metrics).collect()
    assert {r["session"]: r["compress_events"] for r in got} == {r["session"]: r["compress_events"] for r in want}
    windows = run_stream(spark, sessions.windowed_savings(stream, "1 day", "1 hour"), "append", tmp_path, "windows")
    assert windows and len({(r["from"], r["session"]) for r in windows}) == len(windows)


def test_streaming_residency(spark, tmp_path):
    from tilefold.operators import conditional

    texts = spark.createDataFrame([(i, "s" if i % 2 else "t", i, "\n\n".join(f"p{j} word" for j in range(i % 5 + 1)), "log") for i in range(12)], "id bigint, session string, step bigint, text string, content_type string")
    for i in range(3):
        texts.filter(F.col("id").between(i * 4, i * 4 + 3)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in"))
    got = {r["id"]: r["known"] for r in run_stream(spark, sessions.residency_stream(stream, 100), "append", tmp_path, "residency")}
    batch = {r["id"]: r["delta_hits"] for r in conditional.session_fold(texts, 100).collect()}
    assert set(got) == set(batch) and sum(map(sum, got.values())) > 0
    assert all(isinstance(json.dumps(v), str) for v in got.values())


def test_streaming_state_forgets(spark, tmp_path):
    rows = [(i, "s", i, f"only {i} " + "word " * 30 if i < 8 else "only 0 " + "word " * 30, "log") for i in range(9)]
    schema = "id bigint, session string, step bigint, text string, content_type string"
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    for keep, resends in ((100, 1), (3, 0)):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        got = run_stream(spark, sessions.residency_stream(stream, 60, forget_after=keep), "append", tmp_path, f"forget{keep}")
        assert {r["id"]: r["evicted_resends"] for r in got}[8] == resends


def test_windows_count_files_and_null_ids(spark, tmp_path):
    schema = "file string, line_id bigint, received_at string, event string, session string, raw bigint, shown bigint, saved bigint"
    rows = [(f, i, "2026-01-01 00:10:00", "compress", "s", 0, 0, 1) for f, i in (("a", 0), ("a", 0), ("b", 0), ("a", None), ("a", None))]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    late = [("z", 9, "2026-01-09 00:00:00", "compress", "s", 0, 0, 1)]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = run_stream(spark, sessions.windowed_savings(stream, "1 day", "1 hour"), "append", tmp_path, "ids")
    assert [(r["compress_events"], r["saved"]) for r in got] == [(4, 4)]
