"""JSON goes through the same dispatch as code and logs: tiles, views, packing, replay, restoring, and the read cache."""

from __future__ import annotations

import json
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from test_text import estimate, handle

from tilefold.api import Engine
from tilefold.config import EngineConfig
from tilefold.operators import conditional, documents, store, structural, tiles
from tilefold.plans.log_queries import delta_json

TEXTS = "id bigint, session string, step bigint, text string, content_type string"


def package(**changed):
    deps = {f"package-{i}": f"^{i}.1.0" for i in range(30)}
    return json.dumps({"name": "tilefold-test", "version": "0.0.1", "scripts": {"build": "tsc", "test": "run"}, "dependencies": deps, "peers": {**deps, "last": "^1"}, **changed}, indent=2) + "\n"


ROWS = [
    (1, "same", 0, package(), "json"), (2, "same", 1, package(), "json"), (3, "edit", 0, package(), "json"), (4, "edit", 1, package(version="0.0.2"), "json"),
    (5, "bad", 0, '{"a": ' + "x" * 300, "json"), (6, "tiny", 0, '{"a":1}', "json"), (7, "same", 2, "plain\n\nlog\n", "log"), (8, "same", 3, "def f():\n    pass\n", "code"), (9, "same", 4, None, "json"),
]


def plain_tiles(text):
    b = (text or "").encode()
    return [b[s:e].decode() for s, e in tiles.split_json(b)]


def plain_view(text):
    return "".join(v for v, _ in structural.json_parts(text.encode()))


def test_pack_and_fold(spark):
    df = spark.createDataFrame(ROWS, TEXTS)
    out = {r["id"]: r for r in conditional.pack(df).collect()}
    folded = {r["id"]: r for r in conditional.session_fold(df).collect()}
    assert {i: (r["view"], r["blocks"]) for i, r in folded.items()} == {i: (r["view"], r["blocks"]) for i, r in out.items()}
    for i, _, _, text, kind in ROWS:
        assert kind != "json" or out[i]["blocks"] == len(plain_tiles(text))
        assert out[i]["shown_tokens"] <= estimate(text or "")
    assert out[1]["view"] == plain_view(package()) and '"dependencies": [Tilefold: section omitted' in out[1]["view"] and out[1]["delta_hits"] == 0
    assert out[2]["delta_hits"] == out[2]["blocks"] and out[2]["shown_tokens"] * 4 < out[1]["shown_tokens"]
    assert out[4]["delta_hits"] == out[4]["blocks"] - 1 and '"version": "0.0.2"' in out[4]["view"]
    assert out[5]["view"] == ROWS[4][3] and out[6]["view"] == ROWS[5][3] and out[9]["view"] == "" and out[7]["blocks"] == 3 and out[8]["blocks"] == 1


def test_restored_and_mixed_types(spark):
    df = spark.createDataFrame(ROWS, TEXTS).filter("text is not null")
    parts = df.select(F.col("id").alias("seq"), "session", F.explode(tiles.blocks(F.col("text"), F.col("content_type"))).alias("b"))
    kept = store.put(parts.select("seq", "session", F.encode("b", "UTF-8").alias("bytes")))
    assert {r["id"]: r["restored"] for r in conditional.reconstruct(df, kept).collect()} == {r[0]: r[3] for r in ROWS if r[3]}
    views = {r["id"]: r["v"] for r in df.select("id", structural.view(F.col("text"), F.col("content_type")).alias("v")).collect()}
    assert views[1]["view"] == plain_view(package()) and all(e["handle"] == handle(e["text"]) and e["text"] in package() for e in views[1]["elided"]) and len(views[1]["elided"]) == 2
    assert views[7]["view"] == "plain\n\nlog"


def test_engine_detects_json(spark, tmp_path):
    engine = Engine(spark, EngineConfig(root=str(tmp_path)))
    df = spark.createDataFrame([r[:4] for r in ROWS[:1]], "id bigint, session string, step bigint, text string")
    assert engine.pack_output(df).first()["view"] == plain_view(package())
    assert engine.expand_handle(handle(plain_tiles(package())[1])) == plain_tiles(package())[1].encode()


def test_read_cache(spark):
    df = spark.createDataFrame([("/p/package.json", package()), ("/p/a.txt", "x\n")], "path string, text string")
    views = [r[0] for r in df.select(documents.cache_view(F.col("path"), F.col("text"))).collect()]
    assert views[0].endswith(plain_view(package())) and views[1].endswith("]\n\nx")


def test_records_against_replay(spark, small):
    records = {}
    for r in spark.read.parquet(f"{small}/meta_raw.parquet").collect():
        records.setdefault(r["record_id"], set()).add((r["stream"], r["record"]))
    got = {r["id"]: r for r in delta_json(spark, small).collect()}
    assert set(got) == set(records) - {None}
    lone = {i: next(iter(x)) for i, x in records.items() if i is not None and len(x) == 1}
    counts = Counter(len(plain_tiles(t)) - got[i]["blocks"] for i, (_, t) in lone.items())
    assert set(counts) == {0}
    streams = defaultdict(list)
    for i in sorted(got):
        streams[next(iter(records[i]))[0]].append(i)
    for ids in streams.values():
        first = got[ids[0]]
        assert first["delta_hits"] <= first["blocks"] and all(got[i]["shown_tokens"] <= got[i]["raw_tokens"] for i in ids)
