"""Problem 5 against a plain reading of its definition, and its edge cases."""

from __future__ import annotations

import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tilefold.operators import drift

SCHEMA = "record_id bigint, stream string, file_no int, written_at timestamp, record string, field string, type int"


def kind(v):
    return "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number" if isinstance(v, (int, float)) else "list" if isinstance(v, list) else "object"


def canon(v):
    if isinstance(v, dict):
        return {k: canon(x) for k, x in v.items()}
    if isinstance(v, list):
        return [canon(x) for x in v]
    return int(v) if isinstance(v, float) and v == int(v) else v


def brute(rows):
    seen, types, values, files = set(), defaultdict(Counter), defaultdict(set), set()
    for r in rows:
        key = (r["stream"], r["file_no"], r["record_id"])
        if r["record_id"] is not None and key in seen:
            continue
        seen.add(key)
        if r["stream"] is None or r["file_no"] is None:
            continue
        f = (r["stream"], r["file_no"])
        files.add(f)
        try:
            rec = json.loads(r["record"] or "")
        except ValueError:
            continue
        for k, v in rec.items() if isinstance(rec, dict) else ():
            if v is not None:
                types[f, k][kind(v)] += 1
                values[f, k].add(json.dumps(canon(v), sort_keys=True))
    commonest = {fk: max(drift.TYPES, key=lambda t: (c[t], -drift.TYPES.index(t))) for fk, c in types.items()}
    out = set()
    for s, n in files:
        if (s, n - 1) not in files:
            continue
        old = {k for f, k in types if f == (s, n - 1)}
        new = {k for f, k in types if f == (s, n)}
        ended, began, used = old - new, new - old, set()
        for a in ended:
            for b in began:
                if commonest[(s, n - 1), a] == commonest[(s, n), b] and values[(s, n - 1), a] & values[(s, n), b]:
                    out.add((s, n, a, b, "renamed"))
                    used |= {("o", a), ("n", b)}
        out |= {(s, n, a, "", "removed") for a in ended if ("o", a) not in used} | {(s, n, "", b, "added") for b in began if ("n", b) not in used}
        out |= {(s, n, k, k, "retyped") for k in old & new if commonest[(s, n - 1), k] != commonest[(s, n), k]}
    return out


def found(df):
    log = drift.changes(df, drift.shapes(df))
    return {tuple(r) for r in log.select("stream", "file_no", "old_name", "new_name", "change_kind").collect()}


def test_whole_table(spark, small):
    df = spark.read.parquet(f"{small}/meta_raw.parquet")
    want = brute(df.collect())
    assert found(df) == want and want


def rows(*files, stream="s"):
    return [(1000 * n + i, stream, n, None, x, "clash", 1) for n, f in enumerate(files) for i, x in enumerate(f)]


EDGE = (
    rows(['{"a": 1, "b": "x"}'], ['{"c": 1.0, "b": 5}'], ["{}"], ['{"b": null}', None, "", "not json", "[1]", '{"z": {"k": [1, 2], "j": 1}}'], ['{"y": {"j": 1.0, "k": [1, 2]}}'])
    + rows(['{"p": true, "q": true}'], ['{"r": true}'], stream="many")
    + rows(['{"p": 1}', '{"p": "1"}'], ['{"p": "1"}', '{"p": 1}', '{"p": 2}'], stream="tie")
    + rows(['{"k": 1, "k": "last"}'], ['{"k2": "last"}'], stream="repeat")
    + rows(['{"' + "n" * 50_000 + '": "' + "v" * 200_000 + '"}'], ['{"m": "' + "v" * 200_000 + '"}'], stream="long")
    + [(1, None, 0, None, '{"a":1}', None, None), (2, "nofile", None, None, '{"a":1}', None, None), (3, "gap", 0, None, '{"a":1}', None, None), (4, "gap", 2, None, '{"b":1}', None, None)]
    + [(None, "nulls", 0, None, '{"a":1}', None, None)] * 2
    + [(5, "copies", 0, None, '{"a":1}', None, None)] * 3
    + [(6, "copies", 0, None, '{"a":"1"}', None, None), (7, "copies", 0, None, '{"a":"2"}', None, None), (8, "copies", 1, None, '{"a":3}', None, None)]
)


def test_edge_cases(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    assert found(df) == brute(df.collect())


def test_unified(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    found_shapes = drift.shapes(df)
    aliases, types, split = drift.union_schema(found_shapes, drift.changes(df, found_shapes))
    out = drift.unified(df, aliases, types, split)
    assert out.count() == len({(r[1], r[2], r[0]) for r in EDGE}) + 1
    assert types["b"] == "string" and len({c.lower() for c in out.columns}) == len(out.columns)


def test_unified_values(spark):
    data = rows(['{"proj": "x", "Len": 1, "len": 2, "record_id": "r"}'], ['{"project": "x", "Len": "odd", "len": 3.5}', '{"project": ["y"]}'])
    df = spark.createDataFrame(data, SCHEMA)
    found_shapes = drift.shapes(df)
    out = {r["record_id"]: r.asDict() for r in drift.unified(df, *drift.union_schema(found_shapes, drift.changes(df, found_shapes))).collect()}
    assert out[0]["project"] == "x" and out[1000]["project"] == "x" and out[1001]["project"] == '["y"]'
    assert {out[0][c] for c in out[0] if c.lower().startswith("len")} == {"1", 2.0} and out[0]["record_id_"] == "r"


def test_misfits_are_kept(spark):
    df = spark.createDataFrame(rows(['{"n": 1}', '{"n": 2}', '{"n": true}']), SCHEMA)
    out = {r["record_id"]: r for r in drift.unified(df, {"n": ["n"]}, {"n": "number"}).collect()}
    assert out[0]["n"] == 1.0 and out[2]["n"] is None and out[2]["_misfits"] == {"n": "true"}


def test_canonical_names_and_lattice():
    names = drift.canonical_names({("proj", "project"), ("ct", "kind"), ("kind", "content_type")}, {"proj": 5, "project": 2, "ct": 1, "kind": 1, "content_type": 1, "x": 1})
    assert names["proj"] == "project" and names["ct"] == names["kind"] == "content_type" and names["x"] == "x"
    assert drift.promote("number", "number") == "number" and drift.promote("number", "boolean") == "string"
    assert drift.promote("list", "string") == "json" and drift.promote(None, "list") == "list"
    assert drift.promote("integer", "number") == "number" and drift.promote("integer", "boolean") == "string" and drift.promote("integer", "integer") == "integer"


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found(df) == set()
    assert drift.unified(df, {}, {}).count() == 0


def test_further_names_of_a_chain_are_kept(spark):
    rows = [(1, "s", 0, None, '{"a": 1, "b": 2, "c": "x"}', "", 0), (2, "s", 0, None, '{"a": 3}', "", 0), (3, "s", 0, None, '{"a": 4, "c": null, "b": 4}', "", 0), (4, "s", 0, None, '{"b": "y", "a": 5}', "", 0)]
    out = drift.unified(spark.createDataFrame(rows, SCHEMA), {"b": ["a", "b", "c"]}, {"b": "number"})
    got = {r["record_id"]: (r["b"], r["_misfits"]) for r in out.collect()}
    assert got == {1: (2.0, {"a": "1", "c": "x"}), 2: (3.0, {}), 3: (4.0, {"a": "4"}), 4: (None, {"b": "y", "a": "5"})}


def test_all_rename_pairs_are_folded(spark, monkeypatch):
    monkeypatch.setattr(drift, "MAX_FIELDS", 2)
    monkeypatch.setattr(drift, "headers", lambda found: found)
    found = spark.createDataFrame([("s", 0, "a", "number", 3, 0), ("s", 1, "b", "number", 1, 0)], "stream string, file_no bigint, field string, type string, n bigint, n_broken bigint")
    log = spark.createDataFrame([(x, y, "renamed") for x, y in ("am", "mn", "no", "ob")], "old_name string, new_name string, change_kind string")
    assert drift.union_schema(found, log) == ({"b": ["a", "b"]}, {"b": "integer"}, None)
    monkeypatch.setattr(drift, "MAX_FIELDS", 1)
    with pytest.raises(ValueError):
        drift.union_schema(found, log)


def table_of(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    found_shapes = drift.shapes(df)
    return {r["record_id"]: r.asDict() for r in drift.unified(df, *drift.union_schema(found_shapes, drift.changes(df, found_shapes))).collect()}


def test_numbers_keep_their_digits(spark):
    big, huge = 9007199254740993, 123456789012345678901234567890
    out = table_of(spark, rows([f'{{"i": {big}, "d": 1.5, "h": {huge}, "m": {big}}}', '{"i": -3, "d": 2, "h": 1, "m": 0.25}']))
    assert out[0]["i"] == big and out[1]["i"] == -3 and out[0]["d"] == 1.5 and out[1]["d"] == 2.0 and out[1]["m"] == 0.25
    assert out[0]["h"] is None and out[0]["m"] is None and out[0]["_misfits"] == {"h": str(huge), "m": str(big)}


def test_names_of_a_chain_stay_apart_where_they_stand_together(spark):
    data = rows(['{"proj": "x"}'], ['{"project": "x"}']) + [(7, "both", 0, None, '{"proj": "left", "project": "right"}', "clash", 1), (8, "both", 1, None, '{"proj": "alone"}', "clash", 1), (9, "old", 0, None, '{"proj": "o"}', "clash", 1)]
    out = table_of(spark, data)
    assert out[0]["project"] == out[1000]["project"] == "x" and out[0]["proj"] is None and out[9]["project"] == "o"
    assert (out[7]["proj"], out[7]["project"], out[7]["_misfits"]) == ("left", "right", {})
    assert (out[8]["proj"], out[8]["project"]) == ("alone", None)


def test_every_value_is_in_its_row(spark, small):
    df = spark.read.parquet(f"{small}/meta_raw.parquet")
    found_shapes = drift.shapes(df)
    schema = drift.union_schema(found_shapes, drift.changes(df, found_shapes))
    kept = {(r["stream"], r["file_no"], r["record_id"]): r.asDict() for r in drift.unified(df, *schema).collect()}
    for r in df.collect():
        values = [v for v in drift._record(r["record"]).values()]
        row = kept[r["stream"], r["file_no"], r["record_id"]]
        held = [v for k, v in row.items() if k not in ("record_id", "stream", "file_no", "_misfits") and v is not None] + list(row["_misfits"].values())
        same = sorted(drift.dump(v) if not isinstance(v, str) else v for v in values)
        read = []
        for v in held:
            try:
                read.append(drift.dump(drift.parse(v)) if isinstance(v, str) and v[:1] in "[{" else v if isinstance(v, str) else drift.dump(v))
            except ValueError:
                read.append(v)
        assert sorted(read) == same


def test_log_is_ordered(spark):
    df = spark.createDataFrame([(*r[:5],) for r in rows(['{"a": 1, "b": 2}'], ['{"a": "x", "c": 2}'], ['{"a": "x"}'])], ", ".join(SCHEMA.split(", ")[:5])).withColumn("file_name", F.concat(F.lit("f"), "file_no"))
    log = drift.ordered_log(df, drift.changes(df, drift.shapes(df))).collect()
    assert [tuple(r)[1:7] for r in log] == [(1, 1, "f1", "renamed", "b", "c"), (2, 1, "f1", "retyped", "a", "a"), (3, 2, "f2", "removed", "c", "")]
