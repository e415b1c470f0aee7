"""Problem 1 against a recursive reading of its definition, and its edge cases."""

from __future__ import annotations

import json

import pytest

from tilefold.functions.strict_json import _parse_deep, dump, parse
from tilefold.operators import nested

SCHEMA = "line_id bigint, session string, line_no bigint, kind string, role string, message string, content string, logged_at timestamp, tag string"


def whole(text):
    def no(x):
        raise ValueError(x)

    return json.loads(text, parse_constant=no)


def walk(value, path, line_id, out):
    if isinstance(value, str):
        try:
            value = whole(value)
        except ValueError:
            return
        if isinstance(value, str):
            return walk(value, path, line_id, out)
    items = value if isinstance(value, list) else [value] if isinstance(value, dict) else []
    for i, x in enumerate(items):
        if isinstance(x, dict):
            at = f"{path}.{i}"
            out.add((line_id, path, at))
            if "content" in x:
                walk(x["content"], at, line_id, out)
            if isinstance(x.get("message"), dict) and "content" in x["message"]:
                walk(x["message"]["content"], at, line_id, out)


def brute(rows):
    out = set()
    for r in rows:
        if r["content"] is not None:
            walk(r["content"], "c", r["line_id"], out)
        if r["message"] is not None:
            try:
                m = whole(r["message"])
            except ValueError:
                continue
            if isinstance(m, dict) and "content" in m:
                walk(m["content"], "m", r["line_id"], out)
    return out


def keys(spark, df):
    return [tuple(r) for r in nested.object_keys(spark, nested.write_tagged(df)).collect()]


def test_whole_table(spark, small):
    df = spark.read.parquet(f"{small}/transcript.parquet")
    got = keys(spark, df)
    assert len(got) == len(set(got)) and set(got) == brute(df.collect()) and got


def line(i, message=None, content=None, **k):
    return (i, k.get("session", "s"), i, "user", "user", message, content, None, "clash")


CASES = [
    line(1, content='[{"type":"a"},"x",{"content":[{"content":{"b":1}}]}]'),
    line(2, content='"[{\\"k\\": 1}]"'),
    line(3, content='{"content": "[{\\"z\\": []}]", "message": {"content": {"y": 1}}}'),
    line(4, content='[{"a": NaN}]'),
    line(5, content='[{"a": 1}'),
    line(6, content='[{"a": 1}] tail'),
    line(7, content=""),
    line(8),
    line(9, message='{"role":"user","content":{"input":{"content":[{"no":1}]}}}'),
    line(10, message="[1]", content="5"),
    line(10, message="[1]", content="5"),
    line(11, content='{"a":1,"a":{"content":[{}]},"content":null}'),
    line(12, content='[{"is_error": true, "text": "x", "citations": [{"p": 1}, {"p": "\\ud800"}], "\\ud800": [1]}]'),
    (None, None, None, None, None, None, '[{"n": 1}]', None, None),
    line(13, content="[" + '{"t":"' + "x" * 300_000 + '"}' + "]"),
    line(14, content="[" * 50_000 + "]" * 50_000),
    line(15, content='[{"n": ' + "9" * 5000 + "}]"),
]


def test_edge_cases(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    got = keys(spark, df)
    rows = [r for r in df.collect() if r["line_id"] not in (14, 15)]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows) | {(15, "c", "c.0")}


def test_very_deep_content(spark):
    n = 3_000
    text = '[{"content":' * n + "[]" + "}]" * n
    got = keys(spark, spark.createDataFrame([line(1, content=text)], SCHEMA))
    assert len(got) == n and (1, "c" + ".0" * (n - 1), "c" + ".0" * n) in got


def unwrapped(value):
    try:
        inner = parse(value)
    except ValueError:
        return value
    inner = unwrapped(inner) if isinstance(inner, str) else inner
    return inner if isinstance(inner, (list, dict)) else value


def plain_content(value):
    """A content value as the tables hold it: wrapped strings unwrapped, an object as it is."""
    value = unwrapped(value) if isinstance(value, str) else value
    if isinstance(value, list):
        return [plain_object(x) if isinstance(x, dict) else x for x in value]
    return plain_object(value) if isinstance(value, dict) else value


def plain_object(x):
    return {k: plain_content(v) if k == "content" else plain_message(v) if k == "message" and isinstance(v, dict) else v for k, v in x.items()}


def plain_message(x):
    return {k: plain_content(v) if k == "content" else v for k, v in x.items()}


def rebuilt(tables, line_id):
    """The message and content of a line, put together from its rows."""
    rows = {r["node_no"]: (tag, r) for tag, t in tables.items() if tag != "line" for r in t if r["line_id"] == line_id}
    kids = {}
    for no, (tag, r) in sorted(rows.items()):
        kids.setdefault(r["parent_no"], []).append((no, tag, r))

    def fields(r, columns):
        out = {c: r[c] for c in columns if r[c] is not None}
        out |= {k: json.loads(v) for k, v in (r["fields"] or {}).items()}
        return out

    def value(no, tag, r):
        below = [(t, x, value(n, t, x)) for n, t, x in kids.get(no, [])]
        if tag == "text":
            return r["text"]
        if tag == "content":
            if r["shape"] == "scalar":
                return json.loads(r["value"])
            inner = [v for _, _, v in below]
            return inner if r["shape"] == "list" else inner[0]
        if tag == "detail":
            if r["kind"] == "scalar":
                return json.loads(r["value"])
            if r["kind"] == "list":
                return [v for _, _, v in below]
            return fields(r, ()) | {x["place"]: v for _, x, v in below}
        out = fields(r, ("role", "id") if tag == "message" else ("type", "role", "id", "name", "tool_use_id", "text", "is_error"))
        out |= {"content" if t == "content" else "message" if t == "message" else x["place"]: v for t, x, v in below}
        assert len(out) == r["n_fields"]
        return out

    return {"content" if t == "content" else "message": value(n, t, r) for n, t, r in kids.get(0, [])}


def collected(spark, df):
    path = nested.write_tagged(df)
    return {tag: nested.read_table(spark, path, tag).collect() for tag in nested.SCHEMAS}


def by_line(tables):
    out = {}
    for tag, rows in tables.items():
        for r in rows:
            out.setdefault(r["line_id"], {t: [] for t in tables})[tag].append(r)
    return out


def check_rebuilt(tables, rows):
    each = by_line(tables)
    for r in rows:
        want = {}
        if r["content"] is not None:
            want["content"] = plain_content(r["content"])
        if r["message"] is not None:
            m = unwrapped(r["message"])
            want["message"] = plain_message(m) if isinstance(m, dict) else m
        assert rebuilt(each[r["line_id"]], r["line_id"]) == want


def test_records_can_be_rebuilt(spark, small):
    df = spark.read.parquet(f"{small}/transcript.parquet")
    check_rebuilt(collected(spark, df), df.collect())


def test_tables_keep_links_and_fields(spark):
    df = spark.createDataFrame([c for c in CASES if c[0] not in (10, 14, 15)] + OTHERS, SCHEMA)
    tables = collected(spark, df)
    assert len(tables["line"]) == df.select("line_id").distinct().count()
    rows = [r for r in df.collect() if r["line_id"] not in (12, None)]
    check_rebuilt(tables, rows)
    numbers = {(r["line_id"], r["node_no"]) for t, rs in tables.items() if t != "line" for r in rs} | {(r["line_id"], 0) for r in tables["line"]}
    assert all((r["line_id"], r["parent_no"]) in numbers for t, rs in tables.items() if t != "line" for r in rs)
    objects = {(r.line_id, r.node_path): r for r in tables["object"]}
    assert objects[12, "c.0"].is_error is True and objects[12, "c.0"].text == "x"
    assert {r.place for r in tables["detail"] if r.line_id == 12 and r.kind == "list"} == {"citations", "?"}
    think = objects[20, "c.0"]
    assert think.type == "thinking" and think.fields == {"thinking": '"deep"', "signature": '"abc"', "is_error": '"no"', "n": "5"} and think.is_error is None
    roles = {(r.line_id, r.node_path): (r.role, r.id) for r in tables["message"]}
    assert roles[21, "/message"] == ("assistant", "m1") and roles[21, "m.0/message"] == ("tool", None)
    usage = next(r for r in tables["detail"] if r.line_id == 21 and r.place == "usage")
    assert usage.fields == {"input_tokens": "3", "cached": "null"} and usage.parent_path == "/message"


OTHERS = [
    line(20, content='[{"type":"thinking","thinking":"deep","signature":"abc","is_error":"no","n":5}, 7, null, [1,[2,{"a":[]}]]]'),
    line(21, message='{"role":"assistant","id":"m1","usage":{"input_tokens":3,"cached":null,"by":[{"k":1},[]]},"content":[{"message":{"role":"tool","content":{"x":1}},"content":"plain"},{"message":"text"}]}'),
    line(22, message='"just text"', content="true"),
    line(23, message="{broken", content='{"content": 5, "message": {"content": null, "role": 4}}'),
    line(24, message='"{\\"role\\": \\"user\\"}"'),
]


def test_repeats_that_differ_are_not_mixed(spark):
    df = spark.createDataFrame([line(1, content='[{"a":1},{"b":2}]'), line(1, content='[{"a":3}]'), line(1, content='[{"a":3}]')], SCHEMA)
    tables = collected(spark, df)
    assert len(tables["line"]) == 1
    assert rebuilt(tables, 1)["content"] in ([{"a": 1}, {"b": 2}], [{"a": 3}])


def test_empty_table_and_missing_columns(spark):
    assert keys(spark, spark.createDataFrame([], SCHEMA)) == []
    assert keys(spark, spark.createDataFrame([(1, "[{}]")], "line_id bigint, content string")) == [(1, "c", "c.0")]


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a"}', "nul", "01", '"\x01"', "[1] 2", '{"a":1,}', "{,}", "[,1]", "1 2", "﻿[]", "NaN", "[1 2]", '{"a" 1}'])
def test_strict_json_refuses(text):
    for reader in (parse, _parse_deep):
        with pytest.raises(ValueError):
            reader(text)


@pytest.mark.parametrize("text", ["[]", "{}", ' {"a": [1, 2.5, -3e2, true, false, null, "\\u00e9"]} ', "5", '"x"', "[[],{}]", '{"b":{"c":[{"d":[]}]},"a":0}'])
def test_strict_json_reads(text):
    assert parse(text) == _parse_deep(text) == json.loads(text)
    assert json.loads(dump(parse(text))) == json.loads(text)


def test_dump_is_canonical():
    assert dump(parse('{"b": 1.0, "a": [2]}')) == dump(parse('{"a":[2.0],"b":1}')) == '{"a":[2],"b":1}'
    deep = parse("[" * 30_000 + "]" * 30_000)
    assert dump(deep) == "[" * 30_000 + "]" * 30_000
    deep = parse('{"a":' * 30_000 + "1.0" + "}" * 30_000)
    assert dump(deep) == '{"a":' * 30_000 + "1" + "}" * 30_000
