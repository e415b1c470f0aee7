"""Problem 3 against a reader that goes character by character, and its edge cases."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilefold.operators import badrows

LARGEST = 2**63 - 1


def fields(line):
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, text = i + 1, ""
            while True:
                if j >= len(line):
                    return None
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        text += '"'
                        j += 2
                        continue
                    break
                text += line[j]
                j += 1
            j += 1
            if j < len(line) and line[j] != ",":
                return None
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            text = line[i:j]
            if '"' in text:
                return None
        out.append(text)
        if j >= len(line):
            return out
        i = j + 1


def reason(line):
    if line is None:
        return "column_count"
    f = fields(line[:-1] if line.endswith("\r") else line)
    if f is None:
        return "quoting"
    if len(f) != 8:
        return "column_count"
    amount = lambda x: re.fullmatch("[0-9]+", x) and int(x) <= LARGEST
    good = all(amount(f[i]) for i in (0, 3, 4, 6, 7)) and (f[5] == "" or amount(f[5].removeprefix("-"))) and re.fullmatch(r"[a-z][a-z0-9._-]*", f[1])
    return None if good else "bad_value"


GOOD = "1924992000000,compress,s-1,456,76,380,4,0"
LINES = [
    None, "", "\r", GOOD, GOOD + "\r", GOOD + "\r\r", GOOD + "\n", GOOD + ",", "," + GOOD, GOOD.replace("380", ""), GOOD.replace("380", "-"), GOOD.replace("380", "-5"),
    GOOD.replace("380", "--5"), GOOD.replace("380", "+5"), GOOD.replace("456", " 456"), GOOD.replace("456", "٤"), GOOD.replace("456", "9223372036854775807"),
    GOOD.replace("456", "9223372036854775808"), GOOD.replace("380", "-9223372036854775807"), GOOD.replace("380", "-9223372036854775808"), GOOD.replace("456", "0" * 30 + "7"),
    GOOD.replace("compress", "Compress"), GOOD.replace("compress", ""), GOOD.replace("compress", "a\n"), GOOD.replace("s-1", ""), GOOD.replace("s-1", '"a,b""c\nd"'), GOOD.replace("s-1", '"a'),
    GOOD.replace("s-1", 'a"b'), GOOD.replace("s-1", ' "b"'), GOOD.replace("s-1", '"b" '), GOOD.replace("s-1", '""'), GOOD.replace("s-1", '"""'), GOOD.replace("s-1", '""""'),
    ",".join(f'"{x}"' for x in GOOD.split(",")), '"' * 1001, '"' + "a" * 500_000, GOOD.replace("s-1", '"' + 'x""' * 200_000 + '"'), "," * 7, "," * 300_000, GOOD.replace("s-1", "é" * 1000),
]


def run(spark, lines):
    rows = [(i, None, x, "clash", "clash") for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "row_id bigint, arrived_at timestamp, line string, fields string, errors string")


def test_edge_cases(spark):
    df = run(spark, LINES)
    got = {r["row_id"]: r["reason"] for r in badrows.reasons(df).collect()}
    assert got == {i: reason(x) for i, x in enumerate(LINES) if reason(x)}
    typed = {r["row_id"]: r for r in badrows.loaded(df).collect()}
    assert set(typed) == {i for i, x in enumerate(LINES) if not reason(x)}
    assert typed[3]["raw"] == 456 and typed[9]["saved"] is None and typed[11]["saved"] == -5 and typed[25]["session"] == 'a,b"c\nd'
    errors = {r["row_id"]: [(e["reason"], e["field"]) for e in r["errors"]] for r in badrows.rejected(df).collect()}
    assert errors[21] == [("bad_value", "event")] and errors[26] == [("quoting", None)]


def test_repeats_and_empty(spark):
    df = run(spark, [GOOD, "x"])
    twice = df.unionByName(df)
    assert badrows.reasons(twice).count() == 1 and badrows.loaded(twice).count() == 1 and badrows.rejected(twice).count() == 1
    none = run(spark, [])
    assert badrows.reasons(none).count() == 0 and badrows.loaded(none).count() == 0


def test_whole_table(spark, small):
    df = spark.read.parquet(f"{small}/metrics_raw.parquet")
    want = {(r["row_id"], reason(r["line"])) for r in df.collect() if reason(r["line"])}
    assert {tuple(r) for r in badrows.reasons(df).collect()} == want and want


@pytest.mark.parametrize("seed", range(2))
@settings(max_examples=1, deadline=None)
@given(data=st.data())
def test_random_lines(spark, seed, data):
    part = st.text(alphabet='",a1-\r\n ', max_size=12)
    lines = data.draw(st.lists(st.lists(part, max_size=9).map(",".join), min_size=150, max_size=300))
    got = {r["row_id"]: r["reason"] for r in badrows.reasons(run(spark, lines)).collect()}
    assert got == {i: reason(x) for i, x in enumerate(lines) if reason(x)}
