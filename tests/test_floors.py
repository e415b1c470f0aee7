"""Published reduction figures and floors as tests: the delta wins where little changes and costs nothing elsewhere."""

from __future__ import annotations

import random

import pytest

from tilefold.operators import conditional
from tilefold.plans.log_queries import bench_loop

TEXTS = "id bigint, session string, step bigint, text string, content_type string"


def module(edited=()):
    return "".join(f"def handler_{i}(request, options):\n" + "".join(f"    value_{j} = compute(request, {j + (100 if i in edited else 0)})\n" for j in range(9)) + "    return value_0\n\n" for i in range(30))


def run_log(turn):
    head = f"   Compiling service v0.1.{turn}\n    Finished test profile\n     Running unittests src/lib.rs\n\nrunning 60 tests\n"
    return head + "".join(f"test suite::case_number_{i} ... {'FAILED' if i == turn else 'ok'}\n" for i in range(60)) + "\ntest result: done\n"


SCENARIOS = {
    "edit": [("log", run_log(t)) for t in range(10)],
    "stable": [("code", module())] * 6,
    "growing": [("log", "".join(f"[INFO] 2026-05-25 event {i} processed id={i * 3} status=ok\n" for i in range(40 * (t + 1)))) for t in range(8)],
    "rotating": [("log", "".join(f"setting_{i} = {t * 1000 + i if i % 10 == t % 10 else i}\n" for i in range(200))) for t in range(8)],
    "cold": [("code", module())],
    "churn": [("log", "".join(f"GET /r/{random.Random(100 * t + i).random()} 200\n" for i in range(100))) for t in range(6)],
    "tiny": [("log", "ok\n"), ("log", "ok\n")],
}


@pytest.fixture(scope="module")
def totals(spark):
    rows = [(1000 * k + i, name, i, text, kind) for k, (name, turns) in enumerate(SCENARIOS.items()) for i, (kind, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, TEXTS)
    alone = {r["id"]: r for r in conditional.pack(df.withColumn("session", df["id"].cast("string"))).collect()}
    out = {name: [0, 0, 0] for name in SCENARIOS}
    for r in conditional.pack(df).collect():
        for i, x in enumerate((r["raw_tokens"], alone[r["id"]]["shown_tokens"], r["shown_tokens"])):
            out[r["session"]][i] += x
        assert r["shown_tokens"] <= alone[r["id"]]["shown_tokens"] <= r["raw_tokens"]
    return out


@pytest.mark.parametrize("name, floor", [("edit", 70), ("stable", 85), ("growing", 50)])
def test_reduction(totals, name, floor):
    raw, alone, shown = totals[name]
    assert 100 - shown * 100 / raw >= floor
    assert shown < alone or (name == "growing" and shown == alone)


def test_combined(totals):
    raw, shown = (sum(totals[n][i] for n in ("edit", "stable")) for i in (0, 2))
    assert 100 - shown * 100 / raw >= 75


@pytest.mark.parametrize("name", ["cold", "churn"])
def test_no_overhead_without_delta(totals, name):
    assert totals[name][1] == totals[name][2]


def test_edit_loop_total(spark, small):
    rows = bench_loop(spark, small).collect()
    raw, alone, shown = (sum(r[c] for r in rows) for c in ("raw", "stateless", "conditional"))
    assert shown == 4377 and 100 * shown / raw < 8.5 and shown < alone / 4
