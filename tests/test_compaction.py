"""Problem 4: groups, exact once, pairs, and edge cases."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import pytest

from tilefold.operators import compaction

SCHEMA = "file_id bigint, sha256 string, len bigint, group_no string, sha string, part int"


def brute(rows):
    held = defaultdict(list)
    for r in rows:
        if r["sha256"] is not None and r["len"]:
            held[r["sha256"].strip(" ").lower(), r["len"]].append(r["file_id"])
    return held


def key(sha):
    return bytes.fromhex(sha) if len(sha) == 64 and set(sha) <= set("0123456789abcdef") else bytes(33) + sha.encode()


def check(spark, df, target):
    held = brute(df.collect())
    planned = compaction.plan(compaction.frozen_manifest(df, 3), target)
    rows = sorted(planned.collect(), key=lambda r: r["start"])
    held = {(key(s), n): ids for (s, n), ids in held.items()}
    stands = {k: min((i for i in ids if i is not None), default=None) for k, ids in held.items()}
    assert sorted((str(r["file_id"]), r["len"]) for r in rows) == sorted((str(i), n) for (_, n), i in stands.items())
    assert {(bytes(r["key"]), r["len"]) for r in rows if r["key"]} == {k for k, ids in held.items() if len(ids) > 1 or stands[k] is None}
    copies = {(stands[k], k[1]): len(ids) for k, ids in held.items()}
    start = 0
    for r in rows:
        assert r["start"] == start and r["group_no"] == start // target and r["copies"] == (copies[r["file_id"], r["len"]] if r["file_id"] is not None else len(held[bytes(r["key"]), r["len"]]))
        start += r["len"]
    pairs = {tuple(sorted(p)) for ids in held.values() for p in combinations([i for i in ids if i is not None], 2)}
    got = [tuple(r) for r in compaction.same_record_pairs(df, planned).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    return planned


def test_whole_table(spark, small):
    df = spark.read.parquet(f"{small}/block_meta.parquet")
    planned = check(spark, df, 100_000)
    path = compaction.rewrite(df, planned)
    report = compaction.reconcile(planned, path).collect()
    assert report and all(r["agree"] and r["files"] == 1 for r in report)
    back = spark.read.parquet(path)
    assert back.count() == planned.count() == back.select("row.file_id").distinct().count()
    assert back.select("row.*").columns == df.columns and back.select("row.*").exceptAll(df).isEmpty()
    assert len({r["group_no"] for r in report}) == len([p for p in back.inputFiles()])


ROWS = [
    (1, "AB ", 10, "g", "s", 1), (2, " ab", 10, "g", "s", 1), (3, "ab", 11, None, None, None), (4, None, 5, None, None, None), (5, "cd", None, None, None, None),
    (6, "cd", 0, None, None, None), (7, "", 3, None, None, None), (8, "ef", 10_000, None, None, None), (9, "ab", 10, None, None, None), (None, "ab", 10, None, None, None),
    (None, "zz", 4, None, None, None), (10, "x" * 200_000, 7, None, None, None),
]


def test_edge_cases(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    planned = check(spark, df, 20)
    path = compaction.rewrite(df, planned)
    assert all(r["agree"] for r in compaction.reconcile(planned, path).collect())
    kept = {r["file_id"]: r["group_no"] for r in spark.read.parquet(path).select("row.*").collect()}
    assert kept[1] == "g" and 8 in kept and 2 not in kept and None in kept
    joined = compaction.rewrite(df, planned, most_bounds=0)
    assert all(r["agree"] for r in compaction.reconcile(planned, joined).collect())


def test_large_records_and_repeated_rows(spark):
    rows = [(i, f"{i:064x}", 10**9 if i % 3 == 0 else 3, None, None, None) for i in range(12)] + [(1, f"{1:064X}", 3, None, None, None), (20, "neg", -5, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    planned = compaction.plan(compaction.frozen_manifest(df, 3), 20)
    path = compaction.rewrite(df, planned)
    assert all(r["agree"] for r in compaction.reconcile(planned, path).collect()) and spark.read.parquet(path).count() == 13


def test_hot_record_in_slices(spark, monkeypatch):
    monkeypatch.setattr(compaction, "COPIES_PER_SALT", 7)
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i // 2}", 5, None, None, None) for i in range(90)], SCHEMA)
    check(spark, df, 50)


def test_only_null_ids(spark):
    df = spark.createDataFrame([(None, "a", 1, None, None, None)] * 3, SCHEMA)
    planned = check(spark, df, 20)
    assert [r["copies"] for r in planned.collect()] == [3]
    assert all(r["agree"] for r in compaction.reconcile(planned, compaction.rewrite(df, planned)).collect())


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert check(spark, df, 20).count() == 0


def test_pairs_come_from_a_reconciled_rewrite(spark, small, monkeypatch):
    from tilefold.plans import problem_queries

    done = []
    true = compaction.reconcile
    monkeypatch.setattr(compaction, "reconcile", lambda planned, path: done.append(path) or true(planned, path))
    problem_queries.p4_found(spark, small)
    assert done and spark.read.parquet(done[0]).count() > 0
    monkeypatch.setattr(compaction, "reconcile", lambda planned, path: true(planned.filter("file_id % 2 = 0"), path))
    with pytest.raises(RuntimeError):
        problem_queries.p4_found(spark, small)
