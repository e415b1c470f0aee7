"""Problem 2 against plain counting, and its edge cases."""

from __future__ import annotations

from collections import defaultdict

from tilefold.operators import features

SCHEMA = "line_id bigint, t bigint, received_at timestamp, event string, session string, saved bigint, block_0 string, n int"


def brute(rows):
    seen, cells, entities = set(), defaultdict(lambda: [0, None, 0]), set()
    for r in sorted(rows, key=lambda r: (r["received_at"] is not None, str(r["received_at"]))):
        if r["line_id"] is not None and r["line_id"] in seen:
            continue
        seen.add(r["line_id"])
        s = (r["session"] or "").strip(" \t")
        e = (r["event"] or "").strip(" \t").lower()
        if not s:
            continue
        entities.add(s)
        if not e:
            continue
        c = cells[s, e]
        c[0] += 1
        t = r["t"]
        if t is not None:
            t = t * 1000 if abs(t) < 10**11 else t // 1000 if abs(t) > 10**14 else t
            c[1] = t if c[1] is None else max(c[1], t)
        c[2] += r["saved"] or 0
    return {k: tuple(v) for k, v in cells.items()}, entities


def check(df, **how):
    f = features.feature_blocks(df, **how)
    want, entities = brute(df.collect())
    got = {(r["session"], r["event"]): (r["n"], r["last_t"], r["total_saved"]) for r in features.filled(f).collect()}
    assert got == want
    sessions = [r["session"] for r in f.select("session").collect()]
    assert len(sessions) == len(set(sessions)) and set(sessions) == entities
    return f


def test_whole_table(spark, small):
    check(spark.read.parquet(f"{small}/metrics.parquet"))


ROWS = [
    (1, 1924992000000, None, "Compress ", " a\t", 5, "x", 1),
    (1, 1924992000000, None, "Compress ", " a\t", 5, "x", 1),
    (2, 1924992009, None, "compress", "a", None, "x", 1),
    (3, None, None, "gc", "a", -7, None, None),
    (4, 5_000_000_000_000_000, None, "gc", "b", 1, None, None),
    (None, 1924992000001, None, "gc", "b", 1, None, None),
    (None, 1924992000001, None, "gc", "b", 1, None, None),
    (5, 1, None, None, "only entity", 1, None, None),
    (6, 1, None, " \t", "only entity", 1, None, None),
    (7, 1, None, "gc", " ", 1, None, None),
    (8, 1, None, "gc", None, 1, None, None),
    (9, None, None, "e" * 100_000, "s" * 100_000, None, None, None),
]


def test_edge_cases(spark):
    check(spark.createDataFrame(ROWS, SCHEMA), n_blocks=3, n_buckets=2)


def test_empty(spark):
    check(spark.createDataFrame([], SCHEMA))


def test_wide(spark):
    f = features.feature_blocks(spark.createDataFrame(ROWS, SCHEMA))
    got = {r["session"]: r for r in features.wide(f, ["compress", "gc", "absent"]).collect()}
    a = got["a"]
    assert (a["n_compress"], a["last_compress"], a["saved_compress"], a["n_absent"], a["last_absent"]) == (2, 1924992009000, 5, 0, None)
    assert got["only entity"]["n_gc"] == 0


def test_blocks_join_without_shuffle(spark, small):
    f = features.feature_blocks(spark.read.parquet(f"{small}/metrics.parquet"))
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")


def test_table_has_every_event_type(spark, small):
    from tilefold.plans import problem_queries

    queries = problem_queries.QUERIES
    table = queries["p2_table"](spark, small)
    cells = features.cells(spark.read.parquet(f"{small}/metrics.parquet"))
    kinds = {r[0] for r in cells.filter("event is not null").select("event").distinct().collect()}
    assert {r[0] for r in features.filled(table).select("event").distinct().collect()} == kinds and len(kinds) > 2
    assert table.count() == cells.select("session").distinct().count()


def test_no_table_is_left_in_the_catalog(spark, small):
    out = features.feature_blocks(spark.read.parquet(f"{small}/metrics.parquet"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tilefold_cells")] and out.count() > 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_discard(spark):
    from tilefold.session import _own_folder, discard, written

    kept = written(spark.range(3).toDF("i"), "kept")
    files, path, _ = _own_folder(spark)
    assert kept.count() == 3 and files.exists(path)
    discard(spark)
    assert not files.exists(path) and written(spark.range(2).toDF("i"), "again").count() == 2
