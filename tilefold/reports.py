"""Texts of the reports, from a few collected rows.

Only ``limit`` rows of a ranking reach the driver; what stands behind them is one more row with their number and sums, so
a report always adds up to its total.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tilefold.config import LABEL
from tilefold.functions import text as T
from tilefold.operators import decisions, savings

VERDICTS = {
    "none": "nothing measured so far",
    "positive": "saves more tokens than recalls cost",
    "negative": "recalls cost as much as is saved, or more",
}
COUNTS = ("compress_events", "expand_calls", "failed_expands", "raw", "saved", "refetched", "net", "delta_hits", "evicted")
COLUMNS = {"session": "session", "net": "net", "saved": "saved", "refetched": "recalled", "raw": "read", "delta_hits": "unchanged", "evicted": "resent", "expand_calls": "recalls", "failed_expands": "missed"}


def _cut(s: str, n: int) -> str:
    return s if len(s) <= n else s[: n - 1] + "…"


def _table(rows: list[list[str]]) -> list[str]:
    """Columns as wide as their widest cell, the first to the left."""
    widths = [max(map(len, cells)) for cells in zip(*rows)]
    return ["  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(row, widths))).rstrip() for row in rows]


def _cells(r: Row | dict, name: str) -> list[str]:
    return [_cut(name, 24), *(f"{r[k]:,}" for k in list(COLUMNS)[1:])]


def savings_report(lines: DataFrame, limit: int = 1000) -> str:
    """The ranked table of sessions: the best ``limit`` by name, all others in one row, and the grand total."""
    per = savings.sessions(lines, total=True).persist()
    try:
        top = savings.ranked(per.filter("session is not null")).limit(limit).collect()
        whole = per.filter("session is null").first()
        n = per.count() - (whole is not None)
    finally:
        per.unpersist()
    if whole is None:
        return f"{LABEL}: savings by session\n\n(no sessions)\n\n{VERDICTS['none']}"
    table = [list(COLUMNS.values()), *(_cells(r, r["session"]) for r in top)]
    if n > len(top):
        rest = {k: whole[k] - sum(r[k] for r in top) for k in COUNTS}
        table.append(_cells(rest, f"({n - len(top):,} more)"))
    table.append(_cells(whole, "all sessions"))
    return "\n".join([f"{LABEL}: savings by session", "", *_table(table), "", VERDICTS[whole["verdict"]]])


def summary_report(lines: DataFrame, session: str | None = None) -> str:
    r = savings.summary(lines, session).first()
    verdict = "none" if r["compress_events"] == 0 else "positive" if r["net"] > 0 else "negative"
    rows = [[k.replace("_", " "), f"{r[k]:,}"] for k in r.asDict()]
    return "\n".join([f"{LABEL}: totals" + (f" of {session}" if session is not None else ""), *_table(rows), VERDICTS[verdict]])


def status_report(lines: DataFrame, store_size: DataFrame) -> str:
    """The latest session beside all of them, and the size of the store, (blocks, bytes)."""
    size = store_size.select(*(F.col(c).alias(f"store_{c}") for c in ("blocks", "bytes")))
    r = savings.status(lines, size).withColumn("_size", T.human_bytes(F.coalesce("store_bytes", F.lit(0)))).first()
    if r is None:
        return f"{LABEL}: {VERDICTS['none']}"
    out = [f"{LABEL}: status"]
    if r["latest_session"] is not None:
        s = savings.sessions(lines.filter(F.col("session") == r["latest_session"])).first()
        pct = "" if s["reduction_pct"] is None else f", {s['reduction_pct']} % of what it read"
        out.append(f"latest session {_cut(r['latest_session'], 40)}: net {s['net']:,} tokens{pct}, {s['expand_calls']:,} recalls")
    pct = "" if r["reduction_pct"] is None else f", {r['reduction_pct']} %"
    out.append(f"all {r['n_sessions']:,} sessions: net {r['net']:,} of {r['raw']:,} tokens{pct}")
    out.append(f"store: {r['store_blocks'] or 0:,} blocks, {r['_size']}")
    return "\n".join([*out, VERDICTS[r["verdict"]]])


def decisions_report(log: DataFrame, n: int = 10) -> str:
    """The last ``n`` decisions in log order, one line each."""
    rows = decisions.tail(log, n).collect()
    table = [
        [
            datetime.fromtimestamp(r["t"], UTC).strftime("%Y-%m-%d %H:%M:%S"), r["reason"], _cut(r["path"] or "-", 60),
            "-" if r["bytes"] is None else f"{r['bytes']:,} B",
            "-" if r["raw_tokens"] is None or r["view_tokens"] is None else f"{r['raw_tokens']:,} to {r['view_tokens']:,} tokens",
        ]
        for r in rows
    ]
    return "\n".join([f"{LABEL}: last decisions on reads", *(_table(table) if table else ["(none)"])])


def retention_report(report: DataFrame, older_than: int) -> str:
    r = report.first()
    rows = [[k.replace("_", " "), f"{r[k]:,}"] for k in r.asDict() if k != "dry_run"]
    kind = "dry run, nothing is deleted" if r["dry_run"] else "deleted"
    return "\n".join([f"{LABEL}: what is older than {older_than:,} seconds ({kind})", *_table(rows)])


def transcript_report(scan: DataFrame, session: str) -> str:
    r = scan.filter(scan["session"] == session).first()
    if r is None or not r["ok"]:
        return f"{LABEL}: the transcript of {session} cannot be read; residency follows the ledger alone"
    at = "no boundary" if r["last_boundary"] is None else f"last boundary {r['last_boundary']} at line {r['boundary_line']}"
    shown = r["sample"].split() if r["sample"] else []
    more = r["n_resident"] - len(shown)
    out = [f"{LABEL}: transcript of {session}", f"{r['n_lines']:,} lines, {at}, {r['n_resident']:,} handles after it"]
    return "\n".join(out + [f"  {h}" for h in shown] + ([f"  and {more:,} more"] if more > 0 else []))
