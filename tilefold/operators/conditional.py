"""Views of a text relative to what its session has been shown: residency, runs, back-references and guards.

Only handles travel to the place where a session's past is looked up; the texts stay with their rows until the statuses
come back by key. A block is resident if an earlier step of the session holds it, or if its first occurrence in this
text stands before the last resident block before it, since blocks are noted when their run ends. The past of all steps
is one minimum per (session, handle), no fold over the session; with a budget, whose evictions make steps depend on one
another, ``session_fold`` replays the ledger.

A packed row names what its view needs for recall: ``stored`` are the blocks, the elided ranges and the runs behind
back-references, each (handle, text); every handle that a view prints is among them.

Defined results: rows with a null session are one session. A null text has no block and an empty view. Steps equal
within a session see each other's blocks as new. Ids must be unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilefold.config import DEFAULT_BUDGET, LABEL
from tilefold.functions.handles import handle
from tilefold.functions.text import count_lines, let, tokens
from tilefold.operators import structural, tiles
from tilefold.session import written

KNOWN = "array<struct<known:boolean,resent:boolean>>"


def block_rows(texts: DataFrame, weigh: bool = True) -> DataFrame:
    """(session, step, id, block_no, handle, tokens) of (id, session, step, text, content_type), narrow.

    Only a ledger asks for ``tokens``; without ``weigh`` they are left out.
    """
    parts = tiles.blocks(F.col("text"), F.col("content_type"))
    each = F.transform(parts, lambda b: F.struct(handle(b).alias("handle"), *([tokens(b).alias("tokens")] if weigh else [])))
    out = texts.select("session", "step", "id", F.posexplode(each).alias("block_no", "_b"))
    return out.select("session", "step", "id", "block_no", "_b.*")


def residency(blocks: DataFrame, ledger: DataFrame | None = None, proof: DataFrame | None = None) -> DataFrame:
    """``blocks`` with ``seen``, ``gated``, ``barred`` and ``evicted``.

    ``seen``: resident before this step, and not barred. ``barred``: the session's transcript does not prove the handle, so
    it is sent again however often it was; ``gated``: it would be resident but for that. ``evicted``: the ledger holds it
    as evicted, and no step of the session before this one has shown it again.

    ``blocks`` must be stable between uses. ``ledger`` (session, handle, code) is the state before the first step.
    ``proof`` has (session, ok, handle) rows; a session with ok = false, or without rows, is not gated; one that proves
    nothing has a row with a null handle.
    """
    first = blocks.groupBy("session", "handle").agg(F.min("step").alias("first_step"))
    code = F.lit(None).cast("int")
    if ledger is not None:
        held = ledger.groupBy(F.col("session").alias("_s"), F.col("handle").alias("_h")).agg(F.min("code").alias("_code"))
        first = first.join(held, F.col("session").eqNullSafe(F.col("_s")) & (F.col("handle") == F.col("_h")), "left").drop("_s", "_h")
        code = F.col("_code")
    first = first.withColumns({"_held": F.coalesce(code == 0, F.lit(False)), "_gone": F.coalesce(code == 1, F.lit(False))})
    right = first.select(F.col("session").alias("_s"), F.col("handle").alias("_h"), "first_step", "_held", "_gone")
    out = blocks.join(right, F.col("session").eqNullSafe(F.col("_s")) & (F.col("handle") == F.col("_h"))).drop("_s", "_h")
    before = F.col("first_step") < F.col("step")
    out = out.withColumns({"_resident": F.col("_held") | before, "evicted": F.col("_gone") & ~before})
    barred = F.lit(False)
    if proof is not None:
        gate = proof.groupBy(F.col("session").alias("_s")).agg(F.bool_and("ok").alias("_gate"))
        shown = proof.select(F.col("session").alias("_ps"), F.col("handle").alias("_ph")).distinct().withColumn("_proof", F.lit(True))
        out = out.join(gate, F.col("session").eqNullSafe(F.col("_s")), "left")
        out = out.join(shown, F.col("session").eqNullSafe(F.col("_ps")) & (F.col("handle") == F.col("_ph")), "left")
        barred = F.coalesce("_gate", F.lit(False)) & F.col("_proof").isNull()
    out = out.withColumn("barred", barred)
    out = out.withColumns({"gated": F.col("_resident") & F.col("barred"), "seen": F.col("_resident") & ~F.col("barred")})
    return out.select(*blocks.columns, "seen", "gated", "barred", "evicted")


def statuses(resident: DataFrame) -> DataFrame:
    """Per id the array ``_b`` of (block_no, seen, handle, gated, barred, evicted) in order; in-text repeats not yet in."""
    packed = F.array_sort(F.collect_list(F.struct("block_no", "seen", "handle", "gated", "barred", "evicted")))
    return resident.groupBy("id").agg(packed.alias("_b"))


def fold_repeats(b: Column) -> Column:
    """Per block of an array as of ``statuses``: (known, resent).

    The state is the index of the last resident block; a repeat is in the ledger once its first occurrence lies before it.
    A text without repeats needs no fold.
    """
    start = F.struct(F.lit(-1).alias("last"), F.array().cast(KNOWN).alias("out"))
    final = lambda known, x, held: F.struct(known.alias("known"), ((held & x["barred"]) | (~held & x["evicted"])).alias("resent"))

    def fold(handles: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            held = x["seen"] | x["gated"] | (F.array_position(handles, x["handle"]) - 1 < acc["last"])
            return let(
                final(held & ~x["barred"], x, held),
                lambda k: F.struct(F.when(k["known"], x["block_no"]).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], F.array(k)).alias("out")),
            )

        repeated = F.size(F.array_distinct(handles)) < F.size(handles)
        once = F.transform(b, lambda x: final(x["seen"], x, x["seen"] | x["gated"]))
        return F.when(repeated, F.aggregate(b, start, step, lambda acc: acc["out"])).otherwise(once)

    return let(F.transform(b, lambda x: x["handle"]), fold)


def run_bounds(known: Column) -> Column:
    """Array of (first, n, known) of the runs of equal status of the column ``known``."""
    n = F.size(known)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(known, i) != F.get(known, F.greatest(i - 1, F.lit(0)))))

    def rows(ss: Column) -> Column:
        return F.transform(
            ss, lambda s, k: F.struct(s.alias("first"), (F.coalesce(F.get(ss, k + 1), n) - s).alias("n"), F.get(known, s).alias("known"))
        )

    return F.when(n > 0, let(starts, rows)).otherwise(F.array())


def reference_marker(text: Column) -> Column:
    return F.concat(F.format_string(f"[{LABEL}: %d lines unchanged · recall ", count_lines(text)), handle(text), F.lit("]"))


def guarded(packed: DataFrame) -> DataFrame:
    """Choose the smallest of conditional, stateless and raw view; the counters hold only if the delta is shown.

    Takes ``conditional``, ``stateless``, ``text``, ``runs``, ``delta_hits``, ``evicted_resends``.
    """
    many = F.col("runs") > 1  # a single run is its own stateless view
    out = packed.withColumns({"_c": tokens(F.col("conditional")), "_s": F.when(many, tokens(F.col("stateless"))), "raw_tokens": tokens(F.col("text"))})
    use_stateless = many & (F.col("_s") < F.col("_c"))
    best = F.when(use_stateless, F.col("_s")).otherwise(F.col("_c"))
    choice = F.when(best > F.col("raw_tokens"), F.lit("raw")).when(use_stateless, F.lit("stateless")).otherwise(F.lit("conditional"))
    out = out.withColumns({"choice": choice, "shown_tokens": F.least(best, F.col("raw_tokens"))})
    view = F.when(F.col("choice") == "raw", F.col("text")).when(F.col("choice") == "stateless", F.col("stateless")).otherwise(F.col("conditional"))
    kept = {x: F.when(F.col("choice") == "conditional", F.col(x)).otherwise(F.lit(0)).cast("bigint") for x in ("delta_hits", "evicted_resends")}
    return out.withColumns({"view": view, "saved_tokens": F.col("raw_tokens") - F.col("shown_tokens"), **kept})


PACKED = ("id", "session", "step", "view", "choice", "raw_tokens", "shown_tokens", "saved_tokens", "delta_hits", "evicted_resends", "blocks", "runs", "handles", "stored")


def pack(texts: DataFrame, ledger: DataFrame | None = None, proof: DataFrame | None = None) -> DataFrame:
    """One packed view per row of (id, session, step, text, content_type), without a budget.

    Gives id, session, step, view, choice, raw_tokens, shown_tokens, saved_tokens, delta_hits, evicted_resends, blocks,
    runs, handles (of all that is stored for the row) and stored (handle, text). The narrow blocks are written once.
    """
    texts = texts.select("id", "session", "step", F.coalesce("text", F.lit("")).alias("text"), "content_type")
    return pack_blocks(texts, written(block_rows(texts, weigh=False), "blocks"), ledger, proof)


def pack_blocks(texts: DataFrame, blocks: DataFrame, ledger: DataFrame | None = None, proof: DataFrame | None = None) -> DataFrame:
    """``pack`` of texts whose ``block_rows`` are there already."""
    found = statuses(residency(blocks, ledger, proof)).withColumn("_s", fold_repeats(F.col("_b")))
    known = found.select("id", F.transform("_s", lambda x: x["known"]).alias("_k"), F.size(F.filter("_s", lambda x: x["resent"])).cast("bigint").alias("resent"))
    return view_packed(texts.join(known, "id", "left"), F.col("_k")).select(*PACKED)


def view_packed(joined: DataFrame, known: Column) -> DataFrame:
    """Views of rows that carry their text, ``resent`` (a number of blocks) and the array of statuses ``known``."""
    parts = tiles.blocks(F.col("text"), F.col("content_type"))
    rows = joined.withColumns({"_known": F.coalesce(known, F.array().cast("array<boolean>")), "_parts": parts}).withColumn("_runs", run_bounds(F.col("_known")))
    rows = rows.withColumn("_texts", F.transform("_runs", lambda r: F.struct(r["known"].alias("known"), F.array_join(F.slice(F.col("_parts"), r["first"] + 1, r["n"]), "").alias("text"))))

    # the whole text stands before its runs, so each kind of view is one expression; a single run needs no other view
    many = F.size("_runs") > 1
    whole = F.array(F.struct(F.lit(False).alias("known"), F.col("text").alias("text")))
    rows = rows.withColumn("_todo", F.when(many, F.concat(whole, F.col("_texts"))).otherwise(F.col("_texts")))
    # an Arrow function cannot stand inside a lambda, so the runs of a JSON text get their views together
    json = F.col("content_type") == "json"
    new_runs = F.transform("_todo", lambda r: F.when(~r["known"], r["text"]))
    rows = rows.withColumn("_json", structural.json_views(F.when(json, new_runs)))

    def shown(r: Column, i: Column) -> Column:
        fresh = F.when(json, F.get("_json", i)).otherwise(structural.line_view(r["text"], F.col("content_type")))
        named = F.struct(reference_marker(r["text"]).alias("view"), F.array(F.struct(handle(r["text"]).alias("handle"), r["text"].alias("text"))).alias("elided"))
        return F.when(r["known"], named).otherwise(fresh)

    rows = rows.withColumn("_shown", F.transform("_todo", shown))
    of_runs = F.when(many, F.slice("_shown", 2, F.size("_runs"))).otherwise(F.col("_shown"))
    rows = rows.withColumn("conditional", F.array_join(F.transform(of_runs, lambda x: x["view"]), "\n"))
    rows = rows.withColumns(
        {
            "stateless": F.when(many, F.get("_shown", F.lit(0))["view"]).otherwise(F.col("conditional")),
            "runs": F.size("_runs"),
            "blocks": F.size("_parts"),
            "delta_hits": F.size(F.filter("_known", lambda x: x)),
            "evicted_resends": F.coalesce("resent", F.lit(0)),
        }
    )
    out = guarded(rows)
    # new blocks and what the runs' views stand for are stored whatever view is shown; a stateless view adds its own
    new_blocks = F.transform(F.filter(F.col("_parts"), lambda _, i: ~F.get("_known", i)), lambda t: F.struct(handle(t).alias("handle"), t.alias("text")))
    gone = F.flatten(F.transform(of_runs, lambda x: x["elided"]))
    own = F.when(many & (F.col("choice") == "stateless"), F.get("_shown", F.lit(0))["elided"]).otherwise(F.array().cast(structural.GONE))
    out = out.withColumn("stored", F.array_distinct(F.concat(new_blocks, gone, own)))
    return out.withColumn("handles", F.transform("stored", lambda x: x["handle"]))


def stored_rows(packed: DataFrame) -> DataFrame:
    """(seq, session, bytes) of what the packed rows store, for ``store.put``; earlier steps come first."""
    each = packed.select(F.struct("step", "id").alias("seq"), "session", F.explode("stored").alias("_x"))
    return each.select("seq", "session", F.encode("_x.text", "UTF-8").alias("bytes"))


def reconstruct(texts: DataFrame, store: DataFrame) -> DataFrame:
    """(id, restored, restored_bytes): each text put together again from stored blocks; null if any is missing."""
    blocks = block_rows(texts, weigh=False)
    have = blocks.join(store.select("handle", F.col("bytes").alias("_x")), "handle", "left")
    # one character per byte, so that the joined text is the joined bytes whatever they are
    parts = F.array_sort(F.collect_list(F.struct("block_no", tiles.latin(F.col("_x")).alias("_x"))))
    whole = have.groupBy("id").agg(parts.alias("p"), F.count_if(F.col("_x").isNull()).alias("missing"))
    joined = F.when(F.col("missing") == 0, F.encode(F.array_join(F.transform("p", lambda x: x["_x"]), ""), "ISO-8859-1"))
    return whole.select("id", joined.alias("restored_bytes")).select("id", F.col("restored_bytes").cast("string").alias("restored"), "restored_bytes")


_FOLD = "id bigint, known array<boolean>, evicted_resends bigint, evicted bigint, resident_tokens bigint"


class Ledger:
    """A session's ledger for the replay: handle to [code, step, tokens], the resident total, and a heap of the oldest.

    ``evicted`` handles are kept as they mark a re-send. An entry of the heap counts only while it still describes its
    handle, so noting and evicting cost a logarithm each, whatever the session has seen.
    """

    def __init__(self, entries: dict | None = None) -> None:
        self.entries: dict = entries or {}
        self.live = sum(e[2] for e in self.entries.values() if e[0] == 0)
        self.oldest = [(e[1], h) for h, e in self.entries.items() if e[0] == 0]
        heapify(self.oldest)

    def note(self, h: str, step: int, weight: int) -> None:
        old = self.entries.get(h)
        if old is not None and old[0] == 0:
            self.live -= old[2]
        self.entries[h] = [0, step, weight]
        self.live += weight
        heappush(self.oldest, (step, h))

    def enforce(self, budget: int) -> int:
        """Evict the oldest (step, handle) until the rest is within the budget; gives their number."""
        gone = 0
        while self.live > budget and self.oldest:
            step, h = heappop(self.oldest)
            e = self.entries[h]
            if e[0] == 0 and e[1] == step:
                e[0] = 1
                self.live -= e[2]
                gone += 1
        return gone


def fold_session(ledger: Ledger, steps: Iterator[tuple[int, int, list[str], list[int]]], budget: int) -> Iterator[tuple]:
    """Replay steps (id, step, handles, tokens) on ``ledger`` with eviction after each: (id, known, resent, evicted, live)."""
    for ident, step, handles, weights in steps:
        known, resends, waiting = [], 0, []
        for h, w in zip(handles, weights):
            entry = ledger.entries.get(h)
            if entry is not None and entry[0] == 0:
                for x, y in waiting:
                    ledger.note(x, step, y)
                waiting = []
                known.append(True)
                continue
            resends += entry is not None and entry[0] == 1
            known.append(False)
            waiting.append((h, w))
        for x, y in waiting:
            ledger.note(x, step, y)
        gone = ledger.enforce(budget)
        yield ident, known, resends, gone, ledger.live


def session_fold(texts: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """``pack`` with a token budget per session: evicted blocks are sent again and counted.

    A step depends on all evictions before it, so the handles of one session (not its texts) are replayed in order by
    one task; sessions are replayed side by side.
    """
    texts = texts.select("id", "session", "step", F.coalesce("text", F.lit("")).alias("text"), "content_type")
    parts = F.transform(tiles.blocks(F.col("text"), F.col("content_type")), lambda b: F.struct(handle(b).alias("h"), tokens(b).alias("w")))
    narrow = texts.select("session", "step", "id", parts.alias("b")).select(
        "session", "step", "id", F.transform("b", lambda x: x["h"]).alias("handles"), F.transform("b", lambda x: x["w"]).alias("weights")
    )

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["step", "id"], kind="stable")
        steps = zip(pdf["id"], pdf["step"], pdf["handles"], pdf["weights"])
        return pd.DataFrame(list(fold_session(Ledger(), steps, budget)), columns=["id", "known", "evicted_resends", "evicted", "resident_tokens"])

    folded = narrow.groupBy("session").applyInPandas(replay, _FOLD).withColumnRenamed("evicted_resends", "resent")
    return view_packed(texts.join(folded, "id"), F.col("known")).select(
        "id", "session", "step", "view", "choice", "raw_tokens", "shown_tokens", "saved_tokens", "delta_hits", "evicted_resends", "blocks", "runs", "evicted", "resident_tokens", "handles", "stored"
    )
