"""Streaming forms: savings as a running aggregate, and packing with the ledger as keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilefold.config import DEFAULT_BUDGET
from tilefold.functions.handles import handle
from tilefold.functions.text import tokens
from tilefold.operators import conditional, savings, tiles


def running_savings(lines: DataFrame) -> DataFrame:
    """The savings report of a stream of metrics lines so far, for output mode update or complete.

    State is one row of sums per session.
    """
    return savings.sessions(lines)


def windowed_savings(lines: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Savings per session and window of arrival, for output mode append: each window once, when it is complete.

    A line delivered again within ``delay`` of its first delivery counts once; ``delay`` bounds the state of seen ids. Ids
    are numbers inside a ``file``, if there is such a column; lines with a null id all count.
    """
    c = F.col("event").eqNullSafe("compress")
    timed = lines.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", delay)
    keys = [k for k in ("file", "line_id") if k in lines.columns]
    once = timed.filter("line_id is not null").dropDuplicatesWithinWatermark(keys).unionByName(timed.filter("line_id is null"))
    w = once.groupBy(F.window("received_at", window), F.coalesce("session", F.lit(savings.NO_SESSION)).alias("session"))
    out = w.agg(F.count_if(c).alias("compress_events"), F.coalesce(F.sum(F.when(c, F.coalesce("saved", F.col("raw") - F.col("shown")))), F.lit(0)).alias("saved"))
    return out.select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), "session", "compress_events", "saved")


_OUT = "session string, id bigint, step bigint, known array<boolean>, evicted_resends bigint, evicted bigint, resident_tokens bigint"


def residency_stream(texts: DataFrame, budget: int = DEFAULT_BUDGET, idle: str | None = None, forget_after: int = 10_000) -> DataFrame:
    """Residency of each block of a stream of (id, session, step, text, content_type), in steps order inside a batch.

    State is one ledger per session: what is resident within the budget, and what was evicted less than ``forget_after``
    steps ago, so it does not grow with the stream (a block that was forgotten is new, not a re-send, when it comes again).
    With ``idle`` it is dropped after so long without input (for
    streams that run on, as each trigger then also looks for idle sessions). Only handles reach the state function; views
    come from joining its output with the texts (``conditional.view_packed``).
    """
    parts = F.transform(tiles.blocks(F.col("text"), F.col("content_type")), lambda b: F.struct(handle(b).alias("h"), tokens(b).alias("w")))
    narrow = texts.select(F.coalesce("session", F.lit("")).alias("session"), "step", "id", parts.alias("b")).select(
        "session", "step", "id", F.transform("b", lambda x: x["h"]).alias("handles"), F.transform("b", lambda x: x["w"]).alias("weights")
    )
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ledger = conditional.Ledger(pickle.loads(state.get[0]) if state.exists else {})
        pdf = pd.concat(list(batches)).sort_values(["step", "id"], kind="stable")
        steps = list(zip(pdf["id"], pdf["step"], pdf["handles"], pdf["weights"]))
        rows = [(key[0], i, s[1], *r) for s, (i, *r) in zip(steps, conditional.fold_session(ledger, iter(steps), budget))]
        last = int(pdf["step"].max())
        state.update((pickle.dumps({h: e for h, e in ledger.entries.items() if e[0] == 0 or e[1] > last - forget_after}),))
        if wait:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])

    return narrow.groupBy("session").applyInPandasWithState(fold, _OUT, "ledger binary", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
