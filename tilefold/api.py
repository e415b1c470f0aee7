"""The public functions: pack outputs, expand handles, redirect reads, mark residency, evict, over tables in folders.

Tables live under ``EngineConfig.root``. The state is the greatest complete version of the ledger. A call writes its rows
into folders of the next version and the ledger last, so a call that fails leaves the former state: what it had written
is read by nobody, and the next call of that version writes over it. Blocks are the exception, as a block that nothing
names does no harm; their metadata is written first and the first writer of each handle counts.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tilefold.config import EngineConfig
from tilefold.functions.handles import cache_key, handle, shard, sha256_hex
from tilefold.functions.predicates import detect
from tilefold.functions.text import as_text, tokens, tokens_bytes
from tilefold.operators import conditional, decisions, documents, savings, store
from tilefold.operators import ledger as ledgers
from tilefold.session import written

LEDGER = "session string, handle string, code int, step bigint, tokens bigint"
STORE = "handle string, bytes binary, first_session string, shard string"
META = "handle string, sha256 string, len bigint, created bigint, accessed bigint, session string"
PACKS = "id bigint, session string, step bigint, view string, choice string, raw_tokens bigint, shown_tokens bigint, saved_tokens bigint, delta_hits bigint, evicted_resends bigint, blocks int, runs int, handles array<string>"
METRICS = "line_id bigint, t bigint, event string, session string, raw bigint, shown bigint, saved bigint, delta_hits bigint, evicted bigint, handle string, tokens bigint, ok boolean, mode string, caller string"
DECISIONS = "entry_id bigint, t bigint, reason string, path string, bytes bigint, raw_tokens bigint, view_tokens bigint, redirect_to string, note string"
CACHE = "redirect_to string, path string, view string"
READ_SESSION = "read-hook"  # who a redirected read is charged to if it names no session


@dataclass
class Engine:
    spark: SparkSession
    config: EngineConfig

    def _read(self, schema: str, *kinds: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(*(self.config.path(k) for k in kinds)) if kinds else self.spark.createDataFrame([], schema)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _complete(self, kind: str) -> list[int]:
        """Versions of a kind of table that were written to the end."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.config.path(kind)}/*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getName()) for f in found or ())

    def version(self) -> int:
        return max(self._complete("ledger"), default=0)

    def _current(self, kind: str, schema: str) -> DataFrame:
        """All rows of complete calls up to the current version."""
        now = self.version()
        return self._read(schema, *(f"{kind}/{v:012d}" for v in self._complete(kind) if v <= now))

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        rows.write.mode("overwrite").parquet(self.config.path(f"{kind}/{version:012d}"))

    def ledger(self) -> DataFrame:
        now = self.version()
        return self._read(LEDGER, *([f"ledger/{now:012d}"] if now else []))

    def _save_ledger(self, state: DataFrame, version: int | None = None) -> None:
        self._write(state.select("session", "handle", "code", "step", "tokens"), "ledger", version or self.version() + 1)

    def store(self) -> DataFrame:
        """Blocks, each once, however often a failed call was run again."""
        return self._read(STORE, "store").dropDuplicates(["handle"])

    def meta(self) -> DataFrame:
        """Metadata of each handle by its first writer."""
        first = self._read(META, "meta").groupBy("handle").agg(F.min(F.struct("created", "session", "sha256", "len", "accessed")).alias("m"))
        return first.select("handle", "m.sha256", "m.len", "m.created", "m.accessed", "m.session")

    def packs(self) -> DataFrame:
        return self._current("packs", PACKS)

    def metrics(self) -> DataFrame:
        return self._current("metrics", METRICS).unionByName(self._read(METRICS, "recalls"))

    def decisions(self) -> DataFrame:
        return self._current("decisions", DECISIONS)

    def _put(self, rows: DataFrame, now: int) -> None:
        """Store (seq, session, bytes) with metadata."""
        new = written(store.put(rows, self._read(STORE, "store")), "new")
        store.meta_of(new, now).write.mode("append").parquet(self.config.path("meta"))
        store.write(new, self.config.path("store"))

    def pack_output(self, texts: DataFrame, proof: DataFrame | None = None, now: float | None = None) -> DataFrame:
        """Pack (id, session, step, text[, content_type][, command]) against the ledger, and give the packed rows.

        Stores what the views name, notes what was shown, enforces the budget and records one compress event per row. Steps
        of one call see the ledger of before and each other's blocks; the budget is enforced after the call. ``proof``
        (session, ok, handle) is the transcript's word on what is still shown (``transcripts.proof``).
        """
        now, version = now if now is not None else time.time(), self.version() + 1
        if "content_type" not in texts.columns:
            texts = texts.withColumn("content_type", detect(F.col("text"), F.col("command") if "command" in texts.columns else None))
        texts = texts.select("id", "session", "step", F.coalesce("text", F.lit("")).alias("text"), "content_type")
        before, blocks = self.ledger(), written(conditional.block_rows(texts), "blocks")
        packed = written(conditional.pack_blocks(texts, blocks, before, proof), "packed")
        self._put(conditional.stored_rows(packed), int(now))
        self._write(packed.drop("stored"), "packs", version)
        events = packed.select(
            F.col("id").alias("line_id"), F.lit(int(now * 1000)).alias("t"), F.lit("compress").alias("event"), "session", F.col("raw_tokens").alias("raw"),
            F.col("shown_tokens").alias("shown"), F.col("saved_tokens").alias("saved"), "delta_hits", F.col("evicted_resends").alias("evicted"),
            *(F.lit(None).cast(t).alias(c) for c, t in (("handle", "string"), ("tokens", "bigint"), ("ok", "boolean"), ("mode", "string"), ("caller", "string"))),
        )
        self._write(events, "metrics", version)
        shown = conditional.residency(blocks, before, proof).filter("not seen")
        self._save_ledger(ledgers.enforce_budget(ledgers.note(before, shown), self.config.budget), version)
        return self._read(PACKS, f"packs/{version:012d}")

    def _recalls(self, rows: DataFrame, now: float) -> None:
        """Append expand events of ``store.expand`` rows."""
        none = {c: F.lit(None).cast("bigint").alias(c) for c in ("raw", "shown", "saved", "delta_hits", "evicted")}
        line = F.xxhash64(F.lit(uuid.uuid4().hex), "handle").alias("line_id")
        rows.select(line, F.lit(int(now * 1000)).alias("t"), F.lit("expand").alias("event"), "session", *none.values(), "handle", "tokens", "ok", "mode", "caller").write.mode("append").parquet(self.config.path("recalls"))

    def expand_handle(
        self, wanted: str, lines: tuple[int, int] | None = None, pattern: str | None = None, context: int = 0, session: str | None = None, caller: str = "api", now: float | None = None
    ) -> bytes | None:
        """The bytes of a handle, or the chosen lines; None for a handle that is not stored. Records one expand event.

        The tokens are charged to the session that stored the block first, else to ``session``.
        """
        asked = self.spark.createDataFrame([(wanted, session)], "handle string, session string")
        place = asked.select(shard(F.col("handle"))).first()[0]  # the folder to look in
        kept = self._read(STORE, "store").filter((F.col("shard") == place) & (F.col("handle") == wanted))
        out = written(store.expand(kept, asked, self.meta().filter(F.col("handle") == wanted), lines, pattern, context, caller), "expanded")
        self._recalls(out, now if now is not None else time.time())
        got = out.first()["out"]
        return None if got is None else bytes(got)

    def redirect_reads(self, reads: DataFrame, now: float | None = None) -> DataFrame:
        """Decide on reads (id, session, path, bytes, sliced) and give the log rows, with ``id`` and ``view``.

        ``bytes`` are null for a file that cannot be read. A view that is redirected to is cached under the digest of its
        source and its path; a cached one is taken as it is, if the store still serves its source, which is probed by one
        recall of the first line. What views name is stored again on every redirect, so a lost store heals. Redirects count
        as compress events.
        """
        now, version = now if now is not None else time.time(), self.version() + 1
        text, path = as_text(F.col("bytes")), F.col("path")
        size = F.octet_length("bytes").cast("bigint")
        gate = F.lit(self.config.read_gate)
        looked = gate & ~F.col("sliced") & size.between(decisions.MIN_BYTES, decisions.MAX_BYTES)
        base = reads.select("id", "session", "path", "sliced", F.col("bytes").alias("source"), size.alias("n_bytes"), F.when(looked, text).alias("text"))
        built = base.withColumn("_e", documents.cache_entry(path, F.col("text"), F.when(F.col("text").isNotNull(), F.col("source"))))
        known = self._read(CACHE, "cache").groupBy("redirect_to").agg(F.min("view").alias("_cached"))
        built = built.withColumns({"digest": sha256_hex(F.col("source")), "whole": handle(F.col("source"))})
        built = written(built.withColumn("_key", cache_key(F.col("digest"), path)).join(known, F.col("_key") == F.col("redirect_to"), "left").drop("redirect_to"), "reads")
        owner = F.when(F.col("session").isNull() | F.col("session").rlike(r"\A\s*\z"), READ_SESSION).otherwise(F.col("session"))

        def judged(rows: DataFrame, healthy) -> DataFrame:
            view = F.when(F.col("_cached").isNotNull() & healthy, F.col("_cached")).otherwise(F.col("_e.view"))
            rows = rows.withColumns({"view": view, "healthy": healthy, "gate": gate, "cached": F.col("_cached").isNotNull(), "raw_tokens": tokens_bytes(F.col("source"))})
            return decisions.decide(rows.withColumn("view_tokens", tokens(F.col("view"))))

        likely = judged(built, F.lit(True)).filter("redirect_to is not null")
        parts = likely.select(F.col("id").alias("seq"), owner.alias("session"), F.explode(F.concat(F.array("source"), F.transform("_e.stored", lambda x: F.encode(x["text"], "UTF-8")))).alias("bytes"))
        self._put(parts, int(now))
        hits = likely.filter("cached").select(F.col("whole").alias("handle"), owner.alias("session")).distinct()
        probes = written(store.expand(self._read(STORE, "store"), hits, self.meta(), (1, 1), caller="hook"), "probes")
        served = probes.filter("ok").select(F.col("handle").alias("whole"), F.lit(True).alias("_served")).distinct()
        out = written(judged(built.join(served, "whole", "left"), F.coalesce("_served", F.lit(False))), "decided")
        self._recalls(probes, now)
        log = out.select(F.col("id").alias("entry_id"), F.lit(int(now)).alias("t"), "reason", "path", "bytes", "raw_tokens", "view_tokens", "redirect_to", "note")
        self._write(log, "decisions", version)
        fresh = out.filter("redirect_to is not null and (not cached or note is not null)")
        fresh.select("redirect_to", "path", "view").dropDuplicates(["redirect_to"]).write.mode("append").parquet(self.config.path("cache"))
        events = out.filter("redirect_to is not null").select(
            F.col("id").alias("line_id"), F.lit(int(now * 1000)).alias("t"), F.lit("compress").alias("event"), owner.alias("session"), F.col("raw_tokens").alias("raw"),
            F.col("view_tokens").alias("shown"), (F.col("raw_tokens") - F.col("view_tokens")).alias("saved"), F.lit(0).cast("bigint").alias("delta_hits"), F.lit(0).cast("bigint").alias("evicted"),
            *(F.lit(None).cast(t).alias(c) for c, t in (("handle", "string"), ("tokens", "bigint"), ("ok", "boolean"), ("mode", "string"), ("caller", "string"))),
        )
        self._write(events, "metrics", version)
        self._save_ledger(self.ledger(), version)
        return out.select("id", "reason", "path", "bytes", "raw_tokens", "view_tokens", "redirect_to", "note", F.when(F.col("redirect_to").isNotNull(), F.col("view")).alias("view"))

    def record_residency(self, marked: DataFrame) -> None:
        self._save_ledger(ledgers.record_residency(self.ledger(), marked))

    def evict(self, gone: DataFrame) -> None:
        self._save_ledger(ledgers.evict(self.ledger(), gone))

    def drop_blocks(self, gone: DataFrame) -> None:
        """Delete the blocks of ``gone`` (handle) and their metadata, folder by folder of the store.

        What stays of a shard is written beside it first; readers of the moment may miss a block, never get a wrong one.
        """
        gone = written(gone.select("handle").distinct(), "gone")
        kept = written(store.delete(self.store(), gone).select("handle", "bytes", "first_session", "shard"), "kept")
        meta = written(store.delete(self.meta(), gone), "kept_meta")
        meta.write.mode("overwrite").parquet(self.config.path("meta"))
        kept.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(self.config.path("store"))

    def status(self) -> DataFrame:
        return savings.status(self.metrics(), store.size(self.store()).toDF("store_blocks", "store_bytes"))

    def call(self, tool: str, **arguments) -> str:
        """A tool by its name: ``expand`` (handle, lines, pattern, context), ``inspect`` (handle) or ``metrics`` (session)."""
        from tilefold import reports

        if tool == "expand":
            got = self.expand_handle(arguments.pop("handle"), caller="tool", **arguments)
            return "no such handle" if got is None else got.decode("utf-8", "replace")
        if tool == "inspect":
            r = store.inspect(self.store().filter(F.col("handle") == arguments["handle"])).first()
            return "no such handle" if r is None else "\n".join(f"{k}: {v}" for k, v in r.asDict().items())
        if tool == "metrics":
            return reports.summary_report(self.metrics(), arguments.get("session"))
        raise LookupError(f"no tool {tool}")
