"""A thin command line over ``api.Engine`` and the reports: ``python -m tilefold.cli COMMAND ...``.

pack [FILE|-] [--session S] [--step N] [--type code|log|json]   expand HANDLE [--lines A-B] [--grep P] [--context N]
inspect HANDLE|PACKED-FILE    delta OLD NEW [--type T]          store put FILE        transcript FILE
status    metrics [--session S]    ab    why-last [N]    gc [--older-than SECONDS] [--live]    bench

Exit codes: 0 done, 1 nothing found, 2 bad use or a file that cannot be read.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tilefold import reports
from tilefold.api import Engine
from tilefold.config import EngineConfig
from tilefold.functions.handles import handle, session_key
from tilefold.operators import conditional, documents, retention, store, transcripts
from tilefold.sources import records

TEXT = "id bigint, session string, step bigint, text string, command string"


class Usage(Exception):
    """Bad use; the message says how."""


def flag(args: list[str], name: str) -> str | None:
    """The value of ``--name V`` or ``--name=V``; the first one counts."""
    for i, a in enumerate(args):
        if a == f"--{name}":
            return args[i + 1] if i + 1 < len(args) else None
        if a.startswith(f"--{name}="):
            return a.split("=", 1)[1]
    return None


def plain(args: list[str]) -> list[str]:
    """The arguments that are neither flags nor their values."""
    out, skip = [], False
    for a in args:
        if skip or (a.startswith("--") and len(a) > 2):
            skip = not skip and "=" not in a and a not in ("--live",)
        else:
            out.append(a)
    return out


def read_blob(name: str) -> bytes:
    """A file, or standard input to its end for ``-``."""
    try:
        return sys.stdin.buffer.read() if name == "-" else Path(name).read_bytes()
    except OSError as x:
        raise Usage(f"cannot read {name}: {x.strerror}") from x


def line_range(text: str | None) -> tuple[int, int] | None:
    if text is None:
        return None
    first, hyphen, last = text.partition("-")
    if not (hyphen and first.strip().isdecimal() and last.strip().isdecimal()):
        raise Usage("--lines takes A-B")
    return int(first), int(last)


def number(text: str | None, default: int) -> int:
    if text is None:
        return default
    if not text.isdecimal():
        raise Usage(f"{text} is no number")
    return int(text)


def _texts(engine: Engine, rows: list[tuple], kind: str | None):
    if kind not in (None, "code", "log", "json"):
        raise Usage("--type is code, log or json")
    df = engine.spark.createDataFrame(rows, TEXT)
    return df.withColumn("content_type", F.lit(kind)) if kind else df


def run(engine: Engine, command: str, args: list[str]) -> tuple[int, str]:
    """Exit code and output of one command."""
    spark, rest, kind = engine.spark, plain(args), flag(args, "type")
    if command == "pack":
        name = rest[0] if rest else "-"
        text = read_blob(name).decode("utf-8", "replace")
        session = flag(args, "session") or spark.range(1).select(session_key(F.lit(""), F.lit(str(Path.cwd())), F.lit(int(time.time())))).first()[0]
        row = (time.time_ns() // 1000, session, number(flag(args, "step"), 0), text, None if name == "-" else name)
        return 0, engine.pack_output(_texts(engine, [row], kind)).first()["view"]
    if command == "delta" and len(rest) == 2:
        rows = [(i, "delta", i, read_blob(f).decode("utf-8", "replace"), f) for i, f in enumerate(rest)]
        texts = _texts(engine, rows, kind)
        if not kind:
            from tilefold.functions.predicates import detect

            texts = texts.withColumn("content_type", detect(F.col("text"), F.col("command")))
        r = conditional.pack(texts).filter("step = 1").first()
        return 0, f"{r['view']}\n\n{r['raw_tokens']:,} to {r['shown_tokens']:,} tokens, {r['delta_hits']} of {r['blocks']} blocks unchanged"
    if command == "expand" and rest:
        got = engine.expand_handle(rest[0], line_range(flag(args, "lines")), flag(args, "grep"), number(flag(args, "context"), 0), flag(args, "session"), "cli")
        return (1, f"no such handle: {rest[0][:64]}") if got is None else (0, got.decode("utf-8", "replace"))
    if command == "inspect" and rest:
        if not Path(rest[0]).exists():
            out = engine.call("inspect", handle=rest[0])
            return int(out == "no such handle"), out
        m = spark.createDataFrame([(read_blob(rest[0]).decode("utf-8", "replace"),)], "v string").select(documents.manifest(F.col("v")).alias("m")).first()["m"]
        if not m["handle"]:
            return 1, "not a packed file"
        return 0, "\n".join([f"source {m['source']}, whole file {m['handle']}", *(f"  lines {x['first_line']}-{x['last_line']}: {x['tokens']:,} tokens" for x in m["markers"])])
    if command == "store" and rest[:1] == ["put"] and len(rest) == 2:
        blob = bytearray(read_blob(rest[1]))
        engine._put(spark.createDataFrame([(0, flag(args, "session"), blob)], "seq bigint, session string, bytes binary"), int(time.time()))
        return 0, spark.createDataFrame([(blob,)], "b binary").select(handle(F.col("b"))).first()[0]
    if command == "transcript" and rest:
        scan = transcripts.scan(records.transcript(spark, rest[0]))
        return 0, reports.transcript_report(scan, Path(rest[0]).name.removesuffix(".jsonl"))
    if command == "status":
        return 0, reports.status_report(engine.metrics(), store.size(engine.store()))
    if command == "metrics":
        return 0, reports.summary_report(engine.metrics(), flag(args, "session"))
    if command == "ab":
        return 0, reports.savings_report(engine.metrics())
    if command == "why-last":
        return 0, reports.decisions_report(engine.decisions(), number(rest[0] if rest else None, 10))
    if command == "gc":
        age, now, live = number(flag(args, "older-than"), 30 * 86_400), int(time.time()), "--live" in args
        meta = engine.meta().select("handle", "accessed", "created", F.lit(True).alias("has_meta"))
        held = engine.store().select("handle", F.octet_length("bytes").cast("bigint").alias("len")).join(meta, "handle", "left")
        judged = retention.judged(held.withColumns({"has_meta": F.coalesce("has_meta", F.lit(False)), "mtime": F.lit(None).cast("bigint")}), now, age)
        text = reports.retention_report(retention.report(judged.select("len", "kind", "covered", "stale"), not live), age)
        if live:
            engine.drop_blocks(judged.filter("stale").select("handle"))
        return 0, text
    if command == "bench":
        from tilefold.plans.log_queries import bench_loop

        rows = bench_loop(spark, "").orderBy("iteration").collect()
        total = {k: sum(r[k] for r in rows) for k in ("raw", "stateless", "conditional")}
        return 0, "\n".join([*(f"{r['iteration']}: raw {r['raw']:,}, stateless {r['stateless']:,}, conditional {r['conditional']:,}" for r in rows), f"all: {total}"])
    raise Usage(__doc__ or "")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = sys.argv[1:] if argv is None else argv
    if not args:
        print(__doc__)
        return 2
    from tilefold.session import build_session

    try:
        code, text = run(Engine(spark or build_session(memory="2g"), EngineConfig.from_env()), args[0], args[1:])
    except Usage as x:
        print(x, file=sys.stderr)
        return 2
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
