"""Queries on logs and state: savings, ledgers, retention, transcripts, decisions, the store, recall and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.functions import handles as H
from tilefold.functions import text as T
from tilefold.operators import conditional, decisions, ledger, recall, retention, savings, store, transcripts
from tilefold.plans.prefix import one_per_id
from tilefold.plans.text_queries import LOG_BLOCKS, SQL_LINES, sql_code_blocks, sql_code_view, sql_generated, sql_handle, sql_json_view, sql_lines, sql_log_blocks, sql_log_view, sql_tokens
from tilefold.session import written
from tilefold.sources.generate import edit_loop
from tilefold.sources.tables import spread, table

c = F.col
#: The moment of retention and touch queries, and the age of what is deleted (in seconds).
NOW, OLDER_THAN = 1_926_500_000, 1_000_000
BUDGET = 5_000


def savings_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Per session and, under the null session, in total."""
    return savings.sessions(table(spark, d, "metrics"), total=True)


def savings_ranked(spark: SparkSession, d: str) -> DataFrame:
    return savings.ranked(savings.sessions(table(spark, d, "metrics"))).select("session", "net", "verdict")


def savings_summary(spark: SparkSession, d: str) -> DataFrame:
    return savings.summary(table(spark, d, "metrics"))


def savings_latest(spark: SparkSession, d: str) -> DataFrame:
    return savings.latest_session(table(spark, d, "metrics"))


def savings_status(spark: SparkSession, d: str) -> DataFrame:
    size = table(spark, d, "block_meta").agg(F.count("*").alias("store_blocks"), F.coalesce(F.sum("len"), F.lit(0)).alias("store_bytes"))
    return savings.status(table(spark, d, "metrics"), size)


def events_savings(spark: SparkSession, d: str) -> DataFrame:
    """The events table in the shape of the metrics log: purchases, views and signups compress, the rest expands."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    compress = c("event_type").isin("purchase", "view", "signup")
    lines = e.select(
        F.when(compress, "compress").otherwise("expand").alias("event"), c("user_id").cast("string").alias("session"),
        (k * 10).alias("raw"), k.alias("shown"), F.lit(None).cast("bigint").alias("saved"), F.lit(0).cast("bigint").alias("delta_hits"),
        F.lit(0).cast("bigint").alias("evicted"), k.alias("tokens"), (c("event_type") != "error").alias("ok"),
    )
    return savings.sessions(lines)


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger.state(table(spark, d, "ledger"))


def ledger_state(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).withColumn("residency", ledger.residency(c("code")))


def ledger_tokens(spark: SparkSession, d: str) -> DataFrame:
    return ledger.resident_tokens(_ledger(spark, d))


def ledger_budget(spark: SparkSession, d: str) -> DataFrame:
    return ledger.enforce_budget(_ledger(spark, d), BUDGET)


def ledger_marked(spark: SparkSession, d: str) -> DataFrame:
    """Handles expanded from outside are noted at step 999 without weight; those that failed are evicted."""
    m = table(spark, d, "metrics").filter("event = 'expand' and handle is not null and session is not null")
    noted = ledger.record_residency(_ledger(spark, d), m.filter("ok").select("session", "handle", F.lit(999).cast("bigint").alias("step")))
    return ledger.evict(noted, m.filter("not ok").select("session", "handle"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "block_meta")
    return m.select(
        "file_id", F.regexp_extract("path", r"[^/]*\z", 0).alias("handle"), "len", (c("sha256").isNotNull() & c("len").isNotNull()).alias("has_meta"),
        "accessed", "created", F.unix_timestamp("seen_at").alias("mtime"),
    )


def retention_gc(spark: SparkSession, d: str) -> DataFrame:
    """A dry run over blocks, and over the views of redirected reads as the read cache."""
    blocks = retention.judged(_stored(spark, d), NOW, OLDER_THAN)
    views = one_per_id(table(spark, d, "decision_log").filter("redirect_to is not null"), "entry_id").select(c("bytes").alias("len"), c("t").alias("mtime"))
    return retention.report(blocks.select("len", "kind", "covered", "stale").unionByName(retention.judged_cache(views, NOW, OLDER_THAN)))


def retention_kept(spark: SparkSession, d: str) -> DataFrame:
    return retention.survivors(retention.judged(_stored(spark, d), NOW, OLDER_THAN)).select("file_id", "handle")


def retention_coverage(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "ledger").select("handle").distinct()
    return retention.coverage(held, _stored(spark, d).filter("has_meta"))


def store_touch(spark: SparkSession, d: str) -> DataFrame:
    return store.touch(table(spark, d, "block_meta").select("file_id", "accessed"), NOW)


def transcript_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "transcript")
    found = rows.select("line_id", "logged_at", "session", "line_no", transcripts.raw_line(rows).alias("line"))
    found = found.select("line_id", "logged_at", "session", "line_no", *(v.alias(k) for k, v in transcripts.narrow(c("line")).items()))
    return transcripts.scan(one_per_id(found, "line_id", "logged_at").filter("session is not null"))


def decision_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last twenty decisions in log order."""
    return decisions.tail(table(spark, d, "decision_log").distinct(), 20).select("entry_id", "t", "reason", "path")


def decision_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = decisions.readable(table(spark, d, "decision_log").distinct())
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.coalesce(F.sum(c("raw_tokens") - c("view_tokens")), F.lit(0)).alias("saved"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    source = F.lower(F.btrim(F.coalesce("source", F.lit(""))))
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    return docs.select(c("doc_id").alias("id"), source.alias("session"), c("doc_id").alias("step"), "text", F.lit("log").alias("content_type"))


def _put(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d).select(c("id").alias("seq"), "session", F.encode("text", "UTF-8").alias("bytes"))
    return store.put(docs)


def store_put(spark: SparkSession, d: str) -> DataFrame:
    """Pages stored once each, with the session that came first."""
    return _put(spark, d).select("handle", "shard", F.octet_length("bytes").alias("len"), "first_session")


def store_get(spark: SparkSession, d: str) -> DataFrame:
    """Recall of every page's handle from a store with damaged copies beside the good ones, and of handles not stored."""
    good = written(_put(spark, d), "store").withColumn("priority", F.lit(1))
    bad = good.withColumn("bytes", F.concat(c("bytes"), F.encode(F.lit("!"), "UTF-8"))).withColumn("priority", F.lit(0))
    wanted = good.select("handle").unionByName(table(spark, d, "ledger").select("handle").filter("handle is not null"))
    got = store.get(good.unionByName(bad), wanted, store.meta_of(good, NOW))
    return got.select("handle", F.octet_length("bytes").alias("len"))


def store_expand(spark: SparkSession, d: str) -> DataFrame:
    """Expand lines that recalls of all pages and of unknown handles write, whole, by lines and by pattern, charged to who stored them."""
    rows = written(_put(spark, d), "store")
    asked = rows.select("handle").unionByName(table(spark, d, "metrics").select("handle").filter("handle is not null")).distinct()
    asked, meta = asked.withColumn("session", F.lit("caller")), store.meta_of(rows, NOW)
    modes = ({}, {"lines": (3, 12)}, {"lines": (2, 40), "pattern": r"[aeiou]+\w?st.$", "caller": "cli"})
    out = [store.expand(rows, asked, meta, **how).drop("out") for how in modes]
    return out[0].unionByName(out[1]).unionByName(out[2])


def store_inspect(spark: SparkSession, d: str) -> DataFrame:
    return store.inspect(_put(spark, d))


def store_size(spark: SparkSession, d: str) -> DataFrame:
    return store.size(_put(spark, d))


def store_deleted(spark: SparkSession, d: str) -> DataFrame:
    """What stays after pages of fewer than a thousand bytes are deleted."""
    rows = _put(spark, d)
    return store.delete(rows, rows.filter(F.octet_length("bytes") < 1000)).select("handle")


def _recalled(spark: SparkSession, d: str, **how) -> DataFrame:
    t = F.encode("text", "UTF-8")
    return table(spark, d, "documents").select("doc_id", F.sha2(recall.expand(t, **how), 256).alias("part"))


def recall_lines(spark: SparkSession, d: str) -> DataFrame:
    return _recalled(spark, d, lines=(3, 12))


def recall_grep(spark: SparkSession, d: str) -> DataFrame:
    return _recalled(spark, d, lines=(2, 40), pattern=r"[aeiou]+\w?st.$")


def recall_context(spark: SparkSession, d: str) -> DataFrame:
    return _recalled(spark, d, lines=(2, 40), pattern=r"^[A-Z\d .]+$", context=2)


def recall_literal(spark: SparkSession, d: str) -> DataFrame:
    """A pattern outside the language is searched as text."""
    return _recalled(spark, d, pattern="(A|")


def delta_residency(spark: SparkSession, d: str) -> DataFrame:
    return conditional.residency(written(conditional.block_rows(_texts(spark, d), weigh=False), "blocks")).select("id", "block_no", "handle", "seen")


def delta_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every page packed against what its source has shown before."""
    return conditional.pack(_texts(spark, d)).drop("view", "handles", "stored")


def delta_code(spark: SparkSession, d: str) -> DataFrame:
    """The same with every other page read as code."""
    kind = F.when(c("id") % 2 == 0, "code").otherwise("log")
    return conditional.pack(_texts(spark, d).withColumn("content_type", kind)).drop("view", "handles", "stored")


def delta_budget(spark: SparkSession, d: str) -> DataFrame:
    """The same with a token budget per source, replayed in order."""
    return conditional.session_fold(_texts(spark, d), BUDGET).drop("view", "handles", "stored")


def delta_json(spark: SparkSession, d: str) -> DataFrame:
    """Every JSON record packed against what its stream has shown before."""
    rows = one_per_id(table(spark, d, "meta_raw").select("record_id", "stream", "written_at", "record").filter("record_id is not null"), "record_id", "written_at")
    texts = rows.select(c("record_id").alias("id"), c("stream").alias("session"), c("record_id").alias("step"), c("record").alias("text"), F.lit("json").alias("content_type"))
    return conditional.pack(texts).drop("view", "handles", "stored")


def delta_gated(spark: SparkSession, d: str) -> DataFrame:
    """The same with a transcript that proves only blocks of odd hash."""
    blocks = written(conditional.block_rows(_texts(spark, d), weigh=False), "blocks")
    odd = F.substring("handle", 36, 1).isin(*"13579bdf")
    proof = blocks.select("session", F.lit(True).alias("ok"), F.when(odd, c("handle")).alias("handle"))
    out = conditional.residency(blocks, proof=proof)
    return out.groupBy("session").agg(F.count_if("seen").alias("resident"), F.count_if("gated").alias("gated"), F.count("*").alias("blocks"))


def delta_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every page put together again from the stored blocks of all pages."""
    texts = _texts(spark, d)
    from tilefold.operators.tiles import log_blocks

    parts = texts.select(c("id").alias("seq"), "session", F.explode(log_blocks(c("text"))).alias("b"))
    kept = store.put(parts.select("seq", "session", F.encode("b", "UTF-8").alias("bytes")))
    back = conditional.reconstruct(texts, kept)
    return texts.join(back, "id").select("id", (c("restored") == c("text")).alias("same"))


def delta_versions(spark: SparkSession, d: str) -> DataFrame:
    """Each page and a later version of it, with a line put before, as a session of two steps."""
    docs = spread(table(spark, d, "documents").select(c("doc_id").cast("string").alias("session"), c("doc_id"), "text"))
    old = docs.select((c("doc_id") * 2).alias("id"), "session", F.lit(0).alias("step"), "text", F.lit("log").alias("content_type"))
    new = docs.select((c("doc_id") * 2 + 1).alias("id"), "session", F.lit(1).alias("step"), F.concat(F.lit("Running 1\n\n"), "text").alias("text"), F.lit("log").alias("content_type"))
    return conditional.pack(old.unionByName(new)).filter("step = 1").drop("view", "handles", "stored")


def _recalled_handles(packed: DataFrame) -> DataFrame:
    """(id, handle, n_bytes) of every handle that a view prints, read back from the store of all that was packed."""
    packed = written(packed.select("id", "session", "step", "view", "stored"), "packed")
    kept = written(store.put(conditional.stored_rows(packed)), "store")
    named = packed.select("id", F.explode(F.array_distinct(H.handles_in(c("view")))).alias("handle"))
    got = store.get(kept, named, store.meta_of(kept, NOW)).select("handle", F.octet_length("bytes").alias("n_bytes"))
    return named.join(got, "handle", "left").select("id", "handle", "n_bytes")


def delta_recall(spark: SparkSession, d: str) -> DataFrame:
    """Every handle in the views of ``delta_pack`` with the bytes that its recall gives."""
    return _recalled_handles(conditional.pack(_texts(spark, d)))


def _ledger_and_proof(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of ``texts``; a ledger that holds those whose handle ends in 0 to 4, and in 5 to 9 as evicted; a transcript without those that end in 0."""
    blocks = written(conditional.block_rows(texts, weigh=False), "blocks")
    last = F.substring("handle", 36, 1)
    held = blocks.select("session", "handle").distinct()
    ledger = held.select("session", "handle", F.when(last.isin(*"01234"), 0).when(last.isin(*"56789"), 1).alias("code")).filter("code is not null")
    return blocks, ledger, held.select("session", F.lit(True).alias("ok"), F.when(last != "0", c("handle")).alias("handle"))


def delta_ledger(spark: SparkSession, d: str) -> DataFrame:
    """``delta_pack`` on a ledger with resident and evicted blocks: evicted ones are sent again and counted."""
    texts = _texts(spark, d)
    blocks, held, _ = _ledger_and_proof(texts)
    return conditional.pack_blocks(texts, blocks, held).drop("view", "handles", "stored")


def delta_proof(spark: SparkSession, d: str) -> DataFrame:
    """The same behind a transcript that does not prove some resident blocks."""
    texts = _texts(spark, d)
    return conditional.pack_blocks(texts, *_ledger_and_proof(texts)).drop("view", "handles", "stored")


def bench_loop(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of an edit and test loop: raw, stateless and conditional."""
    from tilefold.operators.structural import view

    texts = edit_loop(spark)
    # an Arrow function cannot stand inside the token estimate's lambdas, so views are a column of their own first
    stateless = texts.select("id", view(c("text"), c("content_type")).alias("v")).select("id", T.tokens(c("v.view")).alias("stateless_tokens"))
    packed = conditional.pack(texts).select("id", "raw_tokens", "shown_tokens", "delta_hits")
    return packed.join(stateless, "id").groupBy((F.floor(c("id") / 2) + 1).alias("iteration")).agg(
        F.sum("raw_tokens").alias("raw"), F.sum("stateless_tokens").alias("stateless"), F.sum("shown_tokens").alias("conditional"), F.sum("delta_hits").alias("unchanged"))


QUERIES = {
    f.__name__: f
    for f in (
        savings_sessions, savings_ranked, savings_summary, savings_latest, savings_status, events_savings, ledger_state, ledger_tokens, ledger_budget,
        ledger_marked, retention_gc, retention_kept, retention_coverage, store_touch, transcript_scan, decision_tail, decision_reasons, store_put,
        store_get, store_expand, store_inspect, store_size, store_deleted, recall_lines, recall_grep, recall_context, recall_literal, delta_residency,
        delta_pack, delta_recall, delta_ledger, delta_proof, delta_code, delta_json, delta_budget, delta_gated, delta_restored, delta_versions, bench_loop,
    )
}

_SUMS = """
  count(*) filter (event = 'compress') as compress_events, count(*) filter (event = 'expand') as expand_calls,
  count(*) filter (event = 'expand' and not coalesce(ok, true)) as failed_expands,
  coalesce(sum(raw) filter (event = 'compress'), 0)::bigint as raw, coalesce(sum(shown) filter (event = 'compress'), 0)::bigint as shown,
  coalesce(sum(coalesce(saved, coalesce(raw, 0) - coalesce(shown, 0))) filter (event = 'compress'), 0)::bigint as saved,
  coalesce(sum(tokens) filter (event = 'expand' and coalesce(ok, true)), 0)::bigint as refetched,
  coalesce(sum(delta_hits) filter (event = 'compress'), 0)::bigint as delta_hits, coalesce(sum(evicted) filter (event = 'compress'), 0)::bigint as evicted"""
_RATED = """
  *, saved - refetched as net,
  case when raw > 0 then ((saved - refetched) * 100 - ((saved - refetched) * 100) % raw) // raw end as reduction_pct,
  case when compress_events = 0 then 'none' when saved - refetched > 0 then 'positive' else 'negative' end as verdict"""
_SESSIONS = f"""
s as (select coalesce(session, '(no session)') as session, {_SUMS} from metrics group by 1),
w as (select null::varchar as session, {_SUMS} from metrics),
rated as (select {_RATED} from (select * from s union all select * from w))"""
_STATE = """
state as (select session, handle, code::int as code, step, tokens from (
  select *, row_number() over (partition by session, handle order by line_id desc) as k from ledger
  where handle is not null and code >= 0 and step >= 0 and tokens >= 0) where k = 1)"""
_LATEST = """
  select session, coalesce(t, 0) as t from metrics where event = 'compress' and session <> '' order by coalesce(t, 0) desc, line_id desc limit 1"""
_BLOCKS = """
b as (select file_id, split_part(path, '/', -1) as handle, len, sha256 is not null and len is not null as has_meta, accessed, created,
        cast(floor(epoch(seen_at)) as bigint) as mtime from block_meta),
j as (select *, coalesce(case when has_meta and (case when accessed > 0 then accessed else created end) > 0
        then case when accessed > 0 then accessed else created end end, mtime) as act from b),
k as (select *, has_meta and act is not null as covered, coalesce(greatest(1926500000 - act, 0) >= 1000000, false) as stale from j)"""
_SRC = "lower(trim(coalesce(source, ''), ' '))"
_SEEN = f"""
{SQL_LINES}, {LOG_BLOCKS},
h as (select b.doc_id as id, block_no, {sql_handle('block')} as handle, {_SRC} as session from blocks b join documents d on d.doc_id = b.doc_id),
seen as (select *, min(id) over (partition by session, handle) < id as seen from h)"""


def _recall_sql(cond: str, where: str = "true") -> str:
    return f"""
        with p as (select doc_id, string_split(text, chr(10)) as p from documents),
        x as (select doc_id, i, p[i] as x from p, unnest(range(1, len(p) + 1)) as u(i) where {where}),
        m as (select *, {cond} as hit from x)
        select d.doc_id, sha256(coalesce(string_agg(x, chr(10) order by i), '')) as part from documents d left join (select * from m where hit) m using (doc_id) group by d.doc_id"""


def _pack_sql(texts: str, held: str = "null", proved: str = "true", out: str = "", fold: str = "", json: bool = False) -> str:
    """Packed views of ``texts`` (id, session, step, text, code): past by window, repeats by a fold over the blocks of a text.

    With ``json`` all texts are JSON. ``held`` is the ledger's code of a handle and ``proved`` whether the transcript shows it, as SQL over ``handle``.
    """
    if json:
        tiled = sql_json_view("w", "texts") + ", blocks as (select id as doc_id, n - 1 as block_no, tile as block from wjnum)"
        viewed = sql_json_view("r", "fresh") + ", rall as (select id as doc_id, view from rjviews), wall as (select id as doc_id, view from wjviews)"
    else:
        tiled = f"""{sql_lines('texts', 'id')},
        loglines as (select l.* from lines l join texts t on t.id = l.doc_id where not code), codelines as (select l.* from lines l join texts t on t.id = l.doc_id where code),
        {sql_log_blocks('loglines').replace('blocks as (', 'logblocks as (')}, {sql_code_blocks('codelines')}, blocks as (select * from logblocks union all select * from codeblocks)"""
        viewed = f"""
        {sql_lines('fresh', 'id', 'run_lines')},
        rloglines as (select l.* from run_lines l join fresh t on t.id = l.doc_id where not code), rcodelines as (select l.* from run_lines l join fresh t on t.id = l.doc_id where code),
        {sql_log_view('r', 'rloglines')}, {sql_log_view('w', 'loglines')}, {sql_code_view('r', 'rcodelines')}, {sql_code_view('w', 'codelines')},
        rall as (select doc_id, view from rviews union all select doc_id, view from rcodes), wall as (select doc_id, view from wviews union all select doc_id, view from wcodes)"""
    return f"""
        with recursive {texts}, {tiled},
        h as (select t.id, t.session, t.step, block_no, block, {sql_handle('block')} as handle from blocks b join texts t on t.id = b.doc_id),
        """ + (fold or f"""
        past as (
          select *, min(step) over (partition by session, handle) < step or coalesce(({held}) = 0, false) as held, not ({proved}) as barred,
            coalesce(({held}) = 1, false) and not min(step) over (partition by session, handle) < step as evicted, min(block_no) over (partition by id, handle) as first from h),
        fold as (
          select id, -1::bigint as block_no, -1::bigint as last, null::boolean as known, null::boolean as resent from texts
          union all
          select p.id, p.block_no, case when (held or first < last) and not barred then p.block_no else last end, (held or first < last) and not barred,
            case when held or first < last then barred else evicted end from fold f join past p on p.id = f.id and p.block_no = f.block_no + 1)""") + f""",
        status as (select p.id, p.block_no, block, known, resent from h p join fold f on f.id = p.id and f.block_no = p.block_no),
        cut as (select *, known is distinct from lag(known) over (partition by id order by block_no) as edge from status),
        numbered as (select *, sum(edge::int) over (partition by id order by block_no) as run from cut),
        runs as (select id, run, bool_and(known) as known, count(*) as n, count(*) filter (resent) as resent, string_agg(block, '' order by block_no) as text from numbered group by id, run),
        fresh as (select r.id || ':' || run as id, r.text, code from runs r join texts t on t.id = r.id where not known),
        {viewed},
        shown as (
          select r.id, run, n, known, resent, case when known then '[Tilefold: ' || (length(text) - length(replace(text, chr(10), '')) + case when ends_with(text, chr(10)) then 0 else 1 end)
            || ' lines unchanged · recall ' || {sql_handle('text')} || ']' else coalesce(v.view, '') end as view
          from runs r left join rall v on v.doc_id = r.id || ':' || run),
        cond as (
          select id, count(*) as runs, sum(n)::bigint as blocks, coalesce(sum(n) filter (known), 0)::bigint as hits, sum(resent)::bigint as resent, string_agg(view, chr(10) order by run) as view
          from shown group by id),
        sized as (
          select t.id, session, step, text, {sql_tokens('text')} as raw, coalesce(runs, 0) as runs, coalesce(blocks, 0) as blocks, coalesce(hits, 0) as hits, coalesce(resent, 0) as resent,
            coalesce(cond.view, '') as cview, coalesce(w.view, '') as sview, {sql_tokens("coalesce(cond.view, '')")} as c, {sql_tokens("coalesce(w.view, '')")} as s
          from (select id, session, step, coalesce(text, '') as text from texts) t left join cond on cond.id = t.id left join wall w on w.doc_id = t.id),
        best as (select *, runs > 1 and s < c as stateless, case when runs > 1 and s < c then s else c end as b from sized)
        """ + (out or """
        select id, session, step, case when b > raw then 'raw' when stateless then 'stateless' else 'conditional' end as choice, raw as raw_tokens, least(b, raw) as shown_tokens,
          raw - least(b, raw) as saved_tokens, case when b > raw or stateless then 0 else hits end as delta_hits, case when b > raw or stateless then 0 else resent end as evicted_resends, blocks, runs from best""")


def _budget_sql(budget: int) -> str:
    """CTEs that replay the ledger of each session step by step: replay (id, known, resent, gone, live), and fold out of it."""
    return f"""
        steps as (
          select t.session, t.id, t.step, row_number() over (partition by t.session order by t.step, t.id) as n,
            coalesce(list({{'h': handle, 'w': w}} order by block_no) filter (handle is not null), []) as b
          from texts t left join (select *, {sql_tokens('block')} as w from h) h on h.id = t.id group by t.session, t.id, t.step),
        replay as (
          select session, 0::bigint as n, null::bigint as id, []::struct(h varchar, code int, step bigint, w bigint)[] as led, []::boolean[] as known, 0::bigint as resent, 0::bigint as gone, 0::bigint as live
          from (select distinct session from texts)
          union all
          select session, n, id, list_transform(led, lambda e: {{'h': e.h, 'code': case when list_contains(out, e.h) then 1 else e.code end, 'step': e.step, 'w': e.w}}) as led, known,
            len(list_filter(b, lambda x, i: not known[i] and list_contains(was_out, x.h)))::bigint as resent, len(out)::bigint as gone, (total - coalesce(list_sum(list_transform(list_filter(led, lambda e: list_contains(out, e.h)), lambda e: e.w)), 0))::bigint as live
          from (
            select *, list_transform(list_filter(old, lambda e, i: total - coalesce(list_sum(list_transform(old[1:i - 1], lambda x: x.w)), 0) > {budget}), lambda e: e.h) as out
            from (
              select *, coalesce(list_sum(list_transform(old, lambda e: e.w)), 0) as total
              from (
                select *, list_transform(list_sort(list_transform(list_filter(led, lambda e: e.code = 0), lambda e: {{'step': e.step, 'h': e.h, 'w': e.w}})), lambda e: e) as old
                from (
                  select session, n, id, b, known, was_out,
                    list_concat(list_filter(led, lambda e: not list_contains(noted, e.h)), list_transform(list_distinct(list_filter(b, lambda x, i: not known[i])), lambda x: {{'h': x.h, 'code': 0, 'step': step, 'w': x.w}})) as led
                  from (
                    select *, list_distinct(list_transform(list_filter(b, lambda x, i: not known[i]), lambda x: x.h)) as noted
                    from (
                      select r.session, s.n, s.id, s.step, s.b, r.led, list_transform(list_filter(r.led, lambda e: e.code = 1), lambda e: e.h) as was_out,
                        list_reduce(list_transform(s.b, lambda x, i: {{'i': i, 'last': 0::bigint, 'known': [list_contains(list_transform(list_filter(r.led, lambda e: e.code = 0), lambda e: e.h), x.h)], 'first': list_position(list_transform(s.b, lambda y: y.h), x.h)}}),
                          lambda acc, x: {{'i': x.i, 'last': case when x.known[1] or x.first < acc.last then x.i else acc.last end, 'known': list_append(acc.known, x.known[1] or x.first < acc.last), 'first': x.first}},
                          {{'i': 0::bigint, 'last': 0::bigint, 'known': []::boolean[], 'first': 0}}).known as known
                      from replay r join steps s on s.session = r.session and s.n = r.n + 1))))))),
        fold as (select id, unnest(range(0, len(known))) as block_no, unnest(known) as known, false as resent from replay where id is not null)"""


_DOC_TEXTS = f"texts as (select doc_id as id, {_SRC} as session, doc_id as step, text, false as code from documents)"
_LAST = "right(handle, 1)"
_HELD = f"case when {_LAST} in ('0', '1', '2', '3', '4') then 0 when {_LAST} in ('5', '6', '7', '8', '9') then 1 end"
#: The parts that markers can stand for, and those whose handle the chosen view prints.
_PRINTED = f"""
        , parts as (
          select id, text as part from runs where known
          union all select split_part(doc_id, ':', 1)::bigint, body from rmid
          union all select doc_id, body from wmid)
        select distinct p.id, {sql_handle('part')} as handle, strlen(part) as n_bytes
        from parts p join best b on b.id = p.id where contains(case when b.b > raw then text when stateless then sview else cview end, {sql_handle('part')})"""


ORACLE = {
    "delta_pack": _pack_sql(_DOC_TEXTS),
    "delta_code": _pack_sql(_DOC_TEXTS.replace("false as code", "doc_id % 2 = 0 as code")),
    "bench_loop": _pack_sql(
        sql_generated() + ", texts as (select id, 'loop' as session, id as step, text, content_type = 'code' as code from generated)",
        out="""select id // 2 + 1 as iteration, sum(raw)::bigint as raw, sum(s)::bigint as stateless, sum(least(b, raw))::bigint as conditional,
          sum(case when b > raw or stateless then 0 else hits end)::bigint as unchanged from best group by 1""",
    ),
    "delta_json": _pack_sql(
        """texts as (select record_id as id, stream as session, record_id as step, record as text, false as code from (
          select *, row_number() over (partition by record_id order by written_at) as k from meta_raw where record_id is not null) where k = 1)""", json=True,
    ),
    "delta_budget": _pack_sql(
        _DOC_TEXTS, fold=_budget_sql(BUDGET),
        out="""select b.id, b.session, step, case when b > raw then 'raw' when stateless then 'stateless' else 'conditional' end as choice, raw as raw_tokens, least(b, raw) as shown_tokens,
          raw - least(b, raw) as saved_tokens, case when b > raw or stateless then 0 else hits end as delta_hits, case when b > raw or stateless then 0 else r.resent end as evicted_resends, blocks, runs,
          gone as evicted, live as resident_tokens from best b join replay r on r.id = b.id""",
    ),
    "delta_recall": _pack_sql(_DOC_TEXTS, out=_PRINTED),
    "delta_ledger": _pack_sql(_DOC_TEXTS, _HELD),
    "delta_proof": _pack_sql(_DOC_TEXTS, _HELD, f"{_LAST} <> '0'"),
    "delta_versions": "select * from (" + _pack_sql("""texts as (
        select doc_id * 2 as id, doc_id::varchar as session, 0 as step, text, false as code from documents
        union all select doc_id * 2 + 1, doc_id::varchar, 1, 'Running 1' || chr(10) || chr(10) || text, false from documents)""") + ") where step = 1",
    "transcript_scan": """
        with one as (select * from (select *, row_number() over (partition by line_id order by logged_at) as k from transcript) where k = 1 and session is not null),
        x as (
          select session, line_no, concat_ws(' ', message, content) as t,
            case when (json_valid(message) and contains(message, '"/clear"')) or (json_valid(content) and contains(content, '"/clear"')) or content = '/clear' or message = '/clear' then '/clear'
              when lower(kind) = 'clear' then '/clear' when lower(kind) in ('compact', 'compaction', 'compact_complete', 'compacted') then 'compaction'
              when lower(kind) in ('session_start', 'session_restart', 'session_reset', 'restart') then 'session restart'
              when json_valid(message) and json_type(message, '$.content') = 'VARCHAR' and trim(message ->> '$.content', ' ' || chr(9) || chr(10)) = '/clear' then '/clear'
              when json_valid(content) and json_type(content) = 'VARCHAR' and trim(content ->> '$', ' ' || chr(9) || chr(10)) = '/clear' then '/clear'
              when not json_valid(content) and trim(content, ' ' || chr(9) || chr(10)) = '/clear' then '/clear' end as b
          from one),
        s as (select session, true as ok, count(*) as n_lines, arg_max(b, line_no) filter (b is not null) as last_boundary, max(line_no) filter (b is not null) as boundary_line from x group by 1),
        h as (
          select distinct session, h as handle from (select x.session, unnest(regexp_extract_all(t, 'ks2?_[0-9a-fA-F]+')) as h from x join s on s.session = x.session where boundary_line is null or line_no > boundary_line)
          where (starts_with(h, 'ks2_') and length(h) = 36) or (starts_with(h, 'ks_') and length(h) in (13, 19))),
        r as (select session, count(*) as n, array_to_string(list_sort(list(handle))[1:5], ' ') as sample from h group by 1)
        select s.*, coalesce(n, 0) as n_resident, coalesce(sample, '') as sample from s left join r on r.session = s.session""",
    "savings_sessions": f"with {_SESSIONS} select * from rated",
    "savings_ranked": f"with {_SESSIONS} select session, net, verdict from rated where session is not null",
    "savings_summary": """
        select *, saved - refetched as net from (select
          count(*) filter (event = 'compress') as compress_events,
          coalesce(sum(greatest(raw, 0)) filter (event = 'compress'), 0)::bigint as raw, coalesce(sum(greatest(shown, 0)) filter (event = 'compress'), 0)::bigint as shown,
          coalesce(sum(saved) filter (event = 'compress'), 0)::bigint as saved, coalesce(sum(greatest(delta_hits, 0)) filter (event = 'compress'), 0)::bigint as delta_hits,
          coalesce(sum(greatest(evicted, 0)) filter (event = 'compress'), 0)::bigint as evicted, count(*) filter (event = 'expand') as expand_calls,
          count(*) filter (event = 'expand' and ok = false) as failed_expands,
          coalesce(sum(greatest(tokens, 0)) filter (event = 'expand' and ok is distinct from false), 0)::bigint as refetched
        from metrics)""",
    "savings_latest": _LATEST,
    "savings_status": f"""
        with {_SESSIONS}, latest as ({_LATEST})
        select compress_events, expand_calls, raw, saved, refetched, net, reduction_pct, verdict, (select count(*) from s) as n_sessions,
          (select session from latest) as latest_session, (select count(*) from block_meta) as store_blocks, (select sum(len)::bigint from block_meta) as store_bytes
        from rated where session is null""",
    "events_savings": f"""
        with m as (select case when event_type in ('purchase', 'view', 'signup') then 'compress' else 'expand' end as event, user_id::varchar as session,
            k * 10 as raw, k as shown, null::bigint as saved, 0 as delta_hits, 0 as evicted, k as tokens, event_type <> 'error' as ok
          from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)),
        s as (select session, {_SUMS} from m group by 1)
        select {_RATED} from s""",
    "ledger_state": f"with {_STATE} select *, case code when 0 then 'resident' when 1 then 'evicted' else 'unknown' end as residency from state",
    "ledger_tokens": f"with {_STATE} select session, coalesce(sum(tokens) filter (code = 0), 0)::bigint as resident_tokens, count(*) as handles from state group by 1",
    "ledger_budget": f"""
        with {_STATE},
        o as (select session, coalesce(sum(tokens) filter (code = 0), 0) - {BUDGET} as over from state group by 1),
        r as (select session, handle, sum(tokens) over (partition by session order by step, handle) - tokens as before from state where code = 0),
        g as (select r.session, r.handle from r join o on o.session is not distinct from r.session where before < over)
        select s.session, s.handle, case when g.handle is not null then 1 else code end as code, step, tokens
        from state s left join g on g.session = s.session and g.handle = s.handle""",
    "ledger_marked": f"""
        with {_STATE},
        m as (select distinct session, handle, ok from metrics where event = 'expand' and handle is not null and session is not null),
        n as (select distinct session, handle from m where ok),
        u as (select * from state s where not exists (select 1 from n where n.session = s.session and n.handle = s.handle)
              union all select session, handle, 0, 999, 0 from n)
        select session, handle, case when exists (select 1 from m where not ok and m.session = u.session and m.handle = u.handle) then 1 else code end as code, step, tokens from u""",
    "retention_gc": f"""
        with {_BLOCKS},
        v as (select bytes as len, coalesce(greatest(1926500000 - t, 0) >= 1000000, false) as stale from (
          select *, row_number() over (partition by entry_id) as q from decision_log where redirect_to is not null) where q = 1),
        a as (select len, covered, stale, false as cache from k union all select len, false, stale, true from v)
        select count(*) as scanned, count(*) filter (stale) as deleted, count(*) filter (not stale) as kept, coalesce(sum(len) filter (stale), 0)::bigint as bytes_freed,
          count(*) filter (covered) as meta_present, count(*) filter (not covered) as meta_missing, count(*) filter (cache) as read_cache_scanned,
          count(*) filter (cache and stale) as read_cache_deleted, true as dry_run from a""",
    "retention_kept": f"with {_BLOCKS} select file_id, handle from k where not stale",
    "retention_coverage": f"""
        with {_BLOCKS} select count(*) as blocks, count(*) filter (handle in (select handle from b where has_meta)) as with_meta from (select distinct handle from ledger)""",
    "store_touch": """
        select file_id, case when greatest(1926500000 - coalesce(accessed, 0), 0) >= 60 then 1926500000 else coalesce(accessed, 0) end as accessed from block_meta""",
    "decision_tail": "select entry_id, t, reason, path from (select distinct * from decision_log where t is not null and reason is not null) order by entry_id desc limit 20",
    "decision_reasons": """
        select reason, count(*) as n, coalesce(sum(raw_tokens - view_tokens), 0)::bigint as saved from (select distinct * from decision_log where t is not null and reason is not null) group by 1""",
    "store_put": f"""
        select {sql_handle('text')} as handle, substr(sha256(text), 1, 2) as shard, strlen(text) as len, {_SRC} as first_session
        from (select *, row_number() over (partition by text order by doc_id) as k from documents where text is not null) where k = 1""",
    "store_get": f"""
        with s as (select distinct {sql_handle('text')} as handle, strlen(text) as len from documents where text is not null)
        select handle, len from (select handle from s union select handle from ledger where handle is not null) left join s using (handle)""",
    "store_expand": f"""
        with s as (select text, {sql_handle('text')} as handle, {_SRC} as src, row_number() over (partition by text order by doc_id) as k from documents where text is not null),
        p as (select text, src, handle, string_split(text, chr(10)) as p from s where k = 1),
        x as (select handle, i, p[i] as x from p, unnest(range(1, len(p) + 1)) as u(i)),
        part as (
          select handle, src, text as out, 'whole' as mode, 'api' as caller from p
          union all select p.handle, src, coalesce(string_agg(x, chr(10) order by i), ''), 'lines', 'api' from p left join x on x.handle = p.handle and i between 3 and 12 group by 1, 2
          union all select p.handle, src, coalesce(string_agg(x, chr(10) order by i), ''), 'grep', 'cli'
            from p left join x on x.handle = p.handle and i between 2 and 40 and regexp_matches(lower(x), '[aeiou]+[A-Za-z0-9_]?st[^\\n]$') group by 1, 2),
        a as (select handle, mode, caller from (select handle from s union select handle from metrics where handle is not null), (values ('whole', 'api'), ('lines', 'api'), ('grep', 'cli')) m(mode, caller))
        select a.handle, coalesce(src, 'caller') as session, coalesce({sql_tokens('out')}, 0) as tokens, part.handle is not null as ok, a.mode, a.caller
        from a left join part on part.handle = a.handle and part.mode = a.mode""",
    "store_inspect": f"""
        with {SQL_LINES},
        n as (select doc_id, count(*) as n, string_agg(regexp_replace(x, case when i < 1000000 then '\r$' else '' end, ''), chr(10) order by i) filter (i <= 3) as preview from lines group by doc_id)
        select {sql_handle('text')} as handle, strlen(text) as n_bytes, coalesce(n, 0) as n_lines, {sql_tokens('text')} as n_tokens, true as utf8, coalesce(preview, '') as preview
        from (select min(doc_id) as doc_id, text from documents group by text) left join n using (doc_id)""",
    "store_size": "select count(*) as blocks, sum(strlen(text))::bigint as bytes from (select distinct text from documents where text is not null)",
    "store_deleted": f"select distinct {sql_handle('text')} as handle from documents where strlen(text) >= 1000",
    "recall_lines": _recall_sql("true", "i between 3 and 12"),
    "recall_grep": _recall_sql(r"regexp_matches(lower(x), '[aeiou]+[A-Za-z0-9_]?st[^\n]$')", "i between 2 and 40"),
    "recall_context": _recall_sql(
        r"coalesce(max(regexp_full_match(lower(x), '[a-z0-9 .]+')::int) over (partition by doc_id order by i rows between 2 preceding and 2 following), 0) = 1", "i between 2 and 40"
    ),
    "recall_literal": _recall_sql("contains(lower(x), '(a|')"),
    "delta_residency": f"with {_SEEN} select id, block_no, handle, seen from seen",
    "delta_gated": f"""
        with {_SEEN}
        select session, count(*) filter (seen and right(handle, 1) in ('1','3','5','7','9','b','d','f')) as resident,
          count(*) filter (seen and right(handle, 1) not in ('1','3','5','7','9','b','d','f')) as gated, count(*) as blocks from seen group by 1""",
    "delta_restored": "select doc_id as id, true as same from documents where text <> ''",
}
