"""Queries on texts: scalars, predicates, tilings and stateless views over ``documents`` and the JSON of other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.functions import handles as H
from tilefold.functions import predicates as P
from tilefold.functions import text as T
from tilefold.operators import commands, decisions, documents, structural, tiles
from tilefold.plans.prefix import one_per_id
from tilefold.sources.generate import FUNCTIONS, HANDLER, edit_loop
from tilefold.sources.records import sidecars
from tilefold.sources.tables import spread, table

c = F.col


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def fn_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.tokens(c("text")).alias("n_tokens"), T.tokens_bytes(F.encode("text", "UTF-8")).alias("n_tokens_bytes"))


def fn_digests(spark: SparkSession, d: str) -> DataFrame:
    t = c("text")
    return _docs(spark, d).select(
        "doc_id", H.sha256_hex(t).alias("sha256"), H.sha1_hex(t).alias("sha1"), H.handle(t).alias("handle"),
        H.short_hex(H.sha256_hex(t)).alias("short_hex"), H.verify(H.handle(t), t).alias("own"),
        H.verify(F.upper(H.handle(t)), t).alias("upper_own"), H.verify(F.concat(F.lit("ks_"), F.substring(F.sha1(t), 1, 16)), t).alias("legacy_own"),
        H.verify(F.concat(F.lit("ks_"), F.substring(F.sha1(F.concat(t, F.lit("."))), 1, 10)), t).alias("other_own"),
        T.human_bytes(F.octet_length(t) * 1000).alias("human"), T.commafy(F.octet_length(t)).alias("grouped"),
    )


def fn_handles(spark: SparkSession, d: str) -> DataFrame:
    hs = table(spark, d, "ledger").select("handle").unionByName(table(spark, d, "metrics").select("handle")).filter("handle is not null").distinct()
    h = c("handle")
    return hs.select("handle", H.is_valid(h).alias("valid"), H.is_valid(F.concat(h, F.lit("\n"))).alias("valid_with_feed"), H.display(F.repeat(h, F.lit(3))).alias("shown"), H.shard(h).alias("shard"), H.store_path(h).alias("store_path"))


def fn_lines(spark: SparkSession, d: str) -> DataFrame:
    t = c("text")
    return _docs(spark, d).select(
        "doc_id", T.count_lines(t).alias("n_lines"), F.size(T.recall_lines(t)).alias("n_recall"), F.size(T.log_lines(t)).alias("n_log"),
        F.size(F.filter(T.tile_lines(t), T.is_blank)).alias("n_blank"), T.short(t, 12).alias("short_text"),
    )


def fn_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision_log").select("path", c("t").alias("t")).filter("path is not null").distinct()
    p = c("path")
    return rows.select(
        "path", "t", H.session_file(p).alias("session_file"), H.session_file(F.repeat(p, F.lit(8))).alias("long_file"), H.sidecar_path(p).alias("sidecar"),
        H.cache_key(F.sha2(p, 256), p).alias("cache_key"), H.session_key(F.lit(" "), p, c("t")).alias("session_key"), P.is_markdown_path(p).alias("markdown"),
    )


def fn_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "metrics").select("line_id", "raw", "shown").distinct()
    r = T.parse_range(F.concat_ws("-", F.coalesce(c("shown").cast("string"), F.lit("x")), F.concat(F.lit(" "), c("raw").cast("string"))))
    return rows.select("line_id", "raw", "shown", r["first"].alias("first"), r["last"].alias("last"), T.reduction_pct(c("raw") - c("shown"), c("raw")).alias("pct"))


def pred_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = F.transform(T.tile_lines(c("text")), T.line_text)
    left = lambda x: F.regexp_replace(x, rf"\A{T.WS}++", "")
    tests = {
        "sig": lambda x: P.is_sig(left(x)), "method": lambda x: P.is_method(left(x)), "definition": P.is_definition_start, "anchor": P.is_log_anchor,
        "important": P.important, "comment": lambda x: P.is_comment(left(x)), "closer": P.is_closer, "heading": lambda x: P.is_heading(left(x)),
        "list_item": lambda x: P.is_list_item(left(x)), "mark": P.is_markdown_mark,
    }
    return _docs(spark, d).select("doc_id", *(F.size(F.filter(lines, t)).alias(f"n_{k}") for k, t in tests.items()))


def pred_detect(spark: SparkSession, d: str) -> DataFrame:
    """Content types of pages, records and transcript contents."""
    parts = [
        table(spark, d, "documents").select(F.lit("documents").alias("origin"), c("doc_id").alias("id"), "text"),
        table(spark, d, "meta_raw").select(F.lit("meta_raw").alias("origin"), c("record_id").alias("id"), c("record").alias("text")),
        table(spark, d, "transcript").select(F.lit("transcript").alias("origin"), c("line_id").alias("id"), c("content").alias("text")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("text is not null")
    return rows.groupBy("origin", P.detect(c("text")).alias("kind"), P.looks_like_json(c("text")).alias("opens")).agg(F.count("*").alias("n"))


COMMAND_FORMS = (
    "cat {}", "cat {}.log", "cd /tmp && npm test {}", "FOO='a b' sudo /usr/bin/cargo test {}", "grep x {} | head", "echo \"a;b\" ; pytest {}", "ls {} # all", "env A=1 time make {}",
    "echo 'x > y' && rg z {}", "sleep 1 & cat {}.log", "  nice npx jest {}", "cargo build 2>&1", "go test {};tail {}.log", "A=1 B=\"x y\" {}", "tail 'b.log' {}", "/opt/x/docker ps&&du {}", "git log", "",
)


def pred_commands(spark: SparkSession, d: str) -> DataFrame:
    """Commands made of the paths of the decision log, several forms each."""
    forms = [f if "{}" in f else f + "{}" for f in COMMAND_FORMS]
    paths = table(spark, d, "decision_log").select("path").filter("path is not null").distinct()
    made = F.array(*(F.concat(F.lit(f.split("{}")[0]), c("path"), F.lit(f.split("{}")[1])) for f in forms))
    rows = paths.select("path", F.posexplode(made).alias("form", "command"))
    return rows.select("path", "form", commands.matched_program(c("command")).alias("program"))


def pred_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The decision for a read of each page, as if its source were its path."""
    t = c("text")
    # the page is read sixteen times as long, so that all size bands occur
    rows = _docs(spark, d).select(
        "doc_id", (c("doc_id") % 11 != 0).alias("gate"), F.when(c("doc_id") % 13 != 0, F.format_string("/pages/%d.txt", c("doc_id"))).alias("path"), (c("doc_id") % 7 == 0).alias("sliced"),
        F.when(c("doc_id") % 17 != 0, F.octet_length(t) * 16).cast("bigint").alias("n_bytes"), F.sha2(t, 256).alias("digest"),
        T.tokens(t).alias("raw_tokens"), T.tokens(structural.log_view(t)["view"]).alias("view_tokens"), (c("doc_id") % 3 == 0).alias("cached"), (c("doc_id") % 9 != 0).alias("healthy"),
    )
    return decisions.decide(rows).select("doc_id", "reason", "bytes", "raw_tokens", "view_tokens", "redirect_to", "note")


def gen_lines(spark: SparkSession, d: str) -> DataFrame:
    return tiles.line_ranges(_docs(spark, d), "doc_id", "text")


def _blocks(df: DataFrame, tiler) -> DataFrame:
    return tiles.exploded(df, "doc_id", tiler(c("text"))).select("doc_id", "block_no", F.octet_length("block").alias("n_bytes"), H.handle(c("block")).alias("handle"))


def gen_log_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(_docs(spark, d), tiles.log_blocks)


def gen_code_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(_docs(spark, d), tiles.code_blocks)


def gen_tiling(spark: SparkSession, d: str) -> DataFrame:
    """Whether the tiles of each tiling concatenate to the text."""
    t = c("text")
    same = {k: (F.array_join(f(t), "") == t).alias(k) for k, f in (("lines", T.tile_lines), ("log", tiles.log_blocks), ("code", tiles.code_blocks), ("sections", tiles.sections))}
    as_bytes = F.encode(t, "UTF-8")
    joined = F.aggregate(tiles.byte_tiles(as_bytes, tiles.log_blocks), F.encode(F.lit(""), "UTF-8"), lambda a, x: F.concat(a, x))
    return _docs(spark, d).select("doc_id", *same.values(), (joined == as_bytes).alias("log_bytes"))


def gen_json_tiles(spark: SparkSession, d: str) -> DataFrame:
    rows = one_per_id(table(spark, d, "meta_raw").select("record_id", "written_at", "record"), "record_id", "written_at")
    return rows.select("record_id", tiles.json_blocks(c("record")).alias("b")).select("record_id", F.size("b").alias("n_tiles"), F.octet_length(F.array_join("b", "")).alias("n_bytes"))


def gen_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = documents.section_rows(c("text"))
    out = _docs(spark, d).select("doc_id", F.posexplode(rows).alias("section_no", "s"))
    return out.select("doc_id", "section_no", "s.first_line", "s.n_lines", "s.elide")


def gen_handles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "transcript").select("line_id", F.concat_ws(" ", "message", "content").alias("t")).distinct()
    return rows.select("line_id", F.explode(F.array_distinct(H.handles_in(c("t")))).alias("handle"))


def gen_synthetic(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the generated files and logs of an edit and test loop."""
    return edit_loop(spark).select("id", "content_type", T.tokens(c("text")).alias("n_tokens"), T.count_lines(c("text")).alias("n_lines"))


def view_log(spark: SparkSession, d: str) -> DataFrame:
    v = structural.log_view(c("text"))
    return _docs(spark, d).withColumn("v", v).select("doc_id", F.sha2(c("v.view"), 256).alias("view_sha"), T.tokens(c("v.view")).alias("shown"), F.get(c("v.elided"), F.lit(0))["handle"].alias("handle"))


def view_code(spark: SparkSession, d: str) -> DataFrame:
    v = structural.code_view(c("text"))
    return _docs(spark, d).withColumn("v", v).select("doc_id", T.tokens(c("v.view")).alias("shown"), F.size("v.elided").alias("n_elided"))


def view_json(spark: SparkSession, d: str) -> DataFrame:
    rows = one_per_id(table(spark, d, "transcript").select("line_id", "message", "logged_at").filter("message is not null"), "line_id", "logged_at")
    return rows.select("line_id", "message", structural.json_view(c("message")).alias("v")).select(
        "line_id", T.tokens(c("message")).alias("raw"), T.tokens(c("v.view")).alias("shown"), F.size("v.elided").alias("n_elided"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    label = F.format_string("pages/%d.md", c("doc_id"))
    return _docs(spark, d).select("doc_id", documents.pack_document(label, F.encode("text", "UTF-8")).alias("p"))


def view_document(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("doc_id", "p.handle", "p.raw_tokens", "p.packed_tokens", "p.elisions")


def gen_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Packed views read back: their markers must be the sections that were elided."""
    m = _packed(spark, d).select("doc_id", c("p.elisions").alias("elisions"), documents.manifest(c("p.view")).alias("m"))
    lines = F.aggregate("m.markers", F.lit(0).cast("bigint"), lambda a, x: a + x["last_line"] - x["first_line"] + 1)
    return m.select("doc_id", c("m.source").alias("source"), c("m.handle").alias("handle"), F.size("m.markers").cast("bigint").alias("markers"), lines.alias("elided_lines"), (F.size("m.markers") == c("elisions")).alias("complete"))


def view_cache(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(c("doc_id") % 2 == 0, F.format_string("/p/%d.md", c("doc_id"))).otherwise(F.format_string("/p/%d.txt", c("doc_id")))
    v = documents.cache_view(path, c("text"))
    return _docs(spark, d).select("doc_id", v.alias("v")).select("doc_id", T.tokens(c("v")).alias("shown"), T.count_lines(c("v")).alias("n_lines"))


def sink_sidecars(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select(F.format_string("pages/%d.txt", c("doc_id")).alias("path"), F.encode("text", "UTF-8").alias("bytes"))
    return sidecars(docs).select("path", "out_path", "raw_tokens", "packed_tokens", "written")


QUERIES = {
    f.__name__: f
    for f in (
        fn_tokens, fn_digests, fn_handles, fn_lines, fn_names, fn_ranges, pred_lines, pred_detect, pred_commands, pred_decisions, gen_lines, gen_log_blocks,
        gen_code_blocks, gen_tiling, gen_json_tiles, gen_sections, gen_handles, gen_synthetic, gen_manifest, view_log, view_code, view_json, view_document,
        view_cache, sink_sidecars,
    )
}


def sql_tokens(t: str) -> str:
    """The token estimate in SQL."""
    a, g, s = (f"length(regexp_replace({t}, '[^{k}]', '', 'g'))" for k in ("A-Za-z", "0-9", r" \t\n\r"))
    units = f"(length({t}) + length(regexp_replace({t}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
    return f"cast(ceil({a} * 0.196::double + {g} * 0.699::double + ({units} - {a} - {g} - {s}) * 0.65::double + {s} * 0.433::double) as bigint)"


def sql_handle(t: str) -> str:
    return f"'ks2_' || left(sha256({t}), 32)"


def sql_lines(texts: str, key: str, name: str = "lines") -> str:
    """A CTE with the lines of ``texts`` by the tiling rule: i from 1, x without and l with the line feed."""
    return f"""
{name} as (
  select {key} as doc_id, i, p[i] as x, p[i] || case when i < len(p) then chr(10) else '' end as l
  from (select {key}, string_split(text, chr(10)) as p from {texts}) s, unnest(range(1, len(p) + 1)) as u(i)
  where not (i = len(p) and p[i] = ''))"""


SQL_LINES = sql_lines("documents", "doc_id")


def _words(words: tuple[str, ...]) -> str:
    """The marked word lists of the classifiers as an alternation inside an SQL text."""
    return P.any_of(words).replace("'", "''")


_DEFINITION = "^" + _words(P.DEFINITIONS)
_BLANK = r"regexp_full_match(x, '[ \t\r]*')"
_ANCHOR = rf"regexp_matches(x, '^[ \t]*{_words(P.LOG_ANCHORS)}|{_words(P.LOG_ANCHORS_INSIDE)}')"
_WS = r"[\t-\r \x{85}\p{Z}]"
_MARK = rf"regexp_matches(x, '^{_WS}*(#{{1,6}} |[-*+] |[0-9]+[.)] |>|```)')"
_FENCE = rf"regexp_matches(x, '^{_WS}*```')"
_EMPTY = rf"regexp_full_match(x, '{_WS}*')"
_IMPORTANT = rf"""(regexp_matches(lower(x), '{_words(P.SEVERITY)}|npm err!|: warning ts')
  or regexp_matches(x, '{_words(P.GLYPHS)}') or regexp_matches(lower(x), '^{_WS}*(traceback \(most recent call last\)|caused by:|file ".*", line )')
  or regexp_matches(x, '^{_WS}*(at .*:|\* What went wrong|\* Try:)'))"""
_TEXT = r"regexp_replace(l, '\r*\n*$', '')"


def sql_log_blocks(lines: str) -> str:
    """CTEs that end in blocks (doc_id, block_no, block) of logs."""
    return f"""
flags as (select *, {_BLANK} as blank, {_ANCHOR} as anchor from {lines}),
hard as (select *, i > 1 and (blank or anchor or lag(blank, 1, false) over (partition by doc_id order by i)) as cut from flags),
seg as (select *, sum(cut::int) over (partition by doc_id order by i) as s from hard),
sixes as (select *, (row_number() over (partition by doc_id, s order by i) - 1) // 6 as q from seg),
blocks as (
  select doc_id, row_number() over (partition by doc_id order by min(i)) - 1 as block_no, string_agg(l, '' order by i) as block
  from sixes group by doc_id, s, q)"""


LOG_BLOCKS = sql_log_blocks("lines")


def sql_log_view(p: str, lines: str) -> str:
    """CTEs that view the texts of ``lines`` (doc_id, i, x, l) as logs: <p>mid (doc_id, body) and <p>views (doc_id, view)."""
    return f"""
{p}n as (select doc_id, count(*) as n from {lines} group by doc_id),
{p}li as (select l.*, n.n, {_TEXT} as t from {lines} l join {p}n n using (doc_id)),
{p}mid as (
  select doc_id, string_agg(l, '' order by i) as body, count(*) as k from {p}li where n > 24 and i > 10 and i <= n - 6 group by doc_id),
{p}keyed as (
  select doc_id, i, x as t, row_number() over (partition by doc_id order by i) as k
  from (select doc_id, i, t as x from {p}li where n > 24 and i > 10 and i <= n - 6) where {_IMPORTANT}),
{p}parts as (
  select doc_id, i as o, t from {p}li where n <= 24 or i <= 10 or i > n - 6
  union all select doc_id, 10.3, '[Tilefold: key lines from the elided middle]' from (select distinct doc_id from {p}keyed)
  union all select doc_id, 10.4 + k / 1000.0, t from {p}keyed where k <= 12
  union all select doc_id, 10.6, '[Tilefold: ' || k || ' lines elided · ~' || {sql_tokens("body")} || ' tok · recall ' || {sql_handle("body")} || ']' from {p}mid),
{p}views as (select doc_id, string_agg(t, chr(10) order by o) as view from {p}parts group by doc_id)"""


_SIG = f"""(regexp_matches(y, '^{_words(P.SIGNATURES)}')
  or (regexp_matches(y, '^(const |let |var )') and contains(y, '=') and (contains(y, 'function') or contains(y, '=>') or regexp_matches(y, '\\{{{_WS}*$'))))"""
_METHOD = f"""(ends_with(z, '{{') and contains(y, '(') and contains(y, ')') and regexp_matches(y, '^[\\p{{L}}\\p{{N}}_$]')
  and not regexp_matches(y, '^{_words(P.CONTROL)}([^\\p{{L}}\\p{{N}}_$]|$)'))"""
_COMMENT = "regexp_matches(y, '^(//|#|[*]|/[*]|--)')"
_CLOSER = r"(regexp_full_match(z, '[\])};,]+') and regexp_matches(z, '[\])}]'))"
_TRIMMED = f"regexp_replace(x, '^{_WS}+', '') as y, regexp_replace(x, '{_WS}+$', '') as z"


def sql_detected(lines: str) -> str:
    """A CTE detected (doc_id, code) for texts that are no JSON: whether their first lines hold enough signatures."""
    return f"""
sniff as (select doc_id, {_SIG} or {_METHOD} as sig from (select doc_id, x, {_TRIMMED} from {lines} where i <= 400) where y <> ''),
detected as (select doc_id, count(*) >= 8 and count(*) filter (sig) / count(*) >= 0.06 as code from sniff group by doc_id)"""


def sql_code_view(p: str, lines: str) -> str:
    """CTEs that view the texts of ``lines`` as code: <p>codes (doc_id, view, n_elided)."""
    called = r"'(?:^|[^.\p{L}\p{N}_$])([\p{L}_$][\p{L}\p{N}_$]*) *\('"
    return f"""
{p}cflag as (select *, {_EMPTY} or {_COMMENT} or {_CLOSER} or {_SIG} or {_METHOD} as keep from (select *, {_TRIMMED} from {lines})),
{p}cisle as (select *, case when keep then -i else i - row_number() over (partition by doc_id, keep order by i) end as isle from {p}cflag),
{p}cpart as (
  select doc_id, min(i) as first, bool_and(keep) as keep, count(*) as n, string_agg(l, '' order by i) as body, string_agg({_TEXT}, chr(10) order by i) as kept
  from {p}cisle group by doc_id, isle),
{p}ccall as (
  select *, list_filter(regexp_extract_all(replace(body, '(', '(' || chr(1)), {called}, 1), lambda w: not list_contains({list(P.BODY_WORDS)}, w)) as names from {p}cpart),
{p}cuniq as (select *, list_filter(names, lambda w, k: list_position(names, w) = k)[1:3] as three from {p}ccall),
{p}cmark as (
  select *, '[Tilefold: ' || n || '-line body' || case when len(three) > 0 then ' · calls ' || array_to_string(three, ', ') else '' end || ' · recall ' || {sql_handle('body')} || ']' as marker from {p}cuniq),
{p}cshow as (select *, not keep and n >= {structural.MIN_RUN} and {sql_tokens('body')} > {sql_tokens('marker')} as gone from {p}cmark),
{p}codes as (select doc_id, string_agg(case when gone then marker else kept end, chr(10) order by first) as view, count(*) filter (gone) as n_elided from {p}cshow group by doc_id)"""


def sql_code_blocks(lines: str) -> str:
    """CTEs that end in codeblocks (doc_id, block_no, block)."""
    return f"""
cbf as (select *, regexp_matches(x, '{_DEFINITION}') as def, {_BLANK} as blank from {lines}),
cbg as (select *, bool_or(def) over (partition by doc_id) as has, lag(blank, 1, false) over (partition by doc_id order by i) as after from cbf),
cbb as (select *, sum(case when has then def::int else after::int end) over (partition by doc_id order by i) as b from cbg),
codeblocks as (select doc_id, row_number() over (partition by doc_id order by b) - 1 as block_no, string_agg(l, '' order by i) as block from cbb group by doc_id, b)"""


_SECTIONS = f"""
f as (select *, {_FENCE} as fence, {_MARK} as mark, {_EMPTY} as empty from lines),
f2 as (select *, sum(fence::int) over (partition by doc_id order by i) as fences from f),
kind as (select *, fence or fences % 2 = 1 as inside, ceil(fences / 2.0) as fence_no from f2),
own as (
  select *, case when inside then 'f' || fence_no when mark or empty then 's' || i else null end as solo,
    row_number() over (partition by doc_id order by i) - row_number() over (partition by doc_id, inside or mark or empty order by i) as island from kind),
sec as (
  select doc_id, min(i) as first_line, count(*) as n_lines, sum(length(x) + 1) as chars, bool_and(solo is null) as prose, string_agg(x, chr(10) order by i) as body
  from own group by doc_id, coalesce(solo, 'p' || island)),
secs as (
  select *, row_number() over (partition by doc_id order by first_line) - 1 as section_no,
    prose and ((n_lines = 1 and chars >= 500) or (n_lines >= 3 and chars >= 300)) as elide from sec)"""


_PACKED = f"""
        with {SQL_LINES}, {_SECTIONS},
        body as (
          select doc_id, count(*) filter (elide) as elisions, string_agg(case when elide then '[Tilefold: section omitted · ~' || {sql_tokens('body')} || ' tokens · exact recall available] <!-- tf-recall handle='
            || h || ' lines=' || first_line || '-' || (first_line + n_lines - 1) || ' tokens=' || {sql_tokens('body')} || ' -->' else body end || chr(10), '' order by section_no) as b
          from secs join (select doc_id, {sql_handle('text')} as h from documents) using (doc_id) group by doc_id),
        v as (
          select d.doc_id, @path@ as path, text, {sql_handle('text')} as handle, coalesce(elisions, 0) as elisions, '<!-- tf-pack source=' || @path@ || ' handle=' || {sql_handle('text')} || ' -->' || chr(10)
            || '<!-- tilefold inspect <this-file>  ·  tilefold expand ' || {sql_handle('text')} || '  (full original) -->' || chr(10) || chr(10) || coalesce(b, '') as view
          from documents d left join body using (doc_id)),
        packed as (select doc_id, path, handle, {sql_tokens('text')} as raw_tokens, {sql_tokens('view')} as packed_tokens, elisions from v)"""

_DISTINCT_PATHS = "select distinct path, t from decision_log where path is not null"

_HEADER = """'<!-- Tilefold cached view of ' || path || ' -->' || chr(10) || '<!-- made from bytes with sha256 ' || sha256(text) || '; nothing but the view below was shortened -->' || chr(10)
  || '<!-- whole source again: read the file itself, or tilefold expand ' || @handle@ || ' -->' || chr(10) || chr(10) || '[Tilefold: view from the read cache · source unchanged on disk]' || chr(10) || chr(10)"""
_COUNTED = "length({0}) - length(replace({0}, chr(10), '')) + case when {0} <> '' and not ends_with({0}, chr(10)) then 1 else 0 end"


def sql_generated() -> str:
    """The generated files and logs as (id, content_type, text)."""
    handler = "'" + "\n".join(HANDLER).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"""
k as (select unnest(range(0, 6)) as k),
j as (select unnest(range(0, {FUNCTIONS})) as i),
files as (
  select k * 2 as id, 'code' as content_type, '// service.js — request handlers' || chr(10) || chr(10) ||
    string_agg(replace(replace({handler}, '%1$d', i::varchar), '%2$d', (case when i < k then i + 100 else i end)::varchar), chr(10) order by i) as text from k, j group by k),
logs as (
  select k * 2 + 1 as id, 'log' as content_type, '> service@1.0.0 test' || chr(10) || '> jest --runInBand' || chr(10) || chr(10) ||
    string_agg(case when i < greatest(4 - k, 0) then 'FAIL' else 'PASS' end || '  src/handler' || i || '.test.js', chr(10) order by i) || chr(10) || chr(10) || 'Tests: ' || ({FUNCTIONS} - greatest(4 - k, 0))
    || ' passed, ' || greatest(4 - k, 0) || ' failed, {FUNCTIONS} total' || chr(10) || 'Time: 3.2 s' as text from k, j group by k),
generated as (select * from files union all select * from logs)"""


def sql_json_view(p: str, texts: str) -> str:
    """CTEs that view the JSON texts of ``texts`` (id, text), read character by character: <p>jviews (id, view, n_elided), tiles in <p>jnum."""
    ws = "' ' || chr(9) || chr(10) || chr(13)"
    plain = "not w.esc and not w.quoted"
    return f"""
{p}jm as (select id, text, string_split(text, '') as c, length(text) - length(ltrim(text, {ws})) as lead from {texts}),
{p}walk as (
  select id, lead + 2 as i, 1 as depth, false as quoted, false as esc, [lead + 1] as cuts, false as closed from {p}jm where substr(text, lead + 1, 1) in ('{{', '[')
  union all
  select w.id, i + 1, case when {plain} and x in ('{{', '[') then depth + 1 when {plain} and x in ('}}', ']') then depth - 1 else depth end,
    case when w.esc then w.quoted when x = '"' then not w.quoted else w.quoted end, not w.esc and w.quoted and x = '\\',
    case when {plain} and x in ('}}', ']') and depth = 1 then w.cuts || [i - 1, i] when {plain} and x = ',' and depth = 1 then w.cuts || [i] else w.cuts end,
    {plain} and x in ('}}', ']') and depth = 1
  from (select w.*, m.c[w.i] as x from {p}walk w join {p}jm m on m.id = w.id where not w.closed and w.i <= len(m.c)) w),
{p}jcut as (select {p}jm.id, text, case when w.id is null then [0, length(text)] else [0] || w.cuts || [length(text)] end as cuts from {p}jm left join (select * from {p}walk where closed) w on w.id = {p}jm.id),
{p}jtile as (select id, k, substr(text, cuts[k] + 1, cuts[k + 1] - cuts[k]) as tile from {p}jcut, unnest(range(1, len(cuts))) as u(k) where cuts[k + 1] > cuts[k]),
{p}jnum as (select *, ltrim(tile, {ws}) as body, row_number() over (partition by id order by k) as n, count(*) over (partition by id) as last from {p}jtile),
{p}jshow as (
  select *, last > 1 and n > 1 and n < last and not (n = last - 1 and tile in ('}}', ']')) and strlen(body) > {structural.KEEP_BYTES} as gone,
    regexp_extract(body, '^"((?:[^"\\\\]|\\\\(?s:.))*)"', 1) as key, starts_with(body, '"') as keyed from {p}jnum),
{p}jviews as (
  select id, count(*) filter (gone) as n_elided, string_agg(case when gone then left(tile, length(tile) - length(body)) || case when keyed then '"' || key || '": ' else '' end
    || '[Tilefold: section omitted · ~' || {sql_tokens('tile')} || ' tokens · recall ' || {sql_handle('tile')} || ']' || case when ends_with(tile, ',') then ',' else '' end else tile end, '' order by n) as view
  from {p}jshow group by id)"""


_FORMS = ", ".join("'" + (f if "{}" in f else f + "{}").replace("'", "''") + "'" for f in COMMAND_FORMS)

ORACLE = {
    "view_json": f"""
        with recursive one as (
          select line_id as id, message as text from (select *, row_number() over (partition by line_id order by logged_at) as k from transcript where message is not null) where k = 1 or line_id is null),
        {sql_json_view('d', 'one')}
        select one.id as line_id, {sql_tokens('text')} as raw, {sql_tokens("coalesce(view, '')")} as shown, coalesce(n_elided, 0) as n_elided from one left join djviews using (id)""",
    "gen_synthetic": f"with {sql_generated()} select id, content_type, {sql_tokens('text')} as n_tokens, {_COUNTED.format('text')} as n_lines from generated",
    "view_code": f"""
        with {SQL_LINES}, {sql_code_view('d', 'lines')}
        select d.doc_id, {sql_tokens("coalesce(view, '')")} as shown, coalesce(n_elided, 0) as n_elided from documents d left join dcodes using (doc_id)""",
    "view_cache": f"""
        with {SQL_LINES}, {_SECTIONS}, {sql_detected('lines')}, {sql_code_view('d', 'lines')}, {sql_log_view('w', 'lines')},
        md as (
          select doc_id, string_agg(case when elide then '[Tilefold: section omitted · ~' || {sql_tokens('body')} || ' tokens · exact recall available] <!-- tf-recall handle='
            || h || ' lines=' || first_line || '-' || (first_line + n_lines - 1) || ' tokens=' || {sql_tokens('body')} || ' -->' else body end || chr(10), '' order by section_no) as b
          from secs join (select doc_id, {sql_handle('text')} as h from documents) using (doc_id) group by doc_id),
        v as (
          select doc_id, {_HEADER.replace('@handle@', sql_handle('text'))} || coalesce(case when path like '%.md' then b when code then c.view else w.view end, '') as v
          from (select doc_id, text, '/p/' || doc_id || case when doc_id % 2 = 0 then '.md' else '.txt' end as path from documents)
            left join md using (doc_id) left join detected using (doc_id) left join dcodes c using (doc_id) left join wviews w using (doc_id))
        select doc_id, {sql_tokens('v')} as shown, {_COUNTED.format('v')} as n_lines from v""",
    "pred_detect": f"""
        with t as (
          select 'documents' as origin, doc_id as id, text from documents where text is not null
          union all select 'meta_raw', record_id, record from meta_raw where record is not null union all select 'transcript', line_id, content from transcript where content is not null),
        u as (select row_number() over () as doc_id, * from t),
        {sql_lines('u', 'doc_id')}, {sql_detected('lines')},
        o as (select origin, text, coalesce(code, false) as code, regexp_matches(text, '^[ \\t\\r\\n]{{0,63}}[{{\\[]') as opens from u left join detected using (doc_id))
        select origin, case when opens and json_valid(text) then 'json' when code then 'code' else 'log' end as kind, opens, count(*) as n from o group by all""",
    "gen_json_tiles": """
        with one as (select * from (select *, row_number() over (partition by record_id order by written_at) as k from meta_raw) where k = 1 or record_id is null),
        m as (select record_id, record, case when json_valid(record) then case json_type(record) when 'OBJECT' then len(json_keys(record)) when 'ARRAY' then json_array_length(record) end end as n from one)
        select record_id, case when record is null then null when record = '' then 0 when n is null then 1 when n = 0 then 2 else n + 2 end as n_tiles, strlen(record) as n_bytes from m""",
    "fn_tokens": f"select doc_id, {sql_tokens('text')} as n_tokens, {sql_tokens('text')} as n_tokens_bytes from documents",
    "fn_digests": """
        select doc_id, sha256(text) as sha256, sha1(text) as sha1, 'ks2_' || left(sha256(text), 32) as handle, left(sha256(text), 8) || '…' as short_hex,
          true as own, false as upper_own, true as legacy_own, false as other_own,
          case when strlen(text) * 1000 >= 1048576 then printf('%.1f MB', strlen(text) * 1000 / 1048576.0)
               when strlen(text) * 1000 >= 1024 then (strlen(text) * 1000 // 1024) || ' KB' else (strlen(text) * 1000) || ' B' end as human,
          format('{:,}', strlen(text)) as grouped
        from documents""",
    "fn_handles": r"""
        select handle, regexp_full_match(handle, 'ks2_[0-9a-fA-F]{32}|ks_([0-9a-fA-F]{10}|[0-9a-fA-F]{16})') as valid, false as valid_with_feed,
          case when length(handle) * 3 > 64 then left(repeat(handle, 3), 64) || '… (' || length(handle) * 3 || ' chars total)' else repeat(handle, 3) end as shown,
          substr(handle, instr(handle, '_') + 1, 2) as shard, substr(handle, instr(handle, '_') + 1, 2) || '/' || handle as store_path
        from (select handle from ledger union select handle from metrics) where handle is not null""",
    "fn_lines": f"""
        with {SQL_LINES}
        select d.doc_id, coalesce(c.n, 0) as n_lines, len(string_split(text, chr(10))) as n_recall, coalesce(c.n, 0) as n_log, coalesce(c.b, 0) as n_blank,
          case when length(text) > 12 then left(text, 11) || '…' else text end as short_text
        from documents d left join (select doc_id, count(*) as n, count(*) filter ({_BLANK}) as b from lines group by doc_id) c using (doc_id)""",
    "fn_names": rf"""
        select path, t, regexp_replace(path, '[^A-Za-z0-9_-]', '_', 'g') || '.tsv' as session_file,
          case when length(path) * 8 > 128 then left(regexp_replace(repeat(path, 8), '[^A-Za-z0-9_-]', '_', 'g'), 111) || '_' || left(sha1(repeat(path, 8)), 16)
               else regexp_replace(repeat(path, 8), '[^A-Za-z0-9_-]', '_', 'g') end || '.tsv' as long_file,
          case when regexp_matches(path, '\.[^./]*$') then regexp_replace(path, '\.([^./]*)$', '.tilefold.\1') else path || '.tilefold.md' end as sidecar,
          left(sha256(path), 32) || '_' || left(sha1(path), 8) || '.md' as cache_key,
          'fallback-' || left(sha1(path), 8) || '-' || (t // 86400) as session_key,
          regexp_matches(lower(path), '[^/]\.(md|markdown|mdown|mkd|mkdn)$') as markdown
        from ({_DISTINCT_PATHS})""",
    "fn_ranges": """
        select line_id, raw, shown, case when raw >= 0 and shown >= 0 then shown end as first, case when raw >= 0 and shown >= 0 then raw end as last,
          case when raw > 0 then ((raw - shown) * 100 - ((raw - shown) * 100) % raw) // raw end as pct
        from (select distinct line_id, raw, shown from metrics)""",
    "pred_lines": rf"""
        with {SQL_LINES},
        t as (select doc_id, x, l, regexp_replace(x, '^{_WS}+', '') as y, regexp_replace(x, '{_WS}+$', '') as z from (select doc_id, {_TEXT} as x, l from lines))
        select d.doc_id,
          count(*) filter ({_SIG}) as n_sig, count(*) filter ({_METHOD}) as n_method,
          count(*) filter (regexp_matches(x, '{_DEFINITION}')) as n_definition,
          count(*) filter ({_ANCHOR}) as n_anchor,
          count(*) filter ({_IMPORTANT}) as n_important,
          count(*) filter ({_COMMENT}) as n_comment,
          count(*) filter ({_CLOSER}) as n_closer,
          count(*) filter (regexp_matches(y, '^#{{1,6}} ')) as n_heading,
          count(*) filter (regexp_matches(y, '^([-*+] |[0-9]+[.)] )')) as n_list_item,
          count(*) filter ({_MARK}) as n_mark
        from t join documents d using (doc_id) group by d.doc_id
        union all select doc_id, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 from documents where text = ''""",
    "gen_lines": f"""
        with {SQL_LINES}
        select doc_id, i - 1 as line_no, e - strlen(l) as start, e as end
        from (select doc_id, i, l, sum(strlen(l)) over (partition by doc_id order by i) as e from lines)""",
    "gen_log_blocks": f"with {SQL_LINES}, {LOG_BLOCKS} select doc_id, block_no, strlen(block) as n_bytes, {sql_handle('block')} as handle from blocks",
    "gen_tiling": "select doc_id, true as lines, true as log, true as code, true as sections, true as log_bytes from documents",
    "gen_sections": f"with {SQL_LINES}, {_SECTIONS} select doc_id, section_no, first_line, n_lines, elide from secs",
    "gen_handles": """
        with t as (select distinct line_id, concat_ws(' ', message, content) as t from transcript)
        select distinct line_id, h as handle from t, unnest(regexp_extract_all(t, 'ks2?_[0-9a-fA-F]+')) as u(h)
        where (h like 'ks2\\_%' escape '\\' and length(h) = 36) or (h like 'ks\\_%' escape '\\' and length(h) in (13, 19))""",
    "view_log": f"""
        with {SQL_LINES}, {sql_log_view('', 'lines')}
        select d.doc_id, sha256(coalesce(view, '')) as view_sha, {sql_tokens("coalesce(view, '')")} as shown, case when m.doc_id is not null then {sql_handle('body')} end as handle
        from documents d left join views v using (doc_id) left join mid m using (doc_id)""",
    "gen_code_blocks": f"with {SQL_LINES}, {sql_code_blocks('lines')} select doc_id, block_no, strlen(block) as n_bytes, {sql_handle('block')} as handle from codeblocks",
    "pred_decisions": f"""
        with {SQL_LINES}, {sql_log_view('', 'lines')},
        r as (
          select doc_id, doc_id % 11 <> 0 as gate, case when doc_id % 13 <> 0 then '/pages/' || doc_id || '.txt' end as path, doc_id % 7 = 0 as sliced,
            case when doc_id % 17 <> 0 then strlen(text) * 16 end as n, sha256(text) as digest, {sql_tokens('text')} as raw, {sql_tokens("coalesce(view, '')")} as shown,
            doc_id % 3 = 0 as cached, doc_id % 9 <> 0 as healthy
          from documents left join views using (doc_id)),
        p as (select *, case when raw > 0 then trunc((raw - shown) * 100.0 / raw) else 0 end as pct from r),
        d as (select *, case when not gate then 'gate-disabled' when path is null then 'bad-input' when sliced then 'slicing-requested' when n is null then 'file-unreadable'
            when n < 8192 then 'too-small' when n > 4194304 then 'too-large' when pct < 25 then 'worse-than-raw' when cached and healthy then 'cache-hit' else 'redirect-emitted' end as reason from p)
        select doc_id, reason, case when reason in ('too-small', 'too-large', 'worse-than-raw', 'cache-hit', 'redirect-emitted') then n end as bytes,
          case when reason in ('worse-than-raw', 'cache-hit', 'redirect-emitted') then raw end as raw_tokens, case when reason in ('worse-than-raw', 'cache-hit', 'redirect-emitted') then shown end as view_tokens,
          case when reason in ('cache-hit', 'redirect-emitted') then left(digest, 32) || '_' || left(sha1(path), 8) || '.md' end as redirect_to,
          case when reason = 'redirect-emitted' and cached then 'regenerated' end as note
        from d""",
    "view_document": _PACKED.replace("@path@", "'pages/' || d.doc_id || '.md'") + " select doc_id, handle, raw_tokens, packed_tokens, elisions from packed",
    "sink_sidecars": _PACKED.replace("@path@", "'pages/' || d.doc_id || '.txt'")
    + " select path, replace(path, '.txt', '.tilefold.txt') as out_path, raw_tokens, packed_tokens, packed_tokens < raw_tokens as written from packed",
    "gen_manifest": f"""
        with {SQL_LINES}, {_SECTIONS},
        m as (select doc_id, count(*) as markers, sum(n_lines) as elided_lines from secs where elide group by doc_id)
        select d.doc_id, 'pages/' || d.doc_id || '.md' as source, {sql_handle('text')} as handle, coalesce(markers, 0) as markers, coalesce(elided_lines, 0)::bigint as elided_lines, true as complete
        from documents d left join m using (doc_id)""",
    "pred_commands": rf"""
        with made as (
          select path, u.i - 1 as form, replace(f[u.i], '{{}}', path) as cmd
          from (select distinct path from decision_log where path is not null), (select [{_FORMS}] as f) x, unnest(range(1, {len(COMMAND_FORMS) + 1})) as u(i)),
        bare as (select *, regexp_replace(cmd, '"[^"]*("|$)|''[^'']*(''|$)', ' ', 'g') as b from made),
        told as (select *, regexp_matches(b, '[|<>]|tilefold') or regexp_matches(b, '(^|[^&>])&([^&>]|$)') or regexp_matches(b, '(^|[ \t;()|&<>])#') or trim(cmd) = '' as leave from bare),
        kept as (
          select *, regexp_split_to_array(b, ';|&&') as p, regexp_split_to_array(list_reduce(regexp_extract_all(cmd, '"[^"]*(?:"|$)|''[^'']*(?:''|$)'),
            lambda acc, x: replace(acc, x, translate(x, ';&', chr(1) || chr(2))), cmd), ';|&&') as raw from told),
        seg as (select path, form, leave, k, trim(p[k]) as s, raw[k] as raw from kept, unnest(range(1, len(p) + 1)) as v(k)),
        prog as (
          select *, regexp_replace(regexp_extract(regexp_replace(s, '^(([A-Za-z_][A-Za-z0-9_]*=[^ ]*|([^ ]*[/\\])?({'|'.join(commands.WRAPPERS)}))( +|$))+', ''), '^[^ ]+'), '^.*[/\\]', '') as w from seg),
        hit as (select *, list_contains({list(commands.PROGRAMS)}, w) or (list_contains({list(commands.LOG_PROGRAMS)}, w) and contains(raw, '.log')) as h from prog)
        select path, form, first(w order by k) filter (h and not leave) as program from hit group by path, form""",
}
