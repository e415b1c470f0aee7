"""The p1 to p5 queries with their production parameters, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilefold.operators import badrows, compaction, drift, features, nested
from tilefold.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.object_keys(spark, nested.write_tagged(table(spark, d, "transcript")))


def _p1_links(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The flat tables but ``line`` (whose rows have no parent), and the keys that are parents."""
    path = nested.write_tagged(table(spark, d, "transcript"))
    tables = {tag: nested.read_table(spark, path, tag) for tag in nested.SCHEMAS}
    parents = tables["line"].select("line_id", F.lit(0).cast("bigint").alias("parent_no"))
    for tag in ("message", "content", "object", "detail"):
        parents = parents.unionByName(tables[tag].select("line_id", F.col("node_no").alias("parent_no")))
    return tables, parents


def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each flat table, and of those whose parent is no row of a table (0: every child names its parent)."""
    tables, parents = _p1_links(spark, d)
    known = parents.withColumn("_there", F.lit(True))
    counts = tables["line"].agg(F.lit("line").alias("tag"), F.count("*").alias("n_rows"), F.lit(0).cast("bigint").alias("n_orphans"))
    for tag, rows in tables.items():
        if tag != "line":
            up = rows.select("line_id", "parent_no").join(known, ["line_id", "parent_no"], "left")
            counts = counts.unionByName(up.agg(F.lit(tag).alias("tag"), F.count("*").alias("n_rows"), F.count_if(F.col("_there").isNull()).alias("n_orphans")))
    return counts


def p1_objects(spark: SparkSession, d: str) -> DataFrame:
    """Every content object with its columns, the number of its fields, and the object or line above it."""
    path = nested.write_tagged(table(spark, d, "transcript"))
    return nested.read_table(spark, path, "object").select("line_id", "parent_path", "node_path", "via", "type", "role", "name", "is_error", "n_fields").distinct()


def p1_roles(spark: SparkSession, d: str) -> DataFrame:
    """Every role: of lines, of messages at any depth, of content objects."""
    path = nested.write_tagged(table(spark, d, "transcript"))
    found = None
    for tag in ("line", "message", "object"):
        rows = nested.read_table(spark, path, tag).select("line_id", (F.lit("") if tag == "line" else F.col("node_path")).alias("node_path"), "role")
        rows = rows.withColumn("tag", F.lit(tag)).filter("role is not null")
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return features.filled(features.feature_blocks(table(spark, d, "metrics"))).select("session", "event")


def p2_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every filled cell with its count, recency and total, out of the feature table."""
    return features.filled(features.feature_blocks(table(spark, d, "metrics")))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    """One row per session with every event type, in the maps of its blocks."""
    return features.feature_blocks(table(spark, d, "metrics"))


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per session out of the feature table: its event types, lines, latest time and total."""
    rows = features.feature_blocks(table(spark, d, "metrics"))
    maps = [c for c in rows.columns if c != "session"]
    cells = F.flatten(F.array(*(F.coalesce(F.map_values(m), F.array()) for m in maps)))

    def total(field: str):
        return F.aggregate(cells, F.lit(0).cast("bigint"), lambda acc, x: acc + x[field])

    last = F.array_max(F.transform(cells, lambda x: x["last_t"]))
    return rows.select("session", F.size(cells).alias("n_types"), total("n").alias("n_lines"), last.alias("last_t"), total("total_saved").alias("total_saved"))


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    """Plain feature columns of two chosen event types; ``p2_table`` has all of them."""
    return features.wide(features.feature_blocks(table(spark, d, "metrics")), ["compress", "expand"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.reasons(table(spark, d, "metrics_raw"))


def p3_rejected(spark: SparkSession, d: str) -> DataFrame:
    """The failing lines as they are, with all their errors in order."""
    bad = badrows.rejected(table(spark, d, "metrics_raw"))
    return bad.select("row_id", "reason", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["reason"], e["field"])), " ").alias("errors"), "line")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return badrows.loaded(table(spark, d, "metrics_raw"))


def _compacted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan, rewritten, and its reconciliation; the target of 1 MiB suits sidecar records of some hundred bytes."""
    planned = compaction.plan(compaction.frozen_manifest(files), 1 << 20)
    return planned, compaction.reconcile(planned, compaction.rewrite(files, planned))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files with the same record, out of a plan that was rewritten and agrees with what was written."""
    files = table(spark, d, "block_meta")
    planned, report = _compacted(files)
    if not report.filter("not agree").isEmpty():
        raise RuntimeError("the rewritten groups differ from the plan")
    return compaction.same_record_pairs(files, planned)


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """Which record, named by its standing file, each file holds: one row per file instead of all pairs."""
    files = table(spark, d, "block_meta")
    return compaction.members(files, compaction.plan(compaction.frozen_manifest(files), 1 << 20)).select("file_id", "record_file", "group_no", "copies")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups as planned and as written, reconciled."""
    return _compacted(table(spark, d, "block_meta"))[1]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "meta_raw")
    log = drift.changes(records, drift.shapes(records))
    return log.select("stream", "file_no", "old_name", "new_name", "change_kind").distinct()


def p5_log(spark: SparkSession, d: str) -> DataFrame:
    """The change log in order, with the file where each change began and the types before and after."""
    records = table(spark, d, "meta_raw")
    return drift.ordered_log(records, drift.changes(records, drift.shapes(records)))


def _unified(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "meta_raw")
    found = drift.shapes(records)
    return drift.unified(records, *drift.union_schema(found, drift.changes(records, found)))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    return _unified(spark, d).withColumn("_misfits", F.to_json("_misfits"))


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text columns of the one table, one row per filled cell."""
    rows = _unified(spark, d)
    texts = [c for c, kind in rows.dtypes if kind == "string" and c != "stream"]
    if not texts:
        return rows.select("record_id", "stream", "file_no", F.lit("").alias("name"), F.lit("").alias("value")).limit(0)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")) for c in texts)))
    return rows.select("record_id", "stream", "file_no", cells.alias("c")).select("record_id", "stream", "file_no", "c.name", "c.value").filter("value is not null")


def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    """Records and values of each file in the one table: every non-null value of every record is in its row."""
    rows = _unified(spark, d)
    values = sum((F.when(F.col(f"`{c}`").isNotNull(), 1).otherwise(0) for c in rows.columns if c not in ("record_id", "stream", "file_no", "_misfits")), F.lit(0))
    return rows.groupBy("stream", "file_no").agg(F.count("*").alias("n_records"), F.sum(values + F.coalesce(F.size("_misfits"), F.lit(0))).alias("n_values"))


QUERIES = {f.__name__: f for f in (p1_found, p1_tables, p1_objects, p1_roles, p2_found, p2_cells, p2_table, p2_rows, p2_wide, p3_found, p3_rejected, p3_loaded, p4_found, p4_members, p4_groups, p5_found, p5_log, p5_unified, p5_texts, p5_filled)}

_LINES = r"""
with one as (
  select line_id, trim(session, chr(32) || chr(9)) as session, lower(trim(event, chr(32) || chr(9))) as event, saved,
         case when abs(t) < 100000000000 then t * 1000 when abs(t) > 100000000000000 then cast(floor(t / 1000) as bigint) else t end as t
  from (select *, row_number() over (partition by line_id order by received_at) as k from metrics) x
  where k = 1 or line_id is null),
good as (select * from one where session <> '')
"""
_PARTS = r"""
with led as (
  select row_id, line, arrived_at, ',' || case when ends_with(line, chr(13)) then left(line, length(line) - 1) else line end as l
  from metrics_raw),
shape as (
  select *, regexp_full_match(l, '(,("[^"]*(""[^"]*)*"|[^",]*))+') as good,
         regexp_extract_all(l, ',("[^"]*(?:""[^"]*)*"|[^",]*)', 1) as parts
  from led),
bare as (
  select *, list_transform(parts, lambda p: case when starts_with(p, '"') then replace(substr(p, 2, length(p) - 2), '""', '"') else p end) as f
  from shape),
judged as (
  select *, case
    when line is null then 'column_count'
    when not good then 'quoting'
    when len(f) <> 8 then 'column_count'
    when not regexp_full_match(f[2], '[a-z][a-z0-9._-]*')
      or not (regexp_full_match(f[1], '[0-9]+') and try_cast(f[1] as hugeint) <= 9223372036854775807)
      or not (regexp_full_match(f[4], '[0-9]+') and try_cast(f[4] as hugeint) <= 9223372036854775807)
      or not (regexp_full_match(f[5], '[0-9]+') and try_cast(f[5] as hugeint) <= 9223372036854775807)
      or not (f[6] = '' or (regexp_full_match(f[6], '-?[0-9]+') and abs(try_cast(f[6] as hugeint)) <= 9223372036854775807))
      or not (regexp_full_match(f[7], '[0-9]+') and try_cast(f[7] as hugeint) <= 9223372036854775807)
      or not (regexp_full_match(f[8], '[0-9]+') and try_cast(f[8] as hugeint) <= 9223372036854775807)
    then 'bad_value' end as reason
  from bare)
"""


def _unwrapped(t: str) -> str:
    """SQL for the list or object that a text is, also inside one JSON string; else null."""
    inner = f"({t} ->> '$')"
    kinds = "in ('ARRAY', 'OBJECT')"
    return (
        f"case when json_valid({t}) then case when json_type({t}) {kinds} then {t}::json "
        f"when json_type({t}) = 'VARCHAR' and json_valid({inner}) and json_type({inner}) {kinds} then {inner}::json end end"
    )


def _elements(v: str) -> str:
    return f"case json_type({v}) when 'ARRAY' then json_extract({v}, '$[*]') when 'OBJECT' then [{v}] end"


_NODES = f"""
with recursive vals as (
  select line_id, 'c' as path, {_unwrapped('content')} as v from (select distinct line_id, content from transcript where content is not null)
  union all
  select line_id, 'm', case when json_type(w) = 'VARCHAR' then {_unwrapped("(w ->> '$')")} else w end
  from (select distinct line_id, json_extract(message, '$.content') as w from transcript where json_valid(message) and json_type(message) = 'OBJECT')),
nodes as (
  select line_id, path as parent_path, path || '.' || (i - 1) as node_path, e[i] as o
  from (select line_id, path, {_elements('v')} as e from vals), unnest(range(1, len(e) + 1)) as u(i) where json_type(e[i]) = 'OBJECT'
  union all
  select line_id, node_path, node_path || '.' || (i - 1), e[i]
  from (select line_id, node_path, {_elements('v')} as e
        from (select line_id, node_path, case when json_type(w) = 'VARCHAR' then {_unwrapped("(w ->> '$')")} else w end as v
              from (select line_id, node_path, unnest([json_extract(o, '$.content'), case when json_type(o, '$.message') = 'OBJECT' then json_extract(o, '$.message.content') end]) as w from nodes))),
       unnest(range(1, len(e) + 1)) as u(i) where json_type(e[i]) = 'OBJECT')
select distinct line_id, parent_path, node_path from nodes"""
def _opened(j: str) -> str:
    """SQL for a JSON value, or the list or object inside it if it is a string that holds one."""
    inner = f"({j} ->> '$')"
    return f"case when json_type({j}) = 'VARCHAR' and json_valid({inner}) and json_type({inner}) in ('ARRAY', 'OBJECT') then {inner}::json else {j} end"


def _column(t: str) -> str:
    return f"case when json_valid({t}) then {t}::json else to_json({t}) end"


#: All nodes of problem 1 as (line_id, tag, path, via, v); a content value is opened when it becomes a node.
_TREE = f"""
with recursive rows as (select distinct line_id, session, line_no, kind, role, message, content from transcript),
tree as (
  select line_id, 'content' as tag, 'c' as path, 'content' as via, {_opened(_column('content'))} as v from rows where content is not null
  union all
  select line_id, case when json_type(v) = 'OBJECT' then 'message' else 'detail' end, case when json_type(v) = 'OBJECT' then '/message' else '' end, null, v
  from (select line_id, {_opened(_column('message'))} as v from rows where message is not null)
  union all
  select line_id, tag, path, via, case when tag = 'content' then {_opened('v')} else v end from (
    select t.line_id, e.value as v,
      case when t.tag = 'content' then case e.type when 'OBJECT' then 'object' when 'VARCHAR' then 'text' else 'detail' end
        when t.tag in ('object', 'message') and e.key = 'content' then 'content'
        when t.tag = 'object' and e.key = 'message' and e.type = 'OBJECT' then 'message' else 'detail' end as tag,
      case when t.tag = 'content' then t.path || '.' || e.key when t.tag = 'object' and e.key = 'message' and e.type = 'OBJECT' then t.path || '/message'
        when t.tag = 'message' and e.key = 'content' then case t.path when '/message' then 'm' else left(t.path, length(t.path) - 8) end else t.path end as path,
      case when t.tag = 'content' then t.via when t.tag in ('object', 'message') and e.key = 'content' then case t.tag when 'object' then 'content' else 'message' end end as via
    from (select line_id, tag, path, via, case when tag = 'content' and json_type(v) = 'OBJECT' then json_array(v) else v end as v from tree where json_type(v) in ('ARRAY', 'OBJECT')) t, json_each(t.v) e
    where t.tag = 'content' or json_type(t.v) = 'ARRAY' or e.type in ('ARRAY', 'OBJECT') or (t.tag in ('object', 'message') and e.key = 'content')))"""
_STRING = "case when json_type(v, '$.{0}') = 'VARCHAR' then v ->> '$.{0}' end"
_CHANGES = """
with one as (select * from (select *, row_number() over (partition by stream, file_no, record_id order by written_at) as k from meta_raw) where k = 1),
rec as (select stream, file_no::bigint as file_no, record_id, case when json_valid(record) and json_type(record) = 'OBJECT' then record end as r from one where stream is not null and file_no is not null),
kv as (select stream, file_no, k as field, json_extract(r, '$."' || k || '"') as v from rec, unnest(json_keys(r)) as u(k)),
tv as (
  select *, case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'list' when 'OBJECT' then 'object' else 'number' end as type,
    case when json_type(v) in ('VARCHAR', 'BOOLEAN', 'ARRAY', 'OBJECT') then v::varchar else cast(v::double as varchar) end as val
  from kv where json_type(v) <> 'NULL'),
counts as (select stream, file_no, field, type, count(*) as n from tv group by all),
heads as (
  select stream, file_no, field, type from (
    select *, row_number() over (partition by stream, file_no, field order by n desc, list_position(['string', 'number', 'boolean', 'list', 'object'], type)) as k from counts) where k = 1),
files as (select distinct stream, file_no from rec),
pairs as (select a.stream, a.file_no from files a join files b on a.stream = b.stream and b.file_no = a.file_no - 1),
old as (select p.stream, p.file_no, field, type from pairs p join heads h on h.stream = p.stream and h.file_no = p.file_no - 1),
new as (select p.stream, p.file_no, field, type from pairs p join heads h on h.stream = p.stream and h.file_no = p.file_no),
ended as (select * from old o where not exists (select 1 from new n where n.stream = o.stream and n.file_no = o.file_no and n.field = o.field)),
began as (select * from new n where not exists (select 1 from old o where n.stream = o.stream and n.file_no = o.file_no and n.field = o.field)),
vals as (select distinct stream, file_no, field, val from tv),
ren as (
  select distinct e.stream, e.file_no, e.field as old_name, b.field as new_name
  from ended e join began b on e.stream = b.stream and e.file_no = b.file_no and e.type = b.type
  join vals x on x.stream = e.stream and x.file_no = e.file_no - 1 and x.field = e.field
  join vals y on y.stream = b.stream and y.file_no = b.file_no and y.field = b.field and y.val = x.val)
select *, 'renamed' as change_kind from ren
union all select stream, file_no, field, '', 'removed' from ended e where not exists (select 1 from ren r where r.stream = e.stream and r.file_no = e.file_no and r.old_name = e.field)
union all select stream, file_no, '', field, 'added' from began b where not exists (select 1 from ren r where r.stream = b.stream and r.file_no = b.file_no and r.new_name = b.field)
union all select o.stream, o.file_no, o.field, o.field, 'retyped' from old o join new n on n.stream = o.stream and n.file_no = o.file_no and n.field = o.field and n.type <> o.type"""

_LOG = f"""
  select stream, row_number() over (partition by stream order by file_no, change_kind, old_name, new_name) as change_no, file_no, file_name, change_kind, old_name, new_name, old_type, new_type
  from (select c.*, f.file_name, o.type as old_type, n.type as new_type from changes c
    left join (select stream, file_no::bigint as file_no, min(file_name) as file_name from meta_raw group by 1, 2) f on f.stream = c.stream and f.file_no = c.file_no
    left join heads o on o.stream = c.stream and o.file_no = c.file_no - 1 and o.field = c.old_name
    left join heads n on n.stream = c.stream and n.file_no = c.file_no and n.field = c.new_name)"""

ORACLE = {
    "p5_log": _CHANGES[: _CHANGES.index("\nselect *, 'renamed'")] + ",\nchanges as (" + _CHANGES[_CHANGES.index("select *, 'renamed'") :] + ")" + _LOG,
    "p5_texts": "with recursive" + _CHANGES[: _CHANGES.index("\nselect *, 'renamed'")].strip().removeprefix("with") + """,
        uses as (select field, count(*) as n from tv group by field),
        edges as (select old_name as a, new_name as b from ren union select new_name, old_name from ren),
        reach as (select field as a, field as b from uses union select e.a, e.a from edges e union select r.a, e.b from reach r join edges e on e.a = r.b),
        chain as (
          select a as field, first(b order by exists (select 1 from ren where old_name = b), coalesce(n, 0) desc, b) as chain from reach left join uses on uses.field = reach.b group by a),
        split as (select distinct stream, chain from heads join chain using (field) group by stream, file_no, chain having count(*) > 1),
        names as (select distinct h.stream, h.field, case when s.chain is not null then h.field else c.chain end as name, h.type from heads h join chain c using (field) left join split s on s.stream = h.stream and s.chain = c.chain),
        kinds as (select name, bool_or(type in ('list', 'object')) as nested, count(distinct type) as k, min(type) as type from names group by name),
        mine as (select stream, file_no, record_id, u.k as field, json_extract(r, '$."' || u.k || '"') as v from rec, unnest(json_keys(r)) as u(k)),
        cells as (
          select m.record_id, m.stream, m.file_no, n.name, case when json_type(v) = 'VARCHAR' then v ->> '$' else v::varchar end as value,
            row_number() over (partition by m.record_id, m.stream, m.file_no, n.name order by m.field <> n.name, m.field) as pick
          from mine m join (select distinct stream, field, name from names) n on n.stream = m.stream and n.field = m.field where json_type(v) <> 'NULL')
        select record_id, stream, file_no, c.name, value from cells c join kinds using (name) where pick = 1 and (nested or k > 1 or type = 'string')""",
    "p5_filled": _CHANGES[: _CHANGES.index(",\nkv as")] + """
        select stream, file_no, count(*) as n_records,
          sum(case when r is null then 0 else len(list_filter(json_keys(r), lambda k: json_type(json_extract(r, '$."' || k || '"')) <> 'NULL')) end)::bigint as n_values from rec group by 1, 2""",
    "p1_found": _NODES,
    "p1_tables": _TREE
    + """
        select tag, count(*) as n_rows, 0 as n_orphans
        from (select tag from tree union all select 'text' from tree where tag = 'content' and json_type(v) = 'VARCHAR') group by tag
        union all select 'line', count(distinct line_id), 0 from rows""",
    "p1_objects": _TREE
    + f"""
        select distinct line_id, regexp_replace(path, '[.][0-9]+$', '') as parent_path, path as node_path, via, {_STRING.format('type')} as type, {_STRING.format('role')} as role,
          {_STRING.format('name')} as name, case when json_type(v, '$.is_error') = 'BOOLEAN' then (v ->> '$.is_error')::boolean end as is_error, len(json_keys(v))::bigint as n_fields
        from tree where tag = 'object'""",
    "p1_roles": _TREE
    + f"""
        select distinct line_id, path as node_path, {_STRING.format('role')} as role, tag from tree where tag in ('message', 'object') and json_type(v, '$.role') = 'VARCHAR'
        union all select distinct line_id, '', role, 'line' from rows where role is not null""",
    "p5_found": _CHANGES,
    "p2_found": _LINES + "select distinct session, event from good where event <> ''",
    "p2_cells": _LINES
    + """select session, event, count(*) as n, max(t) as last_t, coalesce(sum(saved), 0)::bigint as total_saved
         from good where event <> '' group by session, event""",
    "p2_rows": _LINES
    + """select session, count(distinct event) filter (event <> '') as n_types, count(*) filter (event <> '') as n_lines, max(t) filter (event <> '') as last_t,
           coalesce(sum(saved) filter (event <> ''), 0)::bigint as total_saved from good group by session""",
    "p2_wide": _LINES
    + """select session, count(*) filter (event = 'compress') as n_compress, max(t) filter (event = 'compress') as last_compress,
           coalesce(sum(saved) filter (event = 'compress'), 0)::bigint as saved_compress,
           count(*) filter (event = 'expand') as n_expand, max(t) filter (event = 'expand') as last_expand,
           coalesce(sum(saved) filter (event = 'expand'), 0)::bigint as saved_expand
         from good group by session""",
    "p3_found": _PARTS + "select distinct row_id, reason from judged where reason is not null",
    "p3_rejected": _PARTS
    + """,
        fields as (select row_id, line, arrived_at, i, ['t', 'event', 'session', 'raw', 'shown', 'saved', 'delta_hits', 'evicted'][i] as name, f[i] as v from judged, unnest(range(1, 9)) as u(i) where reason = 'bad_value'),
        wrong as (
          select row_id, line, string_agg('bad_value:' || name, ' ' order by i) as errors from (select distinct row_id, line, i, name, v from fields)
          where case name when 'session' then false when 'event' then not regexp_full_match(v, '[a-z][a-z0-9._-]*')
            when 'saved' then not (v = '' or (regexp_full_match(v, '-?[0-9]+') and coalesce(abs(try_cast(v as hugeint)) <= 9223372036854775807, false)))
            else not (regexp_full_match(v, '[0-9]+') and coalesce(try_cast(v as hugeint) <= 9223372036854775807, false)) end
          group by row_id, line)
        select distinct j.row_id, reason, case when reason = 'bad_value' then w.errors else reason end as errors, j.line
        from judged j left join wrong w on w.row_id is not distinct from j.row_id and w.line is not distinct from j.line where reason is not null""",
    "p3_loaded": _PARTS
    + """select row_id, f[1]::bigint as t, f[2] as event, f[3] as session, f[4]::bigint as raw, f[5]::bigint as shown,
           nullif(f[6], '')::bigint as saved, f[7]::bigint as delta_hits, f[8]::bigint as evicted
         from (select *, row_number() over (partition by row_id order by arrived_at) as k from judged where reason is null) where k = 1""",
    "p4_found": """
        with r as (select file_id, lower(trim(sha256, ' ')) as sha, len from block_meta where sha256 is not null and len <> 0)
        select a.file_id as file_id_a, b.file_id as file_id_b from r a join r b on a.sha = b.sha and a.len = b.len and a.file_id < b.file_id""",
    "p4_members": """
        with r as (select file_id, lower(trim(sha256, ' ')) as sha, len from block_meta where sha256 is not null and len <> 0),
        s as (select sha, len, min(file_id) as record_file, count(*) as copies from r group by sha, len),
        g as (select *, cast((sum(len) over (order by record_file) - len) // 1048576 as bigint) as group_no from s)
        select file_id, record_file, group_no, copies from r join g on r.sha = g.sha and r.len = g.len""",
    "p4_groups": """
        with r as (select min(file_id) as file_id, lower(trim(sha256, ' ')) as sha, len from block_meta
                   where sha256 is not null and len <> 0 group by 2, 3),
        c as (select *, sum(len) over (order by file_id) - len as start from r)
        select cast(start // 1048576 as bigint) as group_no, count(*) as planned_records, sum(len)::bigint as planned_bytes, count(*) as written_records,
               sum(len)::bigint as written_bytes, 1::bigint as files, true as agree
        from c group by 1""",
}
