"""Content handles, digests, and the names of files derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilefold.config import HANDLE_PREFIX, LEGACY_PREFIX

HEX = "[0-9a-fA-F]"
#: Handles anywhere in a text: the run of hex digits must have exactly a valid length.
HANDLE_ANYWHERE = rf"{HANDLE_PREFIX}{HEX}{{32}}(?!{HEX})|{LEGACY_PREFIX}(?:{HEX}{{16}}|{HEX}{{10}})(?!{HEX})"
#: Longest base name of a session file, hex digits of the digest at the end of a cut one.
MAX_NAME, TAIL = 128, 16


def sha256_hex(b: Column) -> Column:
    return F.sha2(b, 256)


def sha1_hex(b: Column) -> Column:
    return F.sha1(b)


def handle(b: Column) -> Column:
    """The handle of bytes or text: prefix and the first 32 hex digits of their SHA-256."""
    return F.concat(F.lit(HANDLE_PREFIX), F.substring(F.sha2(b, 256), 1, 32))


def is_valid(h: Column) -> Column:
    return h.rlike(rf"\A(?:{HANDLE_PREFIX}{HEX}{{32}}|{LEGACY_PREFIX}(?:{HEX}{{10}}|{HEX}{{16}}))\z")


def verify(h: Column, b: Column) -> Column:
    """Whether the handle names these bytes; the comparison minds case, so upper-case hex never does."""
    new, old = len(HANDLE_PREFIX), len(LEGACY_PREFIX)
    return (
        F.when(~is_valid(h), F.lit(False))
        .when(h.startswith(HANDLE_PREFIX), F.substring(h, new + 1, 32) == F.substring(F.sha2(b, 256), 1, 32))
        .otherwise(F.startswith(F.sha1(b), F.substring(h, old + 1, 16)))
    )


def display(h: Column) -> Column:
    n = F.char_length(h)
    return F.when(n > 64, F.concat(F.substring(h, 1, 64), F.format_string("… (%d chars total)", n))).otherwise(h)


def short_hex(h: Column) -> Column:
    return F.when(F.char_length(h) > 8, F.concat(F.substring(h, 1, 8), F.lit("…"))).otherwise(h)


def sanitize(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")


def shard(h: Column) -> Column:
    """The two characters after the first underscore (or at the start) of a handle's file name."""
    s = sanitize(h)
    two = F.substr(s, F.instr(s, "_") + 1, F.lit(2))
    return F.when(F.char_length(two) == 2, two).otherwise(F.lit("00"))


def store_path(h: Column) -> Column:
    return F.concat_ws("/", shard(h), sanitize(h))


def session_file(session: Column) -> Column:
    """The ledger file of a session: safe characters only, long names cut and told apart by a digest."""
    blank = session.isNull() | session.rlike(r"\A[\t-\r \x{85}\p{Z}]*+\z")
    name = F.when(blank, F.lit("default")).otherwise(session)
    # the digest is of the name as given; each character that is not safe becomes one underscore
    safe = sanitize(name)
    cut = F.concat(F.substring(safe, 1, MAX_NAME - TAIL - 1), F.lit("_"), F.substring(F.sha1(name), 1, TAIL))
    return F.concat(F.when(F.char_length(safe) > MAX_NAME, cut).otherwise(safe), F.lit(".tsv"))


def sidecar_path(path: Column, tag: str = "tilefold") -> Column:
    """``dir/name.ext`` to ``dir/name.<tag>.ext``; without extension ``.md`` is added."""
    dotted = path.rlike(r"\.[^./]*+\z")
    return F.when(dotted, F.regexp_replace(path, r"\.([^./]*+)\z", rf".{tag}.$1")).otherwise(F.concat(path, F.lit(f".{tag}.md")))


def cache_key(digest: Column, path: Column) -> Column:
    """File name of a cached view: digest of the source and of the path it was read from."""
    return F.concat(F.substring(digest, 1, 32), F.lit("_"), F.substring(F.sha1(path), 1, 8), F.lit(".md"))


def session_key(session_id: Column, cwd: Column, unix_seconds: Column) -> Column:
    """The session id, or where it is blank a key of the working directory and the day."""
    given = F.when(~session_id.rlike(r"\A[\t-\r \x{85}\p{Z}]*+\z"), session_id)
    day = F.floor(unix_seconds / 86_400).cast("string")
    return F.coalesce(given, F.concat(F.lit("fallback-"), F.substring(F.sha1(F.coalesce(cwd, F.lit(""))), 1, 8), F.lit("-"), day))


def handles_in(t: Column) -> Column:
    """All handles in a text, in order, with repeats."""
    return F.regexp_extract_all(t, F.lit(HANDLE_ANYWHERE), F.lit(0))
