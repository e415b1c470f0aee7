"""Which shell commands have output worth packing.

Quotes are blanked by one pattern, segments are cut outside of quotes by another, wrappers and assignments are
stripped by a third; all of it built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilefold.config import LABEL
from tilefold.functions.text import let

# Programs whose output is packed, those packed only for log files, and wrappers before a program.
PROGRAMS = (
    "npm", "pnpm", "yarn", "cargo", "go", "make", "gradle", "mvn", "bundle", "pip", "poetry", "node", "bun", "deno",
    "dotnet", "gradlew", "rspec", "phpunit", "ctest", "tox", "nox", "ninja", "swift", "tsx", "psql", "mysql", "sqlite3",
    "pytest", "jest", "vitest", "mocha", "tsc", "eslint", "prettier", "webpack", "vite", "rollup", "docker", "kubectl",
    "terraform", "ansible", "grep", "rg", "ag", "find", "tree", "du",
)
LOG_PROGRAMS = ("tail", "head", "cat")
WRAPPERS = ("sudo", "env", "time", "nice", "command", "npx")

W = r"[\t-\r \x{85}\p{Z}]"
QUOTED = r"\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z)"
SEGMENT = rf"(?:{QUOTED}|(?!;|&&)[\s\S])++"
ASSIGN = rf"[A-Za-z_][A-Za-z0-9_]*+=(?:\"[^\"]*+\"?|'[^']*+'?|(?![\"'])(?:(?!{W})[\s\S])*+)"
WRAP = rf"(?:(?:(?!{W})[\s\S])*[/\\])?(?:{'|'.join(WRAPPERS)})(?={W}|\z)"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{W}++|{W}++\z", "")


def blank_quotes(cmd: Column) -> Column:
    """The command with a blank for each quoted span; only marks outside of quotes matter after it."""
    return F.regexp_replace(cmd, QUOTED, " ")


def has_shell_meta(cmd: Column) -> Column:
    bare = blank_quotes(cmd)
    return bare.rlike(rf"[|<>]|{LABEL.lower()}") | bare.rlike(r"(?<![&>])&(?![&>])") | bare.rlike(r"(?:\A|[ \t;()|&<>])#")


def segments(cmd: Column) -> Column:
    parts = F.regexp_extract_all(cmd, F.lit(rf"{SEGMENT}|;|&&"), F.lit(0))
    return F.filter(F.transform(parts, trim), lambda s: ~s.isin("", ";", "&&"))


def effective_program(segment: Column) -> Column:
    """The program of a segment after assignments and wrappers, without its folder; null if there is none."""
    rest = F.regexp_replace(trim(segment), rf"\A(?:(?:{ASSIGN}|{WRAP}){W}*+)++", "")
    word = F.regexp_extract(rest, rf"\A(?:(?!{W})[\s\S])++", 0)
    return F.nullif(F.regexp_replace(word, r"\A[\s\S]*[/\\]", ""), F.lit(""))


def matched_program(cmd: Column) -> Column:
    """The first program of a command whose output is packed; null if the command is left alone."""
    cmd = trim(cmd)

    def match(s: Column) -> Column:
        return let(effective_program(s), lambda p: F.when(p.isin(*PROGRAMS) | (p.isin(*LOG_PROGRAMS) & s.contains(".log")), p))

    hit = F.get(F.filter(F.transform(segments(cmd), match), lambda p: p.isNotNull()), F.lit(0))
    return F.when((cmd != "") & ~has_shell_meta(cmd), hit)
