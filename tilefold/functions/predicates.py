"""Line and blob classifiers as anchored patterns.

``*_AT`` patterns match at the start of a line inside a longer text, so the tilers can use them as look-ahead; the
functions apply the same pattern to one line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilefold.functions.text import WS, WS_IN_LINE, let

# The words and marks that the classifiers look for.
CODE_EXTENSIONS = (
    "js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "rs", "go", "java", "c", "h", "cpp",
    "cc", "hpp", "cs", "rb", "php", "swift", "kt", "scala",
)
MARKDOWN_EXTENSIONS = ("md", "markdown", "mdown", "mkd", "mkdn")
SIGNATURES = (
    "import", "export", "require(", "module", "package", "#include", "function", "class", "interface", "enum",
    "namespace", "fn ", "func ", "def ", "pub ", "type ",
)
CONTROL = ("if", "for", "while", "switch", "catch", "do", "return", "else", "function", "class")
DEFINITIONS = (
    "pub async fn ", "pub async fn(", "pub fn ", "pub fn(", "pub struct ", "pub enum ", "pub trait ", "pub mod ",
    "pub type ", "pub const ", "pub static ", "async fn ", "fn ", "fn(", "impl ", "impl<", "struct ", "enum ",
    "trait ", "mod ", "macro_rules!", "export default function ", "export default function(",
    "export default async function ", "export default class ", "export default abstract class ",
    "export async function ", "export function ", "export function(", "export class ", "export abstract class ",
    "export interface ", "export type ", "export enum ", "abstract class ", "async function ", "function ",
    "function(", "function*", "class ", "interface ", "type ", "async def ", "def ",
)
LOG_ANCHORS = (
    "test ", "Compiling ", "Finished ", "Running ", "running ", "Doc-tests ", "failures:", "---- ", "thread '",
    "error", "warning",
)
LOG_ANCHORS_INSIDE = ("... ok", "... FAILED", "panicked")
SEVERITY = ("error", "warn", "fail", "panic", "exception", "fatal", "denied", "refused")
GLYPHS = ("✗", "❌", "●")
BODY_WORDS = (
    "if", "for", "while", "switch", "catch", "return", "function", "await", "new", "typeof", "throw", "else", "do",
    "const", "let", "var",
)
SNIFF_BYTES, SNIFF_LINES, CODE_LINES, CODE_RATIO = 256 * 1024, 400, 8, 0.06

IDENT = r"[\p{IsAlphabetic}\p{N}_$]"


def any_of(words: tuple[str, ...]) -> str:
    # of words that begin alike the shorter is enough as a prefix; the patterns only ask whether one matches
    return "(?:" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + ")"


REST = r"[^\n]*"
END = rf"{WS_IN_LINE}*+(?:\n|\z)"

SIG_AT = rf"(?:{any_of(SIGNATURES)}|(?:const |let |var )(?={REST}=)(?:(?={REST}(?:function|=>))|(?={REST}\{{{END})))"
METHOD_AT = rf"(?!{any_of(CONTROL)}(?!{IDENT})){IDENT}++(?={REST}\()(?={REST}\)){REST}\{{{END}"
DEFINITION_AT = any_of(DEFINITIONS)
ANCHOR_AT = rf"(?:[ \t]*+{any_of(LOG_ANCHORS)}|{REST}{any_of(LOG_ANCHORS_INSIDE)})"
BLANK_AT = r"(?:[ \t\r]*+\n|[ \t\r]++\z)"
COMMENT_AT = r"(?://|#|\*|/\*|--)"
CLOSER_AT = rf"(?=[^\n]*[}}\])])[}}\]);,]++{END}"
STRUCTURAL_AT = rf"(?:{CLOSER_AT}|{WS_IN_LINE}*+(?:\n|\z|{COMMENT_AT}|{SIG_AT}|{METHOD_AT}))"
FENCE_AT = rf"{WS_IN_LINE}*+```"
MARK_AT = rf"{WS_IN_LINE}*+(?:#{{1,6}} |[-*+] |[0-9]++[.)] |>|```)"


def _line(t: Column, pattern: str) -> Column:
    return t.rlike(rf"\A{pattern}")


def is_sig(line: Column) -> Column:
    """Whether a left-trimmed line looks like a signature."""
    return _line(line, SIG_AT)


def is_method(line: Column) -> Column:
    return F.contains(line, F.lit("{")) & _line(line, METHOD_AT)


def is_definition_start(line: Column) -> Column:
    return _line(line, DEFINITION_AT)


def is_log_anchor(line: Column) -> Column:
    return _line(line, ANCHOR_AT)


def is_comment(line: Column) -> Column:
    return _line(line, COMMENT_AT)


def is_closer(line: Column) -> Column:
    return _line(line, CLOSER_AT)


def is_structural(line: Column) -> Column:
    return _line(line, STRUCTURAL_AT)


def is_heading(line: Column) -> Column:
    return _line(line, "#{1,6} ")


def is_list_item(line: Column) -> Column:
    return _line(line, r"(?:[-*+] |[0-9]++[.)] )")


def is_markdown_mark(line: Column) -> Column:
    """Heading, list item, quote or fence, after white space at the left."""
    return _line(line, MARK_AT)


def _any_inside(line: Column, words: tuple[str, ...]) -> Column:
    found = F.contains(line, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(line, F.lit(w))
    return found


def important(line: Column) -> Column:
    """Whether a log line must stay visible: severity words, marks of failure, frames of traces.

    Words are searched as bytes; the patterns only look at the start of the few lines that hold their marks.
    """
    left = rf"\A{WS}*+"

    def judged(low: Column) -> Column:
        starts = low.rlike(rf'{left}(?:traceback \(most recent call last\)|caused by:|error\[e|file "[\s\S]*", line )')
        return (
            _any_inside(low, SEVERITY)
            | _any_inside(low, ("npm err!", ": error ts", ": warning ts"))
            | (_any_inside(low, ("traceback (", "caused by:", "file ")) & starts)
        )

    frames = _any_inside(line, ("at ", "* What", "* Try")) & line.rlike(rf"{left}(?:at [\s\S]*:|\* What went wrong|\* Try:)")
    return _any_inside(line, GLYPHS) | frames | let(F.lower(line), judged)


def may_hold_important(text: Column) -> Column:
    """Whether any line of a text can be important: one look at the whole text, for the many that have no such line."""
    words = (*SEVERITY, "npm err!", ": error ts", ": warning ts", "traceback (", "caused by:", 'file "')
    frame = F.contains(text, F.lit("at ")) & text.rlike(rf"(?:\A|\n){WS}*+at ")
    return _any_inside(text, (*GLYPHS, "* What", "* Try")) | frame | let(F.lower(text), lambda low: _any_inside(low, words))


def looks_like_json(t: Column) -> Column:
    """Whether the first byte that is no white space, among the first 64, opens an object or list."""
    return t.rlike(r"\A[ \t\r\n]{0,63}[{\[]")


def parses_as_json(t: Column) -> Column:
    """Whether a JSON value begins the text; text after the value does not matter."""
    first = F.regexp_extract(t, r"\A[ \t\r\n]*+([\s\S])", 1)
    return first.isin("{", "[", '"') & F.try_parse_json(t).isNotNull() | F.get_json_object(t, "$").isNotNull()


def is_markdown_path(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*+)\z", 1)).isin(*MARKDOWN_EXTENSIONS)


def _many_signatures(t: Column) -> Column:
    """Whether the first lines of a text have enough signatures for code."""
    lines = F.slice(F.split(t, "\n", SNIFF_LINES + 1), 1, SNIFF_LINES)
    full = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, rf"\A{WS}++", "")), lambda x: x != "")
    enough = lambda ls: (F.size(ls) >= CODE_LINES) & (F.size(F.filter(ls, lambda x: is_sig(x) | is_method(x))) / F.size(ls) >= CODE_RATIO)
    return let(full, lambda ls: F.when(F.size(ls) > 0, enough(ls)).otherwise(F.lit(False)))


def detect(t: Column, path: Column | None = None) -> Column:
    """``json``, ``code`` or ``log``: by the name, else by parsing a small text, else by its share of signatures.

    A null text is ``log``, a null path decides nothing.
    """
    by_text = (
        F.when((F.octet_length(t) <= SNIFF_BYTES) & looks_like_json(t) & parses_as_json(t), F.lit("json"))
        .when(_many_signatures(t), F.lit("code"))
        .otherwise(F.lit("log"))
    )
    if path is None:
        return by_text
    low = F.lower(path)
    return F.when(low.endswith(".json"), F.lit("json")).when(low.rlike(rf"\.(?:{'|'.join(CODE_EXTENSIONS)})\z"), F.lit("code")).otherwise(by_text)


def body_hint(body: Column) -> Column:
    """The first three distinct names that a code body calls, as text for a marker."""
    calls = F.regexp_extract_all(body, F.lit(rf"(?<![.\p{{IsAlphabetic}}\p{{N}}_$])([\p{{IsAlphabetic}}_$]{IDENT}*+) *+\("), F.lit(1))
    names = F.slice(F.array_distinct(F.filter(calls, lambda x: ~x.isin(*BODY_WORDS))), 1, 3)
    return let(names, lambda n: F.when(F.size(n) > 0, F.concat(F.lit(" · calls "), F.array_join(n, ", "))).otherwise(F.lit("")))


def should_elide(lines: Column, chars: Column) -> Column:
    return ((lines == 1) & (chars >= 500)) | ((lines >= 3) & (chars >= 300))
