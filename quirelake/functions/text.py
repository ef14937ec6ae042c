"""Text functions as column expressions: folding, lines, trimming, snippets, token estimates, globs.

All stay inside whole-stage code generation. Letters fold in ASCII only; trimming knows all Unicode blanks; lengths are
code points. Null in, null out.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as blank when trimming, in a form that Java and RE2 both read.
BLANK = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SNIPPET_CHARS = 160
CHARS_PER_TOKEN = 4


def fold(text: Column) -> Column:
    """ASCII case folding: other letters keep their case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def contains_folded(text: Column, needle: str) -> Column:
    return F.contains(fold(text), F.lit(needle.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def lines(text: Column) -> Column:
    """The lines of a text; a line end may be a line feed alone or behind a carriage return."""
    return F.split(text, "\r?\n")


def snippet(text: Column) -> Column:
    return F.substring(trim(text), 1, SNIPPET_CHARS)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.char_length(text) / CHARS_PER_TOKEN)


def glob_regex(glob: str) -> str:
    """A glob over paths as a regular expression for the path with a slash behind it.

    ``*`` stays inside one segment, ``**`` as a whole segment stands for any number of segments, everything else is
    literal, case counts, and both ends are anchored.
    """
    out = ""
    for segment in glob.split("/"):
        if segment == "**":
            out += "(?:[^/]*/)*"
        else:
            out += "[^/]*".join(re.escape(p) for p in re.split(r"\*+", segment)) + "/"
    return f"^{out}$"


def matches_glob(path: Column, glob: str) -> Column:
    return F.concat(path, F.lit("/")).rlike(glob_regex(glob))


def first_slice_chars(text: Column, max_tokens: int) -> Column:
    """How many code points the first answer under a budget holds.

    A text within four code points a token (at least one) is whole. Else the cut is there, or behind the last line feed
    before it if that stands beyond half the budget, counted in bytes.
    """
    limit = max(1, max_tokens * CHARS_PER_TOKEN)
    head = F.substring(text, 1, limit)
    back = F.locate("\n", F.reverse(head))
    at = F.lit(limit) - back  # code points before the last line feed
    deep = F.octet_length(F.substring(head, F.lit(1), at)) > limit // 2
    return F.when(F.char_length(text) <= limit, F.char_length(text)).when((back > 0) & deep, at + 1).otherwise(F.lit(limit))


def paginate(text: str, max_tokens: int) -> list[tuple[int, int]]:
    """All slices of a text under a budget, each starting where the last ended: nothing is lost, nothing comes twice."""
    limit = max(1, max_tokens * CHARS_PER_TOKEN)
    out, at = [], 0
    while True:
        rest = text[at : at + limit + 1]
        if len(rest) <= limit:
            out.append((at, at + len(rest)))
            return out
        head = rest[:limit]
        line_end = head.rfind("\n")
        size = line_end + 1 if line_end >= 0 and len(head[:line_end].encode()) > limit // 2 else limit
        out.append((at, at + size))
        at += size
