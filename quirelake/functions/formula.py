"""Formulas: the references they hold, and the same formula after rows, columns or sheets changed.

One scanner over the text; formulas are never evaluated. References are rectangles and are never expanded. Strings,
references to other workbooks, function names and truth values are no references; a name is a run of letters, digits,
underscores and points that is none of these.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS, MAX_COLS = 1_048_576, 16_384
_PART = r"(\$?)([A-Za-z]{1,3})(\$?)([0-9]{1,7})"
_SCAN = re.compile(
    r"""(?P<text>"(?:[^"]|"")*")
    | (?P<other>'(?:[^']|'')*\[(?:[^']|'')*'!\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)? | \[[^\]]*\][A-Za-z0-9_.]*!\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?)
    | (?P<quoted>'(?:[^']|'')*')! (?=\$?[A-Za-z])
    | (?P<sheet>[A-Za-z_][A-Za-z0-9_.]*)! (?=\$?[A-Za-z])
    | (?P<word>[$A-Za-z_\\][$A-Za-z0-9_.]*)
    | (?P<number>[0-9][A-Za-z0-9_.]*)
    | .""",
    re.X | re.S,
)
_CELL = re.compile(_PART + r"\Z")
_RANGE_END = re.compile(r":" + _PART + r"(?![A-Za-z0-9_.(!])")


@dataclass(frozen=True)
class Reference:
    """A rectangle (or one cell) on a sheet, with its place in the formula and its dollar signs."""

    start: int
    end: int
    sheet: str | None
    r1: int
    c1: int
    r2: int
    c2: int
    fixed: tuple[str, str, str, str]
    is_range: bool


@dataclass(frozen=True)
class Name:
    start: int
    end: int
    name: str


#: Texts that a task keeps what it found in; then it starts again.
MEMO_TEXTS = 20_000


def column_index(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(m: re.Match) -> tuple[int, int, str, str] | None:
    row, col = int(m.group(4)), column_index(m.group(2))
    return (row, col, m.group(1), m.group(3)) if 1 <= row <= MAX_ROWS and 1 <= col <= MAX_COLS else None


def scan(formula: str) -> Iterator[Reference | Name]:
    """References and names of a formula, from left to right."""
    pos, sheet, begin = 0, None, 0
    while pos < len(formula):
        m = _SCAN.match(formula, pos)
        kind = m.lastgroup
        if kind in ("quoted", "sheet"):
            raw = m.group(kind)
            sheet = raw[1:-1].replace("''", "'") if kind == "quoted" else raw
            begin, pos = pos, m.end()
            continue
        start = begin if sheet is not None else pos
        if kind == "word":
            word, end = m.group("word"), m.end()
            call = formula[end : end + 1] == "("
            cell = _CELL.match(word)
            got = _cell(cell) if cell and not call else None
            if got:
                tail = _RANGE_END.match(formula, end)
                far = _cell(tail) if tail else None
                r, c, fc, fr = got
                if far:
                    yield Reference(start, tail.end(), sheet, min(r, far[0]), min(c, far[1]), max(r, far[0]), max(c, far[1]), (fc, fr, far[2], far[3]), True)
                    end = tail.end()
                else:
                    yield Reference(start, end, sheet, r, c, r, c, (fc, fr, fc, fr), False)
            elif not call and sheet is None and "$" not in word and word.upper() not in ("TRUE", "FALSE"):
                yield Name(pos, end, word)
            pos = end
        else:
            pos = m.end()
        sheet = None


def references(formula: str | None) -> list[dict]:
    """What a formula refers to: rectangles (kind ``ref``) and names (kind ``name``), each once."""
    out: dict[tuple, dict] = {}
    for x in scan(formula or ""):
        row = {"kind": "name", "sheet": None, "r1": None, "c1": None, "r2": None, "c2": None, "name": x.name} if isinstance(x, Name) else {"kind": "ref", "sheet": x.sheet, "r1": x.r1, "c1": x.c1, "r2": x.r2, "c2": x.c2, "name": None}
        out.setdefault(tuple(row.values()), row)
    return list(out.values())


REFERENCE_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n[1:].isdigit() else T.StringType()) for n in ("kind", "sheet", "r1", "c1", "r2", "c2", "name")]))


class _Memo(dict):
    """What a function gives for a text; the same formulas stand in many cells."""

    def __init__(self, work: Callable) -> None:
        super().__init__()
        self.work = work

    def __missing__(self, text):
        if len(self) >= MEMO_TEXTS:
            self.clear()
        out = self[text] = self.work(text)
        return out


@F.pandas_udf(REFERENCE_TYPE)
def references_udf(formulas: pd.Series) -> pd.Series:
    memo = _Memo(references)
    return formulas.map(lambda f: memo[f] if isinstance(f, str) else references(None))


def parsed(df: DataFrame, keys: list[str], formula: str) -> DataFrame:
    """(keys, kind, sheet, r1, c1, r2, c2, name): a row for each reference and name of each formula, without dictionaries on the way."""
    inner = REFERENCE_TYPE.elementType.fields
    schema = T.StructType([df.schema[k] for k in keys] + list(inner))

    def rows_of(text: str) -> set[tuple]:
        return {("name", None, None, None, None, None, x.name) if isinstance(x, Name) else ("ref", x.sheet, x.r1, x.c1, x.r2, x.c2, None) for x in scan(text)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(rows_of)
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                seen = memo[text]
                at += [i] * len(seen)
                rows += seen
            if rows:
                take = pa.array(at, pa.int64())
                columns = [pa.array(c, pa.int32() if f.name[1:].isdigit() else pa.string()) for c, f in zip(zip(*rows), inner)]
                yield pa.RecordBatch.from_arrays([batch.column(k).take(take) for k in range(len(keys))] + columns, names=schema.names)

    return df.where(F.col(formula).isNotNull()).select(*keys, formula).mapInArrow(run, schema)


def rewrite(formula: str, move: Callable[[Reference], str | None]) -> str:
    """The formula with each reference replaced by what ``move`` gives; None leaves it."""
    out, last = [], 0
    for x in scan(formula):
        if isinstance(x, Reference) and (new := move(x)) is not None:
            out += [formula[last : x.start], new]
            last = x.end
    return "".join([*out, formula[last:]])


def same_sheet(a: str | None, b: str | None) -> bool:
    return (a or "").casefold() == (b or "").casefold()


@lru_cache(MEMO_TEXTS)
def shift_formula(formula: str, own_sheet: str, edited_sheet: str, axis: str, at: int, count: int, insert: bool) -> str:
    """References to the edited sheet after rows or columns came in or went: dollar signs stay, what is gone is #REF!."""

    def one(value: int, most: int) -> int | None:
        if insert:
            moved = value + count if value >= at else value
            return moved if moved <= most else None
        return value if value < at else value - count if value >= at + count else None

    def span(low: int, high: int, most: int) -> tuple[int, int] | None:
        if insert:
            a, b = one(low, most), one(high, most)
            return None if a is None or b is None else (a, b)
        if low >= at and high < at + count:
            return None
        return (low if low < at else low - count if low >= at + count else at), (high if high < at else high - count if high >= at + count else at - 1)

    def move(x: Reference) -> str | None:
        if not same_sheet(x.sheet or own_sheet, edited_sheet):
            return None
        rows, cols = (x.r1, x.r2), (x.c1, x.c2)
        if axis == "row":
            rows = span(*rows, MAX_ROWS)
        else:
            cols = span(*cols, MAX_COLS)
        if rows is None or cols is None:
            return "#REF!"
        prefix = formula[x.start : x.end].rpartition("!")
        lead = prefix[0] + prefix[1]
        first = f"{x.fixed[0]}{column_name(cols[0])}{x.fixed[1]}{rows[0]}"
        return lead + (first if not x.is_range else f"{first}:{x.fixed[2]}{column_name(cols[1])}{x.fixed[3]}{rows[1]}")

    return rewrite(formula, move)


def quote_sheet(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", name) and not _CELL.match(name) else "'" + name.replace("'", "''") + "'"


@lru_cache(MEMO_TEXTS)
def rename_sheet(formula: str, old: str, new: str) -> str:
    def move(x: Reference) -> str | None:
        if x.sheet is None or not same_sheet(x.sheet, old):
            return None
        return quote_sheet(new) + "!" + formula[x.start : x.end].rpartition("!")[2]

    return rewrite(formula, move)


@lru_cache(MEMO_TEXTS)
def drop_sheet(formula: str, gone: str) -> str:
    return rewrite(formula, lambda x: "#REF!" if x.sheet is not None and same_sheet(x.sheet, gone) else None)


def shift_sqref(sqref: str, axis: str, at: int, count: int, insert: bool) -> str | None:
    """A list of ranges after the same change; ranges that are gone drop out, and None if all are."""
    moved = [shift_formula(part, "", "", axis, at, count, insert) for part in sqref.split()]
    kept = [m for m in moved if m != "#REF!"]
    return " ".join(kept) or None


def shift_formula_column(formula: Column, own_sheet: Column, edited_sheet: str, axis: str, at: int, count: int, insert: bool) -> Column:
    @F.pandas_udf(T.StringType())
    def run(formulas: pd.Series, sheets: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else shift_formula(f, s, edited_sheet, axis, at, count, insert) for f, s in zip(formulas, sheets)], dtype=object)

    return run(formula, own_sheet)
