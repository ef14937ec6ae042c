"""Cell addresses and ranges as column expressions, and how they move when rows or columns come or go.

Rows and columns count from 1. Dollar signs are ignored. What is no address is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ROWS, MAX_COLS = 1_048_576, 16_384
ADDRESS = r"^\$?([A-Za-z]{1,3})\$?([0-9]{1,7})$"


def column_number(letters: Column) -> Column:
    """A to 1, Z to 26, AA to 27: at most three letters, in closed form; no letters are 0."""
    padded = F.lpad(F.upper(letters), 3, "@")  # the sign before A in ASCII counts as nothing
    digit = lambda k: F.ascii(F.substring(padded, k, 1)) - 64
    return (digit(1) * 676 + digit(2) * 26 + digit(3)).cast("int")


def column_letters(number: Column) -> Column:
    """The inverse, up to 18,278."""
    a = F.floor((number - 703) / 676)
    b = F.floor((number - 27) / 26) % 26
    c = (number - 1) % 26
    letter = lambda x: F.char(x.cast("int") + 65)
    return F.concat(F.when(number > 702, letter(a)).otherwise(""), F.when(number > 26, letter(b)).otherwise(""), letter(c))


def address(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), row.cast("string"))


def row_of(addr: Column) -> Column:
    return F.regexp_extract(addr, ADDRESS, 2).try_cast("int")


def col_of(addr: Column) -> Column:
    return F.nullif(column_number(F.regexp_extract(addr, ADDRESS, 1)), F.lit(0))


def sheet_of(reference: Column) -> Column:
    """What stands before the last exclamation mark, without quotes; null without one."""
    got = F.regexp_extract(reference, r"^(.*)!([^!]*)$", 1)
    return F.when(reference.contains("!"), F.regexp_replace(F.regexp_replace(got, "^'|'$", ""), "''", "'"))


def after_sheet(reference: Column) -> Column:
    return F.regexp_extract(reference, r"([^!]*)$", 1)


_CORNERS = r"^\$?([A-Za-z]{1,3})\$?([0-9]{1,7})(?::\$?([A-Za-z]{1,3})\$?([0-9]{1,7}))?$"


def rectangle(reference: Column) -> dict[str, Column]:
    """r1, c1, r2, c2 of ``Sheet!A1:D20`` or a single cell, corners in order; all null for what is no range."""
    part = lambda k: F.regexp_extract(after_sheet(reference), _CORNERS, k)
    r1, r2 = part(2).try_cast("int"), part(4).try_cast("int")
    c1, c2 = F.nullif(column_number(part(1)), F.lit(0)), F.nullif(column_number(part(3)), F.lit(0))
    # least and greatest skip nulls, so a single cell is both of its corners
    return {"r1": F.least(r1, r2), "c1": F.least(c1, c2), "r2": F.greatest(r1, r2), "c2": F.greatest(c1, c2)}


def shift_insert(at: Column | int, count: Column | int, value: Column, most: int) -> Column:
    """Where a row or column stands after ``count`` are put in before ``at``; null beyond the sheet."""
    at, count = F.lit(at) if isinstance(at, int) else at, F.lit(count) if isinstance(count, int) else count
    moved = F.when(value >= at, value + count).otherwise(value)
    return F.when((at >= 1) & (count >= 1) & (moved <= most), moved)


def shift_delete(at: int, count: int, value: Column) -> Column:
    """Where it stands after ``count`` from ``at`` on are taken out; null if it is one of them."""
    return F.when(value < at, value).when(value >= at + count, value - count)


def shift_range_insert(at: int, count: int, low: Column, high: Column, most: int) -> tuple[Column, Column]:
    """Both ends move by themselves, so a range across the place grows."""
    return shift_insert(at, count, low, most), shift_insert(at, count, high, most)


def shift_range_delete(at: int, count: int, low: Column, high: Column) -> tuple[Column, Column]:
    """A range is clipped to what remains; null if nothing does."""
    gone = (low >= at) & (high < at + count)
    new_low = F.when(low < at, low).when(low >= at + count, low - count).otherwise(F.lit(at))
    new_high = F.when(high < at, high).when(high >= at + count, high - count).otherwise(F.lit(at - 1))
    return F.when(~gone, new_low), F.when(~gone, new_high)
