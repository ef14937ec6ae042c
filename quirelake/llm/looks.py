"""One form for texts that look alike.

``look_form`` maps what does not change the look: width, composition of accents, kinds of blank and of hyphen,
ligatures, characters without a glyph, letters of other alphabets with the same shape. Case, accents, super- and
subscripts, circled digits, fractions, the length of a dash and the number of blanks stay.

Values are mapped character by character in SQL; texts that no other equals when all marks are taken off are done. The
others are grouped under the accent-sensitive UNICODE collation, which brings together what is composed differently and
keeps apart what has other accents. In groups of several texts an exact check of the mapped characters follows, a
canonical member is chosen per class (the shortest, then the first by code points) and joined back.

Defined cases: null texts, and texts without a visible character, belong to no class and keep what they are; equal
texts are one member of their class; a unit that arrives twice counts once, one that arrives with several texts counts
with each, but makes no pair with itself; ties in the choice of the canonical member cannot occur between different
texts; the texts of a hot class are paired before their units; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.session import durable

#: Letters of other alphabets with the shape of a Latin letter.
SAME_SHAPE = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ϲ": "c", "ϳ": "j",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I",
    # Armenian
    "օ": "o", "Տ": "S", "Օ": "O", "ս": "u", "հ": "h", "ո": "n",
    # Latin letters of phonetic use
    "ɡ": "g", "ɑ": "a",
    # the micro sign and the Greek letter
    "µ": "μ",
}
#: Hyphens of one length.
HYPHENS = "\u2010\u2011\ufe63\uff0d\u058a"


def _mapped(ch: str) -> str | None:
    """What a code point becomes, or None if it stays."""
    if ch in SAME_SHAPE:
        return SAME_SHAPE[ch]
    if ch in HYPHENS:
        return "-"
    kind = unicodedata.category(ch)
    if kind == "Zs" and ch != " ":
        return " "
    if ch in "\r\u2028\u2029\x85\x0b\x0c":
        return "\n"
    if ch == "\t":
        return " "
    if (kind in ("Cf", "Cc") and ch != "\n") or ch in "\u034f\u115f\u1160\u3164\uffa0\u17b4\u17b5" or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef" or "\u180b" <= ch <= "\u180f":
        return ""
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if not tag.startswith("<"):
        return None
    plain = "".join(chr(int(x, 16)) for x in rest.split())
    if tag in ("<wide>", "<narrow>", "<small>", "<noBreak>", "<vertical>"):
        return plain
    if tag == "<compat>" and ("LIGATURE" in unicodedata.name(ch, "") or ch in "\u0132\u0133\u01c4\u01c5\u01c6\u01c7\u01c8\u01c9\u01ca\u01cb\u01cc\u01f1\u01f2\u01f3\u2026"):
        return plain
    return None


@cache
def table() -> dict[int, str]:
    """The mapping of all code points, made from the rules above; repeated until nothing maps any further."""
    # the code points of Hangul syllables map to nothing else, and surrogates are no characters
    found = {o: m for o in range(sys.maxunicode + 1) if not 0xAC00 <= o < 0xD7A4 and not 0xD800 <= o < 0xE000 and (m := _mapped(chr(o))) is not None}
    for o, m in found.items():
        while any(ord(c) in found and found[ord(c)] != c for c in m):
            m = m.translate(found)
        found[o] = m
    return found



#: Controls that are mapped; line feeds are not.
_CONTROLS = re.compile(r"[\x00-\x09\x0b-\x1f\x7f]")


def look_form(text: str) -> str:
    """The one form of all texts that look like this one."""
    if text.isascii() and not _CONTROLS.search(text):
        return text
    # composed letters of other alphabets come apart before their base is mapped
    apart, mapping = unicodedata.normalize("NFD", text.replace("\r\n", "\n")), table()
    for ch in set(apart):  # a text has few characters that are mapped, and what they become is mapped no further
        new = mapping.get(ord(ch))
        if new is not None:
            apart = apart.replace(ch, new)
    return unicodedata.normalize("NFC", apart)


@F.pandas_udf(T.StringType())
def look_udf(texts: pd.Series) -> pd.Series:
    return texts.map(look_form, na_action="ignore")


#: No character; stands for those that become several.
_SEVERAL = "\ufffe"


@cache
def _single() -> tuple[str, str]:
    """(characters, what they become): what is mapped one by one; what has nothing to become goes.

    Composition is left out where it is all that differs: the collation does not see it.
    """
    one, new, gone = [], [], []
    known = table()
    for o in range(0x80, sys.maxunicode + 1):
        ch = chr(o)
        if o in known or (0xC0 <= o < 0x2000 and unicodedata.decomposition(ch)):
            form = look_form(ch)
            if form == unicodedata.normalize("NFC", ch):
                continue
            if form:
                one.append(ch)
                new.append(form if len(form) == 1 else _SEVERAL)
            else:
                gone.append(ch)
    control = [chr(o) for o in known if o < 0x80]
    one += [c for c in control if known[ord(c)]]
    new += [known[ord(c)] for c in control if known[ord(c)]]
    return "".join(one + gone + [c for c in control if not known[ord(c)]]), "".join(new)


def mapped(text: Column) -> Column:
    """The text with its characters mapped, in any composition: texts that look the same are equal under the collation.

    What becomes several characters, and marks that may stand in another order, are mapped in Python.
    """
    old, new = _single()
    odd = text.rlike(r"[^\n\x20-\x7e]")
    plain = F.when(odd, F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), old, new)).otherwise(text)
    hard = odd & plain.rlike("[" + _SEVERAL + "\u1100-\u11ff]|[^\\x00-\\x7f]\\p{M}|^\\p{M}")
    return F.coalesce(look_udf(F.when(hard, text)), plain)


@cache
def _bases() -> tuple[str, str]:
    """(characters, what is left of them without their marks): the letters that are composed, then the marks, which go."""
    one, new, gone = [], [], []
    for o in range(0x80, sys.maxunicode + 1):
        ch = chr(o)
        if 0xAC00 <= o < 0xD7A4 or 0xD800 <= o < 0xE000:
            continue
        if unicodedata.category(ch).startswith("M"):
            gone.append(ch)
        elif unicodedata.decomposition(ch)[:1] not in ("", "<"):
            one.append(ch)
            new.append(next(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.category(c).startswith("M")))
    return "".join(one + gone), "".join(new)


def without_marks(text: Column) -> Column:
    """The text without its marks, composed or not: what is equal under the collation is equal in this too."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, *_bases())).otherwise(text)


def _collated(column: str) -> Column:
    return F.expr(f"`{column}` COLLATE UNICODE")


def _several(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key) of which there are several texts; written, so that the planner sees how many there are, and whether they may be sent to all."""
    return durable(rows.groupBy(key).agg(F.min("text").alias("first"), F.max("text").alias("last")).where("first <> last").select(key, F.col("first").alias("group")), label)


def alike_members(units: DataFrame, unit: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Classes of two texts or more: (text, class_key, canonical, n_variants), and their units (unit, text), each once."""
    rows = units.where(F.col(text).isNotNull() & F.col(unit).isNotNull()).select(F.col(unit).alias("unit"), F.col(text).alias("text"))
    # written once, as both the groups and their members are read from it; only texts that differ from their mapped form have one
    rows = durable(rows.withColumn("mapped", mapped(F.col("text"))).select("unit", "text", F.nullif("mapped", "text").alias("mapped")), "mapped").withColumn("mapped", F.coalesce("mapped", "text"))
    rows = rows.where(F.col("mapped").rlike(r"\S")).withColumn("bare", without_marks(F.col("mapped")))
    # comparing under a collation is dear: texts that no other equals even without marks are done
    near = rows.join(_several(rows, "bare", "bare").select("bare"), "bare", "left_semi")
    near = durable(near.select("unit", "text", "mapped").distinct(), "near").withColumn("key", _collated("mapped"))
    members = durable(near.join(_several(near, "key", "groups"), "key").select("unit", "text", "group"), "members")
    looks = members.select("group", "text").distinct().withColumn("look", look_udf("text"))
    chosen = looks.groupBy("group", "look").agg(F.min(F.struct(F.char_length("text").alias("n"), "text")).alias("c"), F.count(F.lit(1)).alias("n_variants"))
    forms = durable(looks.join(chosen.where("n_variants > 1"), ["group", "look"]).select("text", F.col("look").alias("class_key"), F.col("c.text").alias("canonical"), "n_variants"), "forms")
    return forms, members.select("unit", "text")


def alike_pairs(units: DataFrame, unit: str, text: str) -> DataFrame:
    """(unit_a, unit_b): units whose texts look the same but are not the same characters."""
    forms, rows = alike_members(units, unit, text)
    variants = forms.select("text", "class_key")
    # distinct texts are paired first, so units of one text never meet; each join on texts makes only rows that are wanted
    other = variants.select(F.col("text").alias("text_b"), "class_key")
    texts = variants.join(other, "class_key").where("text < text_b").select("text", "text_b")
    left = texts.join(rows, "text").select(F.col("unit").alias("unit_x"), "text_b")
    pairs = left.join(rows.select(F.col("unit").alias("unit_y"), F.col("text").alias("text_b")), "text_b").where("unit_x <> unit_y")
    return pairs.select(F.least("unit_x", "unit_y").alias("unit_a"), F.greatest("unit_x", "unit_y").alias("unit_b")).distinct()


def with_canonical(units: DataFrame, unit: str, text: str) -> DataFrame:
    """(unit, text, canonical): every unit and text once, with the one form of the text; texts without a class keep what they are."""
    forms, _ = alike_members(units, unit, text)
    rows = units.select(F.col(unit).alias("unit"), F.col(text).alias("text")).distinct()
    return rows.join(forms.select("text", "canonical"), "text", "left").select("unit", "text", F.coalesce("canonical", "text").alias("canonical"))
