"""Nested records to related flat tables by Dewey labels.

Every node of a JSON payload gets an ordinal path identifier (``slides[2].tables[0].cells[5]``); an entry's parent
label is its own label cut back to the nearest enclosing entry; rows are grouped into tables by their schema path (the
label without ordinals). Parsing is the one thing Catalyst cannot express here (strings that hold JSON, lone objects,
damaged documents), so it runs in ``mapInArrow``; everything around it stays in the JVM.

Defined cases: null, empty and damaged payloads give no rows; a byte-order mark before the document is skipped; a null
entry takes a position but gives no row; a lone object counts as position 0; JSON held in a string is read as that JSON
at any depth; an entry that is itself a list is walked but is no row; of repeated artifacts the one parsed last counts
(ties: the greater payload); extra columns of the input are ignored; an id that is null is an id of its own; half a
surrogate pair stands for no character and becomes U+FFFD; numbers keep the way they are written.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The lists whose entries are records.
RECORD_LISTS = (
    "sheets", "cells", "named_ranges", "style_table", "comments", "charts", "pictures", "slides", "shapes", "tables",
    "paragraphs", "header_paragraphs", "footer_paragraphs", "pages", "fields",
)

_BLANK = " \t\r\n\ufeff"
_TOKEN = re.compile(r'[\s]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))', re.S)
_WORDS = {"true": True, "false": False, "null": None}
_BAD = object()


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


#: Stands before numbers that a float does not write as they were; made anew in each process, so no text begins with it.
_AS_WRITTEN = f"\ue000{uuid.uuid4().hex}:"
_WRITTEN = re.compile(f'"{_AS_WRITTEN}([-+.0-9eE]+)"')


def _number(text: str):
    value = float(text)
    return value if repr(value) == text else _AS_WRITTEN + text


_decoder = json.JSONDecoder(parse_constant=_no_constant)
#: Floats that would be written otherwise become marked strings.
_keeping_decoder = json.JSONDecoder(parse_constant=_no_constant, parse_float=_number)
#: Escapes: a backslash, a whole surrogate pair, half of one.
_SURROGATES = re.compile(r"\\\\|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|(\\u[dD][89a-fA-F][0-9a-fA-F]{2})")


def _whole_characters(text: str) -> str:
    """The document with U+FFFD for escapes of half a surrogate pair, which no string may hold."""
    return _SURROGATES.sub(lambda m: "\\ufffd" if m.group(1) else m.group(), text) if "\\ud" in text or "\\uD" in text else text


def _load_deep(text: str, decoder: json.JSONDecoder = _decoder):
    """JSON nested too deeply for the C scanner: the same grammar with an explicit stack."""
    stack: list = []
    done, pos, n = _BAD, 0, len(text)
    key, expect = None, "value"
    while pos < n:
        m = _TOKEN.match(text, pos)
        if not m:
            if text[pos:].strip():
                raise ValueError("not JSON")
            break
        pos = m.end()
        mark, quoted, number, word = m.groups()
        if done is not _BAD:
            raise ValueError("text after the document")
        if mark == ",":
            if expect != "next" or not stack:
                raise ValueError("comma")
            expect = "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        if mark == ":":
            if expect != "colon":
                raise ValueError("colon")
            expect = "value"
            continue
        if mark in ("}", "]"):
            empty = expect == ("first_key" if mark == "}" else "first_value")
            if not stack or isinstance(stack[-1][0], dict) != (mark == "}") or not (empty or expect == "next"):
                raise ValueError("close")
            value, key = stack.pop()
        elif expect in ("key", "first_key"):
            if quoted is None:
                raise ValueError("key")
            key, expect = decoder.decode(quoted), "colon"
            continue
        elif expect not in ("value", "first_value"):
            raise ValueError("value")
        elif mark:
            stack.append(({} if mark == "{" else [], key))
            key, expect = None, "first_key" if mark == "{" else "first_value"
            continue
        else:
            value = decoder.decode(quoted) if quoted is not None else _WORDS[word] if word else decoder.decode(number)
        if not stack:
            done = value
            continue
        top = stack[-1][0]
        if isinstance(top, dict):
            top[key] = value
        else:
            top.append(value)
        expect = "next"
    if done is _BAD or stack:
        raise ValueError("incomplete")
    return done


def read_json(text: str | None, decoder: json.JSONDecoder = _decoder):
    """The value of a complete JSON document, or the marker ``_BAD``."""
    if not text:
        return _BAD
    text = _whole_characters(text.strip(_BLANK))
    try:
        return decoder.decode(text)
    except RecursionError:
        try:
            return _load_deep(text, decoder)
        except ValueError:
            return _BAD
    except ValueError:
        return _BAD


def unwrap(value, decoder: json.JSONDecoder = _decoder):
    """JSON held in a string, however often it was wrapped, as that JSON; anything else as it is."""
    while isinstance(value, str):
        head = value.lstrip(_BLANK)[:1]
        if head not in ("{", "[", '"') or not head:
            return value
        inner = read_json(value, decoder)
        if not isinstance(inner, (dict, list, str)) or inner is _BAD:
            return value
        value = inner
    return value


def label_records(payload: str | None, lists: frozenset[str] = frozenset(RECORD_LISTS), as_written: bool = False) -> Iterator[tuple[str, int, str, int, dict]]:
    """(label, length of the parent's label within it, list name, ordinal, record) of every record, in document order."""
    decoder = _keeping_decoder if as_written else _decoder
    top = read_json(payload, decoder)
    if top is _BAD:
        return
    top = unwrap(top, decoder)
    if not isinstance(top, (dict, list)):
        return
    stack: list[tuple] = [(top, "", 0)]
    while stack:
        value, label, cut = stack.pop()
        below: list[tuple] = []
        if isinstance(value, dict):
            for name, child in value.items():
                if isinstance(child, str):
                    child = unwrap(child, decoder)
                if not isinstance(child, (dict, list)):
                    continue
                at = f"{label}.{name}" if label else name
                if name not in lists:
                    below.append((child, at, cut))
                elif isinstance(child, dict):
                    entry = f"{at}[0]"
                    yield entry, cut, name, 0, child
                    below.append((child, entry, len(entry)))
                else:
                    for i, item in enumerate(child):
                        if isinstance(item, str):
                            item = unwrap(item, decoder)
                        if isinstance(item, dict):
                            entry = f"{at}[{i}]"
                            yield entry, cut, name, i, item
                            below.append((item, entry, len(entry)))
                        elif isinstance(item, list):
                            below.append((item, f"{at}[{i}]", cut))
        else:
            for i, item in enumerate(value):
                if isinstance(item, str):
                    item = unwrap(item, decoder)
                if isinstance(item, (dict, list)):
                    below.append((item, f"{label}[{i}]", cut))
        stack.extend(reversed(below))


def _holds_json(value) -> bool:
    return isinstance(value, str) and isinstance(unwrap(value), (dict, list))


def own_fields(record: dict, lists: frozenset[str]) -> str:
    """The record without the lists that became rows of their own, as JSON."""
    text = json.dumps({k: v for k, v in record.items() if not (k in lists and (isinstance(v, (dict, list)) or _holds_json(v)))}, ensure_ascii=False)
    return _WRITTEN.sub(r"\1", text) if _AS_WRITTEN in text else text


def latest_payloads(df: DataFrame, key: str, payload: str, order: str) -> DataFrame:
    """One payload per artifact: the one parsed last. Aggregated before the shuffle, so a hot id costs one row a task."""
    rank = F.struct(F.col(order).alias("o"), F.col(payload).alias("p"))
    return df.groupBy(F.col(key).alias("k")).agg(F.max(rank).alias("m")).select("k", F.col("m.p").alias("p"))


def flatten_records(df: DataFrame, key: str, payload: str, order: str, lists: Iterable[str] = RECORD_LISTS, values: bool = True, only: Iterable[str] | None = None) -> DataFrame:
    """Rows (key, record_path, parent_path, schema_path, list_name, ordinal, depth[, record]) of every nested record.

    ``only`` names the lists whose rows are wanted; the others are walked, but neither written nor passed on.
    """
    names = frozenset(lists)
    wanted = names if only is None else frozenset(only)
    kind = df.schema[key].dataType
    fields = [T.StructField(key, kind), T.StructField("record_path", T.StringType()), T.StructField("parent_path", T.StringType()), T.StructField("list_name", T.StringType()), T.StructField("ordinal", T.IntegerType())]
    if values:
        fields.append(T.StructField("record", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at, path, parent, lname, ordinal, record = [], [], [], [], [], []
            for i in range(batch.num_rows):
                for label, cut, name, k, rec in label_records(texts[i].as_py(), names, values):
                    if name not in wanted:
                        continue
                    at.append(i)
                    path.append(label)
                    parent.append(label[:cut])
                    lname.append(name)
                    ordinal.append(k)
                    if values:
                        record.append(own_fields(rec, names))
                if len(path) >= 50_000:
                    yield emit(ids, at, path, parent, lname, ordinal, record)
                    at, path, parent, lname, ordinal, record = [], [], [], [], [], []
            if path:
                yield emit(ids, at, path, parent, lname, ordinal, record)

    def emit(ids, at, path, parent, lname, ordinal, record) -> pa.RecordBatch:
        columns = [ids.take(pa.array(at, pa.int64())), pa.array(path, pa.string()), pa.array(parent, pa.string()), pa.array(lname, pa.string()), pa.array(ordinal, pa.int32())]
        if values:
            columns.append(pa.array(record, pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    latest = latest_payloads(df, key, payload, order).where(F.col("p").isNotNull())
    rows = latest.mapInArrow(run, T.StructType(fields))
    return rows if not values else rows.withColumn("schema_path", schema_path(F.col("record_path"))).withColumn("depth", F.size(F.split("schema_path", r"\.")))


def schema_path(label: Column) -> Column:
    """A label without its ordinals: the name of the table its row belongs to."""
    return F.regexp_replace(label, r"\[\d+\]", "")


def in_table(path: Column, table: str) -> Column:
    """Whether a schema path is that of a table: the table's path, wherever in a document it begins."""
    return (path == table) | path.endswith("." + table)


def record_table(records: DataFrame, key: str, tables: Iterable[str], columns: dict[str, str]) -> DataFrame:
    """One flat table: the records of the given schema paths with their JSON fields (path: type) as typed columns."""
    picked = records.where(reduce(Column.__or__, [in_table(F.col("schema_path"), t) for t in tables]))
    typed = [F.expr(f"try_variant_get(v, '$.{path}', '{kind}')").alias(path.replace(".", "_")) for path, kind in columns.items()]
    return picked.withColumn("v", F.try_parse_json("record")).select(key, "record_path", "parent_path", *typed)


def write_tables(records: DataFrame, folder: str) -> DataFrame:
    """Write all records once, a folder for each list and in it the rows by schema path, and give them as they are read back.

    Tables of one or several schema paths are then read without parsing a payload again: ``record_table`` over what this
    gives reads only the folders and row groups of its paths.
    """
    records.repartition("list_name", "schema_path", F.pmod(F.xxhash64("record_path"), F.lit(max(1, records.sparkSession.sparkContext.defaultParallelism)))).sortWithinPartitions("list_name", "schema_path").write.partitionBy("list_name").parquet(folder)
    return records.sparkSession.read.schema(records.schema).parquet(folder)
