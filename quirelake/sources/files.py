"""Files of a workspace as DataFrames: listing, fingerprints, formats, and entities by a Python data source or a map.

``scan`` keeps one row an entity with the fields as JSON, so one pass over a file gives all its tables; ``entity`` makes
one of them typed. Bytes are read by Spark's binary file source, in parallel, one file a row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quirelake.operators.status import OFFICE_MAGIC, PDF_MAGIC, detect_format
from quirelake.sources.office import parse_docx, parse_pptx, parse_xlsx
from quirelake.sources.packages import entries
from quirelake.sources.pdf import parse_pdf

PARSERS = {"xlsx": parse_xlsx, "docx": parse_docx, "pptx": parse_pptx, "pdf": parse_pdf}
SCAN = "object_path string, format_id string, source_hash string, entity string, entity_no int, fields string"

TABLES = {
    "sheets": "element_id string, name string, idx int, rows int, cols int, hidden boolean, merges array<string>, freeze_panes string, zoom int, show_gridlines boolean, right_to_left boolean, tab_color string, auto_filter string, page_orientation string",
    "cells": "element_id string, sheet string, address string, row int, col int, kind string, v_str string, v_num double, v_int bigint, v_bool boolean, formula string, style_id string, number_format string",
    "named_ranges": "element_id string, name string, formula string",
    "styles": "style_id string",
    "features": "sheet string, feature string",
    "annotations": "element_id string, kind string, container string, anchor string, author string, text string",
    "paragraphs": "element_id string, idx int, outline_level int, style_id string, text string, editable boolean, in_table boolean",
    "story_paragraphs": "element_id string, story string, part string, idx int, outline_level int, style_id string, text string, editable boolean, in_table boolean",
    "slides": "element_id string, name string, idx int, part_name string, notes string, notes_part_name string",
    "shapes": "element_id string, slide string, name string, ord int, text string",
    "slide_table_cells": "element_id string, slide string, table_name string, row int, col int, text string, bold boolean, italic boolean",
    "pdf_documents": "encrypted boolean, signed boolean, title string, author string, subject string, outline array<string>",
    "pages": "element_id string, number int, text string, rotate int",
    "fields": "element_id string, name string, field_type string, value string, export_values array<string>, options array<string>, page int, max_length int, read_only boolean, required boolean, no_export boolean, multiline boolean, password boolean, combo boolean, edit boolean, do_not_spell_check boolean, do_not_scroll boolean, comb boolean, rich_text boolean, multi_select boolean",
    "errors": "message string",
}


def parse_file(fmt: str, blob: bytes) -> dict[str, list[dict]]:
    """The entities of a file; one error row if it cannot be read."""
    try:
        return PARSERS[fmt](blob)
    except Exception as error:  # noqa: BLE001  a broken file must not end a scan of all others
        return {"errors": [{"message": f"{type(error).__name__}: {error}"[:500]}]}


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(object_path, size, modified_ns, source_hash, content) of all files below a folder; paths are relative to it."""
    return as_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder), folder)


def as_files(found: DataFrame, folder: str) -> DataFrame:
    """What the binary file source gives, with paths relative to the folder; content is read only if it or the hash is asked for."""
    root = re.sub(r"^\w+:/*", "/", folder).rstrip("/") + "/"  # schemes are written with one slash or three
    return found.select(F.regexp_replace("path", "^.*?" + re.escape(root), "").alias("object_path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), F.sha2("content", 256).alias("source_hash"), "content")


def hashes(paths: DataFrame, folder: str) -> DataFrame:
    """(path, source_hash) of some files below a folder that all workers see, given by (path); others are not opened."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import os

        for frame in frames:
            out = []
            for path in frame["path"]:
                with open(os.path.join(folder, path), "rb") as file:
                    out.append(hashlib.file_digest(file, "sha256").hexdigest())
            yield frame.assign(source_hash=out)

    return paths.select("path").mapInPandas(run, "path string, source_hash string")


def with_format(files: DataFrame) -> DataFrame:
    """The format of each file by extension, first bytes and the names in its package; files of none are left out."""

    @F.pandas_udf("array<string>")
    def names(blobs: pd.Series) -> pd.Series:
        def one(b):
            try:
                return [e.name for e in entries(bytes(b))[0]]
            except ValueError:
                return None

        return blobs.map(one)

    magic = F.substring(F.hex(F.substring("content", 1, 16)), 1, 32)
    short = F.when(magic.startswith(OFFICE_MAGIC), names("content"))
    marked = files.withColumn("magic", magic).withColumn("parts", short)
    return detect_format(marked, "object_path", "magic", "parts").where(F.col("detected").isNotNull()).withColumnRenamed("detected", "format_id").drop("magic", "parts", "score")


def scan(files: DataFrame) -> DataFrame:
    """One row an entity of every file (object_path, format_id, source_hash, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, fmt, digest, blob in frame.itertuples(index=False, name=None):
                rows = [(path, fmt, digest, name, i, json.dumps(r, ensure_ascii=False)) for name, listed in parse_file(fmt, bytes(blob)).items() for i, r in enumerate(listed)]
                for k in range(0, len(rows), 20_000):
                    yield pd.DataFrame(rows[k : k + 20_000], columns=[c.split()[0] for c in SCAN.split(", ")])

    return files.select("object_path", "format_id", "source_hash", "content").mapInPandas(run, SCAN)


def entity(scanned: DataFrame, name: str) -> DataFrame:
    """One table of a scan, typed: object_path and the columns of ``TABLES``."""
    return scanned.where(F.col("entity") == name).select("object_path", F.from_json("fields", TABLES[name]).alias("x")).select("object_path", "x.*")


class FilePartition(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.per_partition = int(options.get("filesPerPartition", 64))

    def partitions(self) -> list[InputPartition]:
        import os

        found = sorted(os.path.join(d, f) for d, _, files in os.walk(self.folder) for f in files if f.rpartition(".")[2].lower() in PARSERS)
        return [FilePartition(found[i : i + self.per_partition]) for i in range(0, len(found), self.per_partition)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        import hashlib
        import os

        for path in partition.paths:
            with open(path, "rb") as file:
                blob = file.read()
            fmt = path.rpartition(".")[2].lower()
            digest = hashlib.sha256(blob).hexdigest()
            for name, listed in parse_file(fmt, blob).items():
                for i, row in enumerate(listed):
                    yield os.path.relpath(path, self.folder), fmt, digest, name, i, json.dumps(row, ensure_ascii=False)


class DocumentSource(DataSource):
    """``spark.read.format("documents").load(folder)``: the same rows as ``scan``, for folders that all workers see."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCAN

    def reader(self, schema) -> DataSourceReader:
        return DocumentReader(self.options)
