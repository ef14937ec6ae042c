"""Queries over files: packages and forms are made from tables, by writers that know nothing of the parsers, and read again.

Each file holds a bounded number of rows, whatever the table.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.session import table
from quirelake.sources import files, packages

#: Rows of a table that go into one file.
FILE_ROWS = 400
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def _package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def _related(*pairs: tuple[str, str]) -> str:
    return _RELS.format("".join(f'<Relationship Id="r{i}" Type="{_REL}/{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(pairs)))


def workbook_of(rows: pd.DataFrame) -> bytes:
    """Name, balance, twice the balance as a formula, and whether it is in credit."""
    line = '<row r="{0}"><c r="A{0}" t="inlineStr"><is><t>{1}</t></is></c><c r="B{0}"><v>{2!r}</v></c><c r="C{0}"><f>B{0}*2</f></c><c r="D{0}" t="b"><v>{3}</v></c></row>'
    data = "".join(line.format(k + 1, escape(r.name), r.value, int(r.value > 0)) for k, r in enumerate(rows.rename(columns={"label": "name"}).itertuples(index=False)))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    return _package({"_rels/.rels": _related(("officeDocument", "xl/workbook.xml")), "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{_REL}"><sheets><sheet name="Rows" sheetId="1" r:id="r0"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": _related(("worksheet", "worksheets/sheet1.xml")), "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{data}</sheetData></worksheet>'})


def document_of(rows: pd.DataFrame) -> bytes:
    """A paragraph a row, headings where the value is negative; every fifth stands in a table."""
    def paragraph(k: int, r) -> str:
        style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if r.value < 0 else ""
        text = f"<w:p>{style}<w:r><w:t>{escape(r.label)}</w:t></w:r></w:p>"
        return f"<w:tbl><w:tr><w:tc>{text}</w:tc></w:tr></w:tbl>" if k % 5 == 4 else text

    body = "".join(paragraph(k, r) for k, r in enumerate(rows.itertuples(index=False)))
    return _package({"_rels/.rels": _related(("officeDocument", "word/document.xml")), "word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def deck_of(rows: pd.DataFrame) -> bytes:
    """Ten shapes a slide."""
    ns = f'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{_REL}"'
    shapes = [f'<p:sp><p:nvSpPr><p:cNvPr id="{k + 2}" name="Box {k}"/></p:nvSpPr><p:txBody><a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p></p:txBody></p:sp>' for k, x in enumerate(rows.label)]
    slides = ["".join(shapes[k : k + 10]) for k in range(0, len(shapes), 10)]
    listed = "".join(f'<p:sldId id="{256 + k}" r:id="r{k}"/>' for k in range(len(slides)))
    return _package({"_rels/.rels": _related(("officeDocument", "ppt/presentation.xml")), "ppt/presentation.xml": f"<p:presentation {ns}><p:sldIdLst>{listed}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": _related(*[("slide", f"slides/slide{k}.xml") for k in range(len(slides))])} | {f"ppt/slides/slide{k}.xml": f"<p:sld {ns}><p:cSld><p:spTree>{s}</p:spTree></p:cSld></p:sld>" for k, s in enumerate(slides)})


def form_of(rows: pd.DataFrame) -> bytes:
    """Twenty lines a page, and a text field for each page with the number of its lines."""
    lines = ["(" + x.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") + ") Tj" for x in rows.label]
    pages = [lines[k : k + 20] for k in range(0, len(lines), 20)]
    n = len(pages)
    kids, fields = [f"{4 + 3 * k} 0 R" for k in range(n)], [f"{6 + 3 * k} 0 R" for k in range(n)]
    objects = {1: f"<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [{' '.join(fields)}] >> >>", 2: f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {n} >>", 3: "<< /Title (Rows) >>"}
    for k, page in enumerate(pages):
        content = "BT " + " 0 -14 Td ".join(page) + " ET"
        objects |= {4 + 3 * k: f"<< /Type /Page /Parent 2 0 R /Contents {5 + 3 * k} 0 R >>", 5 + 3 * k: f"<< /Length {len(content)} >>\nstream\n{content}\nendstream", 6 + 3 * k: f"<< /T (Lines{k + 1}) /FT /Tx /V ({len(page)}) >>"}
    return ("%PDF-1.7\n" + "".join(f"{i} 0 obj\n{o}\nendobj\n" for i, o in sorted(objects.items())) + "trailer << /Root 1 0 R /Info 3 0 R >>\n%%EOF").encode("latin-1")


def made(rows: DataFrame, extension: str, make: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """Files of FILE_ROWS rows each, from rows (id, label, value): object_path, format_id, source_hash, content."""
    block = F.floor(F.col("id") / FILE_ROWS).cast("bigint")
    schema = "object_path string, format_id string, content binary"
    write = lambda key, frame: pd.DataFrame({"object_path": [f"made/{key[0]}.{extension}"], "format_id": [extension], "content": [make(frame.sort_values("id"))]})
    out = rows.withColumn("block", block).groupBy("block").applyInPandas(write, schema)
    return out.withColumn("source_hash", F.sha2("content", 256))


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_acctbal").cast("double").alias("value"))


_ROWS = f"r AS (SELECT c_name AS label, c_acctbal AS value, c_custkey // {FILE_ROWS} AS block, CAST(row_number() OVER (PARTITION BY c_custkey // {FILE_ROWS} ORDER BY c_custkey) - 1 AS INT) AS k FROM customer)"


def files_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = files.entity(files.scan(made(_customers(spark, sf), "xlsx", workbook_of)), "cells")
    return cells.select("object_path", "sheet", "address", "row", "col", "kind", "v_str", "v_num", "v_bool", "formula")


def files_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return files.entity(files.scan(made(_customers(spark, sf), "docx", document_of)), "paragraphs").select("object_path", "idx", "text", "style_id", "editable", "in_table")


def files_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return files.entity(files.scan(made(_customers(spark, sf), "pptx", deck_of)), "shapes").select("object_path", "slide", "ord", "name", "text")


def files_pages(spark: SparkSession, sf: str) -> DataFrame:
    return files.entity(files.scan(made(_customers(spark, sf), "pdf", form_of)), "pages").select("object_path", "number", "text")


def files_fields(spark: SparkSession, sf: str) -> DataFrame:
    return files.entity(files.scan(made(_customers(spark, sf), "pdf", form_of)), "fields").select("object_path", "name", "field_type", "value")


def files_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Formats by what the files hold; two kinds of them under a name that says nothing."""
    rows = _customers(spark, sf)
    kinds = {"xlsx": workbook_of, "docx": document_of, "pptx": deck_of, "pdf": form_of}
    all_ = None
    for extension, make in kinds.items():
        one = made(rows, extension, make)
        hidden = one.withColumn("object_path", F.regexp_replace("object_path", r"\.\w+$", "")) if extension in ("docx", "pdf") else one
        hidden = hidden.drop("format_id")
        all_ = hidden if all_ is None else all_.unionByName(hidden)
    return files.with_format(all_).groupBy("format_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("object_path").contains(".")).alias("named"))


def package_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Decks taken apart into parts stored once, and put together again byte by byte."""
    slices = packages.explode_packages(made(_customers(spark, sf), "pptx", deck_of), "object_path", "content")
    manifest, parts = packages.snapshot_tables(slices)
    whole = packages.implode_packages(manifest, parts)
    counts = manifest.groupBy("object_path").agg(F.count(F.lit(1)).alias("slices"))
    return whole.select("object_path", "intact").join(counts, "object_path")


QUERIES = {"files_cells": files_cells, "files_paragraphs": files_paragraphs, "files_shapes": files_shapes, "files_pages": files_pages, "files_fields": files_fields, "files_formats": files_formats, "package_roundtrip": package_roundtrip}

ORACLE = {
    "files_cells": f"""WITH {_ROWS}, c AS (SELECT 'made/' || block || '.xlsx' AS object_path, 'Rows' AS sheet, CAST(k + 1 AS INT) AS "row", label, value FROM r)
SELECT object_path, sheet, 'A' || "row" AS address, "row", 1 AS col, 'string' AS kind, label AS v_str, CAST(NULL AS DOUBLE) AS v_num, CAST(NULL AS BOOLEAN) AS v_bool, CAST(NULL AS VARCHAR) AS formula FROM c
UNION ALL SELECT object_path, sheet, 'B' || "row", "row", 2, 'float', NULL, value, NULL, NULL FROM c
UNION ALL SELECT object_path, sheet, 'C' || "row", "row", 3, 'empty', NULL, NULL, NULL, '=B' || "row" || '*2' FROM c
UNION ALL SELECT object_path, sheet, 'D' || "row", "row", 4, 'boolean', NULL, NULL, value > 0, NULL FROM c""",
    "files_paragraphs": f"WITH {_ROWS} SELECT 'made/' || block || '.docx' AS object_path, k AS idx, label AS text, CASE WHEN value < 0 THEN 'Heading1' END AS style_id, true AS editable, k % 5 = 4 AS in_table FROM r",
    "files_shapes": f"WITH {_ROWS} SELECT 'made/' || block || '.pptx' AS object_path, 'Slide ' || (k // 10 + 1) AS slide, CAST(k % 10 AS INT) AS ord, 'Box ' || k AS name, label AS text FROM r",
    "files_pages": f"WITH {_ROWS} SELECT 'made/' || block || '.pdf' AS object_path, CAST(k // 20 + 1 AS INT) AS number, string_agg(label, chr(10) ORDER BY k) AS text FROM r GROUP BY 1, 2",
    "files_fields": f"WITH {_ROWS} SELECT 'made/' || block || '.pdf' AS object_path, 'Lines' || (k // 20 + 1) AS name, 'tx' AS field_type, CAST(count(*) AS VARCHAR) AS value FROM r GROUP BY 1, 2",
    "files_formats": f"WITH {_ROWS}, n AS (SELECT count(DISTINCT block) AS files FROM r) SELECT f AS format_id, files, CASE WHEN f IN ('xlsx', 'pptx') THEN files ELSE 0 END AS named FROM n, (VALUES ('xlsx'), ('docx'), ('pptx'), ('pdf')) v(f)",
    "package_roundtrip": f"WITH {_ROWS} SELECT 'made/' || block || '.pptx' AS object_path, true AS intact, 3 * (3 + CAST(ceil(count(*) / 10.0) AS BIGINT)) + 1 AS slices FROM r GROUP BY block",
}
