"""Queries of the edit operations: one operation an object, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import ids
from quirelake.operators import edits
from quirelake.plans.workspace import _formula_cells
from quirelake.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def operations(objects: DataFrame, kind: str, payload: Column) -> DataFrame:
    """One operation for each object."""
    return objects.select(F.concat(F.lit("op:"), "object_path").alias("op_id"), "object_path", F.lit(kind).alias("kind"), payload.alias("payload"))


def _json(**fields) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def _notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "object_path string, element_id string, kind string, container string, anchor string, author string, text string")


def _docx(spark: SparkSession, sf: str) -> tuple[edits.Tables, DataFrame]:
    rows = table(spark, sf, "paragraphs").select("object_path", "element_id", "idx", "outline_level", "style_id", "text", "editable", "in_table")
    return {"paragraphs": rows, "annotations": _notes(spark)}, rows.select("object_path").distinct()


def _pptx(spark: SparkSession, sf: str) -> tuple[edits.Tables, DataFrame]:
    rows = table(spark, sf, "shapes").select("object_path", "element_id", "slide", "name", "ord", "text")
    slides = rows.groupBy("object_path", F.col("slide").alias("name")).agg((F.regexp_extract(F.first("slide"), r"(\d+)$", 1).cast("int") - 1).alias("idx"))
    slides = slides.select("object_path", ids.element_id("slide", F.col("name"), F.col("idx")).alias("element_id"), "name", "idx", F.lit("").alias("part_name"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("notes_part_name"))
    return {"shapes": rows, "slides": slides, "annotations": _notes(spark)}, rows.select("object_path").distinct()


def _pdf(spark: SparkSession, sf: str) -> tuple[edits.Tables, DataFrame]:
    rows = table(spark, sf, "pdf_pages").select("object_path", "element_id", F.col("page_number").alias("number"), "text", "rotate")
    return {"pages": rows, "annotations": _notes(spark)}, rows.select("object_path").distinct()


@query("docx_replace_across", "SELECT object_path, CAST(idx AS VARCHAR) AS target, text AS before, replace(text, 'margin', 'MARGIN') AS after FROM paragraphs WHERE editable AND contains(text, 'margin')")
def docx_replace_across(spark: SparkSession, sf: str) -> DataFrame:
    tables, objects = _docx(spark, sf)
    done = edits.apply_kind(tables, operations(objects, "replace_across_paragraphs", _json(find="margin", replace="MARGIN")), "docx", "replace_across_paragraphs")
    return done.diff.select("object_path", "target", F.get_json_object("before", "$.text").alias("before"), F.get_json_object("after", "$.text").alias("after"))


@query("docx_insert_paragraph", "SELECT object_path, CASE WHEN idx > 2 AND object_path IN (SELECT object_path FROM paragraphs WHERE idx = 2) THEN idx + 1 ELSE idx END AS idx, text FROM paragraphs UNION ALL SELECT DISTINCT object_path, 3, 'put in' FROM paragraphs WHERE idx = 2")
def docx_insert_paragraph(spark: SparkSession, sf: str) -> DataFrame:
    tables, objects = _docx(spark, sf)
    return edits.apply_kind(tables, operations(objects, "insert_paragraph", _json(after=2, text="put in")), "docx", "insert_paragraph").tables["paragraphs"].select("object_path", "idx", "text")


@query("docx_delete_paragraph", "WITH d AS (SELECT object_path FROM paragraphs WHERE idx = 1 AND editable) SELECT object_path, CASE WHEN idx > 1 AND object_path IN (SELECT object_path FROM d) THEN idx - 1 ELSE idx END AS idx, element_id FROM paragraphs WHERE NOT (idx = 1 AND object_path IN (SELECT object_path FROM d))")
def docx_delete_paragraph(spark: SparkSession, sf: str) -> DataFrame:
    tables, objects = _docx(spark, sf)
    return edits.apply_kind(tables, operations(objects, "delete_paragraph", _json(index=1)), "docx", "delete_paragraph").tables["paragraphs"].select("object_path", "idx", "element_id")


@query("docx_set_style", "SELECT object_path, idx, CASE WHEN idx = 0 AND editable THEN 'Heading9' ELSE style_id END AS style_id FROM paragraphs")
def docx_set_style(spark: SparkSession, sf: str) -> DataFrame:
    tables, objects = _docx(spark, sf)
    return edits.apply_kind(tables, operations(objects, "set_paragraph_style", _json(index=0, style_id="Heading9")), "docx", "set_paragraph_style").tables["paragraphs"].select("object_path", "idx", "style_id")


@query("docx_locked", "SELECT object_path, 'rejected' AS code FROM paragraphs WHERE idx = 0 AND NOT editable UNION ALL SELECT object_path, 'not_found' FROM (SELECT DISTINCT object_path FROM paragraphs) WHERE object_path NOT IN (SELECT object_path FROM paragraphs WHERE idx = 0)")
def docx_locked(spark: SparkSession, sf: str) -> DataFrame:
    """Edits that are refused: locked paragraphs and ones that are not there."""
    tables, objects = _docx(spark, sf)
    return edits.apply_kind(tables, operations(objects, "set_paragraph_bold", _json(index=0, bold=True)), "docx", "set_paragraph_bold").errors.select("object_path", "code")


@query("pptx_replace_text", "SELECT object_path, slide, ord, CASE WHEN slide = 'Slide 1' AND contains(text, 'e') THEN replace(text, 'e', 'E') ELSE text END AS text FROM shapes")
def pptx_replace_text(spark: SparkSession, sf: str) -> DataFrame:
    tables, objects = _pptx(spark, sf)
    return edits.apply_kind(tables, operations(objects, "replace_across_shapes", _json(slide="1", find="e", replace="E")), "pptx", "replace_across_shapes").tables["shapes"].select("object_path", "slide", "ord", "text")


@query("pptx_move_slide", "WITH s AS (SELECT DISTINCT object_path, slide AS name, CAST(regexp_extract(slide, '([0-9]+)$', 1) AS INT) - 1 AS idx FROM shapes), m AS (SELECT object_path FROM s GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (WHERE idx = 2) = 1) SELECT object_path, name, CASE WHEN object_path NOT IN (SELECT object_path FROM m) OR idx > 2 THEN idx WHEN idx = 2 THEN 0 ELSE idx + 1 END AS idx FROM s")
def pptx_move_slide(spark: SparkSession, sf: str) -> DataFrame:
    tables, objects = _pptx(spark, sf)
    return edits.apply_kind(tables, operations(objects, "move_slide", _json(slide="Slide 3", to_index=0)), "pptx", "move_slide").tables["slides"].select("object_path", "name", "idx")


@query("pptx_add_textbox", "WITH s AS (SELECT DISTINCT object_path FROM shapes WHERE slide = 'Slide 2'), n AS (SELECT object_path, list(name) AS names, max(ord) AS last FROM shapes WHERE slide = 'Slide 2' GROUP BY 1) SELECT object_path, 'Slide 2' AS slide, list_filter(list_transform(generate_series(1, len(names) + 1), lambda i: 'TextBox ' || i), lambda x: NOT list_contains(names, x))[1] AS name, last + 1 AS ord FROM n")
def pptx_add_textbox(spark: SparkSession, sf: str) -> DataFrame:
    tables, objects = _pptx(spark, sf)
    done = edits.apply_kind(tables, operations(objects, "add_textbox", _json(slide="2", text="new")), "pptx", "add_textbox")
    return done.tables["shapes"].where("element_id like 'new_%'").select("object_path", "slide", "name", "ord")


@query("pdf_rotate_page", "SELECT object_path, page_number AS number, CASE WHEN page_number = 1 THEN 180 ELSE rotate END AS rotate FROM pdf_pages")
def pdf_rotate_page(spark: SparkSession, sf: str) -> DataFrame:
    tables, objects = _pdf(spark, sf)
    return edits.apply_kind(tables, operations(objects, "rotate_page", _json(page=1, degrees=180)), "pdf", "rotate_page").tables["pages"].select("object_path", "number", "rotate")


@query("pdf_comments", "SELECT object_path, CAST(max(page_number) AS VARCHAR) AS container, 'seen' AS text FROM pdf_pages GROUP BY 1")
def pdf_comments(spark: SparkSession, sf: str) -> DataFrame:
    tables, objects = _pdf(spark, sf)
    last = tables["pages"].groupBy("object_path").agg(F.max("number").alias("last"))
    return edits.apply_kind(tables, operations(last, "insert_comment", _json(page=F.col("last"), contents="seen")), "pdf", "insert_comment").tables["annotations"].select("object_path", "container", "text")


@query("xlsx_insert_row", """
WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS object_path, CAST(l_linenumber AS INT) AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL)
SELECT object_path, 'c_' || n AS element_id, CASE WHEN n >= 3 THEN n + 2 ELSE n END AS new_row, '=SUM(Data!B2:C' || (p % 90 + 3) || ')+A' || CASE WHEN n + 1 >= 3 THEN n + 3 ELSE n + 1 END || '*Rate&"A1"' AS formula FROM l""")
def xlsx_insert_row(spark: SparkSession, sf: str) -> DataFrame:
    """Two rows come in before the third of each order's sheet; cells and formulas follow."""
    cells = _formula_cells(spark, sf).withColumn("address", F.lit("")).withColumn("kind", F.lit("empty"))
    sheets = cells.select("object_path").distinct().select("object_path", F.lit("Lines").alias("name"), F.lit(0).alias("idx"))
    ops = operations(sheets, "insert_row", _json(sheet="lines", at=3, count=2))
    return edits.apply_kind({"cells": cells, "sheets": sheets}, ops, "xlsx", "insert_row").tables["cells"].select("object_path", "element_id", F.col("row").alias("new_row"), "formula")


@query("field_flags", "SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN event_type = 'error' THEN 2 ELSE 0 END + CASE WHEN value > 50 THEN 4096 ELSE 0 END AS flags, event_type = 'error' AS required, coalesce(value > 50, false) AS multiline FROM events")
def field_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flags of form fields packed into bits and taken out again."""
    bits = F.when(F.col("event_id") % 2 == 0, 1).otherwise(0) + F.when(F.col("event_type") == "error", 2).otherwise(0) + F.when(F.col("value") > 50, 4096).otherwise(0)
    packed = table(spark, sf, "events").select("event_id", "user_id", bits.alias("flags"))
    bit = lambda n: F.shiftright("flags", n - 1).bitwiseAND(1) == 1
    return packed.withColumn("required", bit(2)).withColumn("multiline", bit(13))


@query("edit_capabilities")
def edit_capabilities(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(edits.capabilities(), "format_id string, operation string, payload string, entity string")
