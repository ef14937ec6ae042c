import base64
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quirelake.operators import edits
from quirelake.sources.files import TABLES

PNG = base64.b64encode(b"\x89PNG\r\n\x1a\n" + bytes(8)).decode()


@pytest.fixture(scope="module", autouse=True)
def small_plans(spark):
    """Hundreds of plans over a handful of rows: interpreting them is faster than compiling each."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    for k, v in zip(old, ("false", "NO_CODEGEN", "1", "false")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def frame(spark, name, rows):
    schema = "object_path string, " + TABLES[name]
    columns = [c.strip().split()[0] for c in schema.split(",")]
    return spark.createDataFrame([tuple(("o.x" if c == "object_path" else r.get(c)) for c in columns) for r in rows], schema)


@pytest.fixture(scope="module")
def tables(spark):
    cell = lambda sheet, address, row, col, **k: {"element_id": f"c_{sheet}{address}", "sheet": sheet, "address": address, "row": row, "col": col, "kind": "float"} | k
    xlsx = {
        "sheets": [{"element_id": "s1", "name": "Inputs", "idx": 0, "rows": 3, "cols": 2, "hidden": False, "merges": ["D1:E2"]}, {"element_id": "s2", "name": "Summary", "idx": 1, "rows": 2, "cols": 2, "hidden": False, "merges": []}, {"element_id": "s3", "name": "Free", "idx": 2, "rows": 0, "cols": 0, "hidden": False, "merges": []}],
        "cells": [cell("Inputs", "A1", 1, 1, v_num=1.0), cell("Inputs", "A2", 2, 1, v_num=2.0), cell("Inputs", "B2", 2, 2, v_num=4.0, formula="=A2*2"), cell("Inputs", "A3", 3, 1, v_num=3.0), cell("Summary", "A1", 1, 1, v_num=2.0, formula="=Inputs!A2+SUM(Inputs!A1:A3)")],
        "named_ranges": [{"element_id": "n1", "name": "TaxRate", "formula": "Free!$A$1"}],
        "features": [{"sheet": "Summary", "feature": "autoFilter"}],
        "annotations": [{"element_id": "x1", "kind": "comment", "container": "Inputs", "anchor": "A1", "author": "Bo", "text": "old"}],
    }
    par = lambda i, text, **k: {"element_id": f"p{i}", "idx": i, "text": text, "editable": True, "in_table": False} | k
    docx = {"paragraphs": [par(0, "Title 10%"), par(1, "locked 10%", editable=False), par(2, "cell", in_table=True), par(3, "last 10% and 10%")], "story_paragraphs": [{"element_id": "h", "story": "header", "part": "header1", "idx": 0, "text": "h", "editable": True, "in_table": False}, {"element_id": "f", "story": "footer", "part": "footer1", "idx": 0, "text": "f", "editable": True, "in_table": False}], "annotations": []}
    slide = lambda i, notes=None: {"element_id": f"sl{i}", "name": f"Slide {i + 1}", "idx": i, "part_name": f"s{i}", "notes": notes, "notes_part_name": "n" if notes else None}
    pptx = {"slides": [slide(0, "say"), slide(1), slide(2)], "shapes": [{"element_id": "sh1", "slide": "Slide 1", "name": "KPI", "ord": 0, "text": "Rate 10%"}, {"element_id": "sh2", "slide": "Slide 1", "name": "Title", "ord": 1, "text": "10% of it"}], "slide_table_cells": [{"element_id": "tc", "slide": "Slide 1", "table_name": "Table 1", "row": 0, "col": 0, "text": "x", "bold": False, "italic": False}], "annotations": []}
    base = dict.fromkeys(("read_only", "required", "no_export", "multiline", "password", "combo", "edit", "do_not_spell_check", "do_not_scroll", "comb", "rich_text", "multi_select"), False)
    field = lambda n, kind, value=None, **k: base | {"element_id": f"f_{n}", "name": n, "field_type": kind, "value": value, "export_values": [], "options": []} | k
    pdf = {"fields": [field("Name", "tx", "Ada"), field("Agree", "btn", "Off", export_values=["Yes", "Off"]), field("Level", "btn", "Off", export_values=["Low", "High", "Off"]), field("Dept", "ch", "A"), field("Fixed", "tx", "z", read_only=True), field("Sign", "sig")], "pages": [{"element_id": "pg1", "number": 1, "text": "t", "rotate": None}], "pdf_documents": [{"encrypted": False, "signed": False, "title": "T", "author": "A", "subject": None, "outline": []}], "annotations": []}
    return {fmt: {n: frame(spark, n, rows).cache() for n, rows in t.items()} for fmt, t in {"xlsx": xlsx, "docx": docx, "pptx": pptx, "pdf": pdf}.items()}


def run(spark, tables, fmt, kind, *payloads):
    ops = spark.createDataFrame([(f"op{i}", "o.x", kind, json.dumps(p)) for i, p in enumerate(payloads)], "op_id string, object_path string, kind string, payload string")
    return edits.apply_kind(tables[fmt], ops, fmt, kind)


GOOD = {
    "xlsx": {
        "set_cell_value": {"sheet": "inputs", "address": "$C$9", "value": "5", "value_kind": "float"}, "set_cell_formula": {"sheet": "Inputs", "address": "A1", "formula": "B2*2"}, "set_range": {"sheet": "Inputs", "start_cell": "B5", "values": [["1", "x"], [None, "2"]]},
        "insert_row": {"sheet": "Inputs", "at": 2, "count": 2}, "delete_row": {"sheet": "Inputs", "at": 2}, "insert_column": {"sheet": "Inputs", "at": 1}, "delete_column": {"sheet": "Inputs", "at": 1}, "add_sheet": {"name": "New", "after": "Inputs"}, "rename_sheet": {"from": "inputs", "to": "In puts"},
        "delete_sheet": {"name": "Free"}, "merge_cells": {"sheet": "Inputs", "range": "A1:B2"}, "unmerge_cells": {"sheet": "Inputs", "range": "D1:E2"}, "set_column_width": {"sheet": "Inputs", "column": "B", "width": 20}, "set_row_height": {"sheet": "Inputs", "row": 2, "height": 30},
        "freeze_panes": {"sheet": "Inputs", "cell": "B2"}, "set_sheet_zoom": {"sheet": "Inputs", "zoom": 90}, "set_show_gridlines": {"sheet": "Inputs", "show": False}, "set_right_to_left": {"sheet": "Inputs", "rtl": True}, "define_name": {"name": "taxrate", "formula": "=Inputs!$B$2"}, "delete_name": {"name": "TAXRATE"},
        "hide_sheet": {"sheet": "Inputs", "hidden": True}, "set_tab_color": {"sheet": "Inputs", "color": "#12ab34"}, "set_auto_filter": {"sheet": "Inputs", "range": "A1:B3"}, "set_print_area": {"sheet": "Inputs", "range": "A1:B3"}, "set_print_titles": {"sheet": "Inputs", "rows": "1:2", "cols": "A:B"},
        "set_page_orientation": {"sheet": "Inputs", "orientation": "landscape"}, "set_paper_size": {"sheet": "Inputs", "paper_size": 9}, "set_print_scale": {"sheet": "Inputs", "scale": 80}, "set_fit_to_page": {"sheet": "Inputs", "width": 1, "height": 0}, "set_center_on_page": {"sheet": "Inputs", "horizontal": True, "vertical": False},
        "set_page_margins": {"sheet": "Inputs", "left": 1, "right": 1, "top": 1, "bottom": 0.5}, "set_header_footer": {"sheet": "Inputs", "header": "h"}, "set_cell_font": {"sheet": "Inputs", "address": "A1", "bold": True, "color": "112233"}, "set_cell_fill": {"sheet": "Inputs", "address": "A1", "color": "FF112233"},
        "insert_comment": {"sheet": "Inputs", "address": "A2", "text": "why"}, "insert_picture": {"sheet": "Inputs", "from_cell": "C3", "bytes_base64": PNG, "content_type": "image/png"},
    },
    "docx": {
        "set_paragraph_text": {"index": 0, "text": "ab", "runs": [{"text": "a"}, {"text": "b"}]}, "insert_paragraph": {"after": 0, "text": "new"}, "delete_paragraph": {"index": 2}, "set_paragraph_style": {"index": 0, "style_id": "Heading1"}, "set_paragraph_alignment": {"index": 0, "alignment": "justify"},
        "set_paragraph_spacing": {"index": 0, "before_pt": 6.5}, "insert_page_break": {"index": 0}, "set_paragraph_bold": {"index": 0, "bold": True}, "set_paragraph_italic": {"index": 0, "italic": True}, "set_paragraph_underline": {"index": 0, "underline": False}, "set_paragraph_font_size": {"index": 0, "size_pt": 12},
        "set_paragraph_font_name": {"index": 0, "font": "Arial"}, "set_paragraph_font_color": {"index": 0, "color": "#aabbcc"}, "set_paragraph_highlight": {"index": 0, "color": "yellow"}, "set_paragraph_strikethrough": {"index": 0, "strikethrough": True}, "set_paragraph_vert_align": {"index": 0, "vert_align": "superscript"},
        "set_paragraph_caps": {"index": 0, "caps": "small"}, "set_paragraph_hyperlink": {"index": 0, "url": "https://x.example"}, "set_paragraph_bullet": {"index": 0, "bullet": True}, "set_cell_shading": {"index": 2, "color": "aabbcc"}, "replace_paragraph_text": {"index": 3, "find": "10%", "replace": "12%"},
        "replace_across_paragraphs": {"find": "10%", "replace": "12%"}, "insert_comment": {"index": 0, "text": "n"}, "insert_picture": {"index": 0, "bytes_base64": PNG, "content_type": "image/png"}, "set_header_paragraph_text": {"part": "header1", "index": 0, "text": "x"}, "set_footer_paragraph_text": {"part": "footer1", "index": 0, "text": "x"},
    },
    "pptx": {
        "set_shape_text": {"slide": "1", "shape": "KPI", "text": "x"}, "set_table_cell_text": {"slide": "Slide 1", "table": "Table 1", "row": 0, "col": 0, "text": "y"}, "set_table_cell_bold": {"slide": "slide1", "table": "Table 1", "row": 0, "col": 0, "bold": True}, "set_table_cell_italic": {"slide": "1", "table": "Table 1", "row": 0, "col": 0, "italic": True},
        "set_notes_text": {"slide": "1", "text": "n"}, "add_slide": {}, "delete_slide": {"slide": "2"}, "move_slide": {"slide": "3", "to_index": 0}, "add_textbox": {"slide": "1", "text": "t"}, "delete_shape": {"slide": "1", "shape": "sh1"}, "rename_shape": {"slide": "1", "shape": "KPI", "name": "New"},
        "set_shape_bold": {"slide": "1", "shape": "KPI", "bold": True}, "set_shape_italic": {"slide": "1", "shape": "KPI", "italic": True}, "set_shape_underline": {"slide": "1", "shape": "KPI", "underline": True}, "set_shape_font_size": {"slide": "1", "shape": "KPI", "size_pt": None}, "set_shape_font_name": {"slide": "1", "shape": "KPI", "font": "A"},
        "set_shape_font_color": {"slide": "1", "shape": "KPI", "color": "aabbcc"}, "set_shape_highlight": {"slide": "1", "shape": "KPI", "color": "aabbcc"}, "set_shape_strikethrough": {"slide": "1", "shape": "KPI", "strikethrough": True}, "set_shape_vert_align": {"slide": "1", "shape": "KPI", "vert_align": "subscript"}, "set_shape_caps": {"slide": "1", "shape": "KPI", "caps": "all"},
        "set_shape_hyperlink": {"slide": "1", "shape": "KPI", "url": "mailto:a@b.example"}, "set_shape_bullet": {"slide": "1", "shape": "KPI", "bullet": True}, "replace_shape_text": {"slide": "1", "shape": "KPI", "find": "10", "replace": "12"}, "replace_across_shapes": {"slide": "1", "find": "10%", "replace": "12%"},
        "insert_comment": {"slide": "1", "text": "c"}, "insert_picture": {"slide": "1", "bytes_base64": PNG, "content_type": "image/png"},
    },
    "pdf": {
        "set_form_field": {"name": "Agree", "value": "On"}, "clear_form_field": {"name": "Name"}, "clear_all_form_fields": {}, "set_form_fields": {"fields": {"Name": "Bo", "Level": "low"}}, "set_form_field_readonly": {"name": "Name", "readonly": True}, "set_form_field_required": {"name": "Name", "required": True},
        "set_form_field_multiline": {"name": "Name", "multiline": True}, "set_form_field_password": {"name": "Name", "password": True}, "set_form_field_max_length": {"name": "Name", "max_length": 5}, "set_form_field_comb": {"name": "Name", "comb": True}, "set_form_field_do_not_scroll": {"name": "Name", "do_not_scroll": True},
        "set_form_field_do_not_spell_check": {"name": "Name", "do_not_spell_check": True}, "set_form_field_rich_text": {"name": "Name", "rich_text": True}, "set_form_field_no_export": {"name": "Name", "no_export": True}, "set_form_field_multi_select": {"name": "Dept", "multi_select": True}, "set_form_field_combo": {"name": "Dept", "combo": True},
        "set_form_field_edit": {"name": "Dept", "edit": True}, "set_document_metadata": {"title": "New"}, "clear_document_metadata": {}, "insert_comment": {"page": 1, "contents": "c"}, "insert_picture": {"page": 1, "bytes_base64": PNG, "content_type": "image/png"}, "rotate_page": {"page": 1, "degrees": 90},
    },
}


@pytest.mark.parametrize("fmt", list(edits.FORMATS))
def test_every_kind_applies(spark, tables, fmt):
    assert set(GOOD[fmt]) == set(edits.FORMATS[fmt])


    def one(kind, payload):
        done = run(spark, tables, fmt, kind, payload)
        table = done.tables[edits.FORMATS[fmt][kind].entity]
        parts = [done.errors.select(F.concat_ws(" ", "code", "message").alias("x")), done.diff.select(F.lit("diff").alias("x")), table.select(F.lit("row").alias("x")).where(F.xxhash64(*[c for c in table.columns if c != "attrs"]) != 0)]
        return kind, {r.x for r in parts[0].unionByName(parts[1]).unionByName(parts[2]).collect()}

    with ThreadPoolExecutor(8) as pool:
        found = dict(pool.map(lambda kp: one(*kp), GOOD[fmt].items()))
    for kind, got in found.items():
        assert got == {"diff", "row"} - ({"row"} if kind == "delete_name" else set()), (kind, got)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_cells_and_axes(spark, tables):
    done = run(spark, tables, "xlsx", "set_cell_value", {"sheet": "inputs", "address": "A1", "value": "7", "value_kind": "float"}, {"sheet": "Inputs", "address": "A1", "value": "8", "value_kind": "float"}, {"sheet": "Inputs", "address": "Z9", "value": "t"})
    got = {(r.sheet, r.address): r for r in done.tables["cells"].collect()}
    assert got["Inputs", "A1"].v_num == 8 and got["Inputs", "Z9"].v_str == "t" and got["Inputs", "B2"].kind == "empty" and got["Inputs", "B2"].v_num is None and len(got) == 6
    done = run(spark, tables, "xlsx", "insert_row", {"sheet": "Inputs", "at": 2, "count": 2})
    assert rows(done.tables["cells"].where("formula is not null"), "sheet", "address", "formula") == [("Inputs", "B4", "=A4*2"), ("Summary", "A1", "=Inputs!A4+SUM(Inputs!A1:A5)")]
    done = run(spark, tables, "xlsx", "delete_row", {"sheet": "Inputs", "at": 2, "count": 1})
    assert rows(done.tables["cells"], "sheet", "address", "formula") == [("Inputs", "A1", None), ("Inputs", "A2", None), ("Summary", "A1", "=#REF!+SUM(Inputs!A1:A2)")] or rows(done.tables["cells"].where("formula is not null"), "formula") == [("=#REF!+SUM(Inputs!A1:A2)",)]


def test_shifts_that_are_refused(spark, tables):
    done = run(spark, tables, "xlsx", "insert_row", {"sheet": "summary", "at": 1})
    assert [r.message for r in done.errors.collect()] == ["the sheet holds autoFilter"] and done.diff.count() == 0
    done = run(spark, tables, "xlsx", "delete_column", {"sheet": "Free", "at": 1})
    assert [r.message for r in done.errors.collect()] == ["names point at the sheet: TaxRate"]


def test_sheets_and_merges(spark, tables):
    done = run(spark, tables, "xlsx", "rename_sheet", {"from": "inputs", "to": "In puts"})
    assert rows(done.tables["cells"].where("sheet = 'Summary'"), "formula") == [("='In puts'!A2+SUM('In puts'!A1:A3)",)]
    done = run(spark, tables, "xlsx", "delete_sheet", {"name": "Inputs"})
    assert [r.message for r in done.errors.collect()] == ["formulas refer to the sheet"] and done.tables["sheets"].count() == 3
    done = run(spark, tables, "xlsx", "delete_sheet", {"name": "Inputs", "dependency_policy": "replace_references_with_ref_error"})
    assert rows(done.tables["cells"], "formula") == [("=#REF!+SUM(#REF!)",)] and rows(done.tables["sheets"], "idx", "name") == [(0, "Summary"), (1, "Free")]
    done = run(spark, tables, "xlsx", "merge_cells", {"sheet": "Inputs", "range": "E2:F3"})
    assert [r.code for r in done.errors.collect()] == ["rejected"]
    done = run(spark, tables, "xlsx", "add_sheet", {"name": "summary"})
    assert [r.message for r in done.errors.collect()] == ["the name is taken"]


def test_paragraphs_slides_fields(spark, tables):
    done = run(spark, tables, "docx", "replace_across_paragraphs", {"find": "10%", "replace": "12%"})
    assert rows(done.tables["paragraphs"], "idx", "text") == [(0, "Title 12%"), (1, "locked 10%"), (2, "cell"), (3, "last 12% and 12%")] and done.diff.count() == 2
    done = run(spark, tables, "docx", "delete_paragraph", {"index": 1})
    assert [r.message for r in done.errors.collect()] == ["the paragraph is not edited"]
    done = run(spark, tables, "docx", "insert_paragraph", {"after": 1, "text": "n"})
    assert rows(done.tables["paragraphs"], "idx", "text") == [(0, "Title 10%"), (1, "locked 10%"), (2, "n"), (3, "cell"), (4, "last 10% and 10%")]
    done = run(spark, tables, "docx", "set_paragraph_font_size", {"index": 0, "size_pt": 12})
    assert done.tables["paragraphs"].where("idx = 0").first().attrs == {"font_size": "12.0"}
    done = run(spark, tables, "pptx", "move_slide", {"slide": "3", "to_index": 0})
    assert rows(done.tables["slides"], "idx", "element_id") == [(0, "sl2"), (1, "sl0"), (2, "sl1")]
    done = run(spark, tables, "pptx", "rename_shape", {"slide": "1", "shape": "KPI", "name": "Table 1"})
    assert [r.message for r in done.errors.collect()] == ["the name is taken"]
    done = run(spark, tables, "pptx", "add_slide", {"after": "1"})
    assert rows(done.tables["slides"], "idx", "name")[1] == (1, "Slide 2") and done.tables["slides"].count() == 4
    done = run(spark, tables, "pdf", "set_form_fields", {"fields": {"Name": "Bo", "Nope": "x"}})
    assert [r.code for r in done.errors.collect()] == ["not_found"] and done.diff.count() == 0
    done = run(spark, tables, "pdf", "set_form_field", {"name": "Level", "value": "On"}, {"name": "Fixed", "value": "x"}, {"name": "Level", "value": "HIGH"})
    assert rows(done.errors, "op_id", "message") == [("op0", "On is ambiguous"), ("op1", "the field is read only")] and done.tables["fields"].where("name = 'Level'").first().value == "High"
    done = run(spark, tables, "pdf", "clear_all_form_fields", {})
    assert rows(done.tables["fields"], "name", "value") == [("Agree", "Off"), ("Dept", ""), ("Fixed", "z"), ("Level", "Off"), ("Name", ""), ("Sign", None)]


def test_bad_payloads_and_batches(spark, tables):
    for fmt, kind, payload in [("xlsx", "set_sheet_zoom", {"sheet": "Inputs", "zoom": 5}), ("xlsx", "set_range", {"sheet": "Inputs", "start_cell": "A1", "values": [["1"], ["1", "2"]]}), ("docx", "set_paragraph_highlight", {"index": 0, "color": "mauve"}), ("pptx", "set_shape_hyperlink", {"slide": "1", "shape": "KPI", "url": "ftp://x"}), ("pdf", "rotate_page", {"page": 1, "degrees": 45}), ("docx", "insert_picture", {"index": 0, "bytes_base64": PNG, "content_type": "image/jpeg"})]:
        done = run(spark, tables, fmt, kind, payload)
        assert [r.code for r in done.errors.collect()] == ["invalid_payload"] and done.diff.count() == 0, kind
    ops = spark.createDataFrame([("a", "o.x", "set_paragraph_bold", '{"index": 0, "bold": true}'), ("b", "o.x", "set_chart", "{}"), ("c", "no.x", "set_paragraph_bold", '{"index": 0, "bold": true}')], "op_id string, object_path string, kind string, payload string")
    done = edits.apply(tables["docx"], ops, "docx", ["set_paragraph_bold", "insert_comment"])
    assert rows(done.errors, "op_id", "code") == [("b", "unsupported_capability"), ("c", "not_found")] and [r.op_id for r in done.diff.collect()] == ["a"]
    assert done.tables["paragraphs"].where(F.col("attrs")["bold"] == "true").count() == 1
    empty = edits.apply_kind(tables["docx"], ops.limit(0), "docx", "delete_paragraph")
    assert empty.tables["paragraphs"].count() == 4 and empty.errors.count() == 0


def test_operations_on_one_object_take_turns(spark, tables):
    def all_done(fmt, kind, *payloads):
        done = run(spark, tables, fmt, kind, *payloads)
        assert rows(done.errors, "op_id") == [] and rows(done.diff.select("op_id").distinct(), "op_id") == [(f"op{i}",) for i in range(len(payloads))], kind
        return done.tables

    got = all_done("docx", "insert_paragraph", {"after": 0, "text": "a"}, {"after": 1, "text": "b"}, {"after": 0, "text": "c"})["paragraphs"]
    assert rows(got, "idx", "text") == [(0, "Title 10%"), (1, "c"), (2, "a"), (3, "b"), (4, "locked 10%"), (5, "cell"), (6, "last 10% and 10%")]
    assert rows(all_done("docx", "delete_paragraph", {"index": 0}, {"index": 1})["paragraphs"], "idx", "element_id") == [(0, "p1"), (1, "p3")]
    assert rows(all_done("docx", "replace_paragraph_text", {"index": 3, "find": "last", "replace": "first"}, {"index": 0, "find": "10", "replace": "9"}, {"index": 3, "find": "first", "replace": "1st"})["paragraphs"].where("idx in (0, 3)"), "text") == [("1st 10% and 10%",), ("Title 9%",)]
    assert rows(all_done("pptx", "move_slide", {"slide": "3", "to_index": 0}, {"slide": "2", "to_index": 0})["slides"], "idx", "element_id") == [(0, "sl1"), (1, "sl2"), (2, "sl0")]
    assert rows(all_done("pptx", "add_textbox", {"slide": "1"}, {"slide": "Slide 1"}, {"slide": "2"})["shapes"].where("element_id like 'new%'"), "slide", "ord", "name") == [("Slide 1", 2, "TextBox 1"), ("Slide 1", 3, "TextBox 2"), ("Slide 2", 0, "TextBox 1")]
    got = all_done("xlsx", "insert_row", {"sheet": "Inputs", "at": 1}, {"sheet": "inputs", "at": 3, "count": 2})["cells"]
    assert rows(got, "sheet", "address", "formula") == [("Inputs", "A2", None), ("Inputs", "A5", None), ("Inputs", "A6", None), ("Inputs", "B5", "=A5*2"), ("Summary", "A1", "=Inputs!A5+SUM(Inputs!A2:A6)")]
    assert rows(all_done("xlsx", "add_sheet", {"name": "X"}, {"name": "Y", "after": "X"})["sheets"], "idx", "name") == [(0, "Inputs"), (1, "Summary"), (2, "Free"), (3, "X"), (4, "Y")]
    assert rows(all_done("xlsx", "rename_sheet", {"from": "Inputs", "to": "In"}, {"from": "Free", "to": "Open"})["sheets"], "idx", "name") == [(0, "In"), (1, "Summary"), (2, "Open")]
    assert all_done("xlsx", "merge_cells", {"sheet": "Inputs", "range": "A1:B2"}, {"sheet": "Inputs", "range": "A5:B6"})["sheets"].where("idx = 0").first().merges == ["D1:E2", "A1:B2", "A5:B6"]
    got = all_done("xlsx", "set_column_width", {"sheet": "Inputs", "column": "A", "width": 10}, {"sheet": "Inputs", "column": "B", "width": 20}, {"sheet": "Free", "column": "B", "width": 5})["sheets"]
    assert [r.attrs for r in got.orderBy("idx").collect()] == [{"width:A": "10.0", "width:B": "20.0"}, {}, {"width:B": "5.0"}]
    assert all_done("pdf", "set_document_metadata", {"title": "New"}, {"author": "B"})["pdf_documents"].where("title = 'New' and author = 'B'").count() == 1
    done = run(spark, tables, "xlsx", "merge_cells", {"sheet": "Inputs", "range": "A1:B2"}, {"sheet": "Inputs", "range": "B2:C3"})
    assert rows(done.errors, "op_id", "code") == [("op1", "rejected")] and rows(done.diff, "op_id") == [("op0",)]
    done = run(spark, tables, "xlsx", "hide_sheet", *[{"sheet": s, "hidden": True} for s in ("Inputs", "Summary", "Free")])
    assert rows(done.errors, "op_id") == [("op2",)] and rows(done.tables["sheets"].where("not hidden"), "name") == [("Free",)]
