"""Semantic edits of office and form models as set operations on their entity tables.

An operation is a row (op_id, object_path, kind, payload as JSON). All operations of one kind are applied to all objects
at once: payloads are parsed with the kind's schema, checked, joined with the entities they name, and turned into new
rows. What fails gives an error row and changes nothing; nothing is updated in place, every step gives new tables.

Kinds are a table: the entity, how its rows are named, what is set, and which conditions hold. There are few shapes:
setting attributes, upserting cells, inserting, deleting and moving rows in an order, replacing text, adding
annotations, shifting an axis, and changing the set of sheets. Attributes without a column of their own live in the
map column ``attrs``. Operations of one kind on one object take turns in op_id order (compared as text) where one may
depend on another: in orders, axes, sheets, merges, text boxes, and attributes that build on what is there; each then
sees what the ones before it left. Where a row's values are only overwritten, the one with the greater op_id wins.

Defined cases: a null payload field counts as absent; unknown kinds are errors (``unsupported_capability``); an empty
batch changes nothing; operations on objects or elements that are not there are errors (``not_found``).
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import a1
from quirelake.functions.formula import drop_sheet, rename_sheet, shift_formula
from quirelake.session import durable

Tables = dict[str, DataFrame]

HEX6, HEX8 = "^#?[0-9A-Fa-f]{6}$", "^#?([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"
URL = "^(https?://|mailto:).+"
#: Colours that text can be highlighted in.
HIGHLIGHTS = ("black", "blue", "cyan", "darkBlue", "darkCyan", "darkGray", "darkGreen", "darkMagenta", "darkRed", "darkYellow", "green", "lightGray", "magenta", "none", "red", "white", "yellow")
_UP, _LOW = string.ascii_uppercase, string.ascii_lowercase


def same_ci(a: str, b: str) -> str:
    return f"translate({a}, '{_UP}', '{_LOW}') = translate({b}, '{_UP}', '{_LOW}')"


@dataclass(frozen=True)
class Kind:
    """One kind of edit: its shape, entity, payload, how rows are named, what is set, and conditions with their messages."""

    shape: str
    entity: str
    payload: str
    on: str = "true"
    sets: dict[str, str] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)
    rows: dict[str, str] = field(default_factory=dict)
    target: str = "''"
    options: dict[str, str] = field(default_factory=dict)


def _argb(x: str) -> str:
    """Six or eight hexadecimal digits as AARRGGBB."""
    return f"upper(case when length(replace({x}, '#', '')) = 6 then concat('FF', replace({x}, '#', '')) else replace({x}, '#', '') end)"


_SHEET = same_ci("e.name", "p.sheet")
_CELL = f"{same_ci('e.sheet', 'p.sheet')} and e.address = upper(replace(p.address, '$', ''))"


def _sheet(payload: str, sets: dict[str, str], checks: dict[str, str] | None = None, rows: dict[str, str] | None = None) -> Kind:
    return Kind("set", "sheets", "sheet string, " + payload, _SHEET, sets, checks or {}, rows or {}, "p.sheet")


_RANGE = "'^\\\\$?[A-Za-z]{1,3}\\\\$?[0-9]{1,7}(:\\\\$?[A-Za-z]{1,3}\\\\$?[0-9]{1,7})?$'"
_ADDR = "'^\\\\$?[A-Za-z]{1,3}\\\\$?[0-9]{1,7}$'"
_PICTURE = {"p.content_type in ('image/png', 'image/jpeg')": "a picture is PNG or JPEG", "try_to_binary(p.bytes_base64, 'base64') is not null": "bytes_base64 is not base64", "hex(try_to_binary(p.bytes_base64, 'base64')) rlike (case when p.content_type = 'image/png' then '^89504E47' else '^FFD8' end)": "the bytes are not of that type"}

XLSX: dict[str, Kind] = {
    "set_cell_value": Kind("upsert", "cells", "sheet string, address string, value string, value_kind string", _CELL, {"kind": "coalesce(p.value_kind, case when p.value is null then 'empty' else 'string' end)", "v_str": "case when coalesce(p.value_kind, 'string') = 'string' then p.value end", "v_num": "case when p.value_kind = 'float' then try_cast(p.value as double) end", "v_bool": "case when p.value_kind = 'boolean' then try_cast(p.value as boolean) end", "v_int": "cast(null as bigint)", "formula": "cast(null as string)"}, {f"p.address rlike {_ADDR}": "no address", "coalesce(p.value_kind, 'string') in ('string', 'float', 'boolean', 'empty')": "no kind of value", "coalesce(p.value_kind, '') <> 'float' or try_cast(p.value as double) is not null": "no number"}),
    "set_cell_formula": Kind("upsert", "cells", "sheet string, address string, formula string", _CELL, {"kind": "'empty'", "v_str": "cast(null as string)", "v_num": "cast(null as double)", "v_bool": "cast(null as boolean)", "v_int": "cast(null as bigint)", "formula": "concat('=', regexp_replace(p.formula, '^=', ''))"}, {f"p.address rlike {_ADDR}": "no address", "trim(regexp_replace(p.formula, '^=', '')) <> ''": "an empty formula"}),
    "set_range": Kind("matrix", "cells", "sheet string, start_cell string, values array<array<string>>", _CELL, {}, {f"p.start_cell rlike {_ADDR}": "no address", "size(p.values) > 0 and forall(p.values, r -> size(r) = size(get(p.values, 0)) and size(r) > 0)": "rows must be there and of one length", "size(p.values) * size(get(p.values, 0)) <= 10000": "more than 10,000 cells"}),
    "insert_row": Kind("axis", "cells", "sheet string, at int, count int", checks={"p.at >= 1 and coalesce(p.count, 1) >= 1": "rows count from 1"}, options={"axis": "row", "insert": "1"}),
    "delete_row": Kind("axis", "cells", "sheet string, at int, count int", checks={"p.at >= 1 and coalesce(p.count, 1) >= 1": "rows count from 1"}, options={"axis": "row", "insert": ""}),
    "insert_column": Kind("axis", "cells", "sheet string, at int, count int", checks={"p.at >= 1 and coalesce(p.count, 1) >= 1": "columns count from 1"}, options={"axis": "col", "insert": "1"}),
    "delete_column": Kind("axis", "cells", "sheet string, at int, count int", checks={"p.at >= 1 and coalesce(p.count, 1) >= 1": "columns count from 1"}, options={"axis": "col", "insert": ""}),
    "add_sheet": Kind("add_sheet", "sheets", "name string, after string", checks={"length(p.name) between 1 and 31 and not p.name rlike '[\\\\[\\\\]:*?/\\\\\\\\]' and not p.name rlike \"^'|'$\"": "no name for a sheet"}),
    "rename_sheet": Kind("rename_sheet", "sheets", "`from` string, to string", checks={"length(p.to) between 1 and 31 and not p.to rlike '[\\\\[\\\\]:*?/\\\\\\\\]' and not p.to rlike \"^'|'$\"": "no name for a sheet"}),
    "delete_sheet": Kind("delete_sheet", "sheets", "name string, dependency_policy string", checks={"coalesce(p.dependency_policy, 'reject_if_referenced') in ('reject_if_referenced', 'replace_references_with_ref_error')": "no such policy"}),
    "merge_cells": Kind("merge", "sheets", "sheet string, range string", _SHEET, checks={f"p.range rlike {_RANGE} and p.range like '%:%'": "a merge has more than one cell"}, target="p.sheet"),
    "unmerge_cells": _sheet("range string", {"merges": "array_remove(e.merges, upper(replace(p.range, '$', '')))"}, rows={"array_contains(e.merges, upper(replace(p.range, '$', '')))": "no such merge"}),
    "set_column_width": _sheet("column string, width double", {"@width:": "p.column=p.width"}, {"p.width > 0 and p.width <= 255": "width is above 0 and at most 255", "p.column rlike '^[A-Za-z]{1,3}$'": "no column"}),
    "set_row_height": _sheet("row int, height double", {"@height:": "p.row=p.height"}, {"p.height > 0 and p.height <= 409": "height is above 0 and at most 409", "p.row >= 1": "no row"}),
    "freeze_panes": _sheet("cell string", {"freeze_panes": "nullif(upper(p.cell), 'A1')"}, {f"p.cell is null or p.cell rlike {_ADDR}": "no address"}),
    "set_sheet_zoom": _sheet("zoom int", {"zoom": "p.zoom"}, {"p.zoom between 10 and 400": "zoom is 10 to 400"}),
    "set_show_gridlines": _sheet("`show` boolean", {"show_gridlines": "p.`show`"}, {"p.`show` is not null": "show is missing"}),
    "set_right_to_left": _sheet("rtl boolean", {"right_to_left": "p.rtl"}, {"p.rtl is not null": "rtl is missing"}),
    "define_name": Kind("define_name", "named_ranges", "name string, formula string", checks={"p.name rlike '^[A-Za-z_\\\\\\\\][A-Za-z0-9_.]*$'": "no name", "trim(regexp_replace(p.formula, '^=', '')) <> ''": "an empty formula"}),
    "delete_name": Kind("delete", "named_ranges", "name string", same_ci("e.name", "p.name"), target="p.name"),
    "hide_sheet": _sheet("hidden boolean", {"hidden": "p.hidden"}, {"p.hidden is not null": "hidden is missing"}, {"not p.hidden or e.hidden or e._visible > 1": "the last visible sheet stays"}),
    "set_tab_color": _sheet("color string", {"tab_color": _argb("p.color")}, {f"p.color is null or p.color rlike '{HEX8}'": "no colour"}),
    "set_auto_filter": _sheet("range string", {"auto_filter": "upper(replace(p.range, '$', ''))"}, {f"p.range is null or p.range rlike {_RANGE}": "no range"}),
    "set_print_area": _sheet("range string", {"@print_area": "upper(replace(p.range, '$', ''))"}, {f"p.range is null or p.range rlike {_RANGE}": "no range"}),
    "set_print_titles": _sheet("`rows` string, cols string", {"@print_title_rows": "p.`rows`", "@print_title_cols": "p.cols"}, {"p.`rows` is null or (p.`rows` rlike '^[0-9]+:[0-9]+$' and int(split_part(p.`rows`, ':', 1)) <= int(split_part(p.`rows`, ':', 2)))": "rows are like 1:2", "p.cols is null or p.cols rlike '^[A-Za-z]{1,3}:[A-Za-z]{1,3}$'": "columns are like A:B"}),
    "set_page_orientation": _sheet("orientation string", {"page_orientation": "p.orientation"}, {"p.orientation is null or p.orientation in ('portrait', 'landscape')": "portrait or landscape"}),
    "set_paper_size": _sheet("paper_size int", {"@paper_size": "p.paper_size"}, {"p.paper_size is null or p.paper_size > 0": "a positive code"}),
    "set_print_scale": _sheet("scale int", {"@print_scale": "p.scale"}, {"p.scale is null or p.scale between 10 and 400": "scale is 10 to 400"}),
    "set_fit_to_page": _sheet("width int, height int", {"@fit_width": "p.width", "@fit_height": "p.height"}, {"(p.width is null) = (p.height is null)": "both or neither", "coalesce(p.width, 0) >= 0 and coalesce(p.height, 0) >= 0": "no negative pages"}),
    "set_center_on_page": _sheet("horizontal boolean, vertical boolean", {"@center_horizontal": "p.horizontal", "@center_vertical": "p.vertical"}, {"p.horizontal is not null and p.vertical is not null": "both are needed"}),
    "set_page_margins": _sheet("`left` double, `right` double, top double, bottom double, header double, footer double", {"@margin_left": "p.`left`", "@margin_right": "p.`right`", "@margin_top": "p.top", "@margin_bottom": "p.bottom", "@margin_header": "p.header", "@margin_footer": "p.footer"}, {"least(p.`left`, p.`right`, p.top, p.bottom) >= 0 and p.`left` is not null and p.`right` is not null and p.top is not null and p.bottom is not null": "four margins of no negative size", "coalesce(p.header, 0) >= 0 and coalesce(p.footer, 0) >= 0": "no negative margins"}),
    "set_header_footer": _sheet("header string, footer string", {"@header": "p.header", "@footer": "p.footer"}),
    "set_cell_font": Kind("set", "cells", "sheet string, address string, bold boolean, italic boolean, name string, size_pt double, color string", _CELL, {"@?font_bold": "p.bold", "@?font_italic": "p.italic", "@?font_name": "p.name", "@?font_size": "p.size_pt", "@?font_color": _argb("p.color")}, {"coalesce(string(p.bold), string(p.italic), p.name, string(p.size_pt), p.color) is not null": "nothing to set", f"p.color is null or p.color rlike '{HEX8}'": "no colour", "p.size_pt is null or p.size_pt > 0": "a positive size"}, target="concat(p.sheet, '!', p.address)"),
    "set_cell_fill": Kind("set", "cells", "sheet string, address string, color string", _CELL, {"@fill": _argb("p.color")}, {f"p.color is null or p.color rlike '{HEX8}'": "no colour"}, target="concat(p.sheet, '!', p.address)"),
    "insert_comment": Kind("annotate", "annotations", "sheet string, address string, text string, author string", _CELL, {"kind": "'comment'", "container": "e.sheet", "anchor": "e.address", "author": "coalesce(p.author, 'editor')", "text": "p.text"}, {"p.text <> ''": "an empty comment"}, target="concat(p.sheet, '!', p.address)", options={"of": "cells", "once": "1"}),
    "insert_picture": Kind("annotate", "annotations", "sheet string, from_cell string, bytes_base64 string, content_type string", _SHEET, {"kind": "'picture'", "container": "e.name", "anchor": "upper(p.from_cell)", "author": "cast(null as string)", "text": "cast(null as string)"}, {f"p.from_cell rlike {_ADDR}": "no address", **_PICTURE}, target="p.sheet", options={"of": "sheets"}),
}

_PAR = "e.idx = p.index"
_EDIT = {"e.editable": "the paragraph is not edited"}


def _par(payload: str, sets: dict[str, str], checks: dict[str, str] | None = None, rows: dict[str, str] | None = None) -> Kind:
    return Kind("set", "paragraphs", "index int, " + payload, _PAR, sets, checks or {}, rows or _EDIT, "string(p.index)")


def _flag(entity: str, name: str, column: str) -> Kind:
    maker = _par if entity == "paragraphs" else _shape
    return maker(f"{name} boolean", {f"@{column}": f"p.{name}"}, {f"p.{name} is not null": f"{name} is missing"})


def _shape(payload: str, sets: dict[str, str], checks: dict[str, str] | None = None, rows: dict[str, str] | None = None) -> Kind:
    return Kind("set", "shapes", "slide string, shape string, " + payload, f"{_SLIDE.replace('e.name', 'e.slide')} and (e.name = p.shape or e.element_id = p.shape)", sets, checks or {}, rows or {}, "concat(p.slide, '/', p.shape)")


_SLIDE = "(lower(e.name) = lower(p.slide) or lower(e.name) = concat('slide ', regexp_extract(lower(p.slide), '^(?:slide)?([0-9]+)$', 1)))"
_POINTS = {"p.size_pt is null or p.size_pt > 0": "a positive size"}
_ALIGN = "case when p.alignment in ('left', 'start') then 'left' when p.alignment in ('right', 'end') then 'right' when p.alignment in ('both', 'justify') then 'both' else p.alignment end"
_VERT = {"p.vert_align is null or p.vert_align in ('superscript', 'subscript')": "superscript, subscript or nothing"}
_CAPS = {"p.caps is null or p.caps in ('small', 'all')": "small, all or nothing"}
_LINK = {f"p.url is null or p.url rlike '{URL}'": "http, https or mailto"}
_TEXT = {"p.find <> ''": "nothing to find", "p.replace is not null": "replace is missing"}

DOCX: dict[str, Kind] = {
    "set_paragraph_text": _par("text string, runs array<struct<text string>>", {"text": "p.text"}, {"p.text is not null": "text is missing", "p.runs is null or array_join(p.runs.text, '') = p.text": "runs do not add up to text"}),
    "insert_paragraph": Kind("insert", "paragraphs", "after int, text string", "e.idx = p.after", {"text": "p.text", "editable": "true", "in_table": "false", "style_id": "cast(null as string)", "outline_level": "cast(null as int)"}, {"p.text is not null": "text is missing"}, target="string(p.after)", options={"order": "idx"}),
    "delete_paragraph": Kind("delete_ordered", "paragraphs", "index int", _PAR, rows=_EDIT, target="string(p.index)", options={"order": "idx"}),
    "set_paragraph_style": _par("style_id string", {"style_id": "p.style_id"}, {"p.style_id <> ''": "style_id is missing"}),
    "set_paragraph_alignment": _par("alignment string", {"@alignment": _ALIGN}, {"p.alignment in ('left', 'start', 'center', 'right', 'end', 'both', 'justify')": "no alignment"}),
    "set_paragraph_spacing": _par("before_pt double, after_pt double", {"@?space_before_twips": "int(round(p.before_pt * 20))", "@?space_after_twips": "int(round(p.after_pt * 20))"}, {"coalesce(p.before_pt, p.after_pt) is not null": "nothing to set", "coalesce(p.before_pt, 0) >= 0 and coalesce(p.after_pt, 0) >= 0": "no negative space"}),
    "insert_page_break": _par("_ string", {"@page_break": "true"}),
    "set_paragraph_bold": _flag("paragraphs", "bold", "bold"),
    "set_paragraph_italic": _flag("paragraphs", "italic", "italic"),
    "set_paragraph_underline": _flag("paragraphs", "underline", "underline"),
    "set_paragraph_font_size": _par("size_pt double", {"@font_size": "p.size_pt"}, _POINTS),
    "set_paragraph_font_name": _par("font string", {"@font_name": "p.font"}, {"p.font is null or p.font <> ''": "an empty font"}),
    "set_paragraph_font_color": _par("color string", {"@font_color": "upper(replace(p.color, '#', ''))"}, {f"p.color is null or p.color rlike '{HEX6}'": "no colour"}),
    "set_paragraph_highlight": _par("color string", {"@highlight": "p.color"}, {f"p.color is null or p.color in {HIGHLIGHTS}": "no colour of that name"}),
    "set_paragraph_strikethrough": _flag("paragraphs", "strikethrough", "strikethrough"),
    "set_paragraph_vert_align": _par("vert_align string", {"@vert_align": "p.vert_align"}, _VERT),
    "set_paragraph_caps": _par("caps string", {"@caps": "p.caps"}, _CAPS),
    "set_paragraph_hyperlink": _par("url string", {"@hyperlink": "p.url"}, _LINK),
    "set_paragraph_bullet": _flag("paragraphs", "bullet", "bullet"),
    "set_cell_shading": _par("color string", {"@shading": "upper(replace(p.color, '#', ''))"}, {f"p.color is null or p.color rlike '{HEX6}'": "no colour"}, {"e.in_table": "the paragraph is in no table", **_EDIT}),
    "replace_paragraph_text": _par("find string, replace string", {"text": "replace(e.text, p.find, p.replace)"}, _TEXT, {"contains(e.text, p.find)": "nothing found", **_EDIT}),
    "replace_across_paragraphs": Kind("set", "paragraphs", "find string, replace string", "e.editable and contains(e.text, p.find)", {"text": "replace(e.text, p.find, p.replace)"}, _TEXT, target="string(e.idx)", options={"many": "1"}),
    "insert_comment": Kind("annotate", "annotations", "index int, text string, author string", _PAR, {"kind": "'comment'", "container": "'document'", "anchor": "string(p.index)", "author": "coalesce(p.author, 'editor')", "text": "p.text"}, {"p.text <> ''": "an empty comment"}, _EDIT, "string(p.index)", {"of": "paragraphs"}),
    "insert_picture": Kind("annotate", "annotations", "index int, bytes_base64 string, content_type string", _PAR, {"kind": "'picture'", "container": "'document'", "anchor": "string(p.index)", "author": "cast(null as string)", "text": "cast(null as string)"}, _PICTURE, _EDIT, "string(p.index)", {"of": "paragraphs"}),
    "set_header_paragraph_text": Kind("set", "story_paragraphs", "part string, index int, text string", "e.story = 'header' and e.part = p.part and e.idx = p.index", {"text": "p.text"}, {"p.text is not null": "text is missing"}, _EDIT, "concat(p.part, ':', p.index)"),
    "set_footer_paragraph_text": Kind("set", "story_paragraphs", "part string, index int, text string", "e.story = 'footer' and e.part = p.part and e.idx = p.index", {"text": "p.text"}, {"p.text is not null": "text is missing"}, _EDIT, "concat(p.part, ':', p.index)"),
}

_IN_SLIDE = _SLIDE.replace("e.name", "e.slide")
_TABLE_CELL = f"{_IN_SLIDE} and e.table_name = p.`table` and e.row = p.row and e.col = p.col"


def _table_cell(payload: str, sets: dict[str, str], checks: dict[str, str]) -> Kind:
    return Kind("set", "slide_table_cells", "slide string, `table` string, row int, col int, " + payload, _TABLE_CELL, sets, checks, target="concat(p.slide, '/', p.`table`, '[', p.row, ',', p.col, ']')")


PPTX: dict[str, Kind] = {
    "set_shape_text": _shape("text string", {"text": "p.text"}, {"p.text is not null": "text is missing"}),
    "set_table_cell_text": _table_cell("text string", {"text": "p.text"}, {"p.text is not null": "text is missing"}),
    "set_table_cell_bold": _table_cell("bold boolean", {"bold": "p.bold"}, {"p.bold is not null": "bold is missing"}),
    "set_table_cell_italic": _table_cell("italic boolean", {"italic": "p.italic"}, {"p.italic is not null": "italic is missing"}),
    "set_notes_text": Kind("set", "slides", "slide string, text string", _SLIDE, {"notes": "p.text"}, {"p.text is not null": "text is missing"}, {"e.notes_part_name is not null": "the slide has no notes"}, "p.slide"),
    "add_slide": Kind("insert", "slides", "after string", _SLIDE.replace("p.slide", "p.after"), {"name": "concat('Slide ', e.idx + 2)", "notes": "cast(null as string)"}, target="coalesce(p.after, 'end')", options={"order": "idx", "end": "p.after"}),
    "delete_slide": Kind("delete_ordered", "slides", "slide string", _SLIDE, rows={"e._count > 1": "the only slide stays"}, target="p.slide", options={"order": "idx"}),
    "move_slide": Kind("move", "slides", "slide string, to_index int", _SLIDE, rows={"e._count >= 2": "one slide has no other place", "p.to_index between 0 and e._count - 1 and p.to_index <> e.idx": "no such place"}, target="p.slide", options={"order": "idx", "to": "p.to_index"}),
    "add_textbox": Kind("add_named", "shapes", "slide string, name string, text string", _SLIDE, {"text": "coalesce(p.text, '')"}, target="p.slide", options={"of": "slides"}),
    "delete_shape": Kind("delete", "shapes", "slide string, shape string", f"{_IN_SLIDE} and (e.name = p.shape or e.element_id = p.shape)", target="concat(p.slide, '/', p.shape)"),
    "rename_shape": _shape("name string", {"name": "p.name"}, {"p.name <> ''": "an empty name"}, {"not array_contains(e._names, p.name)": "the name is taken"}),
    "set_shape_bold": _flag("shapes", "bold", "bold"),
    "set_shape_italic": _flag("shapes", "italic", "italic"),
    "set_shape_underline": _flag("shapes", "underline", "underline"),
    "set_shape_font_size": _shape("size_pt double", {"@font_size": "p.size_pt"}, _POINTS),
    "set_shape_font_name": _shape("font string", {"@font_name": "p.font"}, {"p.font is null or p.font <> ''": "an empty font"}),
    "set_shape_font_color": _shape("color string", {"@font_color": "upper(replace(p.color, '#', ''))"}, {f"p.color is null or p.color rlike '{HEX6}'": "no colour"}),
    "set_shape_highlight": _shape("color string", {"@highlight": "upper(replace(p.color, '#', ''))"}, {f"p.color is null or p.color rlike '{HEX6}'": "no colour"}),
    "set_shape_strikethrough": _flag("shapes", "strikethrough", "strikethrough"),
    "set_shape_vert_align": _shape("vert_align string", {"@vert_align": "p.vert_align"}, _VERT),
    "set_shape_caps": _shape("caps string", {"@caps": "p.caps"}, _CAPS),
    "set_shape_hyperlink": _shape("url string", {"@hyperlink": "p.url"}, _LINK),
    "set_shape_bullet": _flag("shapes", "bullet", "bullet"),
    "replace_shape_text": _shape("find string, replace string", {"text": "replace(e.text, p.find, p.replace)"}, _TEXT, {"contains(e.text, p.find)": "nothing found"}),
    "replace_across_shapes": Kind("set", "shapes", "slide string, find string, replace string", f"{_IN_SLIDE} and contains(e.text, p.find)", {"text": "replace(e.text, p.find, p.replace)"}, _TEXT, target="concat(p.slide, '/', e.name)", options={"many": "1"}),
    "insert_comment": Kind("annotate", "annotations", "slide string, text string, author string, shape string", _SLIDE, {"kind": "'comment'", "container": "e.name", "anchor": "p.shape", "author": "coalesce(p.author, 'editor')", "text": "p.text"}, {"p.text <> ''": "an empty comment"}, target="p.slide", options={"of": "slides"}),
    "insert_picture": Kind("annotate", "annotations", "slide string, bytes_base64 string, content_type string, name string", _SLIDE, {"kind": "'picture'", "container": "e.name", "anchor": "p.name", "author": "cast(null as string)", "text": "cast(null as string)"}, _PICTURE, target="p.slide", options={"of": "slides"}),
}

_FIELD = "(e.name = p.name or e.element_id = p.name)"
_OPEN = {"not e.read_only": "the field is read only"}
_ON = "filter(e.export_values, x -> x <> 'Off')"
_BUTTON = f"case when p.value = 'Off' then 'Off' when p.value = 'On' then get({_ON}, 0) else coalesce(get(filter({_ON}, x -> x = p.value), 0), get(filter({_ON}, x -> lower(x) = lower(p.value)), 0)) end"
_VALUE = f"case when e.field_type = 'btn' then {_BUTTON} else p.value end"
_VALUE_OK = {"e.field_type in ('tx', 'ch', 'btn')": "no value for such a field", "e.field_type <> 'btn' or p.value <> 'On' or size(" + _ON + ") = 1": "On is ambiguous", f"({_VALUE}) is not null": "no such state"}
_EMPTY = "case when e.field_type = 'btn' then 'Off' else '' end"


def _bit(name: str, of: str = "e.field_type <> 'sig'") -> Kind:
    return Kind("set", "fields", f"name string, {name} boolean", _FIELD, {name: f"p.{name}"}, {f"p.{name} is not null": f"{name} is missing"}, {of: "not for such a field"}, "p.name")


_TX, _CH = "e.field_type = 'tx'", "e.field_type = 'ch'"
PDF: dict[str, Kind] = {
    "set_form_field": Kind("set", "fields", "name string, value string", _FIELD, {"value": _VALUE}, {"p.value is not null": "value is missing"}, {**_OPEN, **_VALUE_OK}, "p.name"),
    "clear_form_field": Kind("set", "fields", "name string", _FIELD, {"value": _EMPTY}, {}, {**_OPEN, "e.field_type in ('tx', 'ch', 'btn')": "no value for such a field"}, "p.name"),
    "clear_all_form_fields": Kind("set", "fields", "_ string", "not e.read_only and e.field_type in ('tx', 'ch', 'btn')", {"value": _EMPTY}, target="e.name", options={"many": "1"}),
    "set_form_fields": Kind("set_map", "fields", "fields map<string, string>", _FIELD, {"value": _VALUE}, {"size(p.fields) > 0": "no fields"}, {**_OPEN, **_VALUE_OK}, "p.name"),
    "set_form_field_readonly": Kind("set", "fields", "name string, readonly boolean", _FIELD, {"read_only": "p.readonly"}, {"p.readonly is not null": "readonly is missing"}, {"e.field_type <> 'sig'": "not for such a field"}, "p.name"),
    "set_form_field_required": _bit("required"),
    "set_form_field_multiline": _bit("multiline", _TX),
    "set_form_field_password": _bit("password", _TX),
    "set_form_field_max_length": Kind("set", "fields", "name string, max_length int", _FIELD, {"max_length": "p.max_length"}, {"p.max_length is null or p.max_length > 0": "a positive length"}, {_TX: "not for such a field"}, "p.name"),
    "set_form_field_comb": _bit("comb", _TX),
    "set_form_field_do_not_scroll": _bit("do_not_scroll", _TX),
    "set_form_field_do_not_spell_check": _bit("do_not_spell_check", _TX),
    "set_form_field_rich_text": _bit("rich_text", _TX),
    "set_form_field_no_export": _bit("no_export"),
    "set_form_field_multi_select": _bit("multi_select", _CH),
    "set_form_field_combo": _bit("combo", _CH),
    "set_form_field_edit": _bit("edit", _CH),
    "set_document_metadata": Kind("set", "pdf_documents", "title string, author string, subject string", "true", {"?title": "p.title", "?author": "p.author", "?subject": "p.subject"}, {"coalesce(p.title, p.author, p.subject) is not null": "nothing to set"}, target="'metadata'"),
    "clear_document_metadata": Kind("set", "pdf_documents", "_ string", "true", {"title": "cast(null as string)", "author": "cast(null as string)", "subject": "cast(null as string)"}, target="'metadata'"),
    "insert_comment": Kind("annotate", "annotations", "page int, contents string, author string", "e.number = p.page", {"kind": "'comment'", "container": "string(p.page)", "anchor": "'Text'", "author": "p.author", "text": "p.contents"}, {"p.contents <> ''": "an empty comment"}, target="string(p.page)", options={"of": "pages"}),
    "insert_picture": Kind("annotate", "annotations", "page int, bytes_base64 string, content_type string", "e.number = p.page", {"kind": "'picture'", "container": "string(p.page)", "anchor": "'Stamp'", "author": "cast(null as string)", "text": "cast(null as string)"}, _PICTURE, target="string(p.page)", options={"of": "pages"}),
    "rotate_page": Kind("set", "pages", "page int, degrees int", "e.number = p.page", {"rotate": "nullif(p.degrees, 0)"}, {"p.degrees in (0, 90, 180, 270)": "0, 90, 180 or 270"}, target="string(p.page)"),
}

FORMATS: dict[str, dict[str, Kind]] = {"xlsx": XLSX, "docx": DOCX, "pptx": PPTX, "pdf": PDF}
#: Kinds that may be combined in one transaction; every other kind stands alone.
BATCHABLE = frozenset({"set_cell_value", "set_cell_formula", "set_range"})
#: Shapes whose operations on one object depend on each other.
IN_TURN = frozenset({"insert", "delete_ordered", "move", "axis", "add_sheet", "rename_sheet", "delete_sheet", "merge", "add_named"})
ERRORS = "op_id string, object_path string, code string, message string"
DIFF = "op_id string, object_path string, kind string, target string, change string, before string, after string"


@dataclass
class Applied:
    tables: Tables
    diff: DataFrame
    errors: DataFrame


def capabilities() -> list[tuple[str, str, str, str]]:
    """(format, operation, payload, entity) of all kinds of edits."""
    return [(fmt, name, k.payload.replace("`", ""), k.entity) for fmt, kinds in FORMATS.items() for name, k in kinds.items()]


def with_attrs(df: DataFrame) -> DataFrame:
    return df if "attrs" in df.columns else df.withColumn("attrs", F.expr("cast(map() as map<string, string>)"))


def _set_attr(column: F.Column, name: F.Column, value: F.Column) -> F.Column:
    kept = F.map_filter(column, lambda k, _: k != name)
    return F.when(value.isNull(), kept).otherwise(F.map_concat(kept, F.create_map(name, value.cast("string"))))


def unsupported(ops: DataFrame, fmt: str) -> DataFrame:
    return ops.where(~F.col("kind").isin(*FORMATS[fmt])).select("op_id", "object_path", F.lit("unsupported_capability").alias("code"), F.concat(F.lit("no operation "), "kind").alias("message"))


def _checked(rows: DataFrame, checks: dict[str, str], code: str) -> tuple[DataFrame, DataFrame]:
    """Rows for which all conditions hold, and an error for each other: that of its first failed condition."""
    if not checks:
        return rows, rows.limit(0).select("op_id", "object_path", F.lit(code).alias("code"), F.lit("").alias("message"))
    failed = F.coalesce(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(m)) for c, m in checks.items()])
    marked = rows.withColumn("_failed", failed)
    return marked.where("_failed is null").drop("_failed"), marked.where("_failed is not null").select("op_id", "object_path", F.lit(code).alias("code"), F.col("_failed").alias("message"))


def _parsed(ops: DataFrame, name: str, kind: Kind) -> DataFrame:
    return ops.where(F.col("kind") == name).select("op_id", "object_path", F.from_json("payload", kind.payload).alias("p"))


def _entity(tables: Tables, name: str) -> DataFrame:
    """The rows of an entity with the counts some conditions need."""
    df = with_attrs(tables[name])
    if name == "sheets":
        df = df.withColumn("_visible", F.count_if(~F.coalesce("hidden", F.lit(False))).over(Window.partitionBy("object_path")))
    elif name == "slides":
        df = df.withColumn("_count", F.count(F.lit(1)).over(Window.partitionBy("object_path")))
    elif name == "shapes":
        named = df.groupBy("object_path", "slide").agg(F.collect_set("name").alias("_names"))
        if "slide_table_cells" in tables:
            more = tables["slide_table_cells"].groupBy("object_path", "slide").agg(F.collect_set("table_name").alias("_more"))
            named = named.join(more, ["object_path", "slide"], "left").withColumn("_names", F.array_union("_names", F.coalesce("_more", F.expr("cast(array() as array<string>)")))).drop("_more")
        df = df.join(named, ["object_path", "slide"], "left")
    return df


def apply_kind(tables: Tables, ops: DataFrame, fmt: str, name: str) -> Applied:
    """Apply all operations of one kind to all objects at once."""
    kind = FORMATS[fmt][name]
    ops_ok, bad = _checked(_parsed(ops, name, kind), kind.checks, "invalid_payload")
    shape = {"set": _apply_set, "set_map": _apply_set, "upsert": _apply_upsert, "matrix": _apply_upsert, "insert": _apply_ordered, "delete_ordered": _apply_ordered, "move": _apply_ordered, "delete": _apply_delete, "annotate": _apply_annotate, "axis": _apply_axis, "add_sheet": _apply_sheets, "rename_sheet": _apply_sheets, "delete_sheet": _apply_sheets, "merge": _apply_merge, "define_name": _apply_define, "add_named": _apply_add_named}[kind.shape]
    ops_ok, turns = _turns(tables, ops_ok, kind)
    done = shape(tables, ops_ok, kind, name) if turns <= 1 else _in_turns(tables, ops_ok, turns, lambda t, o: shape(t, o, kind, name))
    return Applied(done.tables, done.diff, done.errors.unionByName(bad))


def _turns(tables: Tables, ops: DataFrame, kind: Kind) -> tuple[DataFrame, int]:
    """(operations with their turn, how many turns there are). One turn, and no column for it, where none depends on another."""
    mentions = lambda text: any(re.search(rf"\be\.{re.escape(c.lstrip('@?').rstrip(':'))}\b", text) for c in kind.sets)
    wide = kind.shape in IN_TURN or "many" in kind.options or mentions(kind.on) or any("e._" in c for c in kind.rows)
    builds = any(c.endswith(":") or "?" in c[:2] or mentions(v) for c, v in kind.sets.items()) or any(mentions(c) for c in kind.rows)
    if kind.shape not in IN_TURN and not (kind.shape == "set" and (builds or mentions(kind.on))):
        return ops, 1
    most = ops.groupBy("object_path").count().agg(F.max("count")).first()[0] or 0
    if most <= 1:
        return ops, 1
    turn = F.row_number().over(Window.partitionBy("object_path").orderBy("op_id"))
    if wide:
        return ops.withColumn("_turn", turn), most
    # operations on different rows go together, unless some operation of the object is on several
    table = with_attrs(tables[kind.entity])
    e = _entity(tables, kind.entity)
    pairs = ops.join(e.select("object_path", F.struct(*e.columns).alias("e")), "object_path").where(F.expr(kind.on))
    row = Window.partitionBy("object_path", *[F.col(f"e.{k}") for k in _row_key(kind.entity, table)]).orderBy("op_id")
    ranks = pairs.withColumn("_n", F.row_number().over(row)).groupBy("object_path", "op_id").agg(F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_hits"))
    several = F.max("_hits").over(Window.partitionBy("object_path")) > 1
    placed = ops.join(ranks, ["object_path", "op_id"], "left").withColumn("_turn", F.when(several, turn).otherwise(F.coalesce("_n", F.lit(1)))).select(*ops.columns, "_turn")
    return placed, placed.agg(F.max("_turn")).first()[0]


def _in_turns(tables: Tables, ops: DataFrame, turns: int, step: Callable[[Tables, DataFrame], Applied]) -> Applied:
    """Apply operations turn by turn. From the second turn on only objects with more than one are carried on; what a turn
    leaves is written, so plans do not grow with the turns."""
    ops = durable(ops, "turns")
    take = lambda n: ops.where(F.col("_turn") == n).drop("_turn")
    first = step(tables, take(1))
    busy = ops.where("_turn > 1").select("object_path").distinct()
    changed = [k for k, df in first.tables.items() if df is not tables[k]]
    now = {k: durable(df.join(busy, "object_path", "left_semi"), k) for k, df in first.tables.items()}
    diff, errors = first.diff, first.errors
    for n in range(2, turns + 1):
        done = step(now, take(n))
        now = now | {k: durable(done.tables[k], k) for k in changed}
        diff, errors = diff.unionByName(durable(done.diff, "diff")), errors.unionByName(durable(done.errors, "errors"))
    return Applied(tables | {k: first.tables[k].join(busy, "object_path", "left_anti").select(*now[k].columns).unionByName(now[k]) for k in changed}, diff, errors)


def apply(tables: Tables, ops: DataFrame, fmt: str, kinds: list[str] | None = None) -> Applied:
    """Apply a batch kind by kind; kinds that are not named are errors."""
    diff, errors = None, unsupported(ops, fmt)
    for name in kinds if kinds is not None else FORMATS[fmt]:
        done = apply_kind(tables, ops, fmt, name)
        tables, diff, errors = done.tables, done.diff if diff is None else diff.unionByName(done.diff), errors.unionByName(done.errors)
    return Applied(tables, diff, errors)


def _matched(tables: Tables, ops: DataFrame, kind: Kind, entity: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(operations with the rows they name, operations that name none, errors). Objects are the join key."""
    e = _entity(tables, entity)
    rows = e.select("object_path", F.struct(*e.columns).alias("e"))
    pairs = ops.join(rows, "object_path").where(F.expr(kind.on))
    lost = ops.join(pairs.select("op_id").distinct(), "op_id", "left_anti").select("op_id", "object_path", F.lit("not_found").alias("code"), F.lit("nothing by that name").alias("message"))
    good, bad = _checked(pairs, kind.rows, "rejected")
    if "many" not in kind.options and kind.rows:
        # an operation on several rows is all or nothing
        good = good.join(bad.select("op_id").distinct(), "op_id", "left_anti")
    return good, lost, bad.distinct()


def _json(columns: list[str], source: str) -> F.Column:
    return F.to_json(F.struct(*[F.col(f"{source}.{c}").alias(c) for c in columns]), {"ignoreNullFields": "false"})


def _apply_set(tables: Tables, ops: DataFrame, kind: Kind, name: str) -> Applied:
    if kind.shape == "set_map":
        keys = [f.name for f in ops.schema["p"].dataType.fields]
        del keys
        exploded = ops.select("op_id", "object_path", F.explode("p.fields").alias("name", "value"))
        whole = exploded.select("op_id", "object_path", F.struct("name", "value").alias("p"))
        e = _entity(tables, kind.entity)
        found = whole.join(e.select("object_path", F.struct(*e.columns).alias("e")), "object_path").where(F.expr(kind.on))
        missing = whole.join(found.select("op_id", "p").distinct(), ["op_id", "p"], "left_anti").select("op_id", "object_path", F.lit("not_found").alias("code"), F.concat(F.lit("no field "), "p.name").alias("message"))
        good, bad = _checked(found, kind.rows, "rejected")
        errors = missing.unionByName(bad).distinct()
        good = good.join(errors.select("op_id").distinct(), "op_id", "left_anti")
    else:
        good, lost, bad = _matched(tables, ops, kind, kind.entity)
        errors = lost.unionByName(bad)
    table = with_attrs(tables[kind.entity])
    key = _row_key(kind.entity, table)
    last = good.withColumn("_n", F.row_number().over(Window.partitionBy("object_path", *[F.col(f"e.{k}") for k in key]).orderBy(F.col("op_id").desc()))).where("_n = 1").drop("_n")
    new = F.col("e")
    for column, value in kind.sets.items():
        v = F.expr(value) if "=" not in value or not column.endswith(":") else None
        if column.startswith("@"):
            attr, keep = (column[2:], True) if column[1] == "?" else (column[1:], False)
            if attr.endswith(":"):
                left, right = value.split("=")
                changed = _set_attr(new["attrs"], F.concat(F.lit(attr), F.upper(F.expr(left).cast("string"))), F.expr(right))
            else:
                changed = _set_attr(new["attrs"], F.lit(attr), v)
                changed = F.when(v.isNull(), new["attrs"]).otherwise(changed) if keep else changed
            new = new.withField("attrs", changed)
        elif column.startswith("?"):
            new = new.withField(column[1:], F.coalesce(v, new[column[1:]]))
        else:
            new = new.withField(column, v.cast(table.schema[column].dataType))
    staged = last.select("op_id", "object_path", F.expr(kind.target).alias("target"), "e", new.alias("n"))
    shown = sorted({c.lstrip("@?") if not c.startswith("@") else "attrs" for c in kind.sets})
    diff = staged.select("op_id", "object_path", F.lit(name).alias("kind"), "target", F.lit("changed").alias("change"), _json(shown, "e").alias("before"), _json(shown, "n").alias("after"))
    changed = staged.select("object_path", *[F.col(f"e.{k}").alias(k) for k in key], F.col("n").alias("_new"))
    merged = table.join(changed, ["object_path", *key], "left")
    out = merged.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c != "object_path" else F.col(c) for c in table.columns])
    return Applied(tables | {kind.entity: out}, diff, errors)


def _row_key(entity: str, df: DataFrame) -> list[str]:
    keys = {"cells": ["sheet", "row", "col"], "sheets": ["idx"], "paragraphs": ["idx"], "story_paragraphs": ["story", "part", "idx"], "slides": ["idx"], "shapes": ["slide", "ord"], "slide_table_cells": ["slide", "table_name", "row", "col"], "pages": ["number"], "fields": ["name"], "pdf_documents": [], "named_ranges": ["name"]}
    return [k for k in keys[entity] if k in df.columns]


def _apply_upsert(tables: Tables, ops: DataFrame, kind: Kind, name: str) -> Applied:
    cells, sheets = with_attrs(tables["cells"]), tables["sheets"]
    known = sheets.select("object_path", F.col("name").alias("_sheet"))
    placed = ops.join(known, "object_path").where(F.expr(same_ci("_sheet", "p.sheet")))
    errors = ops.join(placed.select("op_id"), "op_id", "left_anti").select("op_id", "object_path", F.lit("not_found").alias("code"), F.lit("no such sheet").alias("message"))
    if kind.shape == "matrix":
        rows = placed.select("op_id", "object_path", "_sheet", F.col("p.start_cell").alias("start"), F.posexplode("p.values").alias("i", "r")).select("op_id", "object_path", "_sheet", "start", "i", F.posexplode("r").alias("j", "value"))
        number = F.col("value").try_cast("double")
        placed = rows.select("op_id", "object_path", "_sheet", (a1.row_of(F.col("start")) + F.col("i")).alias("row"), (a1.col_of(F.col("start")) + F.col("j")).alias("col"),
            F.when(F.col("value").isNull(), "empty").when(number.isNotNull(), "float").otherwise("string").alias("kind"), F.when(number.isNull(), F.col("value")).alias("v_str"), number.alias("v_num"), F.lit(None).cast("boolean").alias("v_bool"), F.lit(None).cast("bigint").alias("v_int"), F.lit(None).cast("string").alias("formula"))
    else:
        address = F.upper(F.regexp_replace("p.address", r"\$", ""))
        placed = placed.select("op_id", "object_path", "_sheet", a1.row_of(address).alias("row"), a1.col_of(address).alias("col"), *[F.expr(v).alias(c) for c, v in kind.sets.items()])
    beyond = (F.col("row") > a1.MAX_ROWS) | (F.col("col") > a1.MAX_COLS)
    outside = placed.where(beyond).select("op_id", "object_path", F.lit("invalid_payload").alias("code"), F.lit("beyond the sheet").alias("message")).distinct()
    placed = placed.join(outside.select("op_id"), "op_id", "left_anti")
    values = ["kind", "v_str", "v_num", "v_bool", "v_int", "formula"]
    last = placed.groupBy("object_path", F.col("_sheet").alias("sheet"), "row", "col").agg(F.max_by(F.struct("op_id", *values), "op_id").alias("n"))
    both = cells.join(last, ["object_path", "sheet", "row", "col"], "full_outer")
    out = both.select(*[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) if c in values else a1.address(F.col("row"), F.col("col")).alias(c) if c == "address" else F.coalesce(c, F.expr("cast(map() as map<string, string>)")).alias(c) if c == "attrs" else F.col(c) for c in cells.columns])
    # what was calculated before is no longer true: formulas keep their text and lose their value
    touched = last.select("object_path").distinct().withColumn("_touched", F.lit(True))
    stale = F.col("_touched").isNotNull() & F.col("formula").isNotNull()
    out = out.join(touched, "object_path", "left").select(*[F.when(stale, F.lit("empty")).otherwise(F.col(c)).alias(c) if c == "kind" else F.when(~stale, F.col(c)).alias(c) if c.startswith("v_") else F.col(c) for c in cells.columns])
    shown = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    before = cells.select("object_path", "sheet", "row", "col", shown.alias("before"))
    diff = last.join(before, ["object_path", "sheet", "row", "col"], "left").select(F.col("n.op_id").alias("op_id"), "object_path", F.lit(name).alias("kind"), F.concat("sheet", F.lit("!"), a1.address(F.col("row"), F.col("col"))).alias("target"), F.when(F.col("before").isNull(), "added").otherwise("changed").alias("change"), "before", F.to_json(F.struct(*[F.col(f"n.{v}").alias(v) for v in values]), {"ignoreNullFields": "false"}).alias("after"))
    return Applied(tables | {"cells": out}, diff, errors.unionByName(outside))


def _apply_ordered(tables: Tables, ops: DataFrame, kind: Kind, name: str) -> Applied:
    """Insert, delete or move one row in the order of its object; one such operation an object and turn."""
    order = kind.options["order"]
    at_end = kind.options.get("end")
    if at_end:
        heads = tables[kind.entity].groupBy("object_path").agg(F.max_by("name", order).alias("_last"))
        ops = ops.join(heads, "object_path", "left").withColumn("p", F.col("p").withField("after", F.coalesce("p.after", "_last"))).drop("_last")
    good, lost, bad = _matched(tables, ops, kind, kind.entity)
    one = good.withColumn("_n", F.row_number().over(Window.partitionBy("object_path").orderBy(F.col("op_id").desc(), F.col(f"e.{order}")))).where("_n = 1").drop("_n")
    table = with_attrs(tables[kind.entity])
    at = one.select("object_path", "op_id", F.col(f"e.{order}").alias("_at"), (F.expr(kind.options["to"]) if kind.shape == "move" else F.lit(0)).alias("_to"), F.expr(kind.target).alias("_target"), F.struct(*[F.col(f"e.{c}").alias(c) for c in table.columns]).alias("_row"), "p")
    joined = table.join(at.select("object_path", "_at", "_to"), "object_path", "left")
    here = F.col(order)
    if kind.shape == "insert":
        moved = F.when(here > F.col("_at"), here + 1).otherwise(here)
        kept = joined.withColumn(order, moved).select(*table.columns)
        fresh = one.select("object_path", *[
            (F.col(f"e.{order}") + 1).alias(c) if c == order else F.expr(kind.sets[c]).cast(table.schema[c].dataType).alias(c) if c in kind.sets else F.expr("cast(map() as map<string, string>)").alias(c) if c == "attrs"
            else F.concat(F.lit("new_"), "op_id").alias(c) if c == "element_id" else F.lit(None).cast(table.schema[c].dataType).alias(c)
            for c in table.columns if c != "object_path"
        ])
        out, change, before, after = kept.unionByName(fresh.select(*table.columns)), "added", F.lit(None).cast("string"), F.to_json("p")
    elif kind.shape == "delete_ordered":
        out = joined.where(F.col("_at").isNull() | (here != F.col("_at"))).withColumn(order, F.when(here > F.col("_at"), here - 1).otherwise(here)).select(*table.columns)
        change, before, after = "removed", F.to_json("_row"), F.lit(None).cast("string")
    else:
        a, b = F.col("_at"), F.col("_to")
        moved = F.when(here == a, b).when((a < b) & here.between(a + 1, b), here - 1).when((a > b) & here.between(b, a - 1), here + 1).otherwise(here)
        out = joined.withColumn(order, F.when(a.isNotNull(), moved).otherwise(here).cast(table.schema[order].dataType)).select(*table.columns)
        change, before, after = "changed", F.col("_at").cast("string"), F.col("_to").cast("string")
    diff = at.select("op_id", "object_path", F.lit(name).alias("kind"), F.col("_target").alias("target"), F.lit(change).alias("change"), before.alias("before"), after.alias("after"))
    return Applied(tables | {kind.entity: out}, diff, lost.unionByName(bad))


def _apply_delete(tables: Tables, ops: DataFrame, kind: Kind, name: str) -> Applied:
    good, lost, bad = _matched(tables, ops, kind, kind.entity)
    table = with_attrs(tables[kind.entity])
    key = _row_key(kind.entity, table)
    gone = good.select("object_path", *[F.col(f"e.{k}").alias(k) for k in key]).distinct()
    out = table.join(gone, ["object_path", *key], "left_anti").select(*table.columns)
    diff = good.select("op_id", "object_path", F.lit(name).alias("kind"), F.expr(kind.target).alias("target"), F.lit("removed").alias("change"), F.to_json(F.struct(*[F.col(f"e.{c}").alias(c) for c in table.columns])).alias("before"), F.lit(None).cast("string").alias("after"))
    return Applied(tables | {kind.entity: out}, diff, lost.unionByName(bad))


def _apply_annotate(tables: Tables, ops: DataFrame, kind: Kind, name: str) -> Applied:
    good, lost, bad = _matched(tables, ops, kind, kind.options["of"])
    notes = tables["annotations"]
    made = good.select("op_id", "object_path", F.concat(F.lit("new_"), "op_id").alias("element_id"), *[F.expr(v).alias(c) for c, v in kind.sets.items()], F.expr(kind.target).alias("_target")).dropDuplicates(["op_id"])
    if "once" in kind.options:
        there = notes.where("kind = 'comment'").select("object_path", "container", "anchor").distinct()
        taken = made.join(there, ["object_path", "container", "anchor"], "left_semi").select("op_id", "object_path", F.lit("rejected").alias("code"), F.lit("there is a comment already").alias("message"))
        made = made.join(taken.select("op_id"), "op_id", "left_anti")
        bad = bad.unionByName(taken)
    out = notes.unionByName(made.select(*[c if c in made.columns else F.lit(None).cast(notes.schema[c].dataType).alias(c) for c in notes.columns]))
    diff = made.select("op_id", "object_path", F.lit(name).alias("kind"), F.col("_target").alias("target"), F.lit("added").alias("change"), F.lit(None).cast("string").alias("before"), F.to_json(F.struct("author", "text")).alias("after"))
    return Applied(tables | {"annotations": out}, diff, lost.unionByName(bad))


def _formulas(cells: DataFrame, per_object: DataFrame, work) -> DataFrame:
    """Formulas rewritten with the operation of their object; only objects with an operation pass through Python."""
    keys = [c for c in per_object.columns if c != "object_path"]
    run = F.pandas_udf(lambda f, s, *a: work(f, s, *a), "string")
    joined = cells.join(per_object, "object_path", "left")
    todo = F.col(keys[0]).isNotNull() & F.col("formula").isNotNull()
    same = joined.where(~todo)
    changed = joined.where(todo).withColumn("formula", run("formula", "sheet", *keys))
    return same.unionByName(changed)


def _unshiftable(tables: Tables, one: DataFrame) -> DataFrame:
    """Errors for shifts of sheets that hold what does not follow them: features of the sheet, and names that point at it."""
    empty = one.limit(0).select("op_id", "object_path", F.lit("rejected").alias("code"), F.lit("").alias("message"))
    if "features" in tables:
        held = one.join(tables["features"], "object_path").where(F.col("sheet").isNull() | F.expr(same_ci("sheet", "_sheet")))
        empty = empty.unionByName(held.groupBy("op_id", "object_path").agg(F.concat(F.lit("the sheet holds "), F.array_join(F.sort_array(F.collect_set("feature")), ", ")).alias("message")).withColumn("code", F.lit("rejected")))
    if "named_ranges" in tables:
        mention = F.pandas_udf(lambda f, s: f.__class__([drop_sheet(x, y) != x for x, y in zip(f, s)]), "boolean")
        named = one.join(tables["named_ranges"].where("formula is not null"), "object_path").where(mention("formula", "_sheet"))
        empty = empty.unionByName(named.groupBy("op_id", "object_path").agg(F.concat(F.lit("names point at the sheet: "), F.array_join(F.sort_array(F.collect_set("name")), ", ")).alias("message")).withColumn("code", F.lit("rejected")))
    return empty


def _apply_axis(tables: Tables, ops: DataFrame, kind: Kind, name: str) -> Applied:
    """Rows or columns come or go: cells move, formulas on all sheets follow; one operation an object and turn."""
    axis, insert = kind.options["axis"], bool(kind.options["insert"])
    cells, sheets = with_attrs(tables["cells"]), tables["sheets"]
    placed = ops.join(sheets.select("object_path", F.col("name").alias("_sheet")), "object_path").where(F.expr(same_ci("_sheet", "p.sheet")))
    lost = ops.join(placed.select("op_id"), "op_id", "left_anti").select("op_id", "object_path", F.lit("not_found").alias("code"), F.lit("no such sheet").alias("message"))
    one = placed.groupBy("object_path").agg(F.max_by(F.struct("op_id", "_sheet", F.col("p.at").alias("at"), F.coalesce("p.count", F.lit(1)).alias("n")), "op_id").alias("m")).select("object_path", "m.op_id", F.col("m._sheet").alias("_sheet"), F.col("m.at").alias("_at"), F.col("m.n").alias("_n"))
    fixed = _unshiftable(tables, one)
    one = one.join(fixed.select("op_id").distinct(), "op_id", "left_anti")
    lost = lost.unionByName(fixed)
    most = a1.MAX_ROWS if axis == "row" else a1.MAX_COLS
    if insert:
        tail = cells.join(one, "object_path").where((F.col("sheet") == F.col("_sheet")) & (F.col(axis) >= F.col("_at")) & (F.col(axis) + F.col("_n") > most))
        full = tail.select("op_id", "object_path", F.lit("rejected").alias("code"), F.lit("cells would leave the sheet").alias("message")).distinct()
        one = one.join(full.select("op_id"), "op_id", "left_anti")
        lost = lost.unionByName(full)

    def rewrite(formulas, own, sheet, at, n):
        return formulas.__class__([shift_formula(f, s, e, axis, int(i), int(k), insert) for f, s, e, i, k in zip(formulas, own, sheet, at, n)], dtype=object)

    moved = _formulas(cells, one.select("object_path", "_sheet", "_at", "_n"), rewrite)
    value, at, n = F.col(axis), F.col("_at"), F.col("_n")
    here = F.coalesce(F.col("sheet") == F.col("_sheet"), F.lit(False))
    if insert:
        place = F.when(here & (value >= at), value + n).otherwise(value)
    else:
        moved = moved.where(~(here & (value >= at) & (value < at + n)))
        place = F.when(here & (value >= at + n), value - n).otherwise(value)
    stale = F.col("_at").isNotNull() & F.col("formula").isNotNull()
    moved = moved.withColumn(axis, place.cast("int")).withColumn("address", a1.address(F.col("row"), F.col("col")))
    out = moved.select(*[F.when(stale, F.lit("empty")).otherwise(F.col(c)).alias(c) if c == "kind" else F.when(~stale, F.col(c)).alias(c) if c.startswith("v_") else F.col(c) for c in cells.columns])
    diff = one.select("op_id", "object_path", F.lit(name).alias("kind"), F.concat("_sheet", F.lit("!"), F.col("_at").cast("string")).alias("target"), F.lit("added" if insert else "removed").alias("change"), F.lit(None).cast("string").alias("before"), F.col("_n").cast("string").alias("after"))
    return Applied(tables | {"cells": out}, diff, lost)


def _apply_sheets(tables: Tables, ops: DataFrame, kind: Kind, name: str) -> Applied:
    """Add, rename or delete a sheet; one operation an object and turn."""
    cells, sheets = with_attrs(tables["cells"]), with_attrs(tables["sheets"])
    last = ops.groupBy("object_path").agg(F.max_by(F.struct("op_id", "p"), "op_id").alias("m")).select("object_path", "m.op_id", "m.p")
    named = sheets.select("object_path", F.col("name").alias("_name"), F.col("idx").alias("_idx"), F.coalesce("hidden", F.lit(False)).alias("_hidden"))
    error = lambda df, code, text: df.select("op_id", "object_path", F.lit(code).alias("code"), F.lit(text).alias("message")).distinct()
    if kind.shape == "add_sheet":
        taken = last.join(named, "object_path").where(F.expr(same_ci("_name", "p.name")))
        after = last.join(named, "object_path").where(F.expr(f"p.after is null or {same_ci('_name', 'p.after')}")).groupBy("op_id", "object_path").agg(F.max("_idx").alias("_at"))
        errors = error(taken, "rejected", "the name is taken").unionByName(error(last.join(after.select("op_id"), "op_id", "left_anti"), "not_found", "no such sheet"))
        good = last.join(after, ["op_id", "object_path"]).join(errors.select("op_id"), "op_id", "left_anti")
        shifted = sheets.join(good.select("object_path", "_at"), "object_path", "left").withColumn("idx", F.when(F.col("idx") > F.col("_at"), F.col("idx") + 1).otherwise(F.col("idx"))).select(*sheets.columns)
        fresh = good.select(*[F.col("object_path") if c == "object_path" else F.col("p.name").alias(c) if c == "name" else (F.col("_at") + 1).cast("int").alias(c) if c == "idx" else F.concat(F.lit("new_"), "op_id").alias(c) if c == "element_id" else F.lit(False).alias(c) if c == "hidden" else F.lit(0).alias(c) if c in ("rows", "cols") else F.expr("cast(map() as map<string, string>)").alias(c) if c == "attrs" else F.lit(None).cast(sheets.schema[c].dataType).alias(c) for c in sheets.columns])
        tables = tables | {"sheets": shifted.unionByName(fresh)}
        diff = good.select("op_id", "object_path", F.lit(name).alias("kind"), F.col("p.name").alias("target"), F.lit("added").alias("change"), F.lit(None).cast("string").alias("before"), F.col("p.name").alias("after"))
        return Applied(tables, diff, errors)
    if kind.shape == "rename_sheet":
        found = last.join(named, "object_path").where(F.expr(same_ci("_name", "p.`from`")))
        clash = last.join(named, "object_path").where(F.expr(f"{same_ci('_name', 'p.to')} and not {same_ci('_name', 'p.`from`')}"))
        errors = error(last.join(found.select("op_id"), "op_id", "left_anti"), "not_found", "no such sheet").unionByName(error(clash, "rejected", "the name is taken"))
        good = found.join(errors.select("op_id"), "op_id", "left_anti").select("op_id", "object_path", F.col("_name").alias("_old"), F.col("p.to").alias("_new"))
        renamed = lambda df, c: df.join(good.select("object_path", "_old", "_new"), "object_path", "left").withColumn(c, F.when(F.col(c) == F.col("_old"), F.col("_new")).otherwise(F.col(c))).drop("_old", "_new")
        texts = _formulas(cells, good.select("object_path", "_old", "_new"), lambda f, s, old, new: f.__class__([rename_sheet(x, a, b) for x, a, b in zip(f, old, new)], dtype=object)).select(*cells.columns)
        tables = tables | {"sheets": renamed(sheets, "name").select(*sheets.columns), "cells": renamed(texts, "sheet").select(*cells.columns)}
        diff = good.select("op_id", "object_path", F.lit(name).alias("kind"), F.col("_old").alias("target"), F.lit("changed").alias("change"), F.col("_old").alias("before"), F.col("_new").alias("after"))
        return Applied(tables, diff, errors)
    visible = named.where("not _hidden").groupBy("object_path").agg(F.count(F.lit(1)).alias("_visible"))
    found = last.join(named, "object_path").where(F.expr(same_ci("_name", "p.name"))).join(visible, "object_path", "left")
    last_one = found.where("not _hidden and _visible <= 1")
    used = cells.join(found.select("op_id", "object_path", "_name", F.coalesce("p.dependency_policy", F.lit("reject_if_referenced")).alias("_policy")), "object_path").where("formula is not null and sheet <> _name and _policy = 'reject_if_referenced'")
    mention = F.pandas_udf(lambda f, n: f.__class__([drop_sheet(x, y) != x for x, y in zip(f, n)]), "boolean")
    referred = used.where(mention("formula", "_name"))
    errors = error(last.join(found.select("op_id"), "op_id", "left_anti"), "not_found", "no such sheet").unionByName(error(last_one, "rejected", "the last visible sheet stays")).unionByName(error(referred, "rejected", "formulas refer to the sheet"))
    good = found.join(errors.select("op_id"), "op_id", "left_anti").select("op_id", "object_path", F.col("_name").alias("_gone"), F.col("_idx").alias("_at"))
    rest = cells.join(good.select("object_path", F.col("_gone").alias("sheet")), ["object_path", "sheet"], "left_anti").select(*cells.columns)
    texts = _formulas(rest, good.select("object_path", "_gone"), lambda f, s, gone: f.__class__([drop_sheet(x, g) for x, g in zip(f, gone)], dtype=object)).select(*cells.columns)
    left = sheets.join(good.select("object_path", "_at"), "object_path", "left").where(F.col("_at").isNull() | (F.col("idx") != F.col("_at"))).withColumn("idx", F.when(F.col("idx") > F.col("_at"), F.col("idx") - 1).otherwise(F.col("idx"))).select(*sheets.columns)
    diff = good.select("op_id", "object_path", F.lit(name).alias("kind"), F.col("_gone").alias("target"), F.lit("removed").alias("change"), F.col("_gone").alias("before"), F.lit(None).cast("string").alias("after"))
    return Applied(tables | {"sheets": left, "cells": texts}, diff, errors)


def _apply_merge(tables: Tables, ops: DataFrame, kind: Kind, name: str) -> Applied:
    """Add a merged range that shares no cell with one that is there."""
    good, lost, _ = _matched(tables, ops, kind, "sheets")
    rect = {k: v.alias(k) for k, v in a1.rectangle(F.col("p.range")).items()}
    new = good.select("op_id", "object_path", F.col("e.idx").alias("idx"), F.upper(F.regexp_replace("p.range", r"\$", "")).alias("_range"), *rect.values())
    there = tables["sheets"].select("object_path", "idx", F.explode("merges").alias("_m"))
    old = there.select("object_path", "idx", *[v.alias(f"o_{k}") for k, v in a1.rectangle(F.col("_m")).items()])
    hit = new.join(old, ["object_path", "idx"]).where("r1 <= o_r2 and o_r1 <= r2 and c1 <= o_c2 and o_c1 <= c2").select("op_id", "object_path", F.lit("rejected").alias("code"), F.lit("it overlaps a merged range").alias("message")).distinct()
    fine = new.join(hit.select("op_id"), "op_id", "left_anti").groupBy("object_path", "idx").agg(F.max_by(F.struct("op_id", "_range"), "op_id").alias("m"))
    sheets = tables["sheets"]
    out = sheets.join(fine, ["object_path", "idx"], "left").withColumn("merges", F.when(F.col("m").isNotNull(), F.array_append(F.coalesce("merges", F.expr("cast(array() as array<string>)")), F.col("m._range"))).otherwise(F.col("merges"))).select(*sheets.columns)
    diff = fine.select(F.col("m.op_id").alias("op_id"), "object_path", F.lit(name).alias("kind"), F.col("m._range").alias("target"), F.lit("added").alias("change"), F.lit(None).cast("string").alias("before"), F.col("m._range").alias("after"))
    return Applied(tables | {"sheets": out}, diff, lost.unionByName(hit))


def _apply_define(tables: Tables, ops: DataFrame, kind: Kind, name: str) -> Applied:
    """Create or redefine a name; one that is there keeps its spelling."""
    names = tables["named_ranges"]
    fold = lambda c: F.translate(c, _UP, _LOW)
    last = ops.groupBy("object_path", fold(F.col("p.name")).alias("_k")).agg(F.max_by(F.struct("op_id", "p"), "op_id").alias("m"))
    both = names.withColumn("_k", fold(F.col("name"))).join(last, ["object_path", "_k"], "full_outer")
    text = F.regexp_replace("m.p.formula", "^=", "")
    out = both.select(*[F.coalesce("name", "m.p.name").alias(c) if c == "name" else F.coalesce(text, "formula").alias(c) if c == "formula" else F.coalesce(c, F.concat(F.lit("new_"), "m.op_id")).alias(c) if c == "element_id" else F.col(c) for c in names.columns])
    diff = both.where("m is not null").select(F.col("m.op_id").alias("op_id"), "object_path", F.lit(name).alias("kind"), F.coalesce("name", "m.p.name").alias("target"), F.when(F.col("name").isNull(), "added").otherwise("changed").alias("change"), F.col("formula").alias("before"), text.alias("after"))
    return Applied(tables | {"named_ranges": out}, diff, ops.limit(0).select("op_id", "object_path", F.lit("").alias("code"), F.lit("").alias("message")))


def _apply_add_named(tables: Tables, ops: DataFrame, kind: Kind, name: str) -> Applied:
    """Add a text box; its name is the given one, which must be free on the slide, or the next free ``TextBox n``."""
    good, lost, _ = _matched(tables, ops, kind, kind.options["of"])
    shapes = with_attrs(tables["shapes"])
    taken = shapes.groupBy("object_path", "slide").agg(F.collect_set("name").alias("_names"), F.max("ord").alias("_last"))
    one = good.groupBy("object_path", F.col("e.name").alias("slide")).agg(F.max_by(F.struct("op_id", "p"), "op_id").alias("m")).select("object_path", "slide", "m.op_id", "m.p")
    seen = one.join(taken, ["object_path", "slide"], "left").withColumn("_names", F.coalesce("_names", F.expr("cast(array() as array<string>)")))
    free = F.get(F.expr("filter(transform(sequence(1, size(_names) + 1), i -> concat('TextBox ', i)), n -> not array_contains(_names, n))"), F.lit(0))
    clash = seen.where(F.array_contains("_names", F.col("p.name"))).select("op_id", "object_path", F.lit("rejected").alias("code"), F.lit("the name is taken").alias("message"))
    made = seen.where(F.col("p.name").isNull() | ~F.array_contains("_names", F.col("p.name"))).withColumn("_name", F.coalesce("p.name", free))
    fresh = made.select(*[F.col(c) if c in ("object_path", "slide") else F.col("_name").alias(c) if c == "name" else F.expr(kind.sets["text"]).alias(c) if c == "text" else (F.coalesce("_last", F.lit(-1)) + 1).cast("int").alias(c) if c == "ord" else F.concat(F.lit("new_"), "op_id").alias(c) if c == "element_id" else F.expr("cast(map() as map<string, string>)").alias(c) if c == "attrs" else F.lit(None).cast(shapes.schema[c].dataType).alias(c) for c in shapes.columns])
    diff = made.select("op_id", "object_path", F.lit(name).alias("kind"), F.concat("slide", F.lit("/"), "_name").alias("target"), F.lit("added").alias("change"), F.lit(None).cast("string").alias("before"), F.expr(kind.sets["text"]).alias("after"))
    return Applied(tables | {"shapes": shapes.unionByName(fresh)}, diff, lost.unionByName(clash))
