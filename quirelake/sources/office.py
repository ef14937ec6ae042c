"""Office files as entities: sheets, cells, names, paragraphs, slides, shapes, tables, notes, comments, charts, pictures.

Parsers use the standard library only. Each takes the bytes of a file and gives rows as dictionaries by entity; a file
that cannot be read gives one row of the entity ``errors``. Parsing is the one step that needs Python; what follows is
DataFrames.
"""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

from quirelake.functions import formula as fx
from quirelake.functions.formats import NUMBER_FORMATS
from quirelake.functions.formula import column_index, column_name
from quirelake.functions.ids import element_id_of

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"

Rows = dict[str, list[dict]]


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    try:
        return ET.fromstring(z.read(name))
    except KeyError:
        return None


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """rId to (kind, part) of the relations of a part; targets outside the package are left out."""
    folder, _, base = part.rpartition("/")
    root = _xml(z, f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels")
    out = {}
    for rel in root.iter(_REL) if root is not None else ():
        if rel.get("TargetMode") == "External":
            continue
        target = rel.get("Target", "")
        pieces = [] if target.startswith("/") else folder.split("/") if folder else []
        for piece in target.strip("/").split("/"):
            pieces = pieces[:-1] if piece == ".." else pieces if piece == "." else [*pieces, piece]
        out[rel.get("Id", "")] = (rel.get("Type", "").rsplit("/", 1)[-1], "/".join(pieces))
    return out


def _first(z: zipfile.ZipFile, part: str, kind: str) -> str | None:
    return next((p for k, p in _relations(z, part).values() if k == kind), None)


# ---- spreadsheets

#: Built-in formats that show dates or times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)])


def serial_to_iso(serial: float, from_1904: bool = False) -> str:
    base = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    moment = base + timedelta(milliseconds=round(serial * 86_400_000))
    return moment.isoformat(timespec="milliseconds" if moment.microsecond else "seconds")


def _styles(z: zipfile.ZipFile, part: str | None) -> tuple[list[int], dict[int, str]]:
    root = _xml(z, part) if part else None
    if root is None:
        return [], {}
    custom = {int(f.get("numFmtId", -1)): f.get("formatCode", "") for f in root.iter(S + "numFmt")}
    xfs = root.find(S + "cellXfs")
    return [int(x.get("numFmtId", 0)) for x in xfs] if xfs is not None else [], custom


def _is_date(number: int, code: str | None) -> bool:
    if code is None:
        return number in DATE_FORMATS
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())
    return bool(re.search(r"[dyhs]|m", bare)) and "general" not in bare


def _rich(node: ET.Element | None) -> str:
    """The text of a string item without phonetic hints."""
    if node is None:
        return ""
    hints = {t for ph in node.iter(S + "rPh") for t in ph.iter(S + "t")}
    return "".join(t.text or "" for t in node.iter(S + "t") if t not in hints)


def parse_xlsx(blob: bytes) -> Rows:
    out: Rows = {k: [] for k in ("sheets", "cells", "named_ranges", "styles", "annotations", "features")}
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        book_part = _first(z, "", "officeDocument") or "xl/workbook.xml"
        book, rels = _xml(z, book_part), _relations(z, book_part)
        if book is None:
            raise ValueError("no workbook")
        from_1904 = any(p.get("date1904") in ("1", "true") for p in book.iter(S + "workbookPr"))
        shared_part = _first(z, book_part, "sharedStrings")
        shared_root = _xml(z, shared_part) if shared_part else None
        shared = [_rich(si) for si in shared_root.findall(S + "si")] if shared_root is not None else []
        xfs, custom = _styles(z, _first(z, book_part, "styles"))
        used: set[int] = set()
        for name in book.iter(S + "definedName"):
            if not name.get("name", "").startswith("_xlnm."):
                out["named_ranges"].append({"element_id": element_id_of("named_range", name.get("name"), name.text), "name": name.get("name"), "formula": name.text})
        for i, node in enumerate(book.iter(S + "sheet")):
            title = node.get("name", "")
            part = rels.get(node.get(R + "id", ""), ("", ""))[1]
            root = _xml(z, part)
            if root is None:
                continue
            rows = cols = 0
            masters: dict[str, tuple[int, int, str]] = {}
            last_row = 0
            for row in root.iter(S + "row"):
                last_row = int(row.get("r", last_row + 1))
                last_col = 0
                for c in row.findall(S + "c"):
                    m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
                    col = column_index(m.group(1)) if m else last_col + 1
                    last_col = col
                    cell = _xlsx_cell(c, shared, xfs, custom, from_1904, used, NUMBER_FORMATS)
                    formula = _xlsx_formula(c.find(S + "f"), last_row, col, masters)
                    if cell is None and formula is None:
                        continue
                    address = f"{column_name(col)}{last_row}"
                    rows, cols = max(rows, last_row), max(cols, col)
                    base = {"kind": "empty", "v_str": None, "v_num": None, "v_int": None, "v_bool": None, "style_id": None, "number_format": None} | (cell or {})
                    out["cells"].append({"element_id": element_id_of("cell", title, address), "sheet": title, "address": address, "row": last_row, "col": col, "formula": formula, **base})
            merged = [m.get("ref") for m in root.iter(S + "mergeCell")]
            view = next(root.iter(S + "sheetView"), None)
            pane = view.find(S + "pane") if view is not None else None
            setup = next(root.iter(S + "pageSetup"), None)
            tab = next(root.iter(S + "tabColor"), None)
            auto = root.find(S + "autoFilter")
            out["sheets"].append({
                "element_id": element_id_of("sheet", title, i), "name": title, "idx": i, "rows": rows, "cols": cols, "hidden": node.get("state", "visible") != "visible", "merges": merged,
                "freeze_panes": pane.get("topLeftCell") if pane is not None and "frozen" in pane.get("state", "") else None, "zoom": int(view.get("zoomScale")) if view is not None and view.get("zoomScale") else None,
                "show_gridlines": view is None or view.get("showGridLines") not in ("0", "false"), "right_to_left": view is not None and view.get("rightToLeft") in ("1", "true"),
                "tab_color": tab.get("rgb") if tab is not None else None, "auto_filter": auto.get("ref") if auto is not None else None, "page_orientation": setup.get("orientation") if setup is not None else None,
            })
            _xlsx_annotations(z, part, title, out)
            _xlsx_features(z, part, root, title, out)
        _xlsx_pivots(z, book_part, out)
        out["styles"] = [{"style_id": f"{n}"} for n in sorted(used) if n]
    return out


def _xlsx_cell(c: ET.Element, shared: list[str], xfs: list[int], custom: dict[int, str], from_1904: bool, used: set[int], built_in: dict[int, str]) -> dict | None:
    style = int(c.get("s", 0))
    number = xfs[style] if style < len(xfs) else 0
    code = custom.get(number, built_in.get(number))
    if style:
        used.add(style)
    look = {"style_id": str(style) if style else None, "number_format": None if not style or number == 0 or code == "General" else code}
    kind, v = c.get("t", "n"), c.find(S + "v")
    text = v.text if v is not None else None
    if kind == "inlineStr":
        return look | {"kind": "string", "v_str": _rich(c.find(S + "is"))}
    if text is None:
        return None
    if kind == "s":
        return look | {"kind": "string", "v_str": shared[int(text)]}
    if kind == "str":
        return look | {"kind": "string", "v_str": text}
    if kind == "b":
        return look | {"kind": "boolean", "v_bool": text == "1"}
    if kind == "e":
        return look | {"kind": "error", "v_str": text}
    if kind == "d":
        return look | {"kind": "datetime", "v_str": text}
    if _is_date(number, custom.get(number)):
        return look | {"kind": "datetime", "v_str": serial_to_iso(float(text), from_1904)}
    return look | {"kind": "float", "v_num": float(text)}


def _xlsx_formula(f: ET.Element | None, row: int, col: int, masters: dict[str, tuple[int, int, str]]) -> str | None:
    """The formula of a cell; of a shared formula the one written out is moved to the others."""
    if f is None:
        return None
    if f.get("t") == "shared":
        key = f.get("si", "")
        if f.text:
            masters[key] = (row, col, f.text)
        elif key in masters:
            r, c, text = masters[key]
            return "=" + _moved(text, row - r, col - c)
    return "=" + f.text if f.text else None


def _moved(formula: str, rows: int, cols: int) -> str:
    def move(x: fx.Reference) -> str:
        def corner(r: int, c: int, fixed_col: str, fixed_row: str) -> str:
            return f"{fixed_col}{column_name(c if fixed_col else c + cols)}{fixed_row}{r if fixed_row else r + rows}"

        head, mark, _ = formula[x.start : x.end].rpartition("!")
        first = corner(x.r1, x.c1, x.fixed[0], x.fixed[1])
        return head + mark + (first if not x.is_range else first + ":" + corner(x.r2, x.c2, x.fixed[2], x.fixed[3]))

    return fx.rewrite(formula, move)


def _xlsx_annotations(z: zipfile.ZipFile, part: str, sheet: str, out: Rows) -> None:
    for kind, target in _relations(z, part).values():
        if kind == "comments" and (root := _xml(z, target)) is not None:
            authors = [a.text or "" for a in root.iter(S + "author")]
            for c in root.iter(S + "comment"):
                who = int(c.get("authorId", 0))
                out["annotations"].append({"kind": "comment", "container": sheet, "anchor": c.get("ref"), "author": authors[who] if who < len(authors) else None, "text": _rich(c.find(S + "text")), "element_id": element_id_of("comment", sheet, c.get("ref"))})
        elif kind == "drawing":
            for sub, inner in _relations(z, target).values():
                if sub == "chart" and (root := _xml(z, inner)) is not None:
                    title = next(root.iter(C + "title"), None)
                    text = "".join(t.text or "" for t in title.iter(A + "t")) if title is not None else None
                    out["annotations"].append({"kind": "chart", "container": sheet, "anchor": inner, "author": None, "text": text, "element_id": element_id_of("chart", inner)})
                elif sub == "image":
                    out["annotations"].append({"kind": "picture", "container": sheet, "anchor": inner, "author": None, "text": None, "element_id": element_id_of("picture", sheet, inner)})


#: Parts of a sheet that hold places of their own, which shifts of rows and columns do not follow.
PLACED = ("autoFilter", "dataValidations", "conditionalFormatting", "hyperlinks", "rowBreaks", "colBreaks")


def _xlsx_features(z: zipfile.ZipFile, part: str, root: ET.Element, sheet: str, out: Rows) -> None:
    """What makes a sheet one whose rows and columns are not shifted."""
    found = [tag for tag in PLACED if root.find(S + tag) is not None]
    found += sorted({f.get("t") + "_formula" for f in root.iter(S + "f") if f.get("t") in ("shared", "array", "dataTable")})
    for kind, target in _relations(z, part).values():
        if kind == "table":
            found.append("table")
        elif kind == "drawing":
            found += ["chart" for sub, _ in _relations(z, target).values() if sub == "chart"]
        elif kind == "pivotTable":
            found.append("pivot_table")
    out["features"] += [{"sheet": sheet, "feature": f} for f in dict.fromkeys(found)]


def _xlsx_pivots(z: zipfile.ZipFile, book_part: str, out: Rows) -> None:
    """Sheets that pivot tables take their data from; a source that names no sheet concerns all of them."""
    for kind, target in _relations(z, book_part).values():
        root = _xml(z, target) if kind == "pivotCacheDefinition" else None
        for source in root.iter(S + "worksheetSource") if root is not None else ():
            sheet = source.get("sheet")
            if sheet is None:
                named = next((n["formula"] for n in out["named_ranges"] if n["name"].casefold() == (source.get("name") or "").casefold()), None)
                sheet = next((x.sheet for x in fx.scan(named or "") if isinstance(x, fx.Reference) and x.sheet), None)
            out["features"].append({"sheet": sheet, "feature": "pivot_source"})


# ---- word processing

#: Content that makes a paragraph one that is not edited.
LOCKED = tuple(W + t for t in ("del", "ins", "sdt", "fldChar", "instrText"))


def _paragraph(p: ET.Element, index: int, in_table: bool) -> dict:
    text = []
    for node in p.iter():
        if node.tag == W + "t":
            text.append(node.text or "")
        elif node.tag == W + "tab" and node.attrib.get(W + "val") is None:
            text.append("\t")
        elif node.tag in (W + "br", W + "cr"):
            text.append("\n")
    props = p.find(W + "pPr")
    style = props.find(W + "pStyle") if props is not None else None
    level = props.find(W + "outlineLvl") if props is not None else None
    return {"idx": index, "text": "".join(text), "style_id": style.get(W + "val") if style is not None else None, "outline_level": int(level.get(W + "val")) if level is not None else None, "editable": not any(True for t in LOCKED for _ in p.iter(t)), "in_table": in_table}


def _paragraphs(root: ET.Element) -> list[dict]:
    """All paragraphs in document order, those in tables too; they share one index."""
    out: list[dict] = []

    def walk(node: ET.Element, in_table: bool, locked: bool) -> None:
        for child in node:
            if child.tag == W + "p":
                row = _paragraph(child, len(out), in_table)
                out.append(row | {"editable": row["editable"] and not locked})
            else:
                walk(child, in_table or child.tag == W + "tbl", locked or child.tag in LOCKED)

    walk(root, False, False)
    return out


def parse_docx(blob: bytes) -> Rows:
    out: Rows = {k: [] for k in ("paragraphs", "story_paragraphs", "annotations")}
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        main = _first(z, "", "officeDocument") or "word/document.xml"
        root = _xml(z, main)
        if root is None:
            raise ValueError("no document")
        for row in _paragraphs(root.find(W + "body")):
            out["paragraphs"].append({"element_id": element_id_of("paragraph", row["idx"], row["text"]), **row})
        for kind, part in sorted(_relations(z, main).values()):
            if kind in ("header", "footer") and (story := _xml(z, part)) is not None:
                name = part.rsplit("/", 1)[-1].removesuffix(".xml")
                for row in _paragraphs(story):
                    out["story_paragraphs"].append({"element_id": element_id_of("paragraph", kind, name, row["idx"], row["text"]), "story": kind, "part": name, **row})
            elif kind == "comments" and (notes := _xml(z, part)) is not None:
                for c in notes.iter(W + "comment"):
                    out["annotations"].append({"kind": "comment", "container": main, "anchor": c.get(W + "id"), "author": c.get(W + "author"), "text": "".join(t.text or "" for t in c.iter(W + "t")), "element_id": element_id_of("comment", main, c.get(W + "id"))})
            elif kind == "image":
                out["annotations"].append({"kind": "picture", "container": main, "anchor": part, "author": None, "text": None, "element_id": element_id_of("picture", main, part)})
    return out


# ---- presentations


def _frame_text(body: ET.Element | None) -> str:
    return "\n".join("".join("\n" if n.tag == A + "br" else n.text or "" for n in p.iter() if n.tag in (A + "t", A + "br")) for p in body.iter(A + "p")) if body is not None else ""


def parse_pptx(blob: bytes) -> Rows:
    out: Rows = {k: [] for k in ("slides", "shapes", "slide_table_cells", "annotations")}
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        main = _first(z, "", "officeDocument") or "ppt/presentation.xml"
        root, rels = _xml(z, main), _relations(z, main)
        if root is None:
            raise ValueError("no presentation")
        for i, sid in enumerate(root.iter(P + "sldId")):
            part = rels.get(sid.get(R + "id", ""), ("", ""))[1]
            slide = _xml(z, part)
            if slide is None:
                continue
            name = f"Slide {i + 1}"
            notes_part = _first(z, part, "notesSlide")
            notes_root = _xml(z, notes_part) if notes_part else None
            notes = None
            if notes_root is not None:
                bodies = [sp for sp in notes_root.iter(P + "sp") if any(ph.get("type") == "body" for ph in sp.iter(P + "ph"))]
                notes = "\n".join(_frame_text(sp.find(P + "txBody")) for sp in bodies)
            out["slides"].append({"element_id": element_id_of("slide", name, i), "name": name, "idx": i, "part_name": part, "notes": notes, "notes_part_name": notes_part})
            ordinal = 0
            for sp in slide.iter(P + "sp"):
                label = next((n.get("name", "") for n in sp.iter(P + "cNvPr")), "")
                if (body := sp.find(P + "txBody")) is not None:
                    out["shapes"].append({"element_id": element_id_of("shape", name, label), "slide": name, "name": label, "ord": ordinal, "text": _frame_text(body)})
                    ordinal += 1
            for frame in slide.iter(P + "graphicFrame"):
                label = next((n.get("name", "") for n in frame.iter(P + "cNvPr")), "")
                for r, tr in enumerate(frame.iter(A + "tr")):
                    for c, tc in enumerate(tr.findall(A + "tc")):
                        runs = [rp for rp in tc.iter(A + "rPr")]
                        out["slide_table_cells"].append({"element_id": element_id_of("table_cell", name, label, r, c), "slide": name, "table_name": label, "row": r, "col": c, "text": _frame_text(tc.find(A + "txBody")), "bold": any(x.get("b") == "1" for x in runs), "italic": any(x.get("i") == "1" for x in runs)})
            for kind, target in sorted(_relations(z, part).values()):
                if kind == "comments" and (notes := _xml(z, target)) is not None:
                    for k, cm in enumerate(notes.iter(P + "cm")):
                        out["annotations"].append({"kind": "comment", "container": name, "anchor": target, "author": cm.get("authorId"), "text": next((t.text for t in cm.iter(P + "text")), None), "element_id": element_id_of("comment", name, target, k)})
                elif kind in ("image", "chart"):
                    out["annotations"].append({"kind": "picture" if kind == "image" else "chart", "container": name, "anchor": target, "author": None, "text": None, "element_id": element_id_of("picture" if kind == "image" else "chart", name, target)})
    return out


