"""Edits of structure and looks written into office packages: small changes of markup, part by part.

Each kind of edit is a function of the package, the payload and the differences the edit made on the tables; parts that
no function asks for are copied byte by byte. Elements are put where the formats' schemas want them.

What does not follow an edit stops it (``NotWritable``), and the file stays as it is: drawings and comments on a sheet
whose rows are shifted, formulas written for several cells at once, the only paragraph of a table cell.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from copy import deepcopy
from xml.etree import ElementTree as ET

from quirelake.functions.formula import column_index, column_name, drop_sheet, rename_sheet, same_sheet, shift_formula, shift_sqref
from quirelake.sources import office as of
from quirelake.sources.packages import splice

A, C, P, R, S, W = of.A, of.C, of.P, of.R, of.S, of.W
_CT = "{http://schemas.openxmlformats.org/package/2006/content-types}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_TYPES = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"

#: The order of elements in the formats' schemas.
SHEET_ORDER = "sheetPr dimension sheetViews sheetFormatPr cols sheetData sheetCalcPr sheetProtection protectedRanges scenarios autoFilter sortState dataConsolidate customSheetViews mergeCells phoneticPr conditionalFormatting dataValidations hyperlinks printOptions pageMargins pageSetup headerFooter rowBreaks colBreaks customProperties cellWatches ignoredErrors smartTags drawing legacyDrawing tableParts extLst".split()
BOOK_ORDER = "fileVersion fileSharing workbookPr workbookProtection bookViews sheets functionGroups externalReferences definedNames calcPr oleSize pivotCaches extLst".split()
STYLE_ORDER = "numFmts fonts fills borders cellStyleXfs cellXfs cellStyles dxfs tableStyles colors extLst".split()
FONT_ORDER = "b i strike condense extend outline shadow u vertAlign sz color name family charset scheme".split()
RUN_ORDER = "rStyle rFonts b bCs i iCs caps smallCaps strike dstrike outline shadow emboss imprint noProof snapToGrid vanish webHidden color spacing w kern position sz szCs highlight u effect bdr shd fitText vertAlign rtl cs em lang eastAsianLayout specVanish oMath".split()
PARAGRAPH_ORDER = "pStyle keepNext keepLines pageBreakBefore framePr widowControl numPr suppressLineNumbers pBdr shd tabs suppressAutoHyphens kinsoku wordWrap overflowPunct topLinePunct autoSpaceDE autoSpaceDN bidi adjustRightInd snapToGrid spacing ind contextualSpacing mirrorIndents suppressOverlap jc textDirection textAlignment textboxTightWrap outlineLvl divId cnfStyle rPr sectPr pPrChange".split()
CELL_ORDER = "cnfStyle tcW gridSpan hMerge vMerge tcBorders shd noWrap tcMar textDirection tcFitText vAlign hideMark".split()
DRAWING_RUN_ORDER = "ln noFill solidFill gradFill effectLst highlight latin ea cs sym hlinkClick hlinkMouseOver extLst".split()


class NotWritable(ValueError):
    """An edit of a kind, or a target, that cannot be written back into a file."""


def load(blob: bytes) -> ET.Element:
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(blob), events=["start-ns"]):
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    return ET.fromstring(blob)


def dump(root: ET.Element) -> bytes:
    return b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + ET.tostring(root, encoding="utf-8")


def local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def child(parent: ET.Element, tag: str, order: list[str]) -> ET.Element:
    """The child of that tag, put in where its schema wants it if it is not there."""
    found = parent.find(tag)
    if found is None:
        found = ET.Element(tag)
        rank = order.index(local(found))
        parent.insert(next((i for i, n in enumerate(parent) if local(n) in order and order.index(local(n)) > rank), len(parent)), found)
    return found


def drop(parent: ET.Element, *tags: str) -> None:
    for node in [n for n in parent if n.tag in tags]:
        parent.remove(node)


def mark(parent: ET.Element, tag: str, order: list[str], attributes: dict[str, str] | None) -> None:
    """The child of that tag with these attributes alone; without any if they are None."""
    drop(parent, tag)
    if attributes is not None:
        node = child(parent, tag, order)
        for k, v in attributes.items():
            node.set(k, v)


def switch(node: ET.Element, name: str, value: str | None) -> None:
    if value is None:
        node.attrib.pop(name, None)
    else:
        node.set(name, value)


def number(value: float) -> str:
    return f"{value:.10g}"


class Package:
    """A package whose parts are parsed when they are asked for; those asked for to be changed are written again."""

    def __init__(self, blob: bytes) -> None:
        self.blob, self.z = blob, zipfile.ZipFile(io.BytesIO(blob))
        self.names = set(self.z.namelist())
        self.trees: dict[str, ET.Element] = {}
        self.changes: dict[str, bytes | None] = {}
        self.main = of._first(self.z, "", "officeDocument") or next((n for n in ("xl/workbook.xml", "word/document.xml", "ppt/presentation.xml") if n in self.names), "")

    def edit(self, part: str) -> ET.Element:
        if part not in self.trees:
            if part not in self.names:
                raise NotWritable(f"no part {part}")
            self.trees[part] = load(self.z.read(part))
        return self.trees[part]

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        return of._relations(self.z, part)

    @staticmethod
    def rels_of(part: str) -> str:
        folder, _, base = part.rpartition("/")
        return f"{folder}/_rels/{base}.rels"

    def _rels(self, part: str) -> ET.Element:
        name = self.rels_of(part)
        if name not in self.trees and name not in self.names:
            self.trees[name] = ET.Element(_REL + "Relationships")
        return self.trees[name] if name in self.trees else self.edit(name)

    def relate(self, part: str, kind: str, target: str, outside: bool = False) -> str:
        root = self._rels(part)
        taken = {r.get("Id") for r in root}
        new = next(f"rId{k}" for k in range(1, len(taken) + 2) if f"rId{k}" not in taken)
        where = target if outside else posixpath.relpath(target, posixpath.dirname(part))
        ET.SubElement(root, _REL + "Relationship", {"Id": new, "Type": _TYPES + kind, "Target": where} | ({"TargetMode": "External"} if outside else {}))
        return new

    def unrelate(self, part: str, rid: str) -> None:
        root = self._rels(part)
        for rel in [r for r in root if r.get("Id") == rid]:
            root.remove(rel)

    def add(self, part: str, root: ET.Element, content_type: str) -> None:
        self.trees[part] = root
        if "[Content_Types].xml" in self.names:
            ET.SubElement(self.edit("[Content_Types].xml"), _CT + "Override", {"PartName": "/" + part, "ContentType": content_type})

    def remove(self, part: str) -> None:
        for name in (part, self.rels_of(part)):
            self.trees.pop(name, None)
            if name in self.names:
                self.changes[name] = None
        if "[Content_Types].xml" in self.names:
            types = self.edit("[Content_Types].xml")
            for t in [t for t in types if t.get("PartName") == "/" + part]:
                types.remove(t)

    def written(self) -> bytes:
        return splice(self.blob, self.changes | {name: dump(root) for name, root in self.trees.items()})


# ---- spreadsheets


class Book(Package):
    def __init__(self, blob: bytes) -> None:
        super().__init__(blob)
        self.book = self.edit(self.main)
        rels = self.relations(self.main)
        self.sheets = [(n, rels.get(n.get(R + "id", ""), ("", ""))[1]) for n in self.book.iter(S + "sheet")]

    def at(self, name: str) -> int:
        found = [k for k, (n, _) in enumerate(self.sheets) if same_sheet(n.get("name"), name)]
        if not found:
            raise NotWritable(f"no sheet {name}")
        return found[0]

    def sheet(self, name: str) -> ET.Element:
        return self.edit(self.sheets[self.at(name)][1])

    def defined(self, make: bool = False) -> ET.Element | None:
        return child(self.book, S + "definedNames", BOOK_ORDER) if make else self.book.find(S + "definedNames")

    def define(self, name: str, text: str | None, sheet: int | None = None, hidden: bool = False) -> None:
        names = self.defined(True)
        for n in [n for n in names if n.get("name", "").casefold() == name.casefold() and n.get("localSheetId") == (None if sheet is None else str(sheet))]:
            name = n.get("name")
            names.remove(n)
        if text is not None:
            ET.SubElement(names, S + "definedName", {"name": name} | ({} if sheet is None else {"localSheetId": str(sheet)}) | ({"hidden": "1"} if hidden else {})).text = text
        if not len(names):
            self.book.remove(names)

    def rewrite_formulas(self, work: Callable[[str, str], str], skip: str | None = None) -> None:
        """All formulas of cells, rules, names and charts through ``work(formula, sheet)``; ``skip`` names a sheet left out."""
        for node, part in self.sheets:
            title = node.get("name")
            if skip is not None and same_sheet(title, skip):
                continue
            for f in self.edit(part).iter():
                if local(f) in ("f", "formula", "formula1", "formula2") and f.text:
                    f.text = work(f.text, title)
        for n in self.defined() if self.defined() is not None else ():
            n.text = work(n.text or "", "")
        for part in sorted(n for n in self.names if re.search(r"/charts/chart[^/]*\.xml$", n)):
            for f in self.edit(part).iter(C + "f"):
                f.text = work(f.text or "", "")

    def stale(self) -> None:
        """What was calculated is no longer true: formulas lose their values, and the file asks to be calculated."""
        for _, part in self.sheets:
            if part not in self.trees and b"<f" not in self.z.read(part) and b":f" not in self.z.read(part):
                continue
            for c in self.edit(part).iter(S + "c"):
                if c.find(S + "f") is not None:
                    drop(c, S + "v")
                    c.attrib.pop("t", None)
        calc = child(self.book, S + "calcPr", BOOK_ORDER)
        calc.set("fullCalcOnLoad", "1")
        calc.set("forceFullCalc", "1")
        for rid, (kind, part) in self.relations(self.main).items():
            if kind == "calcChain":
                self.unrelate(self.main, rid)
                self.remove(part)


def _plain(address: str) -> str:
    return address.replace("$", "").upper()


def _fixed(area: str) -> str:
    return re.sub(r"([A-Z]+)(\d+)", r"$\1$\2", _plain(area))


def _quoted(sheet: str) -> str:
    return "'" + sheet.replace("'", "''") + "'!"


def _argb(color: str) -> str:
    bare = color.lstrip("#").upper()
    return "FF" + bare if len(bare) == 6 else bare


def _view(root: ET.Element) -> ET.Element:
    views = child(root, S + "sheetViews", SHEET_ORDER)
    view = views.find(S + "sheetView")
    return view if view is not None else ET.SubElement(views, S + "sheetView", {"workbookViewId": "0"})


def _column_width(root: ET.Element, p: dict) -> None:
    cols, at = child(root, S + "cols", SHEET_ORDER), column_index(p["column"])
    pieces = []
    for c in list(cols):
        low, high = int(c.get("min")), int(c.get("max"))
        for a, b in [(low, high)] if not low <= at <= high else [(low, at - 1), (at + 1, high)]:
            if a <= b:
                piece = deepcopy(c)
                piece.set("min", str(a))
                piece.set("max", str(b))
                pieces.append(piece)
        cols.remove(c)
    pieces.append(ET.Element(S + "col", {"min": str(at), "max": str(at), "width": number(p["width"]), "customWidth": "1"}))
    cols.extend(sorted(pieces, key=lambda c: int(c.get("min"))))


def row_of(data: ET.Element, at: int) -> ET.Element:
    """The row of that number, put in where it belongs if it is not there."""
    place = len(data)
    for i, row in enumerate(data):
        here = int(row.get("r", i + 1))
        if here == at:
            return row
        if here > at:
            place = i
            break
    row = ET.Element(S + "row", {"r": str(at)})
    data.insert(place, row)
    return row


def cell_of(data: ET.Element, address: str) -> ET.Element:
    m = re.fullmatch(r"([A-Z]+)(\d+)", address)
    row, col = row_of(data, int(m.group(2))), column_index(m.group(1))
    for i, c in enumerate(row):
        here = column_index(re.match(r"[A-Z]+", c.get("r", "A")).group())
        if here == col:
            return c
        if here > col:
            new = ET.Element(S + "c", {"r": address})
            row.insert(i, new)
            return new
    return ET.SubElement(row, S + "c", {"r": address})


def _row_height(root: ET.Element, p: dict) -> None:
    row = row_of(child(root, S + "sheetData", SHEET_ORDER), p["row"])
    row.set("ht", number(p["height"]))
    row.set("customHeight", "1")


def _freeze(root: ET.Element, p: dict) -> None:
    view = _view(root)
    drop(view, S + "pane", S + "selection")
    cell = _plain(p.get("cell") or "A1")
    if cell != "A1":
        m = re.fullmatch(r"([A-Z]+)(\d+)", cell)
        x, y = column_index(m.group(1)) - 1, int(m.group(2)) - 1
        where = "bottomRight" if x and y else "bottomLeft" if y else "topRight"
        view.insert(0, ET.Element(S + "pane", ({"xSplit": str(x)} if x else {}) | ({"ySplit": str(y)} if y else {}) | {"topLeftCell": cell, "activePane": where, "state": "frozen"}))


def _page(root: ET.Element, name: str, value: str | None) -> None:
    setup = root.find(S + "pageSetup")
    if value is not None or setup is not None:
        switch(child(root, S + "pageSetup", SHEET_ORDER), name, value)


def _fit(root: ET.Element, p: dict) -> None:
    fit = p.get("width") is not None
    if fit or root.find(S + "sheetPr") is not None:
        props = child(root, S + "sheetPr", SHEET_ORDER)
        mark(props, S + "pageSetUpPr", ["tabColor", "outlinePr", "pageSetUpPr"], {"fitToPage": "1"} if fit else None)
    _page(root, "fitToWidth", str(p["width"]) if fit else None)
    _page(root, "fitToHeight", str(p["height"]) if fit else None)


def _center(root: ET.Element, p: dict) -> None:
    options = child(root, S + "printOptions", SHEET_ORDER)
    switch(options, "horizontalCentered", "1" if p["horizontal"] else None)
    switch(options, "verticalCentered", "1" if p["vertical"] else None)


def _margins(root: ET.Element, p: dict) -> None:
    node = child(root, S + "pageMargins", SHEET_ORDER)
    for side in ("left", "right", "top", "bottom", "header", "footer"):
        node.set(side, number(p.get(side) if p.get(side) is not None else float(node.get(side, 0.3))))


def _header_footer(root: ET.Element, p: dict) -> None:
    node = child(root, S + "headerFooter", SHEET_ORDER)
    drop(node, S + "oddHeader", S + "oddFooter")
    for k, tag in enumerate(("header", "footer")):
        if p.get(tag):
            new = ET.Element(S + "odd" + tag.capitalize())
            new.text = p[tag]
            node.insert(k, new)
    if not len(node) and not node.attrib:
        root.remove(node)


def _tab(root: ET.Element, p: dict) -> None:
    mark(child(root, S + "sheetPr", SHEET_ORDER), S + "tabColor", ["tabColor", "outlinePr", "pageSetUpPr"], {"rgb": _argb(p["color"])} if p.get("color") else None)


def _merges(root: ET.Element, add: str | None = None, remove: str | None = None) -> None:
    node = child(root, S + "mergeCells", SHEET_ORDER)
    if remove:
        for m in [m for m in node if _plain(m.get("ref", "")) == remove]:
            node.remove(m)
    if add:
        ET.SubElement(node, S + "mergeCell", {"ref": add})
    node.set("count", str(len(node)))
    if not len(node):
        root.remove(node)


#: Kinds that change one sheet's part.
ON_SHEET: dict[str, Callable[[ET.Element, dict], None]] = {
    "set_column_width": _column_width,
    "set_row_height": _row_height,
    "freeze_panes": _freeze,
    "set_sheet_zoom": lambda root, p: _view(root).set("zoomScale", str(p["zoom"])),
    "set_show_gridlines": lambda root, p: switch(_view(root), "showGridLines", None if p["show"] else "0"),
    "set_right_to_left": lambda root, p: switch(_view(root), "rightToLeft", "1" if p["rtl"] else None),
    "set_tab_color": _tab,
    "set_page_orientation": lambda root, p: _page(root, "orientation", p.get("orientation")),
    "set_paper_size": lambda root, p: _page(root, "paperSize", None if p.get("paper_size") is None else str(p["paper_size"])),
    "set_print_scale": lambda root, p: _page(root, "scale", None if p.get("scale") is None else str(p["scale"])),
    "set_fit_to_page": _fit,
    "set_center_on_page": _center,
    "set_page_margins": _margins,
    "set_header_footer": _header_footer,
    "merge_cells": lambda root, p: _merges(root, add=_plain(p["range"])),
    "unmerge_cells": lambda root, p: _merges(root, remove=_plain(p["range"])),
}


def _hide(book: Book, p: dict, diffs: list[dict]) -> None:
    switch(book.sheets[book.at(p["sheet"])][0], "state", "hidden" if p["hidden"] else None)


def _filter(book: Book, p: dict, diffs: list[dict]) -> None:
    root, area = book.sheet(p["sheet"]), p.get("range")
    mark(root, S + "autoFilter", SHEET_ORDER, {"ref": _plain(area)} if area else None)
    at = book.at(p["sheet"])
    book.define("_xlnm._FilterDatabase", _quoted(book.sheets[at][0].get("name")) + _fixed(area) if area else None, at, True)


def _print_area(book: Book, p: dict, diffs: list[dict]) -> None:
    at = book.at(p["sheet"])
    book.define("_xlnm.Print_Area", _quoted(book.sheets[at][0].get("name")) + _fixed(p["range"]) if p.get("range") else None, at)


def _print_titles(book: Book, p: dict, diffs: list[dict]) -> None:
    at = book.at(p["sheet"])
    lead = _quoted(book.sheets[at][0].get("name"))
    parts = [lead + re.sub(r"(\w+)", r"$\1", p[k].upper()) for k in ("cols", "rows") if p.get(k)]
    book.define("_xlnm.Print_Titles", ",".join(parts) or None, at)


def _define(book: Book, p: dict, diffs: list[dict]) -> None:
    book.define(p["name"], p["formula"].lstrip("="))
    book.stale()


def _undefine(book: Book, p: dict, diffs: list[dict]) -> None:
    book.define(p["name"], None)
    book.stale()


def _rename_sheet(book: Book, p: dict, diffs: list[dict]) -> None:
    node = book.sheets[book.at(p["from"])][0]
    old = node.get("name")
    book.rewrite_formulas(lambda f, s: rename_sheet(f, old, p["to"]))
    node.set("name", p["to"])


def _add_sheet(book: Book, p: dict, diffs: list[dict]) -> None:
    at = book.at(p["after"]) + 1 if p.get("after") else len(book.sheets)
    part = next(n for k in range(1, len(book.names) + 2) if (n := f"{posixpath.dirname(book.main)}/worksheets/sheet{k}.xml") not in book.names)
    root = ET.Element(S + "worksheet")
    ET.SubElement(root, S + "sheetData")
    book.add(part, root, "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml")
    rid = book.relate(book.main, "worksheet", part)
    sheets = book.book.find(S + "sheets")
    sheets.insert(at, ET.Element(S + "sheet", {"name": p["name"], "sheetId": str(max([int(n.get("sheetId", 0)) for n in sheets], default=0) + 1), R + "id": rid}))
    _renumber(book, lambda k: k + 1 if k >= at else k)


def _delete_sheet(book: Book, p: dict, diffs: list[dict]) -> None:
    at = book.at(p["name"])
    node, part = book.sheets[at]
    if any(kind in ("drawing", "table", "pivotTable") for kind, _ in book.relations(part).values()):
        raise NotWritable("the sheet holds drawings, tables or pivot tables")
    gone = node.get("name")
    book.rewrite_formulas(lambda f, s: drop_sheet(f, gone), skip=gone)
    for _, target in list(book.relations(part).values()):
        book.remove(target)
    book.remove(part)
    book.unrelate(book.main, node.get(R + "id"))
    book.book.find(S + "sheets").remove(node)
    del book.sheets[at]
    _renumber(book, lambda k: None if k == at else k - 1 if k > at else k)
    for view in book.book.iter(S + "workbookView"):
        view.attrib.pop("activeTab", None)
        view.attrib.pop("firstSheet", None)
    book.stale()


def _renumber(book: Book, moved: Callable[[int], int | None]) -> None:
    names = book.defined()
    for n in list(names) if names is not None else ():
        if n.get("localSheetId") is not None:
            new = moved(int(n.get("localSheetId")))
            if new is None:
                names.remove(n)
            else:
                n.set("localSheetId", str(new))
    if names is not None and not len(names):
        book.book.remove(names)


def _shift(axis: str, insert: bool) -> Callable[[Book, dict, list[dict]], None]:
    def run(book: Book, p: dict, diffs: list[dict]) -> None:
        at, n = p["at"], p.get("count") or 1
        k = book.at(p["sheet"])
        node, part = book.sheets[k]
        title = node.get("name")
        if any(kind in ("comments", "drawing", "vmlDrawing", "table", "pivotTable") for kind, _ in book.relations(part).values()):
            raise NotWritable("comments, drawings or tables of the sheet would not follow")
        for _, other in book.sheets:
            if any(f.get("t") in ("shared", "array", "dataTable") for f in book.edit(other).iter(S + "f")):
                raise NotWritable("formulas are written for several cells at once")
        root = book.edit(part)
        moved = lambda x: x + n if insert and x >= at else x - n if not insert and x >= at + n else x
        gone = lambda x: not insert and at <= x < at + n
        book.rewrite_formulas(lambda f, own: shift_formula(f, own, title, axis, at, n, insert))
        drop(root, S + "dimension")
        for row in list(root.find(S + "sheetData")):
            r = int(row.get("r"))
            row.attrib.pop("spans", None)
            if axis == "row":
                if gone(r):
                    root.find(S + "sheetData").remove(row)
                    continue
                r = moved(r)
                row.set("r", str(r))
            for c in list(row):
                col = column_index(re.match(r"[A-Z]+", c.get("r", "A")).group())
                if axis == "col":
                    if gone(col):
                        row.remove(c)
                        continue
                    col = moved(col)
                c.set("r", f"{column_name(col)}{r}")
        if axis == "col" and (cols := root.find(S + "cols")) is not None:
            for c in list(cols):
                span = shift_sqref(f"{column_name(int(c.get('min')))}1:{column_name(int(c.get('max')))}1", "col", at, n, insert)
                if span is None:
                    cols.remove(c)
                else:
                    low, high = re.findall(r"[A-Z]+", span)[0], re.findall(r"[A-Z]+", span)[-1]
                    c.set("min", str(column_index(low)))
                    c.set("max", str(column_index(high)))
            if not len(cols):
                root.remove(cols)
        if (merges := root.find(S + "mergeCells")) is not None:
            for m in list(merges):
                span = shift_sqref(m.get("ref"), axis, at, n, insert)
                if span is None or ":" not in span or span.split(":")[0] == span.split(":")[1]:
                    merges.remove(m)
                else:
                    m.set("ref", span)
            merges.set("count", str(len(merges)))
            if not len(merges):
                root.remove(merges)
        book.stale()

    return run


def _styled(work: Callable[[ET.Element, ET.Element, dict], None]) -> Callable[[Book, dict, list[dict]], None]:
    """A cell gets a copy of its style that ``work(styles, xf, payload)`` changes."""

    def run(book: Book, p: dict, diffs: list[dict]) -> None:
        part = next((t for kind, t in book.relations(book.main).values() if kind == "styles"), None)
        if part is None:
            raise NotWritable("the workbook has no styles")
        styles = book.edit(part)
        xfs = child(styles, S + "cellXfs", STYLE_ORDER)
        if not len(xfs):
            ET.SubElement(xfs, S + "xf", {"numFmtId": "0"})
        cell = cell_of(book.sheet(p["sheet"]).find(S + "sheetData"), _plain(p["address"]))
        new = deepcopy(xfs[min(int(cell.get("s", 0)), len(xfs) - 1)])
        work(styles, new, p)
        xfs.append(new)
        xfs.set("count", str(len(xfs)))
        cell.set("s", str(len(xfs) - 1))

    return run


def _listed(styles: ET.Element, tag: str, first: list[ET.Element], new: ET.Element) -> str:
    """The number of a new entry in one of the lists of styles."""
    held = child(styles, S + tag, STYLE_ORDER)
    if not len(held):
        held.extend(first)
    held.append(new)
    held.set("count", str(len(held)))
    return str(len(held) - 1)


def _cell_font(styles: ET.Element, xf: ET.Element, p: dict) -> None:
    fonts = child(styles, S + "fonts", STYLE_ORDER)
    at = int(xf.get("fontId", 0))
    font = deepcopy(fonts[at]) if at < len(fonts) else ET.Element(S + "font")
    for key, tag in (("bold", "b"), ("italic", "i")):
        if p.get(key) is not None:
            mark(font, S + tag, FONT_ORDER, {} if p[key] else None)
    for key, tag, value in (("name", "name", lambda v: {"val": v}), ("size_pt", "sz", lambda v: {"val": number(v)}), ("color", "color", lambda v: {"rgb": _argb(v)})):
        if p.get(key) is not None:
            mark(font, S + tag, FONT_ORDER, value(p[key]))
    xf.set("fontId", _listed(styles, "fonts", [ET.Element(S + "font")], font))
    xf.set("applyFont", "1")


def _cell_fill(styles: ET.Element, xf: ET.Element, p: dict) -> None:
    plain = []
    for kind in ("none", "gray125"):  # the first two fills of a workbook are these
        fill = ET.Element(S + "fill")
        ET.SubElement(fill, S + "patternFill", {"patternType": kind})
        plain.append(fill)
    if not p.get("color"):
        _listed(styles, "fills", plain, plain[0]) if styles.find(S + "fills") is None else None
        xf.set("fillId", "0")
        return
    fill = ET.Element(S + "fill")
    pattern = ET.SubElement(fill, S + "patternFill", {"patternType": "solid"})
    ET.SubElement(pattern, S + "fgColor", {"rgb": _argb(p["color"])})
    xf.set("fillId", _listed(styles, "fills", plain, fill))
    xf.set("applyFill", "1")


XLSX: dict[str, Callable[[Book, dict, list[dict]], None]] = {
    **{kind: (lambda work: lambda book, p, diffs: work(book.sheet(p["sheet"]), p))(work) for kind, work in ON_SHEET.items()},
    "hide_sheet": _hide,
    "set_auto_filter": _filter,
    "set_print_area": _print_area,
    "set_print_titles": _print_titles,
    "define_name": _define,
    "delete_name": _undefine,
    "rename_sheet": _rename_sheet,
    "add_sheet": _add_sheet,
    "delete_sheet": _delete_sheet,
    "insert_row": _shift("row", True),
    "delete_row": _shift("row", False),
    "insert_column": _shift("col", True),
    "delete_column": _shift("col", False),
    "set_cell_font": _styled(_cell_font),
    "set_cell_fill": _styled(_cell_fill),
}


# ---- word processing


def listed_paragraphs(root: ET.Element) -> list[ET.Element]:
    """Paragraphs in document order, those in tables too; what lies within a paragraph is none."""
    out: list[ET.Element] = []

    def walk(node: ET.Element) -> None:
        for n in node:
            if n.tag == W + "p":
                out.append(n)
            else:
                walk(n)

    walk(root)
    return out


def set_runs(p: ET.Element, text: str, run: str, t: str, props: str) -> None:
    """A paragraph's text in one run with the looks of its first."""
    first = next(p.iter(run), None)
    looks = first.find(props) if first is not None else None
    for node in list(p):
        if node.tag != props.replace("rPr", "pPr") and not node.tag.endswith("}endParaRPr"):
            p.remove(node)
    r = ET.Element(run)
    if looks is not None:
        r.append(looks)
    body = ET.SubElement(r, t)
    body.text = text
    if " " in (text[:1], text[-1:]):
        body.set(_SPACE, "preserve")
    at = next((i for i, n in enumerate(p) if n.tag.endswith("}endParaRPr")), len(p))
    p.insert(at, r)


class Document(Package):
    def __init__(self, blob: bytes) -> None:
        super().__init__(blob)
        self.body = self.edit(self.main).find(W + "body")

    def paragraph(self, index: int) -> ET.Element:
        listed = listed_paragraphs(self.body)
        if index >= len(listed):
            raise NotWritable(f"no paragraph {index}")
        return listed[index]

    def above(self, node: ET.Element) -> ET.Element:
        return next(n for n in self.body.iter() if any(c is node for c in n))


def _val(value: str) -> dict[str, str]:
    return {W + "val": value}


def _run_marks(make: Callable[[dict], dict[str, dict[str, str] | None]]) -> Callable[[Document, dict, list[dict]], None]:
    """Marks of all runs of a paragraph: tag to attributes, or None for a mark that goes."""

    def run(doc: Document, p: dict, diffs: list[dict]) -> None:
        for r in doc.paragraph(p["index"]).iter(W + "r"):
            props = r.find(W + "rPr")
            if props is None:
                props = ET.Element(W + "rPr")
                r.insert(0, props)
            for tag, attributes in make(p).items():
                mark(props, W + tag, RUN_ORDER, attributes)

    return run


def _paragraph_marks(work: Callable[[ET.Element, dict], None]) -> Callable[[Document, dict, list[dict]], None]:
    def run(doc: Document, p: dict, diffs: list[dict]) -> None:
        node = doc.paragraph(p["index"])
        props = node.find(W + "pPr")
        if props is None:
            props = ET.Element(W + "pPr")
            node.insert(0, props)
        work(props, p)

    return run


def _flag(key: str, *tags: str) -> Callable[[Document, dict, list[dict]], None]:
    return _run_marks(lambda p: {t: {} if p[key] else _val("0") for t in tags})


def _spacing(props: ET.Element, p: dict) -> None:
    node = child(props, W + "spacing", PARAGRAPH_ORDER)
    for key, side in (("before_pt", "before"), ("after_pt", "after")):
        if p.get(key) is not None:
            node.set(W + side, str(round(p[key] * 20)))
            node.attrib.pop(W + side + "Autospacing", None)


def _shade(doc: Document, p: dict, diffs: list[dict]) -> None:
    cell = doc.above(doc.paragraph(p["index"]))
    if cell.tag != W + "tc":
        raise NotWritable("the paragraph is in no table cell")
    props = cell.find(W + "tcPr")
    if props is None:
        props = ET.Element(W + "tcPr")
        cell.insert(0, props)
    mark(props, W + "shd", CELL_ORDER, _val("clear") | {W + "color": "auto", W + "fill": p["color"].lstrip("#").upper()} if p.get("color") else None)


def _insert_paragraph(doc: Document, p: dict, diffs: list[dict]) -> None:
    here = doc.paragraph(p["after"])
    above = doc.above(here)
    new = ET.Element(W + "p")
    set_runs(new, p["text"], W + "r", W + "t", W + "rPr")
    above.insert(list(above).index(here) + 1, new)


def _delete_paragraph(doc: Document, p: dict, diffs: list[dict]) -> None:
    here = doc.paragraph(p["index"])
    above = doc.above(here)
    if above.tag == W + "tc" and len(above.findall(W + "p")) == 1:
        raise NotWritable("a table cell keeps one paragraph")
    if here.find(f"{W}pPr/{W}sectPr") is not None:
        raise NotWritable("the paragraph ends a section")
    above.remove(here)


def _story(kind: str) -> Callable[[Document, dict, list[dict]], None]:
    def run(doc: Document, p: dict, diffs: list[dict]) -> None:
        part = next((t for k, t in doc.relations(doc.main).values() if k == kind and posixpath.basename(t).removesuffix(".xml") == p["part"]), None)
        listed = listed_paragraphs(doc.edit(part)) if part else []
        if p["index"] >= len(listed):
            raise NotWritable(f"no paragraph {p['index']}")
        set_runs(listed[p["index"]], p["text"], W + "r", W + "t", W + "rPr")

    return run


def _link(doc: Document, p: dict, diffs: list[dict]) -> None:
    node = doc.paragraph(p["index"])
    for link in node.findall(W + "hyperlink"):
        at = list(node).index(link)
        node.remove(link)
        for k, r in enumerate(link):
            node.insert(at + k, r)
    runs = node.findall(W + "r")
    if p.get("url") and runs:
        link = ET.Element(W + "hyperlink", {R + "id": doc.relate(doc.main, "hyperlink", p["url"], outside=True)})
        node.insert(list(node).index(runs[0]), link)
        for r in runs:
            node.remove(r)
            link.append(r)


_SIDES = {"left": "left", "start": "left", "right": "right", "end": "right", "both": "both", "justify": "both", "center": "center"}
DOCX: dict[str, Callable[[Document, dict, list[dict]], None]] = {
    "set_paragraph_style": _paragraph_marks(lambda props, p: mark(props, W + "pStyle", PARAGRAPH_ORDER, _val(p["style_id"]))),
    "set_paragraph_alignment": _paragraph_marks(lambda props, p: mark(props, W + "jc", PARAGRAPH_ORDER, _val(_SIDES[p["alignment"]]))),
    "set_paragraph_spacing": _paragraph_marks(_spacing),
    "insert_page_break": _paragraph_marks(lambda props, p: mark(props, W + "pageBreakBefore", PARAGRAPH_ORDER, {})),
    "set_paragraph_bold": _flag("bold", "b", "bCs"),
    "set_paragraph_italic": _flag("italic", "i", "iCs"),
    "set_paragraph_strikethrough": _flag("strikethrough", "strike"),
    "set_paragraph_underline": _run_marks(lambda p: {"u": _val("single" if p["underline"] else "none")}),
    "set_paragraph_font_size": _run_marks(lambda p: dict.fromkeys(("sz", "szCs"), _val(str(round(p["size_pt"] * 2))) if p.get("size_pt") else None)),
    "set_paragraph_font_name": _run_marks(lambda p: {"rFonts": {W + k: p["font"] for k in ("ascii", "hAnsi", "cs")} if p.get("font") else None}),
    "set_paragraph_font_color": _run_marks(lambda p: {"color": _val(p["color"].lstrip("#").upper()) if p.get("color") else None}),
    "set_paragraph_highlight": _run_marks(lambda p: {"highlight": _val(p["color"]) if p.get("color") else None}),
    "set_paragraph_vert_align": _run_marks(lambda p: {"vertAlign": _val(p["vert_align"]) if p.get("vert_align") else None}),
    "set_paragraph_caps": _run_marks(lambda p: {"caps": {} if p.get("caps") == "all" else None, "smallCaps": {} if p.get("caps") == "small" else None}),
    "set_paragraph_hyperlink": _link,
    "set_cell_shading": _shade,
    "insert_paragraph": _insert_paragraph,
    "delete_paragraph": _delete_paragraph,
    "set_header_paragraph_text": _story("header"),
    "set_footer_paragraph_text": _story("footer"),
}


# ---- presentations


def set_lines(body: ET.Element, text: str) -> None:
    """The text of a frame; lines become paragraphs with the looks of those they replace."""
    paragraphs, lines = body.findall(A + "p"), text.split("\n")
    for extra in paragraphs[len(lines) :]:
        body.remove(extra)
    for k, line in enumerate(lines):
        set_runs(paragraphs[k] if k < len(paragraphs) else ET.SubElement(body, A + "p"), line, A + "r", A + "t", A + "rPr")


class Deck(Package):
    def __init__(self, blob: bytes) -> None:
        super().__init__(blob)
        self.show = self.edit(self.main)
        self.listing = self.show.find(P + "sldIdLst")
        rels = self.relations(self.main)
        self.slides = [(n, rels.get(n.get(R + "id", ""), ("", ""))[1]) for n in (self.listing if self.listing is not None else ())]

    def at(self, slide: str) -> int:
        m = re.fullmatch(r"(?:slide)?\s*([0-9]+)", slide.strip().lower())
        if not m or not 1 <= int(m.group(1)) <= len(self.slides):
            raise NotWritable(f"no slide {slide}")
        return int(m.group(1)) - 1

    def slide(self, slide: str) -> ET.Element:
        return self.edit(self.slides[self.at(slide)][1])

    def shape(self, p: dict) -> ET.Element:
        at = self.at(p["slide"])
        label = lambda sp: next((n.get("name", "") for n in sp.iter(P + "cNvPr")), "")
        shapes = [sp for sp in self.slide(p["slide"]).iter(P + "sp") if sp.find(P + "txBody") is not None]
        known = {s["ord"]: s["element_id"] for s in of.parse_pptx(self.blob)["shapes"] if s["slide"] == f"Slide {at + 1}"}
        found = [sp for k, sp in enumerate(shapes) if label(sp) == p["shape"] or known.get(k) == p["shape"]]
        if not found:
            raise NotWritable(f"no shape {p['shape']}")
        return found[0]

    def cell(self, p: dict) -> ET.Element:
        for frame in self.slide(p["slide"]).iter(P + "graphicFrame"):
            if next((n.get("name", "") for n in frame.iter(P + "cNvPr")), "") == p["table"]:
                rows = list(frame.iter(A + "tr"))
                cells = rows[p["row"]].findall(A + "tc") if p["row"] < len(rows) else []
                if p["col"] < len(cells):
                    return cells[p["col"]]
        raise NotWritable(f"no cell of {p['table']}")


def _runs(node: ET.Element) -> list[ET.Element]:
    out = []
    for r in node.iter(A + "r"):
        props = r.find(A + "rPr")
        if props is None:
            props = ET.Element(A + "rPr")
            r.insert(0, props)
        out.append(props)
    return out


def _looks(where: str, work: Callable[[ET.Element, dict], None]) -> Callable[[Deck, dict, list[dict]], None]:
    def run(deck: Deck, p: dict, diffs: list[dict]) -> None:
        for props in _runs(getattr(deck, where)(p)):
            work(props, p)

    return run


def _color(tag: str) -> Callable[[ET.Element, dict], None]:
    def work(props: ET.Element, p: dict) -> None:
        drop(props, A + tag, *([A + "noFill", A + "gradFill"] if tag == "solidFill" else []))
        if p.get("color"):
            ET.SubElement(child(props, A + tag, DRAWING_RUN_ORDER), A + "srgbClr", {"val": p["color"].lstrip("#").upper()})

    return work


def _shape_link(deck: Deck, p: dict, diffs: list[dict]) -> None:
    part = deck.slides[deck.at(p["slide"])][1]
    rid = deck.relate(part, "hyperlink", p["url"], outside=True) if p.get("url") else None
    for props in _runs(deck.shape(p)):
        mark(props, A + "hlinkClick", DRAWING_RUN_ORDER, {R + "id": rid} if rid else None)


def _bullet(deck: Deck, p: dict, diffs: list[dict]) -> None:
    for para in deck.shape(p).iter(A + "p"):
        props = para.find(A + "pPr")
        if props is None:
            props = ET.Element(A + "pPr")
            para.insert(0, props)
        drop(props, A + "buNone", A + "buChar", A + "buAutoNum", A + "buBlip")
        order = "lnSpc spcBef spcAft buClrTx buClr buSzTx buSzPct buSzPts buFontTx buFont buNone buAutoNum buChar buBlip tabLst defRPr extLst".split()
        mark(props, A + ("buChar" if p["bullet"] else "buNone"), order, {"char": "•"} if p["bullet"] else {})


def _notes(deck: Deck, p: dict, diffs: list[dict]) -> None:
    part = next((t for k, t in deck.relations(deck.slides[deck.at(p["slide"])][1]).values() if k == "notesSlide"), None)
    bodies = [sp.find(P + "txBody") for sp in deck.edit(part).iter(P + "sp") if any(ph.get("type") == "body" for ph in sp.iter(P + "ph"))] if part else []
    if not bodies or bodies[0] is None:
        raise NotWritable("the slide has no notes")
    set_lines(bodies[0], p["text"])
    for more in bodies[1:]:
        set_lines(more, "")


def _delete_shape(deck: Deck, p: dict, diffs: list[dict]) -> None:
    gone = deck.shape(p)
    next(n for n in deck.slide(p["slide"]).iter() if any(c is gone for c in n)).remove(gone)


def _add_textbox(deck: Deck, p: dict, diffs: list[dict]) -> None:
    root = deck.slide(p["slide"])
    tree = next(root.iter(P + "spTree"), root)
    name = diffs[0]["target"].split("/", 1)[1]
    sp = ET.SubElement(tree, P + "sp")
    about = ET.SubElement(sp, P + "nvSpPr")
    ET.SubElement(about, P + "cNvPr", {"id": str(max([int(n.get("id", 0)) for n in root.iter(P + "cNvPr")], default=1) + 1), "name": name})
    ET.SubElement(about, P + "cNvSpPr", {"txBox": "1"})
    ET.SubElement(about, P + "nvPr")
    form = ET.SubElement(sp, P + "spPr")
    frame = ET.SubElement(form, A + "xfrm")
    ET.SubElement(frame, A + "off", {"x": "914400", "y": "914400"})
    ET.SubElement(frame, A + "ext", {"cx": "3657600", "cy": "914400"})
    ET.SubElement(ET.SubElement(form, A + "prstGeom", {"prst": "rect"}), A + "avLst")
    body = ET.SubElement(sp, P + "txBody")
    ET.SubElement(body, A + "bodyPr", {"wrap": "square"})
    ET.SubElement(body, A + "p")
    set_lines(body, p.get("text") or "")


def _move_slide(deck: Deck, p: dict, diffs: list[dict]) -> None:
    node = deck.slides[deck.at(p["slide"])][0]
    deck.listing.remove(node)
    deck.listing.insert(p["to_index"], node)


def _delete_slide(deck: Deck, p: dict, diffs: list[dict]) -> None:
    node, part = deck.slides[deck.at(p["slide"])]
    for kind, target in deck.relations(part).values():
        if kind in ("notesSlide", "comments"):
            deck.remove(target)
    deck.remove(part)
    deck.unrelate(deck.main, node.get(R + "id"))
    deck.listing.remove(node)


def _add_slide(deck: Deck, p: dict, diffs: list[dict]) -> None:
    if not deck.slides:
        raise NotWritable("there is no slide whose layout could be used")
    after = deck.at(p["after"]) if p.get("after") else len(deck.slides) - 1
    beside = deck.slides[after][1]
    part = next(n for k in range(1, len(deck.names) + 2) if (n := f"{posixpath.dirname(beside)}/slide{k}.xml") not in deck.names)
    root = ET.Element(P + "sld")
    tree = ET.SubElement(ET.SubElement(root, P + "cSld"), P + "spTree")
    about = ET.SubElement(tree, P + "nvGrpSpPr")
    ET.SubElement(about, P + "cNvPr", {"id": "1", "name": ""})
    ET.SubElement(about, P + "cNvGrpSpPr")
    ET.SubElement(about, P + "nvPr")
    ET.SubElement(tree, P + "grpSpPr")
    deck.add(part, root, "application/vnd.openxmlformats-officedocument.presentationml.slide+xml")
    for kind, target in deck.relations(beside).values():
        if kind == "slideLayout":
            deck.relate(part, kind, target)
    rid = deck.relate(deck.main, "slide", part)
    deck.listing.insert(after + 1, ET.Element(P + "sldId", {"id": str(max([int(n.get("id", 255)) for n in deck.listing], default=255) + 1), R + "id": rid}))


PPTX: dict[str, Callable[[Deck, dict, list[dict]], None]] = {
    "set_table_cell_text": lambda deck, p, diffs: set_lines(deck.cell(p).find(A + "txBody"), p["text"]),
    "set_table_cell_bold": _looks("cell", lambda props, p: props.set("b", "1" if p["bold"] else "0")),
    "set_table_cell_italic": _looks("cell", lambda props, p: props.set("i", "1" if p["italic"] else "0")),
    "set_notes_text": _notes,
    "add_slide": _add_slide,
    "delete_slide": _delete_slide,
    "move_slide": _move_slide,
    "add_textbox": _add_textbox,
    "delete_shape": _delete_shape,
    "rename_shape": lambda deck, p, diffs: next(deck.shape(p).iter(P + "cNvPr")).set("name", p["name"]),
    "set_shape_bold": _looks("shape", lambda props, p: props.set("b", "1" if p["bold"] else "0")),
    "set_shape_italic": _looks("shape", lambda props, p: props.set("i", "1" if p["italic"] else "0")),
    "set_shape_underline": _looks("shape", lambda props, p: props.set("u", "sng" if p["underline"] else "none")),
    "set_shape_strikethrough": _looks("shape", lambda props, p: props.set("strike", "sngStrike" if p["strikethrough"] else "noStrike")),
    "set_shape_font_size": _looks("shape", lambda props, p: switch(props, "sz", str(round(p["size_pt"] * 100)) if p.get("size_pt") else None)),
    "set_shape_vert_align": _looks("shape", lambda props, p: switch(props, "baseline", {"superscript": "30000", "subscript": "-25000"}.get(p.get("vert_align")))),
    "set_shape_caps": _looks("shape", lambda props, p: switch(props, "cap", p.get("caps"))),
    "set_shape_font_name": _looks("shape", lambda props, p: mark(props, A + "latin", DRAWING_RUN_ORDER, {"typeface": p["font"]} if p.get("font") else None)),
    "set_shape_font_color": _looks("shape", _color("solidFill")),
    "set_shape_highlight": _looks("shape", _color("highlight")),
    "set_shape_hyperlink": _shape_link,
    "set_shape_bullet": _bullet,
}

KINDS: dict[str, tuple[type[Package], dict]] = {"xlsx": (Book, XLSX), "docx": (Document, DOCX), "pptx": (Deck, PPTX)}


def rewrite(fmt: str, blob: bytes, kind: str, payload: dict, diffs: list[dict]) -> bytes:
    """The package after one edit of a kind in ``KINDS``."""
    opened, kinds = KINDS[fmt]
    package = opened(blob)
    kinds[kind](package, payload, diffs)
    return package.written()
