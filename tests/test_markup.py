"""Edits written into files: what changes is read back by the parsers, what does not is the same bytes."""

import io
import zipfile

import pytest
from test_sources import SP, deck, document, form, package, rels, workbook

from quirelake.operators import edits
from quirelake.sources import markup, office, packages, pdf, writers

S, W, A, P = markup.S, markup.W, markup.A, markup.P


def book():
    """Two plain sheets with formulas across them, widths, merges and names."""
    return package({
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/xl/worksheets/sheet1.xml" ContentType="x"/><Override PartName="/xl/calcChain.xml" ContentType="y"/></Types>',
        "_rels/.rels": rels(("officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'<workbook {SP}><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="Data" sheetId="1" r:id="rId1"/><sheet name="Sum up" sheetId="4" r:id="rId2"/></sheets><definedNames><definedName name="Rate">\'Sum up\'!$A$1</definedName><definedName name="_xlnm.Print_Area" localSheetId="1">\'Sum up\'!$A$1:$B$2</definedName></definedNames></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("worksheet", "worksheets/sheet1.xml"), ("worksheet", "worksheets/sheet2.xml"), ("styles", "styles.xml"), ("calcChain", "calcChain.xml")),
        "xl/calcChain.xml": "<calcChain/>",
        "xl/styles.xml": f'<styleSheet {SP}><fonts count="1"><font><sz val="11"/></font></fonts><cellXfs count="1"><xf numFmtId="0" fontId="0" fillId="0"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {SP}><dimension ref="A1:C3"/><cols><col min="1" max="3" width="9"/></cols><sheetData><row r="1" spans="1:3"><c r="A1"><v>1</v></c><c r="B1"><f>A1+A3</f><v>4</v></c></row><row r="3"><c r="A3"><v>3</v></c><c r="C3" t="inlineStr"><is><t>x</t></is></c></row></sheetData><mergeCells count="2"><mergeCell ref="A5:B6"/><mergeCell ref="A2:B2"/></mergeCells><pageMargins left="1" right="1" top="1" bottom="1" header="0.5" footer="0.5"/></worksheet>',
        "xl/worksheets/sheet2.xml": f"<worksheet {SP}><sheetData><row r=\"2\"><c r=\"A2\"><f>SUM(Data!A1:A3)+Rate</f><v>4</v></c></row></sheetData></worksheet>",
        "docProps/app.xml": "<Properties/>",
    })


def rewritten(fmt, blob, kind, target="", **payload):
    """The new file; entries of parts that did not change must be the same bytes."""
    out = markup.rewrite(fmt, blob, kind, payload, [{"kind": kind, "target": target}])
    with zipfile.ZipFile(io.BytesIO(out)) as new, zipfile.ZipFile(io.BytesIO(blob)) as old:
        assert new.testzip() is None
        same = [n for n in old.namelist() if n in new.namelist() and old.read(n) == new.read(n)]
    before = {e.name: e.header + e.data + e.trailer for e in packages.entries(blob)[0]}
    after = {e.name: e.header + e.data + e.trailer for e in packages.entries(out)[0]}
    assert all(before[n] == after[n] for n in same)
    return out


def part(blob, name):
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        return markup.load(z.read(name))


def test_sheet_properties_are_read_back():
    sheet = lambda blob: office.parse_xlsx(blob)["sheets"][0]
    base, on = book(), {"sheet": "data"}
    assert sheet(rewritten("xlsx", base, "freeze_panes", cell="B3", **on))["freeze_panes"] == "B3"
    assert sheet(rewritten("xlsx", rewritten("xlsx", base, "freeze_panes", cell="B3", **on), "freeze_panes", cell=None, **on))["freeze_panes"] is None
    assert sheet(rewritten("xlsx", base, "set_sheet_zoom", zoom=140, **on))["zoom"] == 140
    assert sheet(rewritten("xlsx", base, "set_show_gridlines", show=False, **on))["show_gridlines"] is False
    assert sheet(rewritten("xlsx", base, "set_right_to_left", rtl=True, **on))["right_to_left"] is True
    assert sheet(rewritten("xlsx", base, "set_tab_color", color="#ff8800", **on))["tab_color"] == "FFFF8800"
    assert sheet(rewritten("xlsx", base, "set_page_orientation", orientation="landscape", **on))["page_orientation"] == "landscape"
    assert sheet(rewritten("xlsx", base, "merge_cells", range="$C$1:d2", **on))["merges"] == ["A5:B6", "A2:B2", "C1:D2"]
    assert sheet(rewritten("xlsx", base, "unmerge_cells", range="a2:b2", **on))["merges"] == ["A5:B6"]
    assert sheet(rewritten("xlsx", base, "hide_sheet", hidden=True, **on))["hidden"] is True
    filtered = rewritten("xlsx", base, "set_auto_filter", range="A1:C3", **on)
    assert sheet(filtered)["auto_filter"] == "A1:C3" and b"Data'!$A$1:$C$3" in markup.dump(part(filtered, "xl/workbook.xml"))
    assert sheet(rewritten("xlsx", filtered, "set_auto_filter", range=None, **on))["auto_filter"] is None


def test_sheet_markup_is_in_order():
    blob = book()
    steps = {
        "set_column_width": {"column": "B", "width": 20.5}, "set_row_height": {"row": 2, "height": 30}, "set_paper_size": {"paper_size": 9}, "set_print_scale": {"scale": 80}, "set_fit_to_page": {"width": 1, "height": 0}, "set_center_on_page": {"horizontal": True, "vertical": False},
        "set_page_margins": {"left": 0.5, "right": 0.5, "top": 1, "bottom": 1}, "set_header_footer": {"header": "&CTop", "footer": None}, "set_print_titles": {"rows": "1:2", "cols": "A:B"}, "set_print_area": {"range": "A1:B9"}, "freeze_panes": {"cell": "A2"}, "set_tab_color": {"color": "00FF00"},
    }
    for kind, payload in steps.items():
        blob = rewritten("xlsx", blob, kind, sheet="Data", **payload)
    root = part(blob, "xl/worksheets/sheet1.xml")
    places = [markup.SHEET_ORDER.index(markup.local(n)) for n in root]
    assert places == sorted(places) and len(set(places)) == len(places)
    assert [(c.get("min"), c.get("max"), c.get("width")) for c in root.iter(S + "col")] == [("1", "1", "9"), ("2", "2", "20.5"), ("3", "3", "9")]
    assert [(r.get("r"), r.get("ht")) for r in root.iter(S + "row")] == [("1", None), ("2", "30"), ("3", None)]
    assert root.find(S + "pageSetup").attrib == {"paperSize": "9", "scale": "80", "fitToWidth": "1", "fitToHeight": "0"}
    assert root.find(S + "pageMargins").get("left") == "0.5" and root.find(S + "pageMargins").get("header") == "0.5" and root.find(S + "headerFooter")[0].text == "&CTop"
    names = {(n.get("name"), n.get("localSheetId")): n.text for n in part(blob, "xl/workbook.xml").iter(S + "definedName")}
    assert names["_xlnm.Print_Titles", "0"] == "'Data'!$A:$B,'Data'!$1:$2" and names["_xlnm.Print_Area", "0"] == "'Data'!$A$1:$B$9" and names["_xlnm.Print_Area", "1"]


def test_rows_and_columns_move_with_all_formulas():
    cells = lambda blob: {(c["sheet"], c["address"]): c["formula"] or c["v_num"] or c["v_str"] for c in office.parse_xlsx(blob)["cells"]}
    new = rewritten("xlsx", book(), "insert_row", sheet="data", at=2, count=2)
    assert cells(new) == {("Data", "A1"): 1, ("Data", "B1"): "=A1+A5", ("Data", "A5"): 3, ("Data", "C5"): "x", ("Sum up", "A2"): "=SUM(Data!A1:A5)+Rate"}
    assert office.parse_xlsx(new)["sheets"][0]["merges"] == ["A7:B8", "A4:B4"]
    assert "xl/calcChain.xml" not in zipfile.ZipFile(io.BytesIO(new)).namelist() and b"calcChain" not in markup.dump(part(new, "[Content_Types].xml")) + markup.dump(part(new, "xl/_rels/workbook.xml.rels"))
    new = rewritten("xlsx", book(), "delete_row", sheet="Data", at=3, count=1)
    assert cells(new) == {("Data", "A1"): 1, ("Data", "B1"): "=A1+#REF!", ("Sum up", "A2"): "=SUM(Data!A1:A2)+Rate"}
    new = rewritten("xlsx", book(), "insert_column", sheet="Data", at=1, count=1)
    assert cells(new)[("Data", "C1")] == "=B1+B3" and cells(new)[("Data", "D3")] == "x" and [(c.get("min"), c.get("max")) for c in part(new, "xl/worksheets/sheet1.xml").iter(S + "col")] == [("2", "4")]
    new = rewritten("xlsx", book(), "delete_column", sheet="Data", at=1, count=2)
    assert cells(new) == {("Data", "A3"): "x", ("Sum up", "A2"): "=SUM(#REF!)+Rate"} and office.parse_xlsx(new)["sheets"][0]["merges"] == []
    with pytest.raises(markup.NotWritable):
        rewritten("xlsx", workbook(), "insert_row", sheet="Inputs", at=1, count=1)  # its comments would not follow


def test_sheets_come_and_go():
    titles = lambda blob: [s["name"] for s in office.parse_xlsx(blob)["sheets"]]
    new = rewritten("xlsx", book(), "add_sheet", name="New", after="data")
    assert titles(new) == ["Data", "New", "Sum up"]
    assert [n.get("localSheetId") for n in part(new, "xl/workbook.xml").iter(S + "definedName")] == [None, "2"]
    assert titles(rewritten("xlsx", new, "add_sheet", name="Last")) == ["Data", "New", "Sum up", "Last"]
    new = rewritten("xlsx", book(), "rename_sheet", **{"from": "Data", "to": "It's"})
    assert titles(new) == ["It's", "Sum up"] and office.parse_xlsx(new)["cells"][-1]["formula"] == "=SUM('It''s'!A1:A3)+Rate"
    new = rewritten("xlsx", book(), "delete_sheet", name="data", dependency_policy="replace_references_with_ref_error")
    assert titles(new) == ["Sum up"] and office.parse_xlsx(new)["cells"][0]["formula"] == "=SUM(#REF!)+Rate" and "xl/worksheets/sheet1.xml" not in zipfile.ZipFile(io.BytesIO(new)).namelist()
    names = office.parse_xlsx(rewritten("xlsx", rewritten("xlsx", book(), "define_name", name="Top", formula="=Data!$A$1"), "delete_name", name="rate"))["named_ranges"]
    assert [(n["name"], n["formula"]) for n in names] == [("Top", "Data!$A$1")]


def test_cell_looks():
    new = rewritten("xlsx", rewritten("xlsx", book(), "set_cell_font", sheet="Data", address="a1", bold=True, size_pt=14, color="112233"), "set_cell_fill", sheet="Data", address="A1", color="ABCDEF")
    styles, cell = part(new, "xl/styles.xml"), next(part(new, "xl/worksheets/sheet1.xml").iter(S + "c"))
    xf = styles.find(S + "cellXfs")[int(cell.get("s"))]
    font, fill = styles.find(S + "fonts")[int(xf.get("fontId"))], styles.find(S + "fills")[int(xf.get("fillId"))]
    assert [(markup.local(n), *n.attrib.values()) for n in font] == [("b",), ("sz", "14"), ("color", "FF112233")]
    assert fill[0][0].get("rgb") == "FFABCDEF" and len(styles.find(S + "fills")) == 3 and len(styles.find(S + "fonts")[0]) == 1
    assert office.parse_xlsx(new)["cells"][0]["style_id"] == "2"


def test_documents():
    texts = lambda blob: [p["text"] for p in office.parse_docx(blob)["paragraphs"]]
    assert texts(rewritten("docx", document(), "insert_paragraph", after=2, text=" in the cell")) == ["Title", "new", "cell", " in the cell", "last"]
    assert texts(rewritten("docx", document(), "delete_paragraph", index=3)) == ["Title", "new", "cell"]
    with pytest.raises(markup.NotWritable):
        rewritten("docx", document(), "delete_paragraph", index=2)
    new = rewritten("docx", document(), "set_paragraph_style", index=3, style_id="Quote")
    assert office.parse_docx(new)["paragraphs"][3]["style_id"] == "Quote"
    for kind, payload in {
        "set_paragraph_bold": {"bold": True}, "set_paragraph_italic": {"italic": False}, "set_paragraph_underline": {"underline": True}, "set_paragraph_font_size": {"size_pt": 10.5}, "set_paragraph_font_name": {"font": "Arial"}, "set_paragraph_font_color": {"color": "#aa00bb"},
        "set_paragraph_highlight": {"color": "yellow"}, "set_paragraph_strikethrough": {"strikethrough": True}, "set_paragraph_vert_align": {"vert_align": "superscript"}, "set_paragraph_caps": {"caps": "small"}, "set_paragraph_alignment": {"alignment": "justify"}, "set_paragraph_spacing": {"before_pt": 6, "after_pt": None}, "insert_page_break": {},
    }.items():
        new = rewritten("docx", new, kind, index=3, **payload)
    last = markup.listed_paragraphs(part(new, "word/document.xml").find(W + "body"))[3]
    marks = {markup.local(n): n.get(W + "val") for n in next(last.iter(W + "rPr"))}
    assert marks == {"rFonts": None, "b": None, "bCs": None, "i": "0", "iCs": "0", "smallCaps": None, "strike": None, "color": "AA00BB", "sz": "21", "szCs": "21", "highlight": "yellow", "u": "single", "vertAlign": "superscript"}
    assert [markup.RUN_ORDER.index(k) for k in marks] == sorted(markup.RUN_ORDER.index(k) for k in marks)
    assert [markup.local(n) for n in last.find(W + "pPr")] == ["pStyle", "pageBreakBefore", "spacing", "jc"] and texts(new)[3] == "last"
    linked = rewritten("docx", new, "set_paragraph_hyperlink", index=3, url="https://example.org/")
    assert b"https://example.org/" in markup.dump(part(linked, "word/_rels/document.xml.rels")) and texts(linked)[3] == "last"
    assert not list(part(rewritten("docx", linked, "set_paragraph_hyperlink", index=3, url=None), "word/document.xml").iter(W + "hyperlink"))
    shaded = rewritten("docx", document(), "set_cell_shading", index=2, color="FFEEDD")
    assert next(part(shaded, "word/document.xml").iter(W + "shd")).get(W + "fill") == "FFEEDD"
    assert office.parse_docx(rewritten("docx", document(), "set_header_paragraph_text", part="header1", index=0, text="new head"))["story_paragraphs"][0]["text"] == "new head"


def test_presentations():
    base = deck()
    slides = lambda blob: [(s["notes"], [x["text"] for x in office.parse_pptx(blob)["shapes"] if x["slide"] == s["name"]]) for s in office.parse_pptx(blob)["slides"]]
    assert slides(base) == [("say it", ["Rate 10%"]), (None, ["One"])]
    assert slides(rewritten("pptx", base, "move_slide", slide="1", to_index=1)) == [(None, ["One"]), ("say it", ["Rate 10%"])]
    gone = rewritten("pptx", base, "delete_slide", slide="Slide 1")
    assert slides(gone) == [(None, ["One"])] and "ppt/notesSlides/notesSlide1.xml" not in zipfile.ZipFile(io.BytesIO(gone)).namelist()
    assert slides(rewritten("pptx", base, "add_slide", after="slide 1")) == [("say it", ["Rate 10%"]), (None, []), (None, ["One"])]
    assert slides(rewritten("pptx", base, "set_notes_text", slide="1", text="a\nb"))[0][0] == "a\nb"
    boxed = rewritten("pptx", base, "add_textbox", "Slide 2/TextBox 1", slide="2", text="hi")
    assert slides(boxed)[1] == (None, ["One", "hi"]) and office.parse_pptx(boxed)["shapes"][-1]["name"] == "TextBox 1"
    assert slides(rewritten("pptx", boxed, "delete_shape", slide="2", shape="TextBox 1")) == slides(base)
    kpi = next(s for s in office.parse_pptx(base)["shapes"] if s["name"] == "KPI")
    assert office.parse_pptx(rewritten("pptx", base, "rename_shape", slide="1", shape=kpi["element_id"], name="Key"))["shapes"][0]["name"] == "Key"
    new = base
    for kind, payload in {
        "set_shape_bold": {"bold": True}, "set_shape_italic": {"italic": True}, "set_shape_underline": {"underline": True}, "set_shape_strikethrough": {"strikethrough": True}, "set_shape_font_size": {"size_pt": 18}, "set_shape_font_name": {"font": "Arial"}, "set_shape_font_color": {"color": "#010203"}, "set_shape_highlight": {"color": "FFFF00"},
        "set_shape_vert_align": {"vert_align": "subscript"}, "set_shape_caps": {"caps": "all"}, "set_shape_bullet": {"bullet": True}, "set_shape_hyperlink": {"url": "https://example.org/"},
    }.items():
        new = rewritten("pptx", new, kind, slide="1", shape="KPI", **payload)
    props = next(part(new, "ppt/slides/slide2.xml").iter(A + "rPr"))
    assert {k: props.get(k) for k in ("b", "i", "u", "strike", "sz", "baseline", "cap")} == {"b": "1", "i": "1", "u": "sng", "strike": "sngStrike", "sz": "1800", "baseline": "-25000", "cap": "all"}
    assert [markup.local(n) for n in props] == ["solidFill", "highlight", "latin", "hlinkClick"] and next(part(new, "ppt/slides/slide2.xml").iter(A + "buChar")) is not None
    table = {"slide": "1", "table": "Table 1", "row": 0, "col": 0}
    new = rewritten("pptx", rewritten("pptx", rewritten("pptx", base, "set_table_cell_text", text="y", **table), "set_table_cell_bold", bold=False, **table), "set_table_cell_italic", italic=True, **table)
    cell = office.parse_pptx(new)["slide_table_cells"][0]
    assert (cell["text"], cell["bold"], cell["italic"]) == ("y", False, True)


def test_pdf_pages_and_description():
    write = lambda blob, kind, **p: writers.write_back("pdf", blob, [{"kind": kind, "target": "", "change": "changed", "after": "{}"}], p)
    base = form()
    new = write(write(base, "rotate_page", page=1, degrees=180), "insert_comment", page=1, contents="see (this)", author="Ed")
    assert new.startswith(base)
    rows = pdf.parse_pdf(new)
    assert rows["pages"][0]["rotate"] == 180 and rows["pages"][0]["text"] == pdf.parse_pdf(base)["pages"][0]["text"]
    assert ("see (this)", "Ed") in {(a["text"], a["author"]) for a in rows["annotations"]} and len(rows["annotations"]) == len(pdf.parse_pdf(base)["annotations"]) + 1
    described = pdf.parse_pdf(write(new, "set_document_metadata", title="Neü", author=None, subject="S"))["pdf_documents"][0]
    assert (described["title"], described["author"], described["subject"]) == ("Neü", "Bo", "S")
    cleared = pdf.parse_pdf(write(new, "clear_document_metadata"))["pdf_documents"][0]
    assert (cleared["title"], cleared["author"], cleared["subject"]) == (None, None, None)
    with pytest.raises(writers.NotWritable, match="Nope"):
        writers.patch_pdf(base, {"Agree": {"value": "Off"}, "Nope": {"value": "x"}})


def test_what_cannot_be_written_is_known():
    texts = {"xlsx": {"set_cell_formula", "set_cell_value", "set_range"}, "docx": {"replace_across_paragraphs", "replace_paragraph_text", "set_paragraph_text"}, "pptx": {"replace_across_shapes", "replace_shape_text", "set_shape_text"}}
    left = {(fmt, kind) for fmt, known in texts.items() for kind in set(edits.FORMATS[fmt]) - set(markup.KINDS[fmt][1]) - known}
    assert left == {(f, k) for f in texts for k in ("insert_comment", "insert_picture")} | {("docx", "set_paragraph_bullet")}
    assert all(set(kinds) <= set(edits.FORMATS[fmt]) for fmt, (_, kinds) in markup.KINDS.items())
