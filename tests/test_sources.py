import io
import zipfile
import zlib

import pytest

from quirelake.sources import files, office, packages, pdf

SP = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
WP = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
PP = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def rels(*pairs):
    inner = "".join(f'<Relationship Id="rId{i + 1}" Type="{KIND}{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(pairs))
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 2, 3, 4, 6)), text, zipfile.ZIP_STORED if name.endswith(".png") else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def workbook():
    return package({
        "_rels/.rels": rels(("officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'<workbook {SP}><sheets><sheet name="Inputs" sheetId="1" r:id="rId1"/><sheet name="It\'s" sheetId="2" state="hidden" r:id="rId2"/></sheets><definedNames><definedName name="TaxRate">Inputs!$B$1</definedName><definedName name="_xlnm.Print_Area">Inputs!$A$1</definedName></definedNames></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("worksheet", "worksheets/sheet1.xml"), ("worksheet", "/xl/worksheets/sheet2.xml"), ("sharedStrings", "sharedStrings.xml"), ("styles", "styles.xml")),
        "xl/sharedStrings.xml": f"<sst {SP}><si><t>Month</t></si><si><r><t>Amo</t></r><r><t>unt</t></r><rPh><t>x</t></rPh></si></sst>",
        "xl/styles.xml": f'<styleSheet {SP}><numFmts><numFmt numFmtId="164" formatCode="$#,##0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {SP}><sheetViews><sheetView zoomScale="90" showGridLines="0"><pane topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="3"><c r="A3" s="1"><v>45292.5</v></c><c r="B3" s="2"><v>100</v></c><c r="C3"><f t="shared" si="0" ref="C3:C4">B3*TaxRate</f></c><c r="D3" t="b"><v>1</v></c></row><row r="4"><c r="C4"><f t="shared" si="0"/><v>2.5</v></c><c r="E4" t="inlineStr"><is><t>in</t></is></c><c r="F4" t="e"><v>#DIV/0!</v></c><c r="G4"/></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": rels(("comments", "../comments1.xml")),
        "xl/comments1.xml": f'<comments {SP}><authors><author>Ada</author></authors><commentList><comment ref="B3" authorId="0"><text><t>why</t></text></comment></commentList></comments>',
        "xl/worksheets/sheet2.xml": f"<worksheet {SP}><sheetData/></worksheet>",
        "xl/media/image1.png": b"\x89PNG" + bytes(300),
    })


def document():
    p = lambda t, extra="", run="": f"<w:p><w:pPr>{extra}</w:pPr>{run}<w:r><w:t>{t}</w:t></w:r></w:p>"
    return package({
        "_rels/.rels": rels(("officeDocument", "word/document.xml")),
        "word/document.xml": f'<w:document {WP}><w:body>{p("Title", "<w:pStyle w:val=" + chr(34) + "Heading1" + chr(34) + "/>")}{p("", run="<w:ins><w:r><w:t>new</w:t></w:r></w:ins>")}<w:tbl><w:tr><w:tc>{p("cell")}</w:tc></w:tr></w:tbl>{p("last")}</w:body></w:document>',
        "word/_rels/document.xml.rels": rels(("header", "header1.xml"), ("comments", "comments.xml")),
        "word/header1.xml": f"<w:hdr {WP}>{p('head')}</w:hdr>",
        "word/comments.xml": f'<w:comments {WP}><w:comment w:id="0" w:author="Bo"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:comment></w:comments>',
    })


def deck():
    sp = lambda name, text: f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="{name}"/></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    table = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="4" name="Table 1"/></p:nvGraphicFramePr><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:rPr b="1"/><a:t>x</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>'
    return package({
        "_rels/.rels": rels(("officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f'<p:presentation {PP}><p:sldIdLst><p:sldId id="256" r:id="rId2"/><p:sldId id="257" r:id="rId1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("slide", "slides/slide1.xml"), ("slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": f"<p:sld {PP}>{sp('Title 1', 'One')}</p:sld>",
        "ppt/slides/slide2.xml": f"<p:sld {PP}>{sp('KPI', 'Rate 10%')}{table}</p:sld>",
        "ppt/slides/_rels/slide2.xml.rels": rels(("notesSlide", "../notesSlides/notesSlide1.xml")),
        "ppt/notesSlides/notesSlide1.xml": f'<p:notes {PP}><p:sp><p:nvSpPr><p:cNvPr id="3" name="n"/><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>say it</a:t></a:r></a:p></p:txBody></p:sp></p:notes>',
    })


def form(extra_root="", stream=b"BT (Hel) Tj [(lo) -200 (wor) 10 (ld)] TJ 0 -14 Td (two) Tj T* <00410042> Tj ET"):
    squeezed = zlib.compress(stream)
    objects = [
        f"<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [5 0 R 7 0 R] >> {extra_root} >>".encode(),
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Rotate 90 >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Annots [6 0 R 9 0 R] >>",
        b"<< /Length " + str(len(squeezed)).encode() + b" /Filter /FlateDecode >>\nstream\n" + squeezed + b"\nendstream",
        b"<< /T (form) /FT /Tx /Kids [8 0 R] >>",
        b"<< /Subtype /Text /Contents (a \\(note\\) \\101) /T (Ada) >>",
        b"<< /T (Agree) /FT /Btn /V /Yes /AP << /N << /Yes 4 0 R /Off 4 0 R >> >> >>",
        b"<< /T (Name) /V <FEFF0041> /Ff 3 /MaxLen 20 >>",
        b"<< /Subtype /Widget >>",
        b"<< /Title (Intake) /Author (Bo) >>",
    ]
    out = bytearray(b"%PDF-1.7\n")
    for i, o in enumerate(objects):
        out += f"{i + 1} 0 obj\n".encode() + o + b"\nendobj\n"
    return bytes(out + b"trailer << /Root 1 0 R /Info 10 0 R >>\n%%EOF")


def test_packages_are_byte_exact():
    for blob in (workbook(), document(), deck(), b"", b"not a zip", workbook()[:-30]):
        parts = packages.explode(blob)
        assert packages.implode([p for *_, p in parts], packages.digest(blob)) == blob
    with pytest.raises(ValueError):
        packages.implode([b"x"], packages.digest(b"y"))


def test_splice_copies_all_other_entries():
    blob = workbook()
    new = packages.splice(blob, {"xl/sharedStrings.xml": b"<sst/>", "xl/new.xml": b"<n/>", "xl/comments1.xml": None})
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert z.testzip() is None and z.read("xl/sharedStrings.xml") == b"<sst/>" and z.read("xl/new.xml") == b"<n/>" and "xl/comments1.xml" not in z.namelist()
    before = {e.name: (e.header, e.data) for e in packages.entries(blob)[0]}
    after = {e.name: (e.header, e.data) for e in packages.entries(new)[0]}
    assert {n for n in before if after.get(n) != before[n]} == {"xl/sharedStrings.xml", "xl/comments1.xml"}
    assert packages.splice(blob, {}) == blob


def test_workbook():
    got = office.parse_xlsx(workbook())
    cells = {c["address"]: c for c in got["cells"]}
    assert [cells[a]["v_str"] for a in ("A1", "B1", "E4", "F4")] == ["Month", "Amount", "in", "#DIV/0!"]
    assert cells["A3"]["kind"] == "datetime" and cells["A3"]["v_str"] == "2024-01-01T12:00:00"
    assert cells["B3"]["number_format"] == "$#,##0.00" and cells["B3"]["style_id"] == "2" and cells["D3"]["v_bool"] is True
    assert (cells["C3"]["kind"], cells["C3"]["formula"], cells["C4"]["formula"], cells["C4"]["v_num"]) == ("empty", "=B3*TaxRate", "=B4*TaxRate", 2.5)
    assert got["features"] == [{"sheet": "Inputs", "feature": "shared_formula"}]
    first, second = got["sheets"]
    assert (first["rows"], first["cols"], first["merges"], first["freeze_panes"], first["zoom"], first["show_gridlines"]) == (4, 6, ["A1:B1"], "A2", 90, False) and second["hidden"]
    assert [n["name"] for n in got["named_ranges"]] == ["TaxRate"] and got["annotations"][0]["text"] == "why" and [s["style_id"] for s in got["styles"]] == ["1", "2"]


def test_document_and_deck():
    got = office.parse_docx(document())
    assert [(p["idx"], p["text"], p["editable"], p["in_table"]) for p in got["paragraphs"]] == [(0, "Title", True, False), (1, "new", False, False), (2, "cell", True, True), (3, "last", True, False)]
    assert got["story_paragraphs"][0]["story"] == "header" and got["annotations"][0]["author"] == "Bo"
    got = office.parse_pptx(deck())
    assert [(s["name"], s["part_name"], s["notes"]) for s in got["slides"]] == [("Slide 1", "ppt/slides/slide2.xml", "say it"), ("Slide 2", "ppt/slides/slide1.xml", None)]
    assert [(s["slide"], s["name"], s["text"]) for s in got["shapes"]] == [("Slide 1", "KPI", "Rate 10%"), ("Slide 2", "Title 1", "One")] and got["slide_table_cells"][0]["bold"]


def test_pdf():
    got = pdf.parse_pdf(form())
    assert got["pages"] == [{"element_id": got["pages"][0]["element_id"], "number": 1, "text": "Hello world\ntwo\nAB", "rotate": 90}]
    fields = {f["name"]: f for f in got["fields"]}
    assert fields["form.Name"]["value"] == "A" and fields["form.Name"]["read_only"] and fields["form.Name"]["required"] and fields["form.Name"]["max_length"] == 20
    assert fields["Agree"]["value"] == "Yes" and fields["Agree"]["export_values"] == ["Yes", "Off"]
    assert [(a["kind"], a["text"]) for a in got["annotations"]] == [("comment", "a (note) A")]
    assert got["pdf_documents"][0]["title"] == "Intake" and not got["pdf_documents"][0]["signed"]
    assert pdf.parse_pdf(form("/Perms << /DocMDP 6 0 R >>"))["pdf_documents"][0]["signed"]
    assert pdf.parse_pdf(form().replace(b"/Info 10 0 R", b"/Encrypt 9 0 R"))["pdf_documents"][0]["encrypted"]


def test_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, blob in {"a/b.xlsx": workbook(), "c.docx": document(), "d.pptx": deck(), "e.pdf": form(), "bad.docx": b"PK\x03\x04zzz", "note.txt": b"hi"}.items():
        (tmp_path / name).write_bytes(blob)
    listed = files.list_files(spark, str(tmp_path))
    scanned = files.scan(files.with_format(listed)).cache()
    assert {(r.object_path, r.format_id) for r in scanned.select("object_path", "format_id").distinct().collect()} == {("a/b.xlsx", "xlsx"), ("c.docx", "docx"), ("d.pptx", "pptx"), ("e.pdf", "pdf"), ("bad.docx", "docx")}
    assert files.entity(scanned, "cells").where("formula is not null").count() == 2
    assert [r.object_path for r in files.entity(scanned, "errors").collect()] == ["bad.docx"]
    spark.dataSource.register(files.DocumentSource)
    again = spark.read.format("documents").option("path", str(tmp_path)).load()
    assert sorted(map(str, again.select("object_path", "entity", "fields").collect())) == sorted(map(str, scanned.select("object_path", "entity", "fields").collect()))
    slices = packages.explode_packages(listed, "object_path", "content")
    manifest, parts = packages.snapshot_tables(slices)
    assert parts.count() < manifest.count()
    back = packages.implode_packages(manifest, parts)
    assert back.where("intact").count() == 6 == listed.count()
    assert packages.snapshot_tables(slices, parts)[1].count() == 0


def test_outline_is_whole():
    n = 100_005
    items = "".join(f"{20 + i} 0 obj\n<< /Title (t{i}) /Next {20 + (i + 1) % n} 0 R >>\nendobj\n" for i in range(n))
    blob = form("/Outlines << /First 20 0 R >>").replace(b"trailer", items.encode() + b"trailer")
    assert pdf.parse_pdf(blob)["pdf_documents"][0]["outline"] == [f"t{i}" for i in range(n)]


def test_pdf_strings_without_an_operator():
    assert pdf.parse_pdf(form(stream=b"(loose) <414243> ( ) Xx"))["pages"][0]["text"] == "loose ABC"


def test_recipe_keys(spark):
    from quirelake.functions.recipes import recipe_key

    rows = [("s", "p", "1", "c", ["m"]), ("s", "p", "2", "c", ["m"]), ("s", "p", "1", "c", ["m", "n"]), ("s", "p", "1", "c", ["n", "m"]), ("x", "p", "1", "c", ["m"]), ("s", "q", "1", "c", ["m"]), ("s", "p", "1", "d", ["m"]), (None, None, None, None, None), ("s", "p", "1", "c", ["m"])]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e array<string>")
    keys = [r.k for r in df.select(recipe_key(*[df[c] for c in "abcde"]).alias("k")).collect()]
    assert keys[0] == keys[-1] and len(set(keys)) == len(rows) - 1 and all(len(k) == 64 for k in keys)
