import io
import zipfile

import pytest
from test_sources import deck, document, form, workbook

from quirelake.plans.engine import Workspace, WorkspaceError
from quirelake.sources import office, packages, pdf, writers


@pytest.fixture
def ws(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, blob in {"a/b.xlsx": workbook(), "c.docx": document(), "d.pptx": deck(), "e.pdf": form()}.items():
        (tmp_path / name).write_bytes(blob)
    w = Workspace(spark, str(tmp_path))
    with pytest.raises(WorkspaceError, match="workspace_not_initialized"):
        w.status()
    w.init()
    return w


def test_reads_search_and_status(ws, tmp_path):
    assert ws.refresh() == 4 and ws.refresh() == 0
    assert {r.path: r.state for r in ws.status().collect()} == dict.fromkeys(["a/b.xlsx", "c.docx", "d.pptx", "e.pdf"], "fresh_fast_path")
    assert "| Month | Amount |" in ws.read("a/b.xlsx", "sheet", "inputs").content
    assert ws.read("a/b.xlsx", "range", "Inputs!A1:B1").content.count("|") > 3 and "TaxRate = Inputs!$B$1" == ws.read("a/b.xlsx", "named_ranges").content
    assert ws.read("c.docx", "paragraphs", "2:9").content == "cell\nlast" and ws.read("c.docx", "headers").content == "head"
    assert ws.read("d.pptx", "notes", "1").content == "say it" and "Rate 10%" in ws.read("d.pptx", "slide", "slide1").content
    assert ws.read("e.pdf", "page", "1").content == "Hello world\ntwo\nAB" and '"Agree"' in ws.read("e.pdf", "field", "Agree").content
    for path, kind, value, code in [("c.docx", "paragraphs", "9:10", "format_error"), ("c.docx", "slide", "1", "unsupported_capability"), ("../x", None, None, "invalid_source_path"), ("e.pdf", "page", "7", "format_error")]:
        with pytest.raises(WorkspaceError) as error:
            ws.read(path, kind, value)
        assert error.value.code == code
    whole, cursor, parts = ws.read("c.docx").content, None, []
    while True:
        got = ws.read("c.docx", max_tokens=2, cursor=cursor)
        parts.append(got.content)
        cursor = got.cursor
        if cursor is None:
            break
    assert "".join(parts) == whole and len(parts) > 1
    assert ws.read("c.docx").content == whole and ws.table("access_log").where("view_cache_hit").count() == 1
    hits = ws.search("rate 10%").collect()
    assert {(h.path, h.source) for h in hits} == {("d.pptx", "model"), ("d.pptx", "view")} and hits[0].hit_no == 1
    assert ws.search("Month", "*.docx").count() == 0
    assert ws.inspect("a/b.xlsx")["sheets"][0]["formula_count"] == 2 and ws.inspect("c.docx")["headings"] == [(0, "Title")]
    assert ws.inspect("d.pptx")["slides"][0]["shapes"] == 1 and ws.inspect("e.pdf")["title"] == "Intake"
    assert {r.name for r in ws.deps("a/b.xlsx", "Inputs", "C3").collect()} | {None} == {None} and ws.deps("a/b.xlsx", "Inputs", "B3", "reverse").count() == 1
    assert ws.metrics()["source_bytes"] > 0 and ws.capabilities("pdf").count() == 22
    (tmp_path / "c.docx").unlink()
    assert {r.path: r.state for r in ws.status().collect()}["c.docx"] == "missing"


def test_edit_apply_history_revert(ws, tmp_path):
    original = (tmp_path / "c.docx").read_bytes()
    diffs = ws.edit("c.docx", "set_paragraph_text", {"index": 3, "text": "final "}, "t1")
    assert diffs[0]["target"] == "3" and (tmp_path / "c.docx").read_bytes() == original
    assert ws.edit("c.docx", "set_paragraph_text", {"text": "final ", "index": 3}, "t1") == diffs
    with pytest.raises(WorkspaceError, match="staged_conflict"):
        ws.edit("c.docx", "set_paragraph_text", {"index": 3, "text": "other"}, "t1")
    with pytest.raises(WorkspaceError, match="stale_source"):
        ws.edit("c.docx", "set_paragraph_text", {"index": 3, "text": "x"}, "t9", expected_hash="0")
    with pytest.raises(WorkspaceError, match="format_error"):
        ws.edit("c.docx", "set_paragraph_text", {"index": 1, "text": "x"}, "t9")
    ws.edit("c.docx", "replace_paragraph_text", {"index": 0, "find": "Title", "replace": "Head"}, "t2")
    assert [r.tx_id for r in ws.staged("c.docx").collect()] == ["t1", "t2"]
    assert ws.apply_all("c.docx") == [1, 2] and ws.apply("c.docx", "t1") == 1
    assert [p["text"] for p in office.parse_docx((tmp_path / "c.docx").read_bytes())["paragraphs"]] == ["Head", "new", "cell", "final "]
    before = {e.name: e.data for e in packages.entries(original)[0]}
    after = {e.name: e.data for e in packages.entries((tmp_path / "c.docx").read_bytes())[0]}
    assert {n for n in before if before[n] != after[n]} == {"word/document.xml"}
    assert [r.version for r in ws.history("c.docx").collect()] == [1, 2] and ws.diff("c.docx", 2)[0]["target"] == "0"
    with pytest.raises(WorkspaceError, match="history_version_missing"):
        ws.diff("c.docx", 9)
    ws.revert("c.docx", 1, "t3")
    assert ws.apply("c.docx", "t3") == 3 and (tmp_path / "c.docx").read_bytes() == original and ws.history("c.docx").collect()[-1].revert_of == 1
    ws.edit("c.docx", "set_paragraph_text", {"index": 3, "text": "y"}, "t4")
    ws.discard("c.docx", "t4")
    with pytest.raises(WorkspaceError, match="staged_missing"):
        ws.apply("c.docx", "t4")
    assert ws.staged().count() == 0


def test_write_back_of_the_other_formats(ws, tmp_path):
    ws.edit("a/b.xlsx", "set_cell_value", {"sheet": "Inputs", "address": "B3", "value": "7", "value_kind": "float"}, "x1")
    ws.apply("a/b.xlsx", "x1")
    blob = (tmp_path / "a/b.xlsx").read_bytes()
    cells = {c["address"]: c for c in office.parse_xlsx(blob)["cells"]}
    assert cells["B3"]["v_num"] == 7 and cells["B3"]["style_id"] == "2" and cells["C4"]["kind"] == "empty" and cells["C4"]["formula"] == "=B4*TaxRate"
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        assert b"fullCalcOnLoad" in z.read("xl/workbook.xml")
    assert ws.history("a/b.xlsx").first().impact == '["Inputs!C3"]'
    ws.edit("d.pptx", "set_shape_text", {"slide": "1", "shape": "KPI", "text": "a\nb"}, "x2")
    ws.apply("d.pptx", "x2")
    assert office.parse_pptx((tmp_path / "d.pptx").read_bytes())["shapes"][0]["text"] == "a\nb"
    ws.edit("e.pdf", "set_form_field", {"name": "Agree", "value": "Off"}, "x3")
    ws.edit("e.pdf", "set_form_field_required", {"name": "Agree", "required": True}, "x4")
    assert ws.apply_all("e.pdf") == [1, 2]
    fields = {f["name"]: f for f in pdf.parse_pdf((tmp_path / "e.pdf").read_bytes())["fields"]}
    assert fields["Agree"]["value"] == "Off" and fields["Agree"]["required"] and fields["form.Name"]["value"] == "A"
    ws.edit("c.docx", "set_paragraph_bold", {"index": 0, "bold": True}, "x5")
    ws.edit("c.docx", "insert_paragraph", {"after": 0, "text": "second"}, "x6")
    assert ws.apply_all("c.docx") == [1, 2] and ws.read("c.docx", "paragraphs", "0:2").content == "Title\nsecond"
    ws.edit("c.docx", "insert_comment", {"index": 0, "text": "why"}, "x7")
    with pytest.raises(WorkspaceError, match="unsupported_capability"):
        ws.apply("c.docx", "x7")
    with pytest.raises(writers.NotWritable):
        writers.patch_pdf(form(), {"Nope": {"value": "x"}})


def test_command_line_and_close(ws, spark, tmp_path, capsys):
    import json

    from quirelake.__main__ import main

    call = lambda *a: (main(["--json", "--folder", str(tmp_path), *a], spark), json.loads((lambda o: o.out or o.err)(capsys.readouterr())))
    assert call("init")[1]["parsed"] == 4
    assert call("read", "c.docx", "--selector", "paragraphs", "0:1")[1]["content"] == "Title"
    code, answer = call("read", "nope.docx")
    assert code == 1 and answer["code"] == "invalid_source_path"
    assert call("edit", "c.docx", "set_paragraph_text", '{"index": 0, "text": "New"}', "--tx", "z1")[1]["tx_id"] == "z1"
    assert [r["tx_id"] for r in call("staged")[1]] == ["z1"]
    assert ws.close() == {} and call("history", "c.docx")[1][0]["tx_id"] == "z1" and call("diff", "c.docx", "1")[1][0]["target"] == "0"
    assert call("search", "New")[1] and call("viz")[1]["parts"] > 3 and ws.recover() == 0
    assert {r["path"] for r in call("status")[1]} == {"a/b.xlsx", "c.docx", "d.pptx", "e.pdf"}
