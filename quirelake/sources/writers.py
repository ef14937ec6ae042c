"""Writing edits back into files: only the parts that change are made anew, all other bytes are copied.

What can be written back: cells and formulas of spreadsheets, texts of paragraphs and shapes, what ``markup`` knows of
structure and looks, values and flags of form fields, turned pages, notes and descriptions of PDF files, and whole
earlier states. After cells change, what was calculated from formulas is no longer true: their values and the
calculation chain are dropped, and the file asks to be calculated when it is opened.
"""

from __future__ import annotations

import io
import json
import os
import re
import tempfile
import zipfile
from xml.etree import ElementTree as ET

from quirelake.sources import markup
from quirelake.sources import office as of
from quirelake.sources.markup import NotWritable, cell_of, dump, listed_paragraphs, load, set_lines, set_runs
from quirelake.sources.packages import splice
from quirelake.sources.pdf import FLAGS, Name, Pdf, Ref


def _fill(cell: ET.Element, value: dict) -> None:
    style = cell.get("s")
    address = cell.get("r")
    cell.clear()
    cell.set("r", address)
    if style:
        cell.set("s", style)
    if value.get("formula"):
        ET.SubElement(cell, of.S + "f").text = value["formula"].lstrip("=")
    elif value["kind"] == "float":
        number = value["v_num"]
        ET.SubElement(cell, of.S + "v").text = str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)
    elif value["kind"] == "boolean":
        cell.set("t", "b")
        ET.SubElement(cell, of.S + "v").text = "1" if value["v_bool"] else "0"
    elif value["kind"] == "string":
        cell.set("t", "inlineStr")
        t = ET.SubElement(ET.SubElement(cell, of.S + "is"), of.S + "t")
        t.text = value["v_str"]
        t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def patch_xlsx(blob: bytes, cells: dict[tuple[str, str], dict]) -> bytes:
    """Cells by (sheet, address) with kind, values and formula as in the entity table."""
    changes: dict[str, bytes | None] = {}
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        book_part = of._first(z, "", "officeDocument") or "xl/workbook.xml"
        rels = of._relations(z, book_part)
        book = load(z.read(book_part))
        sheets = {n.get("name"): rels[n.get(of.R + "id")][1] for n in book.iter(of.S + "sheet")}
        for name, part in sheets.items():
            raw = z.read(part)
            mine = {a: v for (s, a), v in cells.items() if s == name}
            if not mine and b"<f" not in raw and b":f" not in raw:
                continue
            root = load(raw)
            data = root.find(of.S + "sheetData")
            for c in data.iter(of.S + "c"):
                if c.find(of.S + "f") is not None:
                    for v in c.findall(of.S + "v"):
                        c.remove(v)
                    c.attrib.pop("t", None)
            for address, value in mine.items():
                _fill(cell_of(data, address), value)
            changes[part] = dump(root)
        calc = book.find(of.S + "calcPr")
        if calc is None:
            calc = ET.SubElement(book, of.S + "calcPr")
        calc.set("fullCalcOnLoad", "1")
        calc.set("forceFullCalc", "1")
        changes[book_part] = dump(book)
        chain = next((p for k, p in rels.values() if k == "calcChain"), None)
        if chain:
            folder, _, base = book_part.rpartition("/")
            part = f"{folder}/_rels/{base}.rels"
            root = load(z.read(part))
            for rel in list(root):
                if rel.get("Type", "").endswith("/calcChain"):
                    root.remove(rel)
            changes |= {part: dump(root), chain: None}
            if "[Content_Types].xml" in z.namelist():
                types = load(z.read("[Content_Types].xml"))
                for t in list(types):
                    if t.get("PartName") == "/" + chain:
                        types.remove(t)
                changes["[Content_Types].xml"] = dump(types)
    return splice(blob, changes)


def patch_docx(blob: bytes, texts: dict[int, str]) -> bytes:
    """New texts of paragraphs by index."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        main = of._first(z, "", "officeDocument") or "word/document.xml"
        root = load(z.read(main))
    listed = listed_paragraphs(root.find(of.W + "body"))
    for index, text in texts.items():
        if index >= len(listed):
            raise NotWritable(f"no paragraph {index}")
        set_runs(listed[index], text, of.W + "r", of.W + "t", of.W + "rPr")
    return splice(blob, {main: dump(root)})


def patch_pptx(blob: bytes, texts: dict[tuple[str, str], str]) -> bytes:
    """New texts of shapes by (slide name, shape name); lines become paragraphs."""
    changes: dict[str, bytes | None] = {}
    slides = {s["name"]: s["part_name"] for s in of.parse_pptx(blob)["slides"]}
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        for slide in {s for s, _ in texts}:
            root = load(z.read(slides[slide]))
            for sp in root.iter(of.P + "sp"):
                name = next((n.get("name", "") for n in sp.iter(of.P + "cNvPr")), "")
                body = sp.find(of.P + "txBody")
                if (slide, name) not in texts or body is None:
                    continue
                set_lines(body, texts[slide, name])
            changes[slides[slide]] = dump(root)
    return splice(blob, changes)


def _written(value: object) -> bytes:
    """A PDF value as bytes."""
    if isinstance(value, Ref):
        return b"%d 0 R" % int(value)
    if isinstance(value, Name):
        return b"/" + re.sub(rb"[^A-Za-z0-9_.+-]", lambda m: b"#%02X" % m.group()[0], value.encode("latin-1", "replace"))
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if value is None:
        return b"null"
    if isinstance(value, dict):
        return b"<< " + b" ".join(_written(Name(k)) + b" " + _written(v) for k, v in value.items()) + b" >>"
    if isinstance(value, list):
        return b"[" + b" ".join(map(_written, value)) + b"]"
    if isinstance(value, bytes):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, str):
        return b"<" + (b"\xfe\xff" + value.encode("utf-16-be")).hex().encode() + b">"
    return str(value).encode()


def patch_pdf(blob: bytes, fields: dict[str, dict]) -> bytes:
    """Values and flags of form fields by name, appended as an update: what was there stays as it is."""
    pdf = Pdf(blob)
    if pdf.encrypted:
        raise NotWritable("the file is encrypted")
    root = pdf.get(pdf.trailer["Root"])
    form = pdf.get(root.get("AcroForm")) or {}
    new: dict[int, dict] = {}
    found: set[str] = set()
    stack = [(r, "") for r in pdf.get(form.get("Fields")) or []]
    while stack:
        ref, above = stack.pop()
        node = pdf.get(ref)
        part = pdf.get(node.get("T"))
        name = above if part is None else (f"{above}." if above else "") + (part.decode("latin-1") if part[:2] != b"\xfe\xff" else part.decode("utf-16"))
        kids = pdf.get(node.get("Kids")) or []
        stack += [(k, name) for k in kids if "T" in (pdf.get(k) or {})]
        if name in fields and isinstance(ref, Ref):
            changed = dict(node)
            for key, value in fields[name].items():
                if key == "value":
                    button = str(pdf.get(node.get("FT"))) == "Btn"
                    changed["V"] = Name(value) if button else value
                    if button:
                        changed["AS"] = Name(value)
                elif key in FLAGS:
                    bit = 1 << (FLAGS[key] - 1)
                    bits = pdf.get(node.get("Ff")) or 0
                    changed["Ff"] = (pdf.get(changed.get("Ff")) or bits) & ~bit | (bit if value else 0)
                elif key == "max_length":
                    changed.pop("MaxLen", None)
                    changed |= {"MaxLen": value} if value else {}
            new[int(ref)] = changed
            found.add(name)
    missing = set(fields) - found
    if missing:
        raise NotWritable(f"no field {sorted(missing)}")
    return _updated(pdf, blob, new)


def _updated(pdf: Pdf, blob: bytes, new: dict[int, dict], info: int | None = None) -> bytes:
    """The file with objects written behind it; what was there stays as it is."""
    out = bytearray(blob if blob.endswith(b"\n") else blob + b"\n")
    places = {}
    for number, value in new.items():
        places[number] = len(out)
        out += b"%d 0 obj\n" % number + _written(value) + b"\nendobj\n"
    at = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in sorted(places.items()))
    before = re.findall(rb"startxref\s+(\d+)", blob)
    trailer = {k: v for k, v in pdf.trailer.items() if k in ("Root", "Info", "ID")} | {"Size": max([*pdf.places, *new, 0]) + 1} | ({"Info": Ref(info)} if info else {}) | ({"Prev": int(before[-1])} if before else {})
    return bytes(out + b"trailer\n" + _written(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % at)


def patch_pdf_document(blob: bytes, kind: str, payload: dict) -> bytes:
    """A turned page, a note on a page, or the description of the file, appended as an update."""
    pdf = Pdf(blob)
    if pdf.encrypted:
        raise NotWritable("the file is encrypted")
    fresh = max([*pdf.places, 0]) + 1
    if kind in ("set_document_metadata", "clear_document_metadata"):
        ref = pdf.trailer.get("Info")
        known = dict(pdf.get(ref) or {}) if ref is not None else {}
        for key in ("title", "author", "subject"):
            if kind == "clear_document_metadata":
                known.pop(key.capitalize(), None)
            elif payload.get(key) is not None:
                known[key.capitalize()] = payload[key]
        at = int(ref) if isinstance(ref, Ref) else fresh
        return _updated(pdf, blob, {at: known}, at)
    pages = pdf.pages()
    if not 1 <= payload["page"] <= len(pages) or not isinstance(pages[payload["page"] - 1][0], Ref):
        raise NotWritable(f"no page {payload['page']}")
    ref = pages[payload["page"] - 1][0]
    page = dict(pdf.get(ref))
    if kind == "rotate_page":
        return _updated(pdf, blob, {int(ref): page | {"Rotate": payload["degrees"]}})
    note = {"Type": Name("Annot"), "Subtype": Name("Text"), "Rect": [36, 36, 56, 56], "Contents": payload["contents"], "P": ref} | ({"T": payload["author"]} if payload.get("author") else {})
    return _updated(pdf, blob, {fresh: note, int(ref): page | {"Annots": [*(pdf.get(page.get("Annots")) or []), Ref(fresh)]}})


#: Kinds of edits of PDF files that concern pages or the whole file.
PDF_DOCUMENT = frozenset({"set_document_metadata", "clear_document_metadata", "rotate_page", "insert_comment"})


def write_back(fmt: str, blob: bytes, diffs: list[dict], payload: dict | None = None) -> bytes:
    """The file with the differences an edit makes (rows of ``edits``: kind, target, before, after) written into it.

    ``payload`` is that of the edit; kinds that change structure or looks need it.
    """
    kind = diffs[0]["kind"]
    if fmt in markup.KINDS and kind in markup.KINDS[fmt][1] and payload is not None:
        return markup.rewrite(fmt, blob, kind, payload, diffs)
    if fmt == "pdf" and kind in PDF_DOCUMENT and payload is not None:
        return patch_pdf_document(blob, kind, payload)
    if fmt == "pdf" and any(d["change"] != "changed" for d in diffs):
        raise NotWritable("pictures are not written into PDF files")
    if fmt == "xlsx":
        if any(d["kind"] not in ("set_cell_value", "set_cell_formula", "set_range") for d in diffs):
            raise NotWritable("only cells are written back into spreadsheets")
        return patch_xlsx(blob, {tuple(d["target"].rsplit("!", 1)): json.loads(d["after"]) for d in diffs})
    texts = [(d["target"], json.loads(d["after"]).get("text")) for d in diffs] if fmt in ("docx", "pptx") else []
    if fmt in ("docx", "pptx") and any(set(json.loads(d["after"])) != {"text"} or d["change"] != "changed" for d in diffs):
        raise NotWritable("only texts are written back")
    if fmt == "docx":
        return patch_docx(blob, {int(t): text for t, text in texts})
    if fmt == "pptx":
        names = {s["name"].lower(): s["name"] for s in of.parse_pptx(blob)["slides"]}
        full = lambda s: names.get(s.lower()) or names[f"slide {re.search(r'[0-9]+$', s).group()}"]
        return patch_pptx(blob, {(full(t.split("/", 1)[0]), t.split("/", 1)[1]): text for t, text in texts})
    return patch_pdf(blob, {d["target"]: json.loads(d["after"]) for d in diffs})


def replace_file(path: str, blob: bytes) -> None:
    """Put new bytes in the place of a file at once: written beside it, flushed, then renamed."""
    folder = os.path.dirname(path) or "."
    handle, beside = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "wb") as out:
        out.write(blob)
        out.flush()
        os.fsync(out.fileno())
    os.replace(beside, path)


__all__ = ["NotWritable", "patch_docx", "patch_pdf", "patch_pdf_document", "patch_pptx", "patch_xlsx", "replace_file", "write_back"]
