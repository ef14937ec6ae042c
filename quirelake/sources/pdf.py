"""PDF files as entities: pages with their text, form fields, annotations, outline and document information.

A small reader: objects are found by scanning the file for their marks (later ones win, so updates count), object
streams are opened, and strings, names, arrays and dictionaries are parsed. Content streams are read for the operators
that show text. Only the standard library is used; encrypted files give their stub and nothing else.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from quirelake.functions.ids import element_id_of

_TOKEN = re.compile(rb"""[\x00\t\n\x0c\r ]*(?:%[^\r\n]*[\x00\t\n\x0c\r ]*)*(?:(?P<ref>(\d+)[ \r\n]+(\d+)[ \r\n]+R(?![A-Za-z]))|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<name>/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<open><<|\[)|(?P<close>>>|\])|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<text>\()|(?P<word>[A-Za-z'"*]+\d?|[{}]))""")
_OBJECT = re.compile(rb"(?<![0-9])(\d+)[ \r\n]+(\d+)[ \r\n]+obj\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """A reference to an object by its number."""


class Name(str):
    """A name; its text is without the slash."""


class Word(str):
    """An operator or keyword."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string whose bracket was just read: nested brackets, escapes, octal digits."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            m = re.match(rb"[0-7]{1,3}", data[at : at + 3])
            if m:
                out.append(int(m.group(), 8) & 255)
                at += m.end()
                continue
            at += 1
            if e == b"\r":
                at += data[at : at + 1] == b"\n"
            elif e != b"\n":
                out += _ESCAPES.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if depth == 0:
            break
        out += c
    return bytes(out), at


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values and marks in order, each with the place behind it."""
    while m := _TOKEN.match(data, at):
        at = m.end()
        kind = m.lastgroup if m.lastgroup in ("num", "name", "open", "close", "hex", "text", "word") else "ref"
        raw = m.group(kind)
        if kind == "ref":
            yield Ref(int(m.group(2))), at
        elif kind == "num":
            yield float(raw) if b"." in raw else int(raw), at
        elif kind == "name":
            yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h.group(1), 16)]), raw[1:]).decode("latin-1")), at
        elif kind == "hex":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
        elif kind == "text":
            value, at = _string(data, at)
            yield value, at
        else:
            yield Word(raw.decode()), at


def parse_value(data: bytes, at: int = 0) -> tuple[object, int]:
    """One value (dictionaries and arrays whole), and the place behind it."""
    stack: list[list] = []
    for token, at in tokens(data, at):
        if isinstance(token, Word) and token in ("<<", "["):
            stack.append([token])
            continue
        if isinstance(token, Word) and token in (">>", "]"):
            if not stack:
                break
            first, *items = stack.pop()
            token = items if first == "[" else {str(k): v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)}
        elif isinstance(token, Word):
            token = {"true": True, "false": False, "null": None}.get(str(token), token)
            if isinstance(token, Word) and not stack:
                return None, at
        if not stack:
            return token, at
        stack[-1].append(token)
    return None, at


class Pdf:
    def __init__(self, blob: bytes) -> None:
        if b"%PDF-" not in blob[:1024]:
            raise ValueError("no PDF")
        self.blob = blob
        self.places = {int(m.group(1)): m.end() for m in _OBJECT.finditer(blob)}
        self.known: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        self.trailer: dict = {}
        for m in re.finditer(rb"\btrailer\b", blob):
            value, _ = parse_value(blob, m.end())
            if isinstance(value, dict):
                self.trailer |= value
        for number in list(self.places):
            value = self.get(Ref(number))
            if isinstance(value, dict) and value.get("Type") == "XRef":
                self.trailer = {k: v for k, v in value.items() if k in ("Root", "Info", "Encrypt", "ID")} | self.trailer
            elif isinstance(value, dict) and value.get("Type") == "ObjStm" and "Encrypt" not in self.trailer:
                self._open(number, value)
        if "Root" not in self.trailer:
            root = next((n for n, v in self.known.items() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
            if root is not None:
                self.trailer["Root"] = Ref(root)
        self.encrypted = "Encrypt" in self.trailer

    def _open(self, number: int, head: dict) -> None:
        data = self.stream(Ref(number))
        first, count = self.get(head.get("First")) or 0, self.get(head.get("N")) or 0
        pairs = [int(x) for x in data[:first].split()[: 2 * count]]
        for inner, offset in zip(pairs[::2], pairs[1::2]):
            if inner not in self.places:
                self.known[inner] = parse_value(data, first + offset)[0]

    def get(self, value: object) -> object:
        seen = 0
        while isinstance(value, Ref) and seen < 50:
            number = int(value)
            if number not in self.known:
                at = self.places.get(number)
                self.known[number] = parse_value(self.blob, at)[0] if at is not None else None
            value = self.known[number]
            seen += 1
        return value

    def stream(self, ref: object) -> bytes:
        """The decoded bytes of a stream object; unknown filters give nothing."""
        if not isinstance(ref, Ref) or int(ref) not in self.places:
            return b""
        head, at = parse_value(self.blob, self.places[int(ref)])
        m = re.compile(rb"\s*stream\r?\n?").match(self.blob, at)
        if not isinstance(head, dict) or not m:
            return b""
        length = self.get(head.get("Length"))
        end = m.end() + length if isinstance(length, int) and re.match(rb"\s*endstream", self.blob[m.end() + length : m.end() + length + 20]) else self.blob.find(b"endstream", m.end())
        data = self.blob[m.end() : end if end >= 0 else len(self.blob)]
        filters = self.get(head.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if self.get(f) in ("FlateDecode", "Fl"):
                data = zlib.decompressobj().decompress(data)
                parms = self.get(head.get("DecodeParms"))
                parms = self.get(parms[0]) if isinstance(parms, list) and parms else parms
                if isinstance(parms, dict) and (self.get(parms.get("Predictor")) or 1) >= 10:
                    data = _unpredict(data, int(self.get(parms.get("Columns")) or 1))
            elif self.get(f) in ("ASCIIHexDecode", "AHx"):
                data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", data).decode())
            else:
                return b""
        return data

    def pages(self) -> list[tuple[object, dict]]:
        """(reference, page with what it inherits) in order."""
        root = self.get(self.trailer.get("Root"))
        out: list[tuple[object, dict]] = []
        stack = [(root.get("Pages") if isinstance(root, dict) else None, {})]
        seen: set[int] = set()
        while stack:
            ref, inherited = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or isinstance(ref, Ref) and int(ref) in seen:
                continue
            if isinstance(ref, Ref):
                seen.add(int(ref))
            kids = self.get(node.get("Kids"))
            own = inherited | {k: node[k] for k in ("Rotate", "Resources") if k in node}
            if isinstance(kids, list) and node.get("Type") != "Page":
                stack += [(k, own) for k in reversed(kids)]
            else:
                out.append((ref, own | node))
        return out


def _unpredict(data: bytes, columns: int) -> bytes:
    """Rows with PNG filters none, sub or up, as cross-reference and object streams use them."""
    out, before = bytearray(), bytes(columns)
    for i in range(0, len(data), columns + 1):
        kind, row = data[i], bytearray(data[i + 1 : i + 1 + columns])
        for k in range(len(row)):
            left = row[k - 1] if k else 0
            row[k] = (row[k] + (before[k] if kind == 2 else left if kind == 1 else 0)) & 255
        out += row
        before = bytes(row)
    return bytes(out)


def text_of(value: object) -> str | None:
    """A text string: UTF-16 with a mark, UTF-8 with a mark, else one byte a character."""
    if isinstance(value, bytes):
        if value[:2] in (b"\xfe\xff", b"\xff\xfe"):
            return value.decode("utf-16", "replace")
        return value[3:].decode("utf-8", "replace") if value[:3] == b"\xef\xbb\xbf" else value.decode("latin-1")
    return str(value) if isinstance(value, (Name, int, float)) and not isinstance(value, bool) else None


def _shown(value: bytes) -> str:
    """A string in a content stream: two bytes a character if it looks like that."""
    if len(value) >= 2 and len(value) % 2 == 0 and (value[:2] == b"\xfe\xff" or all(b == 0 for b in value[::2])):
        return value.decode("utf-16-be", "replace").lstrip("﻿")
    return value.decode("latin-1")


def content_text(data: bytes) -> str:
    """Text in the order it is shown. Moves of more than one unit down, and the operators for it, begin lines; wide kerning is a blank."""
    out: list[str] = []
    args: list[object] = []
    array: list[object] | None = None
    for token, _ in tokens(data):
        if isinstance(token, Word):
            if token == "[":
                array = []
            elif token == "]":
                args.append(array or [])
                array = None
            elif token in ("Td", "TD") and len(args) >= 2 and isinstance(args[-1], (int, float)) and args[-1] < -1 or token == "T*":
                out.append("\n")
            elif token in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
                out.append(("" if token == "Tj" else "\n") + _shown(args[-1]))
            elif token == "TJ" and args and isinstance(args[-1], list):
                out += [_shown(x) if isinstance(x, bytes) else " " if isinstance(x, (int, float)) and x <= -100 else "" for x in args[-1]]
            if token not in ("[", "]"):
                args = []
        elif array is not None:
            array.append(token)
        else:
            args.append(token)
    lines = [line.rstrip() for line in "".join(out).split("\n")]
    return "\n".join(line for line in lines if line.strip())


def literal_text(data: bytes) -> str:
    """The strings of a content stream that shows none of them by an operator, in order and with a blank between."""
    found = (_shown(t).strip() for t, _ in tokens(data) if isinstance(t, bytes))
    return " ".join(t for t in found if t)


#: Bits of the field flags, counted from one.
FLAGS = {"read_only": 1, "required": 2, "no_export": 3, "multiline": 13, "password": 14, "combo": 18, "edit": 19, "do_not_spell_check": 23, "do_not_scroll": 24, "comb": 25, "rich_text": 26, "multi_select": 22}


def _fields(pdf: Pdf, root: dict) -> Iterator[dict]:
    form = pdf.get(root.get("AcroForm"))
    top = pdf.get(form.get("Fields")) if isinstance(form, dict) else None
    stack = [(ref, "", {}) for ref in reversed(top)] if isinstance(top, list) else []
    while stack:
        ref, above, inherited = stack.pop()
        node = pdf.get(ref)
        if not isinstance(node, dict):
            continue
        own = inherited | {k: node[k] for k in ("FT", "V", "Ff", "MaxLen", "Opt") if k in node}
        part = text_of(pdf.get(node.get("T")))
        name = above if part is None else f"{above}.{part}" if above else part
        kids = pdf.get(node.get("Kids"))
        named = [k for k in kids if isinstance(pdf.get(k), dict) and "T" in pdf.get(k)] if isinstance(kids, list) else []
        if named:
            stack += [(k, name, own) for k in reversed(named)]
            continue
        states: list[str] = []
        for widget in [node, *(pdf.get(k) for k in kids or [])]:
            looks = pdf.get(widget.get("AP")) if isinstance(widget, dict) else None
            normal = pdf.get(looks.get("N")) if isinstance(looks, dict) else None
            states += [k for k in normal if k not in states] if isinstance(normal, dict) and "Length" not in normal else []
        kind = {"Tx": "tx", "Ch": "ch", "Btn": "btn", "Sig": "sig"}.get(str(pdf.get(own.get("FT"))), "unknown")
        options = [text_of(pdf.get(o[0] if isinstance(o, list) and o else o)) for o in (pdf.get(x) for x in pdf.get(own.get("Opt")) or [])]
        bits = pdf.get(own.get("Ff")) or 0
        value = pdf.get(own.get("V"))
        value = text_of(pdf.get(value[0])) if isinstance(value, list) and value else text_of(value)
        length = pdf.get(own.get("MaxLen"))
        yield {"element_id": element_id_of("field", name), "name": name, "field_type": kind, "value": value, "export_values": states, "options": [o for o in options if o is not None], "page": None, "max_length": length if isinstance(length, int) else None} | {f: bool(bits >> (b - 1) & 1) for f, b in FLAGS.items()}


def parse_pdf(blob: bytes) -> dict[str, list[dict]]:
    pdf = Pdf(blob)
    root = pdf.get(pdf.trailer.get("Root"))
    root = root if isinstance(root, dict) else {}
    out: dict[str, list[dict]] = {k: [] for k in ("pdf_documents", "pages", "fields", "annotations")}
    if pdf.encrypted:
        out["pdf_documents"].append({"encrypted": True, "signed": False, "title": None, "author": None, "subject": None, "outline": []})
        return out
    for i, (_, page) in enumerate(pdf.pages()):
        contents = page.get("Contents")
        parts = pdf.get(contents)
        refs = parts if isinstance(parts, list) else [contents]
        rotate = pdf.get(page.get("Rotate")) or 0
        data = b"\n".join(pdf.stream(r) for r in refs)
        out["pages"].append({"element_id": element_id_of("page", i + 1), "number": i + 1, "text": content_text(data) or literal_text(data), "rotate": int(rotate) % 360 or None})
        for k, a in enumerate(pdf.get(page.get("Annots")) or []):
            note = pdf.get(a)
            subtype = str(note.get("Subtype")) if isinstance(note, dict) else ""
            if subtype in ("Text", "FreeText", "Stamp"):
                key = int(a) if isinstance(a, Ref) else f"{i + 1}.{k}"
                kind = "picture" if subtype == "Stamp" else "comment"
                out["annotations"].append({"kind": kind, "container": str(i + 1), "anchor": subtype, "author": text_of(pdf.get(note.get("T"))), "text": text_of(pdf.get(note.get("Contents"))), "element_id": element_id_of(kind, key)})
    out["fields"] = list(_fields(pdf, root))
    info = pdf.get(pdf.trailer.get("Info"))
    info = info if isinstance(info, dict) else {}
    titles, node, seen = [], pdf.get(root.get("Outlines")), set()
    stack = [node.get("First")] if isinstance(node, dict) else []
    while stack:
        ref = stack.pop()
        if isinstance(ref, Ref):  # only references can lead back
            if ref in seen:
                continue
            seen.add(ref)
        item = pdf.get(ref)
        if isinstance(item, dict):
            titles.append(text_of(pdf.get(item.get("Title"))) or "")
            stack += [item[k] for k in ("Next", "First") if k in item]
    signed = "Perms" in root or any(f["field_type"] == "sig" and f["value"] is not None for f in out["fields"]) or any(f["field_type"] == "sig" for f in out["fields"])
    out["pdf_documents"].append({"encrypted": False, "signed": signed, "outline": titles, **{k.lower(): text_of(pdf.get(info.get(k))) for k in ("Title", "Author", "Subject")}})
    return out
