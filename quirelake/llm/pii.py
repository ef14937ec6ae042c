"""Personal data in free text: found by kind, and replaced by typed placeholders.

A linear-chain conditional random field over word shapes (``crf``), fitted on a small labelled table made by rule from
sentence patterns and the known parts of names (``pii_labels``; its size is the parameter ``rows``), proposes spans in
every text. An exact check of each proposal follows: an email, a number, an address or a name must have the form of its
kind around the proposed place, and its ends are set by that form (no title, label, extension, unit, postcode or town).

Defined cases: null and empty texts have nothing and stay as they are; a repeated value of a document comes out once; a
document that arrives twice gives its rows once; texts are handled whole, however long; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.crf import RAW, Crf, Features, tokenize
from quirelake.llm.pii_labels import DIAL_WORDS, ID_WORDS, OTHER_NUMBER_WORDS, STREET_WORDS, SUFFIXES, TITLE_WORDS, labelled_rows

KINDS = ["email", "phone", "id_number", "address", "name"]
LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
#: Rows of the labelled table.
LABELLED_ROWS = 10_000
#: Code points decoded at once in a task.
SLICE_CHARS = 400_000

#: Function words that begin or end no name.
_NO_NAME = frozenset("a an the after before because if in on of is was what does nothing cells range der die das dem den ein eine liegt nach für im bei zu la le les el los las un une une del du des tras si en para con por be been was were ser est sein please for by and or to with et und y lists wohnhaft welche which per regards owner signed".split())
#: Words before a place.
_BEFORE_PLACES = frozenset("at in near à en nach aus bei".split())
#: Particles that names are written with in small letters.
_PARTICLES = frozenset("de la van der den von du del di da le los y".split())

_LETTER = r"[^\W\d_]"
_NAME_WORD = rf"(?:{_LETTER}['’])?{_LETTER}+(?:['’-]{_LETTER}+)*"
_EMAIL = re.compile(
    r"[\w.+'-]*\w(?:@|\s?\(at\)\s?|\s?\[at\]\s?| @ | at )[a-z0-9-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?| dot )[a-z0-9-]+)*(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?| dot )[a-z]{2,}\b",
    re.I,
)
_PHONE = re.compile(r"(?<![\w+])(?:\+ ?|00 ?)?\(?\d{1,5}\)?(?:[  .\-/‐‑–]{0,2}\(?\d{1,8}\)?){1,7}(?!\w)")
_ID = re.compile(r"(?<![\w-])(?:[A-Z]{0,2}\d[A-Z\d]*(?:[  .‐‑-][A-Z\d]+)*)(?![\w-])", re.I)
#: How identity numbers are grouped where they are (social security, tax, and the fifteen digits of the NIR).
_ID_GROUPED = re.compile(r"(?<![\w.,-])(?:\d{3}[- ]\d{2}[- ]\d{4}|\d{2} \d{3} \d{3} \d{3}|\d \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?|\d{8}-[A-Z])(?![\w-]|[.,]\d)", re.I)
_ID_SURE = re.compile(r"(?<![\w.,-])(?:\d{3}([- ])\d{2}\1\d{4}|[12]\d{14}|[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2})(?![\w-]|[.,]\d)")
_PHONE_SURE = re.compile(r"(?<![\w.,-])(?:1\d{10}|\+\d{1,3}[  -]\(?\d[\d() ‑-]{7,13}\d|\(\d{3,4}\) \d{3}[ -]\d{4}|\d{3}([ .‑-])\d{3}\1\d{4})(?![\w-]|[.,]\d)")
_STREET_SURE = re.compile(rf"(?<!\w){_LETTER}{{3,}}(?:straße|strasse|str\.|gasse|weg|platz|allee) \d{{1,4}}(?: ?[a-z]\b|\b)", re.I)
#: Words that stand before a name, written with a capital at the start of a sentence.
_BEFORE_NAMES = frozenset("as and with by from to von par por et y und à an bei slide owner signed regards".split())
_GAP = r"(?:[ \t ]+|[ \t]*\r?\n)"
_NUMBER_FIRST = re.compile(rf"\d{{1,5}} ?[a-z]?(?:{_GAP}(?:bis|ter|quater)\b)?,?(?:{_GAP}(?:{_LETTER}['’])?{_LETTER}[\w'’-]*\.?){{1,6}}", re.I)
_NUMBER_LAST = re.compile(rf"{_LETTER}(?:[^\W\d]|['’.-])*(?:/)?(?:{_GAP}{_LETTER}(?:[^\W\d]|['’.-])*){{0,5}},?{_GAP}(?:(?:núm\.?|nº|no\.?|n°|nr\.?){_GAP}?)?\d{{1,5}}(?: ?[a-z]\b)?", re.I)


def letters_and_digits(text: str) -> str:
    return "".join(c for c in text if c.isalnum()).lower()


class Finder:
    """The fitted model with the exact checks; made on the driver, sent to the tasks."""

    def __init__(self, given: list[str], family: list[str], rows: int = LABELLED_ROWS, steps: int = 120, held: int | None = None) -> None:
        words = lambda parts: frozenset(w.casefold() for p in parts for w in re.findall(_LETTER + "+(?:['’]" + _LETTER + "+)*", p))
        self.given, self.family = words(given) - _PARTICLES, words(family) - _PARTICLES
        several = [f.casefold().split(" ") for f in family if " " in f]
        self.led = [(" ".join(f[:k]), f[k]) for f in several for k in range(1, len(f))]
        lexicon = {"given": self.given, "family": self.family, "street": STREET_WORDS, "title": TITLE_WORDS, "dial": DIAL_WORDS, "id": ID_WORDS, "number": OTHER_NUMBER_WORDS}
        texts = []
        for text, spans in labelled_rows(given, family, rows, held=held):
            keys, starts, ends = tokenize(text)
            if keys:
                texts.append((keys, self._numbers(starts, ends, spans)))
        self.crf = Crf(LABELS, Features(lexicon, SUFFIXES)).fit(texts, steps)
        self._scorer = None

    @staticmethod
    def _numbers(starts: list[int], ends: list[int], spans: list[tuple[int, int, str]]) -> list[int]:
        out, k = [0] * len(starts), 0
        for a, b, kind in sorted(spans):
            base, first = 1 + 2 * KINDS.index(kind), True
            while k < len(starts) and ends[k] <= a:
                k += 1
            while k < len(starts) and starts[k] < b:
                out[k] = base if first else base + 1
                first = False
                k += 1
        return out

    def __getstate__(self):
        return self.__dict__ | {"_scorer": None}

    def propose(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """The model's spans of each text."""
        if self._scorer is None:
            self._scorer = self.crf.scorer()
        tokens = [RAW.findall(t) for t in texts]
        out = []
        for raws, labels in zip(tokens, self._scorer.label(tokens)):
            spans: list[list] = []
            hits = labels.nonzero()[0].tolist()
            ends = np.cumsum([len(r) for r in raws]).tolist() if hits else []
            last = 0
            for i in hits:
                label = int(labels[i])
                kind, begins = KINDS[(label - 1) // 2], label % 2 == 1
                if spans and not begins and last == i - 1 and spans[-1][2] == kind:
                    spans[-1][1] = ends[i]
                else:
                    spans.append([ends[i] - len(raws[i].lstrip()), ends[i], kind])
                last = i
            out.append([tuple(s) for s in spans])
        return out

    def proposed(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """The model's spans without the checks, but for blanks and punctuation at their ends."""
        trim = lambda t, a, b: (a + len(t[a:b]) - len(t[a:b].lstrip(" \t\r\n.,;:|<>()")), a + len(t[a:b].rstrip(" \t\r\n,;:|<>(")))
        return [[(*trim(t, a, b), kind) for a, b, kind in spans] for t, spans in zip(texts, self.propose(texts))]

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """The checked spans of each text, in order and apart from each other."""
        out = []
        for text, spans in zip(texts, self.propose(texts)):
            done: list[tuple[int, int, str]] = []
            for a, b, kind in spans:
                hit = getattr(self, "_" + kind)(text, a, b)
                if not hit and kind != "name":  # the form may be that of another kind, where it leaves no doubt
                    grouped = self._around(_ID_SURE, text, a, b, 12)
                    if grouped:
                        hit, kind = grouped.span(), "id_number"
                    elif dialled := self._around(_PHONE_SURE, text, a, b, 12):
                        hit, kind = dialled.span(), "phone"
                    elif street := self._around(_STREET_SURE, text, a, b, 30):
                        hit, kind = street.span(), "address"
                if hit and text[hit[0] : hit[1]].strip():
                    done.append((*hit, kind))
            done.sort(key=lambda s: (s[0], -s[1]))
            kept: list[tuple[int, int, str]] = []
            for s in done:
                if not kept or s[0] >= kept[-1][1]:
                    kept.append(s)
            out.append(kept)
        return out

    # ---- the exact checks: the span as the form of its kind has it, or None

    @staticmethod
    def _around(pattern: re.Pattern, text: str, a: int, b: int, reach: int) -> re.Match | None:
        """The match that shares most with the proposal."""
        best, most = None, 0
        for m in pattern.finditer(text, max(0, a - reach), min(len(text), b + reach)):
            shared = min(m.end(), b) - max(m.start(), a)
            if shared > most:
                best, most = m, shared
        return best

    def _email(self, text: str, a: int, b: int):
        lo = text.rfind("\n", 0, a) + 1
        for m in _EMAIL.finditer(text, lo if a - lo < 400 else a - 80, min(len(text), b + 120)):
            if m.start() < b and m.end() > a:
                return m.span()
        return None

    def _phone(self, text: str, a: int, b: int):
        while a and text[a - 1] in "+(":
            a -= 1
        whole = self._around(_PHONE, text, a, b, 24)
        for m in (_PHONE.match(text, a), whole):
            if m and m.end() <= b + 2 and self._is_phone(m.group()):
                return m.span()
        part = text[a:b].rstrip(" .,;:|-/(")
        if self._is_phone(part):
            return a, a + len(part)
        return whole.span() if whole and self._is_phone(whole.group()) else None

    @staticmethod
    def _is_phone(part: str) -> bool:
        """Country or area code and number: 9 to 15 digits, grouped as numbers that are dialled."""
        groups = re.findall(r"\d+", part)
        n = sum(map(len, groups))
        if not 9 <= n <= 15 or re.search(_LETTER + r"|[\r\n]", part):
            return False
        if part.lstrip("( ").startswith(("+", "00")):
            return True
        lengths = [len(g) for g in groups]
        if n > 12 or lengths in ([3, 2, 4], [2, 3, 3, 3]) or len(lengths) > 5:
            return False
        return part[0] in "(01" or n == 10 or n == 9 and part[0] in "6789"

    def _id_number(self, text: str, a: int, b: int):
        if a > 1 and text[a - 1] == ":" and text[a - 2].isalnum():  # the end of a range of cells
            return None
        grouped = self._around(_ID_GROUPED, text, a, b, 24)
        if grouped:
            return grouped.span()
        part = text[a:b]
        m = re.match(r"[\W_]+", part)
        if m:
            a += m.end()
        while b > a and not text[b - 1].isalnum():
            b -= 1
        while b < len(text) and (text[b].isascii() and text[b].isalnum() or text[b] == "-" and text[b + 1 : b + 2].isalnum()):
            b += 1
        while a and text[a - 1].isascii() and text[a - 1].isalnum():
            a -= 1
        part = text[a:b]
        m = re.match(r"(?:[A-Za-z]{3,}[ .:]+)+", part)
        if m:
            a += m.end()
            part = text[a:b]
        digits, size = sum(c.isdigit() for c in part), sum(c.isalnum() for c in part)
        return (a, b) if digits >= 5 and 7 <= size <= 16 and _ID.fullmatch(part) else None

    def _address(self, text: str, a: int, b: int):
        part = text[a:b]
        if not re.search(r"\d", part):  # the number stands beside what was proposed
            m = re.search(r"(?:(?<=\s)|^)\d{1,5} ?[A-Za-z]?,?\s$", text[max(0, a - 8) : a])
            if m:
                a = max(0, a - 8) + m.start()
            else:
                m = re.match(r",?\s(?:núm\.?\s|nº\s)?\d{1,5}(?: ?[A-Za-z]\b)?", text[b : b + 16])
                if not m:
                    return None
                b += m.end()
            part = text[a:b]
        first = re.match(r"\W*", part).end()
        if part[first:first + 1].isdigit():
            m = _NUMBER_FIRST.match(text, a + first)
            if not m:
                return None
            end = min(m.end(), max(b, a + first + 1))
            while end < m.end() and re.search(r"(?:^|\s)(?:de|du|des|del|la|los|las|aux|of)$", text[a + first : end], re.I):  # a street does not end there
                step = re.match(r"\s+\S+", text[end : m.end()])
                end += step.end() if step else 0
                if not step:
                    break
            body = text[a + first : end]
        else:
            m = _NUMBER_LAST.match(text, a + first)
            if not m or m.end() < b - 3:
                hits = [x for x in _NUMBER_LAST.finditer(text, a + first, min(len(text), b + 12))]
                if not hits:
                    return None
                m = hits[0]
            end = m.end()
            body = text[m.start() : end]
            a, first = m.start(), 0
        body = body.rstrip(" \t\r\n,;:|")
        if re.search(rf"{_LETTER}{{3,}}", body) and re.search(r"\d", body) and body != body.lower():
            return a + first, a + first + len(body)
        return None

    def _name(self, text: str, a: int, b: int):
        m = re.match(r"[\W\d_]+", text[a:b])
        if m:
            a += m.end()
        while b > a and not text[b - 1].isalpha():
            b -= 1
        while True:  # titles are not part of a name
            m = re.match(rf"({_LETTER}+)\.?\s+", text[a:b])
            low = m.group(1).casefold() if m else ""
            rest = text[a + m.end() : b].split() if m else []
            lone = len(low) == 1 and (len(rest) < 2 or rest[0].strip(".,").casefold() in _PARTICLES)
            if m and (low in _BEFORE_NAMES and len(low) > 1 or low in TITLE_WORDS and not lone):
                a += m.end()
            else:
                break
        head = re.match(_NAME_WORD, text[a:b])
        for lead, word in self.led if head else ():  # families of several words, of which the model may leave the first
            if word == head.group().casefold() and text[max(0, a - len(lead) - 1) : a].casefold() == lead + " ":
                a -= len(lead) + 1
                break
        more = re.match(rf"(?:-{_LETTER}+)+", text[b : b + 40])  # a double name is whole
        b += more.end() if more else 0
        lead = re.match(rf"{_LETTER}+", text[a:b])
        if lead and lead.group().casefold() in _PARTICLES:  # what begins with a particle lacks its given name
            given = re.search(rf"(?<![\w'’-])({_NAME_WORD})(?: {_LETTER}\.)? $", text[max(0, a - 40) : a])
            if given and self._part(given.group(1)):
                a = max(0, a - 40) + given.start()
        if len(re.findall(_NAME_WORD, text[a:b])) == 1:
            after = re.match(rf"(?:,? (?:{_LETTER}\. )?)({_NAME_WORD})", text[b : b + 40])
            before = re.search(rf"({_NAME_WORD}|{_LETTER}\.),? $", text[max(0, a - 40) : a])
            if after and self._part(after.group(1)):
                b += after.end()
            elif before and (self._part(before.group(1)) or len(before.group(1)) == 2 and before.group(1)[1] == "."):
                a = max(0, a - 40) + before.start()
        words = re.findall(_NAME_WORD, text[a:b])
        if len(words) < 2 or len(words) > 6 or len(words[-1]) < 2 or re.search(r"[\r\n|;:]", text[a:b]):
            return None
        first, last = words[0], words[-1]
        before = re.search(rf"({_LETTER}+)[ \t]+$", text[max(0, a - 12) : a])
        if before and before.group(1).casefold() in _BEFORE_PLACES and not all(self._part(w) for w in words if len(w) > 1):
            return None
        if first.casefold() in _BEFORE_PLACES:
            return None
        if len(first) == 1 and first.isupper() and text[a + 1 : a + 2] == "." and last[:1].isupper():
            return a, b
        if first.casefold() in _NO_NAME - _PARTICLES or last.casefold() in _NO_NAME or first.islower() and len(first) == 1 and not last.islower():
            return None
        return a, b

    def _part(self, word: str) -> bool:
        low = word.casefold()
        return any(w in self.given or w in self.family for w in [low, *re.split("-", low)])


_FITTED: dict[tuple, Finder] = {}


def fitted(parts: DataFrame, part: str, kind: str, rows: int = LABELLED_ROWS) -> Finder:
    """The finder for a table of name parts; fitted once in a process for the same parts."""
    known = sorted((r[0], r[1] or "") for r in parts.where(F.col(part).isNotNull()).select(part, kind).distinct().toLocalIterator())
    key = (tuple(known), rows)
    if key not in _FITTED:
        _FITTED[key] = Finder([p for p, k in known if k == "given"], [p for p, k in known if k == "family"], rows)
    return _FITTED[key]


def _slices(values, limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    texts, first, weight = [], 0, 0
    for i, v in enumerate(values):
        t = v.as_py() or ""
        texts.append(t)
        weight += len(t)
        if weight >= limit or i == len(values) - 1:
            yield first, texts
            texts, first, weight = [], i + 1, 0


def find_pii(df: DataFrame, key: str, text: str, finder: Finder) -> DataFrame:
    """(key, pii_kind, start_at, end_at, pii_text, pii_key) of every case in every text."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("pii_kind", T.StringType()), T.StructField("start_at", T.IntegerType()), T.StructField("end_at", T.IntegerType()), T.StructField("pii_text", T.StringType()), T.StructField("pii_key", T.StringType())])
    sent = df.sparkSession.sparkContext.broadcast(finder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            rows = []
            for first, texts in _slices(batch.column(1)):
                for i, spans in enumerate(own.find(texts)):
                    rows += [(first + i, kind, a, b, texts[i][a:b]) for a, b, kind in spans]
            if rows:
                at, kind, a, b, value = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kind, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value, pa.string()), pa.array(map(letters_and_digits, value), pa.string())], names=schema.names)

    return df.where(F.col(text) != "").select(key, text).mapInArrow(run, schema)


def redact(df: DataFrame, key: str, text: str, finder: Finder) -> DataFrame:
    """(key, redacted): the texts with ``<EMAIL>``, ``<PHONE>`` and so on in place of the cases, the rest unchanged."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("redacted", T.StringType())])
    sent = df.sparkSession.sparkContext.broadcast(finder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            out: list[str | None] = []
            for _, texts in _slices(batch.column(1)):
                for t, spans in zip(texts, own.find(texts)):
                    parts, last = [], 0
                    for a, b, kind in spans:
                        parts += [t[last:a], f"<{kind.upper()}>"]
                        last = b
                    out.append("".join([*parts, t[last:]]))
            valid = [v if batch.column(1)[i].is_valid else None for i, v in enumerate(out)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(valid, pa.string())], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)
