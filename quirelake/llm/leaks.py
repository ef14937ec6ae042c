"""Evaluation texts that leaked into training text.

Texts are brought to the form the eye reads (``looks``), cut into words (runs of letters and digits, without case), and
each word is replaced by its template: a typed placeholder for numbers, cell addresses, names and units, else itself.
Windows of twelve templates are hashed; windows of the corpus are hash-joined with those of the items, and the slots
behind the placeholders are compared: all equal is a passage that leaked as it is. Windows that follow each other are one
passage; a consistent one-to-one replacement along a passage of ``REPARAMETERISED_WORDS`` words or more, of which each
window holds ``LITERAL_WORDS`` words that are no placeholders, is a re-parameterised item. Each passage is judged by itself.

The items are the stated query set. Up to ``BLOCK_WORDS`` words of them go to every task, and the corpus is read once and
never shuffled. More of them stay where they are: a filter of fixed size over the hashes of their windows goes to every
task instead, and the windows of the corpus that it holds are joined with theirs on the hash; the result is the same.

Defined cases: null texts and items match nothing; items under twelve words match nothing; an item matches a document
once however often it occurs; repeated items each match; extra columns are ignored; ids may be of any type, and null.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from quirelake.llm.encoding import FILTER_BITS, repeated_filter
from quirelake.llm.looks import look_form

WINDOW = 12
#: Words of a window that are no placeholders, for it to count as re-parameterised; what is equal as it is needs none.
LITERAL_WORDS = 6
#: Words of a passage that counts as re-parameterised: two sentences of one pattern share twelve templates by chance.
REPARAMETERISED_WORDS = 16
#: Words of items sent to the tasks at once: about 100 MB.
BLOCK_WORDS = 400_000
#: Documents are handled in slices of about so many code points, so that a batch of long texts stays small.
SLICE_CHARS = 1_000_000

_WORD = re.compile("[^\\W_][^\\W_̀-ͯ]*(?:[̀-ͯ]+[^\\W_]*)*")
_CELL = re.compile(r"[a-z]{1,3}\d{1,7}")
#: Units and currencies.
UNITS = frozenset("eur usd gbp chf k m kg km cm mm t l h min pct percent".split())
#: The months in four languages, look-alike form and case folded.
MONTHS = frozenset(
    "january february march april may june july august september october november december janvier février mars avril mai juin juillet août septembre octobre novembre décembre "
    "januar februar märz juni juli oktober dezember enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Words as the eye reads them, without case."""
    folded = look_form(text).casefold()
    return _WORD.findall(folded if folded.isascii() else look_form(folded))


def template_of(word: str, names: frozenset[str]) -> str:
    """The placeholder of a word that is a number, cell, unit or name; the word itself otherwise."""
    if word.isdigit():
        return "<number>"
    if _CELL.fullmatch(word):
        return "<cell>"
    if word in UNITS:
        return "<unit>"
    if word in MONTHS:
        return "<month>"
    return "<name>" if word in names else word


def known_names(items: Iterable[tuple[str, str]], parts: Iterable[str]) -> frozenset[str]:
    """Parts of names, and words written with a capital inside sentences in items of more than one language."""
    seen: dict[str, set[str]] = defaultdict(set)
    small: set[str] = set()
    for lang, text in items:
        for m in re.finditer(r"(?<=[\w,;] )(\w+)", look_form(text)):
            word = m.group(1)
            if word[:1].isupper() and word[1:].islower():
                seen[word.casefold()].add(lang)
            elif word.islower():
                small.add(word)
    found = {w for w, langs in seen.items() if len(langs) > 1} - small - MONTHS
    return frozenset(found | {w for p in parts for w in words_of(p)})


def _rolled(values: np.ndarray) -> np.ndarray:
    """A hash of each window of WINDOW values; wraps around at 64 bits."""
    n = len(values) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            out += values[j : j + n] * factor
            factor = factor * _STEP
    return out


class Matcher:
    """One block of items, ready to be searched in documents."""

    def __init__(self, items: list[tuple[list, list[str]]], names: frozenset[str]) -> None:
        self.items, self.names = items, names
        self.code: dict[str, int] = {}
        self.hashes: list[int] = []
        at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, words) in enumerate(items):
            for pos, h in enumerate(_rolled(self.values(words)).tolist()):
                at[h].append((k, pos))
        self.at = dict(at)
        self.sorted = np.array(sorted(self.at), np.uint64)

    def codes(self, words: list[str]) -> np.ndarray:
        code, hashes, names = self.code, self.hashes, self.names
        if len(code) > 500_000:  # rare words of a long task; the cache starts again
            code.clear()
            hashes.clear()
        get = code.get
        out = [get(w) for w in words]
        for i in [i for i, c in enumerate(out) if c is None]:
            w = words[i]
            c = get(w)
            if c is None:
                c = code[w] = len(hashes)
                hashes.append(xxh64_intdigest(template_of(w, names)))
            out[i] = c
        return np.array(out, np.int64)

    def values(self, words: list[str]) -> np.ndarray:
        codes = self.codes(words)
        return np.array(self.hashes, np.uint64)[codes] if len(codes) else np.empty(0, np.uint64)

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, str, int, int]]:
        """(text number, item number, kind, windows, first word) of each item found in each text."""
        split = [words_of(t) for t in texts]
        starts = np.cumsum([0, *map(len, split)])
        flat = [w for ws in split for w in ws]
        rolled = _rolled(self.values(flat))
        if not len(rolled) or not len(self.sorted):
            return
        place = np.minimum(np.searchsorted(self.sorted, rolled), len(self.sorted) - 1)
        hits = np.flatnonzero(self.sorted[place] == rolled)
        if not len(hits):
            return
        text = np.searchsorted(starts, hits, side="right") - 1
        hits, text = hits[hits + WINDOW <= starts[text + 1]], text[hits + WINDOW <= starts[text + 1]]
        lines: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        for h, t in zip(hits.tolist(), text.tolist()):
            for k, pos in self.at[int(rolled[h])]:
                lines[t, k, h - pos].append(pos)
        found: dict[tuple[int, int], list] = {}
        for (t, k, shift), positions in lines.items():
            item = self.items[k][1]
            for kind, passage in self._passages(item, flat, shift, positions):
                first = shift + passage[0] - int(starts[t])
                best = found.setdefault((t, k), [kind, 0, first])
                if kind == "verbatim" and best[0] != kind:
                    best[:] = [kind, 0, first]
                if kind == best[0]:
                    best[1] += len(passage)
                    best[2] = min(best[2], first)
        for (t, k), (kind, n, first) in found.items():
            yield t, k, kind, n, first

    def _passages(self, item: list[str], flat: list[str], shift: int, positions: list[int]) -> Iterator[tuple[str, list[int]]]:
        for p, n in _runs(positions):
            words = n + WINDOW - 1
            for kind, at in judged(item[p : p + words], flat[shift + p : shift + p + words], self.names):
                yield kind, [p + k for k in at]


def _runs(positions: list[int]) -> Iterator[tuple[int, int]]:
    """(first, how many) of positions that follow each other; a passage is made of such windows."""
    first, n = None, 0
    for p in positions:
        if first is not None and p == first + n:
            n += 1
        elif first is None or p != first + n - 1:
            if n:
                yield first, n
            first, n = p, 1
    if n:
        yield first, n


def judged(item: list[str], text: list[str], names: frozenset[str]) -> Iterator[tuple[str, list[int]]]:
    """(kind, windows) of a passage, by what stands behind its placeholders in the item and in the text; nothing if they disagree."""
    windows = range(len(item) - WINDOW + 1)
    same = [q for q in windows if item[q : q + WINDOW] == text[q : q + WINDOW]]
    if same:
        yield "verbatim", same
    elif len(item) >= REPARAMETERISED_WORDS and _consistent(item, text, names):
        yield "re-parameterised", list(windows)


def _consistent(item: list[str], text: list[str], names: frozenset[str]) -> bool:
    there: dict[tuple[str, str], str] = {}
    back: dict[tuple[str, str], str] = {}
    literal = []
    for a, b in zip(item, text):
        kind = template_of(a, names)
        literal.append(kind == a)
        if kind != template_of(b, names) or there.setdefault((kind, a), b) != b or back.setdefault((kind, b), a) != a:
            return False
    return all(sum(literal[i : i + WINDOW]) >= LITERAL_WORDS for i in range(len(item) - WINDOW + 1))


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, lang: str, parts: DataFrame, part: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, leak_kind, windows, first_word) of each document and item that share a window of templates."""
    rows = [tuple(r) for r in items.where(F.col(item_text).isNotNull()).select(item_id, lang, item_text).orderBy(item_id, item_text).toLocalIterator()]
    names = known_names([(r[1] or "", r[2]) for r in rows], [r[0] for r in parts.where(F.col(part).isNotNull()).select(part).toLocalIterator()])
    alike: dict[tuple[str, ...], list] = {}  # items that are repeated are searched once
    for key, _, item in rows:
        words = tuple(words_of(item))
        if len(words) >= WINDOW:
            alike.setdefault(words, []).append(key)
    kinds = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", items.schema[item_id].dataType), T.StructField("leak_kind", T.StringType()),
        T.StructField("windows", T.IntegerType()), T.StructField("first_word", T.IntegerType()),
    ])
    context = docs.sparkSession.sparkContext
    if sum(map(len, alike)) > block_words:
        return _joined(docs.where(F.col(text) != "").select(doc_id, text), items.where(F.col(item_text) != "").select(item_id, item_text), context.broadcast(names), kinds)
    sent = context.broadcast(([(keys, list(words)) for words, keys in alike.items()], names))
    return docs.where(F.col(text) != "").select(doc_id, text).mapInArrow(_searcher(sent, kinds), kinds)


def _hashed(words: list[str], names: frozenset[str]) -> np.ndarray:
    return _rolled(np.array([xxh64_intdigest(template_of(w, names)) for w in words], np.uint64))


def _joined(docs: DataFrame, items: DataFrame, names, kinds: T.StructType) -> DataFrame:
    """The same as the search in blocks, by a join of windows on their hash; pairs of document and item are judged where they meet."""
    item_kind, doc_kind = items.schema[0].dataType, docs.schema[0].dataType
    items = items.select(F.monotonically_increasing_id().alias("item"), F.col(items.columns[0]).alias("item_id"), F.col(items.columns[1]).alias("text"))
    docs = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(docs.columns[0]).alias("doc_id"), F.col(docs.columns[1]).alias("text"))
    digest_schema = T.StructType([T.StructField("digests", T.ArrayType(T.BinaryType()))])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[int(h).to_bytes(8, "little") * 2 for h in _hashed(words_of(t), names.value)] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary()))], names=["digests"])

    held = docs.sparkSession.sparkContext.broadcast(repeated_filter(items.select("text").mapInArrow(digests, digest_schema), "digests", FILTER_BITS, 1))

    def windows(filtered: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, code, at, said = [], [], [], []
                for i, t in enumerate(batch.column(2)):
                    words = words_of(t.as_py())
                    hashes = _hashed(words, names.value)
                    places = np.arange(len(hashes))
                    if filtered and len(hashes):
                        bit = (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                        places = np.flatnonzero(held.value[bit >> 3] >> (bit & 7) & 1)
                    for p in places.tolist():
                        row.append(i)
                        code.append(int(hashes[p].astype(np.int64)))
                        at.append(p)
                        said.append(" ".join(words[p : p + WINDOW]))
                if row:
                    take = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(code, pa.int64()), pa.array(at, pa.int32()), pa.array(said, pa.string())], names=["row", "key", "hash", "at", "said"])

        return run

    schema = lambda kind: T.StructType([T.StructField("row", T.LongType()), T.StructField("key", kind), T.StructField("hash", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("said", T.StringType())])
    theirs = items.mapInArrow(windows(False), schema(item_kind)).select(F.col("row").alias("item"), F.col("key").alias("item_id"), "hash", F.col("at").alias("item_at"), F.col("said").alias("item_said"))
    ours = docs.mapInArrow(windows(True), schema(doc_kind)).select(F.col("row").alias("doc"), F.col("key").alias("doc_id"), "hash", F.col("at").alias("doc_at"), F.col("said").alias("doc_said"))
    met = ours.join(theirs, "hash").groupBy("doc", "item").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.sort_array(F.collect_list(F.struct((F.col("doc_at") - F.col("item_at")).alias("shift"), "item_at", "item_said", "doc_said"))).alias("found"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i, found in enumerate(batch.column(2).to_pylist()):
                best = _best(found, names.value)
                if best:
                    row.append(i)
                    out.append(best)
            if row:
                take = pa.array(row, pa.int64())
                kind, n, first = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(kind, pa.string()), pa.array(n, pa.int32()), pa.array(first, pa.int32())], names=kinds.names)

    return met.select("doc_id", "item_id", "found").mapInArrow(judge, kinds)


def _best(found: list[dict], names: frozenset[str]) -> tuple[str, int, int] | None:
    """(kind, windows, first word) of one document and item, from their common windows by line and place."""
    lines: dict[int, dict[int, tuple[str, str]]] = defaultdict(dict)
    for x in found:
        lines[x["shift"]][x["item_at"]] = (x["item_said"], x["doc_said"])
    best: list | None = None
    for shift, at in lines.items():
        for p, n in _runs(sorted(at)):
            passage = [[w for k in range(p, p + n - 1) for w in at[k][side].split(" ")[:1]] + at[p + n - 1][side].split(" ") for side in (0, 1)]
            for kind, hits in judged(*passage, names):
                first = shift + p + hits[0]
                if best is None or kind == "verbatim" and best[0] != kind:
                    best = [kind, 0, first]
                if kind == best[0]:
                    best[1] += len(hits)
                    best[2] = min(best[2], first)
    return tuple(best) if best else None


def _searcher(sent, kinds: T.StructType):
    item_type = to_arrow_type(kinds["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*sent.value)
        for batch in batches:
            rows: list[tuple] = []
            texts, first, weight = [], 0, 0
            for i, value in enumerate(batch.column(1)):
                t = value.as_py()
                texts.append(t)
                weight += len(t)
                if weight >= SLICE_CHARS or i == batch.num_rows - 1:
                    rows += [(first + a, key, *rest) for a, k, *rest in matcher.search(texts) for key in matcher.items[k][0]]
                    texts, first, weight = [], i + 1, 0
            if rows:
                doc, item, kind, n, start = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(item, item_type), pa.array(kind, pa.string()), pa.array(n, pa.int32()), pa.array(start, pa.int32())],
                    names=kinds.names,
                )

    return run
