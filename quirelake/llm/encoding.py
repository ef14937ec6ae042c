"""Encoding a corpus with a public tokenizer, chunks shared across documents encoded once.

A rolling hash over the code points cuts every text at content-defined places, so repeated passages give the same
chunks in all documents. Inside a chunk the text between its first and last anchor is encoded without its surroundings;
an anchor is a change from a non-blank to a blank character, which the tokenizer's pattern always splits at. The text
from the last anchor of one chunk to the first of the next is the join: it is encoded again as one piece, over as many
chunks as it takes to reach the next anchor, so the result agrees exactly with encoding the whole text.

Digests of bodies and joins are counted over the corpus. Those that occur more than once set bits of a filter of fixed
size (``FILTER_BITS``), which all tasks get. What the filter does not hold occurs once and is encoded where it stands;
what it holds is brought together by its digest, encoded once, and joined back into the documents it came from. A filter
that fills up, or a bit set by chance, sends more pieces that way and changes no result; texts without such a piece are
never shuffled.

Defined cases: null and empty texts have an empty list; texts without a blank are one join; repeated rows give repeated
results (ids are grouped by row, not by doc_id); extra columns are ignored; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.session import discard, durable

#: Chunks are about this many code points long, at least a quarter of it.
CHUNK_CHARS = 512
#: Bits of the filter of repeated digests: 8 MB in memory, whatever the corpus.
FILTER_BITS = 1 << 26
#: Texts are cut in batches of about so many code points.
SLICE_CHARS = 4_000_000
#: Where the vocabulary files are, and which one; both are parameters of ``encode_corpus``.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern the vocabulary's merges were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WINDOW = 16
#: Blanks that every regular expression engine takes for such; what comes before one may be no blank for any.
_BLANKS = " \t\n\r"
_ANCHOR = re.compile(r"(?<=\S)(?=[ \t\n\r])")


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def content_cuts(text: str, size: int = CHUNK_CHARS) -> list[int]:
    """Places where the rolling hash of the last 16 code points has its low bits zero; the same passage cuts alike."""
    n = len(text)
    if n <= size // 4:
        return []
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = points * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    width = 1
    while width < _WINDOW:
        h[width:] = h[width:] + h[:-width] * np.uint64(pow(0x100000001B3, width, 1 << 64))
        width *= 2
    hits = np.flatnonzero((h >> np.uint64(40)) & np.uint64(size - 1) == 0) + 1
    out, last = [], 0
    for at in hits.tolist():
        if at - last >= size // 4 and at < n:
            out.append(at)
            last = at
    return out


def units_of(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """The text as bodies of chunks and joins between them; each boundary is an anchor, so each is encoded by itself."""
    cuts = [0, *content_cuts(text, size), len(text)]
    bounds, done = [0], 0
    for a, b in zip(cuts, cuts[1:]):
        first = _ANCHOR.search(text, max(a, 1), b) if a else None
        start = first.start() if first and first.start() > a else None
        if a == 0:
            start = 0
        if start is None:
            continue
        end = next((i for i in range(b - 1, start, -1) if text[i] in _BLANKS and not text[i - 1].isspace()), None) if b < len(text) else len(text)
        if end is None or end <= start:
            continue
        for at in (start, end):
            if at > bounds[-1]:
                bounds.append(at)
        done = end
    if bounds[-1] < len(text):
        bounds.append(len(text))
    return [text[x:y] for x, y in zip(bounds, bounds[1:])]


def _digest(unit: str) -> bytes:
    return hashlib.blake2b(unit.encode(), digest_size=16).digest()


def _bits(digests: np.ndarray, n_bits: int) -> np.ndarray:
    """The bit of each digest (rows of 16 bytes)."""
    return digests.reshape(-1, 16)[:, :8].copy().view("<u8").ravel() & np.uint64(n_bits - 1)


def _as_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def repeated_filter(places: DataFrame, digests: str, n_bits: int = FILTER_BITS, at_least: int = 2) -> np.ndarray:
    """Packed bits of the digests (an array column) that occur so often: ORed in the tasks, of fixed size."""
    page = 1 << 19  # bits of one row of the filter

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = _bits(_as_rows(batch.column(0)), n_bits)
            for p in np.unique(at // page).tolist():
                own = held.setdefault(p, np.zeros(page // 8, np.uint8))
                inside = np.unique(at[at // page == p] % page).astype(np.int64)
                np.bitwise_or.at(own, inside >> 3, np.left_shift(1, inside & 7).astype(np.uint8))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["page", "bits"])

    repeated = places.select(F.explode(digests).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least).select("digest")
    out = np.zeros(n_bits // 8, np.uint8)
    parts = repeated.mapInArrow(pages, "page int, bits binary").repartition(max(1, n_bits // page // 16), "page").mapInArrow(_or_pages, "page int, bits binary")
    for row in parts.collect():  # n_bits, no more
        own = np.frombuffer(row.bits, np.uint8)
        out[row.page * (page // 8) : row.page * (page // 8) + len(own)] |= own
    return out


def _or_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for page, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(bits, np.uint8)
            held[page] = held[page] | own if page in held else own
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["page", "bits"])


def _sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose texts have about SLICE_CHARS code points together."""
    for batch in batches:
        first, weight = 0, 0
        for i, t in enumerate(batch.column(column)):
            weight += len(t.as_py())
            if weight >= SLICE_CHARS or i == batch.num_rows - 1:
                yield batch.slice(first, i + 1 - first)
                first, weight = i + 1, 0


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN, size: int = CHUNK_CHARS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(key, ids) of every row."""
    spark = df.sparkSession
    kind = df.schema[key].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 2):
            units = [units_of(t, size) for t in batch.column(2).to_pylist()]
            digests = [[_digest(u) for u in us] for us in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.list_(pa.string())), pa.array(digests, pa.list_(pa.binary()))], names=cut_schema.names)

    cut_schema = T.StructType([T.StructField(key, kind), T.StructField("row", T.LongType()), T.StructField("units", T.ArrayType(T.StringType())), T.StructField("digests", T.ArrayType(T.BinaryType()))])
    # whole: the ids of a text, or of none; part: the ids of its piece ``pos``, or the piece itself where the filter holds it
    out_schema = T.StructType([T.StructField(key, kind), T.StructField("row", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("digest", T.BinaryType()), T.StructField("unit", T.StringType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bits = encoder(vocabulary, pattern), sent.value
        for batch in batches:
            lengths = pc.list_value_length(batch.column(2))
            flat = batch.column(3).flatten()
            at = _bits(_as_rows(flat), filter_bits).astype(np.int64)
            shared = (bits[at >> 3] >> (at & 7) & 1).astype(bool)
            rows: list[int] = []
            pos: list[int | None] = []
            ids: list[list[int] | None] = []
            digest: list[bytes | None] = []
            unit: list[str | None] = []
            start = 0
            for i, (n, us) in enumerate(zip(lengths.to_pylist(), batch.column(2).to_pylist())):
                held = shared[start : start + n]
                if held.any():
                    for k, u in enumerate(us):
                        rows.append(i)
                        pos.append(k)
                        ids.append(None if held[k] else own.encode_ordinary(u))
                        digest.append(flat[start + k].as_py() if held[k] else None)
                        unit.append(u if held[k] else None)
                else:
                    rows.append(i)
                    pos.append(None)
                    ids.append(own.encode_ordinary("".join(us)))  # no piece is shared: as one, the same
                    digest.append(None)
                    unit.append(None)
                start += n
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(pos, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(digest, pa.binary()), pa.array(unit, pa.string())], names=out_schema.names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, pattern)
        for batch in batches:
            ids = [own.encode_ordinary(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["digest", "ids"])

    rows = df.select(key, F.monotonically_increasing_id().alias("row"), text)
    full = rows.where(F.col(text) != "")
    bare = rows.where(F.col(text).isNull() | (F.col(text) == "")).select(key, F.expr("cast(array() as array<int>)").alias("ids"))
    # written once, as both the repeated digests and the pieces are read from it
    cuts = durable(full.mapInArrow(cut, cut_schema), "units")
    sent = spark.sparkContext.broadcast(repeated_filter(cuts, "digests", filter_bits))
    placed = durable(cuts.mapInArrow(place, out_schema), "placed")
    discard(cuts)  # what follows reads the pieces placed, and those alone
    whole = placed.where("pos is null").select(key, "ids")
    shared = placed.where("digest is not null")
    # equal digests are equal units; one of each is encoded
    encoded = shared.groupBy("digest").agg(F.first("unit").alias("unit")).mapInArrow(encode, "digest binary, ids array<int>")
    parts = placed.where("pos is not null and digest is null").select(key, "row", "pos", "ids").unionByName(shared.select(key, "row", "pos", "digest").join(encoded, "digest").drop("digest"))
    joined = parts.groupBy("row").agg(F.first(key).alias(key), F.flatten(F.expr("transform(array_sort(collect_list(struct(pos, ids))), x -> x.ids)")).alias("ids"))
    return whole.unionByName(joined.select(key, "ids")).unionByName(bare)


def reuse_report(df: DataFrame, text: str, size: int = CHUNK_CHARS) -> DataFrame:
    """How much of the corpus is encoded once for several places: units, distinct units, and their code points."""
    cut = F.pandas_udf(lambda s: s.map(lambda t: units_of(t, size)), T.ArrayType(T.StringType()))
    units = df.where(F.col(text) != "").select(F.explode(cut(F.col(text))).alias("unit")).groupBy(F.md5("unit").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.first(F.char_length("unit")).alias("c"))
    return units.agg(F.sum("n").alias("units"), F.count(F.lit(1)).alias("distinct_units"), F.sum(F.col("n") * F.col("c")).alias("chars"), F.sum("c").alias("distinct_chars"))
