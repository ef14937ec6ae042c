"""Cutting oversized texts at natural boundaries with balanced targets.

The smallest number of pieces that can hold the text under the limit (given the overlap) is computed, equal-length
targets are placed, each is snapped to the strongest boundary near it, and pieces are added while any piece would break
the limit. Lengths are code points: four make a token. Consecutive pieces share exactly the asked overlap.

Defined cases: null content gives no piece, empty content one empty piece; a limit below one token still lets one code
point through; a null limit is 2,000 tokens; a null or negative overlap is none, one at or above the limit is cut to
one code point less than it; a carriage return stays with its line feed, a mark with its letter and a joined emoji
together wherever the limit allows; extra columns are ignored; repeated rows give repeated pieces (the queries drop them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHARS_PER_TOKEN = 4
DEFAULT_TOKENS = 2000

#: Boundaries from the strongest to the weakest; a cut is placed after the match.
BOUNDARIES = [
    re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)+(?=#{1,6} )"),
    re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)+"),
    re.compile(r"\r\n|\n|\r(?!\n)"),
    re.compile("[.!?\u2026]+[\"'\u201d\u2019\u00bb)\\]]*[ \t\u00a0\u202f]+|[\u3002\uff01\uff1f]+[\u300d\u300f\uff09]*"),
    re.compile("[;:,][ \t\u00a0]+|[\uff1b\uff1a\uff0c\u3001]+|[ \t]\\|[ \t]*"),
    re.compile(r"\s+"),
    re.compile("(?<=[^\\W_])[-_/.\\\\&=?]+|(?<=[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3])"),
]
_GLUED = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u200d\u3099\u309a\ufe00-\ufe0f\ufe20-\ufe2f\U0001f3fb-\U0001f3ff\U000e0100-\U000e01ef]")


def _breaks_cluster(text: str, at: int) -> bool:
    if not 0 < at < len(text):
        return False
    after, before = text[at], text[at - 1]
    return (before == "\r" and after == "\n") or before == "\u200d" or _GLUED.match(after) is not None


def snap(text: str, target: int, low: int, high: int) -> int:
    """The strongest boundary in [low, high], of several the one nearest to the target; else a place inside no cluster."""
    for rule in BOUNDARIES:
        best = -1
        for m in rule.finditer(text, max(0, low - 8), min(len(text), high + 8)):
            at = m.end()
            if low <= at <= high and (best < 0 or abs(at - target) < abs(best - target)) and not _breaks_cluster(text, at):
                best = at
        if best >= 0:
            return best
    for step in range(high - low + 1):
        for at in (target - step, target + step):
            if low <= at <= high and not _breaks_cluster(text, at):
                return at
    return min(max(target, low), high)


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``: none longer than ``limit``, each sharing ``overlap`` with the next."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    overlap = min(max(overlap, 0), limit - 1)
    pieces = -(-(n - overlap) // (limit - overlap))
    while True:
        stride = (n - overlap) / pieces
        reach = int(stride / 4)
        start, out, fits = 0, [], True
        for k in range(pieces - 1):
            target = round((k + 1) * stride) + overlap
            low = max(target - reach, start + overlap + 1)
            high = min(target + reach, start + limit, n - 1)
            if low > high:
                fits = False
                break
            end = snap(text, min(max(target, low), high), low, high)
            out.append((start, end))
            start = end - overlap
        if fits and n - start <= limit:
            return [*out, (start, n)]
        pieces += max(1, pieces // 16)


def over_limit(content: str, limit: str) -> F.Column:
    """Whether ceil(code points / 4) is above the limit, which is 2,000 where null."""
    return F.ceil(F.char_length(content) / CHARS_PER_TOKEN) > F.coalesce(F.col(limit), F.lit(DEFAULT_TOKENS))


def split_oversized(df: DataFrame, key: str, content: str, limit: str, overlap: str) -> DataFrame:
    """Pieces (key, piece_no, n_pieces, start_at, end_at, piece, over_limit) of every content.

    Contents under the limit stay in the JVM as one piece; only the others go through Arrow.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("piece_no", T.IntegerType()), T.StructField("n_pieces", T.IntegerType()), T.StructField("start_at", T.IntegerType()),
        T.StructField("end_at", T.IntegerType()), T.StructField("piece", T.StringType()), T.StructField("over_limit", T.BooleanType()),
    ])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, text, most, shared in frame.itertuples(index=False, name=None):
                cuts = cut_points(text, max(1, int(most) * CHARS_PER_TOKEN), int(shared) * CHARS_PER_TOKEN)
                rows.extend((k, i, len(cuts), a, b, text[a:b], True) for i, (a, b) in enumerate(cuts))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=schema.names)
                    rows = []
            yield pd.DataFrame(rows, columns=schema.names)

    kept = df.where(F.col(content).isNotNull())
    size = F.char_length(content).cast("int")
    whole = kept.where(~over_limit(content, limit)).select(key, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_at"), size.alias("end_at"), F.col(content).alias("piece"), F.lit(False).alias("over_limit"))
    long = kept.where(over_limit(content, limit)).select(F.col(key).alias("k"), F.col(content).alias("c"), F.coalesce(F.col(limit), F.lit(DEFAULT_TOKENS)).cast("bigint").alias("m"), F.coalesce(F.greatest(F.col(overlap), F.lit(0)), F.lit(0)).cast("bigint").alias("o"))
    return whole.unionByName(long.mapInPandas(run, schema))
