"""Freshness of tracked objects, detection of formats, and the roll-ups of the workspace: metrics, access log, tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The part that marks each office package, by extension.
MAIN_PARTS = {"xlsx": "xl/workbook.xml", "docx": "word/document.xml", "pptx": "ppt/presentation.xml"}
OFFICE_MAGIC, PDF_MAGIC = "504B0304", "255044462D"


def freshness(tracked: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, state): missing, fresh_fast_path (size and time as they were), fresh_after_hash, or stale.

    tracked: path, size, modified_ns, source_hash. listing: path, size, modified_ns, source_hash of what is there now;
    the hash is looked at only where size or time differ.
    """
    now = listing.select("path", F.col("size").alias("now_size"), F.col("modified_ns").alias("now_ns"), F.col("source_hash").alias("now_hash"))
    same = (F.col("size") == F.col("now_size")) & (F.col("modified_ns") == F.col("now_ns"))
    state = F.when(F.col("now_size").isNull(), "missing").when(same, "fresh_fast_path").when(F.col("source_hash") == F.col("now_hash"), "fresh_after_hash").otherwise("stale")
    return tracked.join(now, "path", "left").withColumn("state", state)


def refresh(tracked: DataFrame, listing: DataFrame) -> DataFrame:
    """The tracked objects with the new size and time of those that only look changed."""
    seen = freshness(tracked, listing)
    touched = F.col("state") == "fresh_after_hash"
    return seen.select("path", F.when(touched, F.col("now_size")).otherwise(F.col("size")).alias("size"), F.when(touched, F.col("now_ns")).otherwise(F.col("modified_ns")).alias("modified_ns"), "source_hash", "state")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def format_scores(path: Column, magic: Column, parts: Column) -> dict[str, Column]:
    """How sure each format is of a file: its extension, its first bytes (hexadecimal), and the names in its package (null: unreadable)."""
    ext = extension(path)
    zipped = F.coalesce(magic.startswith(OFFICE_MAGIC), F.lit(False))
    out = {}
    for fmt, part in MAIN_PARTS.items():
        has = F.coalesce(F.array_contains(parts, part), F.lit(False))
        named = ext == fmt
        out[fmt] = F.when(named & has, 100).when(has, 80).when(named & zipped & parts.isNull(), 100).when(named & zipped, 10).when(named, 40).otherwise(0)
    pdf = F.coalesce(magic.startswith(PDF_MAGIC), F.lit(False))
    out["pdf"] = F.when((ext == "pdf") & pdf, 100).when(pdf, 80).when(ext == "pdf", 40).otherwise(0)
    return out


def detect_format(df: DataFrame, path: str, magic: str, parts: str) -> DataFrame:
    """The format with the best score; of equal scores the one registered last; null if none scores."""
    scores = format_scores(F.col(path), F.col(magic), F.col(parts))
    ranked = F.greatest(*[F.struct(score.alias("score"), F.lit(i).alias("i"), F.lit(fmt).alias("fmt")) for i, (fmt, score) in enumerate(scores.items())])
    return df.withColumn("best", ranked).withColumn("detected", F.when(F.col("best.score") > 0, F.col("best.fmt"))).withColumn("score", F.col("best.score")).drop("best")


def access_rollup(log: DataFrame, *keys: str) -> DataFrame:
    """Accesses, cache hits and tokens served of a log whose broken lines are gone; null tokens count as nothing."""
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("accesses"), F.count_if("model_cache_hit").alias("model_hits"), F.count_if("view_cache_hit").alias("view_hits"),
        F.coalesce(F.sum(F.col("estimated_tokens").cast("bigint")), F.lit(0)).alias("tokens_served"), F.count_if("truncated").alias("truncated_reads"),
    )


ACCESS_LINE = "operation string, object_path string, timestamp_unix_ms bigint, source_hash string, model_cache_hit boolean, view_cache_hit boolean, estimated_tokens int, truncated boolean"


def parse_access_lines(df: DataFrame, line: str) -> DataFrame:
    """JSON lines of the access log as columns; lines that are broken, or have no operation, are skipped."""
    parsed = df.select(F.from_json(line, ACCESS_LINE, {"mode": "PERMISSIVE"}).alias("x")).select("x.*")
    return parsed.where(F.col("operation").isNotNull() & F.col("object_path").isNotNull())


def workspace_metrics(objects: DataFrame, parts: DataFrame, log: DataFrame) -> DataFrame:
    """One row: bytes stored, bytes of parts, what full copies would take, tokens of a dump, hits and tokens served.

    objects: size, version_count. parts: part_hash, bytes. The three are aggregated by themselves; one-row sides meet.
    """
    a = objects.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_bytes"), F.coalesce(F.sum(F.greatest("version_count", F.lit(1)) * F.col("size")), F.lit(0)).alias("full_copy_bytes"), F.coalesce(F.sum(F.floor(F.col("size") / 4)), F.lit(0)).alias("dump_tokens"))
    b = parts.groupBy("part_hash").agg(F.max("bytes").alias("bytes")).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("part_bytes"), F.count(F.lit(1)).alias("parts"))
    c = access_rollup(log).select("model_hits", "view_hits", "tokens_served")
    one = [x.withColumn("one", F.lit(1)) for x in (a, b, c)]
    return one[0].join(one[1], "one").join(one[2], "one").drop("one")


def tree_rollup(files: DataFrame, path: str, size: str) -> DataFrame:
    """(dir, bytes, files) of every directory over all that lies below it; '' is the top."""
    pieces = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda k: F.array_join(F.slice(pieces, F.lit(1), k), "/"))
    own = files.groupBy(path).agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n"))
    return own.select(F.explode(above).alias("dir"), "b", "n").groupBy("dir").agg(F.sum("b").alias("bytes"), F.sum("n").alias("files"))


def cached(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Requests that a cache answers: all of its keys must agree, a null key never does."""
    return requests.join(cache.select(*keys).distinct(), keys, "left_semi")
