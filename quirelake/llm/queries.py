"""Queries of the text operators (problems 2, 4, 6, 7 and 8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import encoding, leaks, looks, pii, splitting
from quirelake.session import table


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "access_log"), "access_id", "content", "max_tokens", "overlap_tokens")


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).dropDuplicates(["access_id", "piece_no"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).where("over_limit and piece_no = 0").select("access_id").distinct()


#: The four tables of texts with the column that holds them.
TEXT_TABLES = {"paragraphs": "text", "shapes": "text", "pdf_pages": "text", "search_requests": "query"}


def _units(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, name).select("unit_id", F.col(column).alias("text")) for name, column in TEXT_TABLES.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return looks.alike_pairs(_units(spark, sf), "unit_id", "text")


def p4_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return looks.with_canonical(_units(spark, sf), "unit_id", "text").withColumnRenamed("unit", "unit_id")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


def p6_reuse(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.reuse_report(table(spark, sf, "documents"), "text")


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "item_text", "lang", table(spark, sf, "name_parts"), "name_part")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).where("leak_kind = 'verbatim'").select("doc_id", "item_id").distinct()


def _finder(spark: SparkSession, sf: str) -> pii.Finder:
    return pii.fitted(table(spark, sf, "name_parts"), "name_part", "part_kind")


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_pii(table(spark, sf, "documents"), "doc_id", "text", _finder(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_spans(spark, sf).select("doc_id", "pii_kind", "pii_key").distinct()


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact(table(spark, sf, "documents"), "doc_id", "text", _finder(spark, sf))


QUERIES = {
    "p2_found": p2_found, "p2_pieces": p2_pieces, "p4_found": p4_found, "p4_canonical": p4_canonical, "p6_ids": p6_ids, "p6_reuse": p6_reuse, "p7_found": p7_found, "p7_leaks": p7_leaks,
    "p8_found": p8_found, "p8_spans": p8_spans, "p8_redacted": p8_redacted,
}
ORACLE = {
    "p2_found": "SELECT DISTINCT access_id FROM access_log WHERE content IS NOT NULL AND ceil(length(content) / 4.0) > coalesce(max_tokens, 2000)",
}
