"""Reads of documents, decks and forms: ranges of paragraphs, slides by name, pages by number, and what a file holds.

Defined cases: a slide is named by its name, ``slideN`` or N, without case; ranges are half open and count from 0;
pages count from 1; what is not there gives no row; texts that are null count no tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text as tx


def paragraph_range(paragraphs: DataFrame, first: int, end: int) -> DataFrame:
    return paragraphs.where((F.col("idx") >= first) & (F.col("idx") < end))


def is_heading() -> Column:
    return F.coalesce(tx.fold(F.col("style_id")).startswith("heading"), F.lit(False)) | F.col("outline_level").isNotNull()


def document_summary(paragraphs: DataFrame) -> DataFrame:
    """(object_path, paragraphs, headings, in_tables, locked, tokens)."""
    tokens = F.sum(F.coalesce(tx.token_estimate(F.col("text")), F.lit(0)))
    return paragraphs.groupBy("object_path").agg(F.count(F.lit(1)).alias("paragraphs"), F.count_if(is_heading()).alias("headings"), F.count_if("in_table").alias("in_tables"), F.count_if(~F.col("editable")).alias("locked"), tokens.alias("tokens"))


def is_slide(column: str, selector: str) -> Column:
    """Whether a slide is the one a selector names."""
    plain = selector.strip().lower()
    number = plain.removeprefix("slide").strip()
    return F.lower(column).isin(*([plain] if not number.isdigit() else [f"slide {int(number)}", f"slide{int(number)}", f"{int(number)}"]))


def slide_shapes(shapes: DataFrame, selector: str) -> DataFrame:
    return shapes.where(is_slide("slide", selector))


def deck_summary(shapes: DataFrame) -> DataFrame:
    """(object_path, slide, shapes, preview, names): the first text of a slide, and the names of its shapes in order."""
    first = F.min(F.when(F.col("text").isNotNull(), F.struct("ord", "text")))
    names = F.sort_array(F.collect_list(F.struct("ord", "name")))
    return shapes.groupBy("object_path", "slide").agg(F.count(F.lit(1)).alias("shapes"), first.alias("f"), names.alias("n")).select("object_path", "slide", "shapes", F.col("f.text").alias("preview"), F.array_join("n.name", "|").alias("names"))


def page(pages: DataFrame, number: int, column: str = "number") -> DataFrame:
    return pages.where(F.col(column) == number)


def form_summary(pages: DataFrame, column: str = "number") -> DataFrame:
    """(object_path, pages, rotated, last_page, chars)."""
    return pages.groupBy("object_path").agg(F.count(F.lit(1)).alias("pages"), F.count("rotate").alias("rotated"), F.max(column).alias("last_page"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).cast("bigint").alias("chars"))
