"""Sparse grids: ranges as rows of text or cells, previews, sizes, header rows.

cells: object_path, sheet, row, col, kind, v_str, v_num, v_int, v_bool, formula. Only populated cells are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import a1

RENDER_CELLS = 10_000
PREVIEW_SHEETS, PREVIEW_ROWS, PREVIEW_CELLS = 3, 10, 200


def display_number(value: Column) -> Column:
    """Whole numbers without a fraction, others as short as they are."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("decimal(20,0)").cast("string")).otherwise(value.cast("string"))


def display(kind: str = "kind") -> Column:
    """What a cell shows; with a formula, the formula in brackets behind it."""
    value = (
        F.when(F.col(kind) == "float", display_number(F.col("v_num"))).when(F.col(kind) == "integer", F.col("v_int").cast("string"))
        .when(F.col(kind) == "boolean", F.col("v_bool").cast("string")).when(F.col(kind) == "empty", F.lit("")).otherwise(F.col("v_str"))
    )
    return F.when(F.col("formula").isNotNull(), F.concat(value, F.lit(" ("), F.when(F.col("formula").startswith("="), F.col("formula")).otherwise(F.concat(F.lit("="), "formula")), F.lit(")"))).otherwise(value)


def in_range(r1: int, c1: int, r2: int, c2: int) -> Column:
    return F.col("row").between(min(r1, r2), max(r1, r2)) & F.col("col").between(min(c1, c2), max(c1, c2))


def select_range(cells: DataFrame, sheet: str, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """Cells of a rectangle; the sheet compares without case."""
    return cells.where((F.upper("sheet") == sheet.upper()) & in_range(r1, c1, r2, c2))


def cap_cells(cells: DataFrame, limit: int = RENDER_CELLS) -> DataFrame:
    """The first cells of each sheet in row-major order, and whether there were more: a render shows no more."""
    per_sheet = Window.partitionBy("object_path", "sheet")
    ranked = cells.withColumn("cell_no", F.row_number().over(per_sheet.orderBy("row", "col"))).where(F.col("cell_no") <= limit + 1)
    return ranked.withColumn("cut", F.max(F.col("cell_no") > limit).over(per_sheet)).where(F.col("cell_no") <= limit)


def range_lines(cells: DataFrame) -> DataFrame:
    """(object_path, sheet, row, line): one table line a populated row, over the columns that hold anything.

    The columns come from the data, so no pivot is planned: rows and columns that occur are crossed per sheet by
    looking each row's values up in a map.
    """
    shown = cells.withColumn("shown", F.translate(F.coalesce(display(), F.lit("")), "\n\r|", "  /"))
    columns = shown.groupBy("object_path", "sheet").agg(F.sort_array(F.collect_set("col")).alias("cols"))
    rows = shown.groupBy("object_path", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "shown"))).alias("by_col"))
    line = F.array_join(F.transform("cols", lambda c: F.coalesce(F.try_element_at("by_col", c), F.lit(""))), " | ")
    return rows.join(columns, ["object_path", "sheet"]).select("object_path", "sheet", "row", F.concat(F.lit("| "), line, F.lit(" |")).alias("line"))


def render_markdown(cells: DataFrame) -> DataFrame:
    """(object_path, sheet, content): a Markdown table a sheet, its first populated row as the head."""
    lines = range_lines(cells)
    listed = lines.groupBy("object_path", "sheet").agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("l"))
    rule = F.regexp_replace(F.regexp_replace(F.col("l")[0]["line"], r"[^|]+", " --- "), r"\|", "|")
    body = F.array_join(F.transform(F.slice("l", 2, 1 << 30), lambda x: x["line"]), "\n")
    return listed.select("object_path", "sheet", F.concat_ws("\n", F.col("l")[0]["line"], rule, F.when(F.size("l") > 1, body)).alias("content"))


def range_json(cells: DataFrame) -> DataFrame:
    """(object_path, sheet, cells): the cells of a range with their ids as JSON, in row-major order."""
    entry = F.struct("row", "col", "element_id", a1.address(F.col("row"), F.col("col")).alias("address"), display().alias("value"), "formula")
    return cells.groupBy("object_path", "sheet").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("cells"))


def sheet_summary(cells: DataFrame) -> DataFrame:
    """Size, cells and formulas of each sheet; rows and columns are the greatest of each by themselves."""
    return cells.groupBy("object_path", "sheet").agg(F.max("row").alias("rows"), F.max("col").alias("cols"), F.count(F.lit(1)).alias("cells"), F.count_if(F.col("formula").isNotNull()).alias("formula_count"))


def preview(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """The first sheets (object_path, sheet, idx), their first rows, and no more than 200 cells of an object."""
    first = sheets.withColumn("n", F.row_number().over(Window.partitionBy("object_path").orderBy("idx"))).where(F.col("n") <= PREVIEW_SHEETS)
    near = cells.join(first, ["object_path", "sheet"])
    rows = near.withColumn("row_no", F.dense_rank().over(Window.partitionBy("object_path", "sheet").orderBy("row"))).where(F.col("row_no") <= PREVIEW_ROWS)
    return rows.withColumn("cell_no", F.row_number().over(Window.partitionBy("object_path").orderBy("n", "row", "col"))).where(F.col("cell_no") <= PREVIEW_CELLS).drop("n", "row_no", "idx")


def header_rows(cells: DataFrame) -> DataFrame:
    """(object_path, sheet, header_row, confidence, is_header): the first populated row, by its share of non-blank strings."""
    first = cells.groupBy("object_path", "sheet").agg(F.min(F.struct("row")).getField("row").alias("row"))
    top = cells.join(first, ["object_path", "sheet", "row"])
    text = (F.col("kind") == "string") & (F.regexp_replace(F.coalesce("v_str", F.lit("")), r"\s", "") != "")
    out = top.groupBy("object_path", "sheet", F.col("row").alias("header_row")).agg((F.count_if(text) / F.count(F.lit(1))).cast("float").alias("confidence"))
    return out.withColumn("is_header", F.col("confidence") >= 0.5)
