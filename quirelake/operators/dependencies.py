"""Formula dependencies as joins: edges from formulas, what a cell uses, what uses a cell, and what an edit touches.

Rectangles stay rectangles. Every rectangle has a level for its rows and one for its columns: the blocks of a level are
twice as long as those of the level before, and the level is the first at which it lies in two blocks at most. So a
rectangle of any size stands for four blocks or fewer. "Which ranges hold this cell" is an equi join on the sheet, the
levels that occur, and the blocks, with the exact containment behind it. Sheets compare without case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import a1
from quirelake.functions.formula import parsed, references_udf
from quirelake.session import durable

#: Blocks of level 0.
ROW_BLOCK, COL_BLOCK = 64, 16
#: Sheets have 2^20 rows and 2^14 columns, so no level is above these.
ROW_LEVELS, COL_LEVELS = 15, 11


def formula_edges(cells: DataFrame, names: DataFrame) -> DataFrame:
    """(object_path, from_id, target_kind, target_id, sheet, r1, c1, r2, c2, name), each edge once.

    cells: object_path, element_id, sheet, row, col, formula. names: object_path, name, formula. A reference to one cell
    that exists is an ``element`` edge, any other a ``selector``; a name that is defined gives the sheet-qualified
    references of its formula, or a ``named_range`` edge if there are none; unknown names give nothing.
    """
    # formulas are read once: both kinds of targets come from what is written here
    used = durable(parsed(cells.select("object_path", F.col("element_id").alias("from_id"), F.col("sheet").alias("own"), "formula"), ["object_path", "from_id", "own"], "formula"), "references")
    direct = used.where("kind = 'ref'").select("object_path", "from_id", F.coalesce("sheet", "own").alias("sheet"), "r1", "c1", "r2", "c2")
    known = names.select("object_path", F.upper("name").alias("key"), F.col("name").alias("defined"), F.filter(references_udf("formula"), lambda r: (r.kind == "ref") & r.sheet.isNotNull()).alias("refs"))
    by_name = used.where("kind = 'name'").select("object_path", "from_id", F.upper("name").alias("key")).distinct().join(known, ["object_path", "key"])
    through = by_name.select("object_path", "from_id", F.explode("refs").alias("r")).select("object_path", "from_id", "r.sheet", "r.r1", "r.c1", "r.r2", "r.c2")
    bare = by_name.where(F.size("refs") == 0).select("object_path", "from_id", F.lit("named_range").alias("target_kind"), F.lit(None).cast("string").alias("target_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("sheet", "string"), ("r1", "int"), ("c1", "int"), ("r2", "int"), ("c2", "int"))], F.col("defined").alias("name"))
    rectangles = direct.unionByName(through).withColumn("key", F.upper("sheet")).distinct()
    here = cells.select("object_path", F.upper("sheet").alias("key"), F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("element_id").alias("target_id"))
    single = rectangles.where("r1 = r2 and c1 = c2").join(here, ["object_path", "key", "r1", "c1"], "left")
    wide = rectangles.where("r1 <> r2 or c1 <> c2").withColumn("target_id", F.lit(None).cast("string"))
    found = single.unionByName(wide).select("object_path", "from_id", F.when(F.col("target_id").isNotNull(), "element").otherwise("selector").alias("target_kind"), "target_id", "sheet", "r1", "c1", "r2", "c2", F.lit(None).cast("string").alias("name"))
    return found.unionByName(bare).distinct()


def forward(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges of the given cells (object_path, element_id): what they use."""
    return edges.join(sources.select("object_path", F.col("element_id").alias("from_id")).distinct(), ["object_path", "from_id"], "left_semi")


def _block(at: Column, size: int, level: Column) -> Column:
    """The block of a row or column at a level."""
    return F.floor((at - 1) / (F.lit(size) * F.pow(F.lit(2), level))).cast("bigint")


def _level(low: Column, high: Column, size: int, levels: int) -> Column:
    """The first level at which a span lies in two blocks at most."""
    fits = [F.when(_block(high, size, F.lit(k)) - _block(low, size, F.lit(k)) <= 1, k) for k in range(levels)]
    return F.coalesce(*fits, F.lit(levels)).cast("int")


def _leveled(ranges: DataFrame) -> DataFrame:
    return ranges.withColumns({"rl": _level(F.col("r1"), F.col("r2"), ROW_BLOCK, ROW_LEVELS), "cl": _level(F.col("c1"), F.col("c2"), COL_BLOCK, COL_LEVELS)})


def _used_levels(leveled: DataFrame) -> list[tuple[int, int]]:
    """The levels that occur, at most (ROW_LEVELS + 1) x (COL_LEVELS + 1)."""
    return sorted((r.rl, r.cl) for r in leveled.select("rl", "cl").distinct().collect())


def _level_array(levels: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("rl"), F.lit(c).alias("cl")) for r, c in levels])


def _over(low: str, high: str, size: int, level: str) -> Column:
    return F.explode(F.sequence(_block(F.col(low), size, F.col(level)), _block(F.col(high), size, F.col(level))))


def containing(cells: DataFrame, ranges: DataFrame, cell_columns: list[str], range_columns: list[str]) -> DataFrame:
    """Cells (object_path, sheet_key, row, col, ...) with the ranges (object_path, sheet_key, r1, c1, r2, c2, ...) that hold them."""
    inside = (F.col("row") >= F.col("r1")) & (F.col("row") <= F.col("r2")) & (F.col("col") >= F.col("c1")) & (F.col("col") <= F.col("c2"))
    out = ["object_path", "sheet_key", *cell_columns, *range_columns]
    leveled = _leveled(ranges.where("r1 is not null and c1 is not null and r2 is not null and c2 is not null"))
    levels = _used_levels(leveled)
    if not levels:
        return cells.join(ranges, ["object_path", "sheet_key"]).where(inside).select(*out)
    laid = leveled.withColumn("rb", _over("r1", "r2", ROW_BLOCK, "rl")).withColumn("cb", _over("c1", "c2", COL_BLOCK, "cl"))
    probes = cells.withColumn("_l", F.explode(_level_array(levels))).withColumns({"rl": F.col("_l.rl"), "cl": F.col("_l.cl")}).drop("_l")
    placed = probes.withColumns({"rb": _block(F.col("row"), ROW_BLOCK, F.col("rl")), "cb": _block(F.col("col"), COL_BLOCK, F.col("cl"))})
    return placed.join(laid, ["object_path", "sheet_key", "rl", "cl", "rb", "cb"]).where(inside).select(*out)


def reverse(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """(object_path, element_id, from_id): for given cells the direct dependents, by cell or by a range that holds it.

    cells: object_path, element_id, sheet, row, col. Edges to named ranges match no cell.
    """
    by_id = edges.where("target_kind = 'element'").select("object_path", F.col("target_id").alias("element_id"), "from_id")
    exact = by_id.join(cells.select("object_path", "element_id").distinct(), ["object_path", "element_id"], "left_semi")
    ranges = edges.where("target_kind = 'selector'").select("object_path", F.upper("sheet").alias("sheet_key"), "r1", "c1", "r2", "c2", "from_id")
    held = containing(cells.select("object_path", F.upper("sheet").alias("sheet_key"), "row", "col", "element_id"), ranges, ["element_id"], ["from_id"])
    return exact.select("object_path", "element_id", "from_id").unionByName(held.select("object_path", "element_id", "from_id")).distinct()


def impact(edges: DataFrame, edited: DataFrame, cells: DataFrame) -> DataFrame:
    """(object_path, dependents): sorted, distinct ``Sheet!A1`` of the cells that use an edited cell."""
    hit = reverse(edges, edited).select("object_path", F.col("from_id").alias("element_id")).distinct()
    named = hit.join(cells.select("object_path", "element_id", "sheet", "row", "col"), ["object_path", "element_id"])
    return named.groupBy("object_path").agg(F.sort_array(F.collect_set(F.concat("sheet", F.lit("!"), a1.address(F.col("row"), F.col("col"))))).alias("dependents"))


def overlapping(ranges: DataFrame, key: str) -> DataFrame:
    """(key, overlaps): ranges (object_path, sheet_key, r1, c1, r2, c2, key) that share a cell with another of their sheet.

    Two ranges meet in blocks of the higher of their levels, by rows and by columns, and a pair counts in the block where
    its common rectangle begins, so it comes out once.
    """
    leveled = _leveled(ranges.where("r1 is not null and c1 is not null and r2 is not null and c2 is not null"))
    used = _used_levels(leveled)
    if not used:
        return leveled.select(key, F.lit(0).cast("bigint").alias("overlaps")).limit(0)
    meeting = sorted({(max(a[0], b[0]), max(a[1], b[1])) for a in used for b in used})
    raised = leveled.withColumns({"own_rl": F.col("rl"), "own_cl": F.col("cl")}).drop("rl", "cl")
    raised = raised.withColumn("_l", F.explode(F.filter(_level_array(meeting), lambda x: (x.rl >= F.col("own_rl")) & (x.cl >= F.col("own_cl"))))).withColumns({"rl": F.col("_l.rl"), "cl": F.col("_l.cl")}).drop("_l")
    cut = raised.withColumn("rb", _over("r1", "r2", ROW_BLOCK, "rl")).withColumn("cb", _over("c1", "c2", COL_BLOCK, "cl"))
    own = ["r1", "c1", "r2", "c2", "own_rl", "own_cl", key]
    other = cut.select("object_path", "sheet_key", "rl", "cl", "rb", "cb", *[F.col(c).alias(f"o_{c}") for c in own])
    first_row, first_col = F.greatest("r1", "o_r1"), F.greatest("c1", "o_c1")
    begins = (_block(first_row, ROW_BLOCK, F.col("rl")) == F.col("rb")) & (_block(first_col, COL_BLOCK, F.col("cl")) == F.col("cb"))
    here = (F.greatest("own_rl", "o_own_rl") == F.col("rl")) & (F.greatest("own_cl", "o_own_cl") == F.col("cl"))
    meet = (F.col("r1") <= F.col("o_r2")) & (F.col("o_r1") <= F.col("r2")) & (F.col("c1") <= F.col("o_c2")) & (F.col("o_c1") <= F.col("c2")) & (F.col(key) != F.col(f"o_{key}")) & begins & here
    return cut.join(other, ["object_path", "sheet_key", "rl", "cl", "rb", "cb"]).where(meet).groupBy(key).agg(F.count(F.lit(1)).alias("overlaps"))
