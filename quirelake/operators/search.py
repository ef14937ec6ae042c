"""Workspace search: literal, ASCII case-insensitive, over models first and cached lines second, capped per file.

The cap is the feature: at most 32 hits of a file over both sources, in the order (source, element or request, line).
``row_number() <= k`` plans a group limit before and after the exchange, so a hot file sends 32 rows a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as tx
from quirelake.operators.dewey import read_json

HITS_PER_FILE = 32
#: Fields that hold structure, not content.
STRUCTURAL = frozenset("element_id kind part_name notes_part_name workbook_id document_id presentation_id style_id field_type content_type index row col number format_id schema_id".split())


def matching_lines(df: DataFrame, path: str, content: str, needle: str, *order: str) -> DataFrame:
    """(path, order..., line_no, snippet) of each line of ``content`` that holds the needle.

    The whole text is tested before its lines are made: the optimizer does not push a predicate on lines through them.
    """
    found = df.where(tx.contains_folded(F.col(content), needle)).select(F.col(path).alias("path"), *order, F.posexplode(tx.lines(F.col(content))).alias("line_no", "line"))
    return found.where(tx.contains_folded(F.col("line"), needle)).select("path", *order, "line_no", tx.snippet(F.col("line")).alias("snippet"))


def cap_per_file(hits: DataFrame, *order: str, limit: int = HITS_PER_FILE) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("path").orderBy(*order))
    return hits.withColumn("hit_no", rank).where(F.col("hit_no") <= limit)


def model_leaves(df: DataFrame, path: str, payload: str) -> DataFrame:
    """(path, key_path, leaf, leaf_role, sheet, slide, address, paragraph, field, page) of each string and number of a model.

    Depth first; objects go by sorted keys. Booleans and nulls are no leaves. The context is that of the nearest enclosing
    entry; a named range is one leaf, ``name -> formula``. Payloads that are no JSON give nothing.
    """
    schema = "path string, key_path string, leaf string, leaf_role string, sheet string, slide string, address string, paragraph int, field string, page int"
    names = [c.split()[0] for c in schema.split(", ")]

    def walk(value) -> Iterator[tuple]:
        stack: list[tuple] = [(value, "", "", "", {})]
        while stack:
            v, at, key, parent, ctx = stack.pop()
            if isinstance(v, dict):
                ctx = dict(ctx)
                if parent == "sheets" and isinstance(v.get("name"), str):
                    ctx["sheet"] = v["name"]
                elif parent == "slides" and isinstance(v.get("name"), str):
                    ctx["slide"] = v["name"]
                elif parent == "paragraphs" and isinstance(v.get("index"), int):
                    ctx["paragraph"] = v["index"]
                elif parent == "fields" and isinstance(v.get("name"), str):
                    ctx["field"] = v["name"]
                elif parent == "pages" and isinstance(v.get("number"), int):
                    ctx["page"] = v["number"]
                if isinstance(v.get("address"), str):
                    ctx["address"] = v["address"]
                if parent == "named_ranges" and isinstance(v.get("name"), str):
                    yield at, f"{v['name']} → {v.get('formula', '')}", "named_range", ctx
                    continue
                for k in sorted(v, reverse=True):
                    stack.append((v[k], f"{at}.{k}" if at else k, k, "", ctx))
            elif isinstance(v, list):
                for i in range(len(v) - 1, -1, -1):
                    stack.append((v[i], f"{at}[{i}]", key, key, ctx))
            elif isinstance(v, str) or isinstance(v, (int, float)) and not isinstance(v, bool):
                yield at, v if isinstance(v, str) else json.dumps(v), "structure" if key in STRUCTURAL else "content", ctx

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = read_json(t.as_py())
                if isinstance(value, (dict, list)):
                    for at, leaf, role, ctx in walk(value):
                        rows.append((p, at, leaf, role, ctx.get("sheet"), ctx.get("slide"), ctx.get("address"), ctx.get("paragraph"), ctx.get("field"), ctx.get("page")))
                if len(rows) > 50_000:
                    yield pack(rows)
                    rows = []
            if rows:
                yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32() if c.endswith(" int") else pa.string() for c in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)

    return df.where(F.col(payload).isNotNull()).select(F.col(path).cast("string"), payload).mapInArrow(run, schema)


def selector_of(hit: DataFrame) -> DataFrame:
    """The selector a hit can be read with again: range before field before paragraph before slide before page."""
    kind = F.when(F.col("leaf_role") == "named_range", "named_ranges").when(F.col("sheet").isNotNull() & F.col("address").isNotNull(), "range").when(F.col("sheet").isNotNull(), "sheet").when(F.col("field").isNotNull(), "field").when(F.col("paragraph").isNotNull(), "paragraphs").when(F.col("slide").isNotNull(), "slide").when(F.col("page").isNotNull(), "page")
    value = F.when(F.col("sheet").isNotNull() & F.col("address").isNotNull(), F.concat("sheet", F.lit("!"), "address")).otherwise(F.coalesce("sheet", "field", F.col("paragraph").cast("string"), "slide", F.col("page").cast("string")))
    return hit.withColumn("selector_kind", kind).withColumn("selector_value", value)


def _may_hold(payload: F.Column, needle: str) -> F.Column:
    """Payloads worth a walk: for letters alone those that hold them as they are, or an escape; else all.

    Other characters may stand otherwise in JSON than in the leaf, and so may the letters a number is written with.
    """
    plain = needle.isascii() and needle.isalpha() and not any(needle.lower() in word for word in ("infinity", "nan", "e"))
    return tx.contains_folded(payload, needle) | payload.contains("\\u") if plain else payload.isNotNull()


def search_models(df: DataFrame, path: str, payload: str, needle: str, structure: bool = False) -> DataFrame:
    """Hits in models with their selectors; payloads that cannot hold the needle are not walked."""
    leaves = model_leaves(df.where(_may_hold(F.col(payload), needle)), path, payload).where(tx.contains_folded(F.col("leaf"), needle))
    if not structure:
        leaves = leaves.where("leaf_role <> 'structure'")
    return selector_of(leaves).withColumn("snippet", F.substring("leaf", 1, tx.SNIPPET_CHARS))


def search_workspace(models: DataFrame, model_path: str, payload: str, views: DataFrame, view_path: str, content: str, view_order: str, needle: str, limit: int = HITS_PER_FILE) -> DataFrame:
    """(path, hit_no, source, selector_kind, selector_value, snippet): model hits first, then lines of views, capped per file."""
    a = search_models(models, model_path, payload, needle).select("path", F.lit(0).alias("rank"), F.col("key_path").alias("place"), F.lit(0).alias("line_no"), F.lit("model").alias("source"), "selector_kind", "selector_value", "snippet")
    b = matching_lines(views, view_path, content, needle, view_order).select("path", F.lit(1).alias("rank"), F.lpad(F.col(view_order).cast("string"), 20, "0").alias("place"), "line_no", F.lit("view").alias("source"), F.lit(None).cast("string").alias("selector_kind"), F.lit(None).cast("string").alias("selector_value"), "snippet")
    return cap_per_file(a.unionByName(b), "rank", "place", "line_no", "snippet", limit=limit).drop("rank", "place")


def not_indexed(objects: DataFrame, path: str, models: DataFrame, model_path: str) -> DataFrame:
    """Objects that no fresh model is known of."""
    return objects.select(F.col(path).alias("path")).distinct().join(models.select(F.col(model_path).alias("path")).distinct(), "path", "left_anti")
