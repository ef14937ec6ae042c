"""Queries over nested records, cell hierarchies and package snapshots (problems 1, 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators import dewey, hierarchy, snapshots
from quirelake.session import durable, shared_place, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = dewey.flatten_records(table(spark, sf, "artifacts"), "artifact_id", "payload", "parsed_at", values=False)
    return rows.select("artifact_id", "record_path", "parent_path")


def p1_records(spark: SparkSession, sf: str) -> DataFrame:
    return dewey.flatten_records(table(spark, sf, "artifacts"), "artifact_id", "payload", "parsed_at")


#: The flat tables of the four models: their schema paths, and the fields with their types.
RECORD_TABLES: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "p1_sheets": (("sheets",), {"element_id": "string", "name": "string", "index": "int", "dimensions.rows": "int", "dimensions.cols": "int"}),
    "p1_cells": (("sheets.cells",), {"element_id": "string", "address": "string", "row": "int", "col": "int", "value.kind": "string", "value.value": "string", "formula": "string", "style_id": "string", "number_format": "string"}),
    "p1_named_ranges": (("named_ranges",), {"element_id": "string", "name": "string", "formula": "string"}),
    "p1_styles": (("style_table",), {"style_id": "string"}),
    "p1_comments": (("comments",), {"element_id": "string", "author": "string", "text": "string", "sheet": "string", "cell": "string", "paragraph": "string", "index": "int", "slide": "string", "page": "int", "subtype": "string", "contents": "string"}),
    "p1_charts": (("charts",), {"element_id": "string", "title": "string", "slide": "string"}),
    "p1_pictures": (("pictures",), {"element_id": "string", "sheet": "string", "name": "string", "content_type": "string", "index": "int", "part": "string"}),
    "p1_paragraphs": (("paragraphs", "header_paragraphs", "footer_paragraphs"), {"element_id": "string", "index": "int", "part": "string", "style_id": "string", "outline_level": "int", "text": "string", "editable": "boolean", "in_table": "boolean"}),
    "p1_slides": (("slides",), {"element_id": "string", "name": "string", "index": "int", "part_name": "string", "notes": "string"}),
    "p1_shapes": (("slides.shapes",), {"element_id": "string", "name": "string", "text": "string"}),
    "p1_slide_tables": (("slides.tables",), {"element_id": "string", "name": "string"}),
    "p1_table_cells": (("tables.cells",), {"element_id": "string", "row": "int", "col": "int", "text": "string"}),
    "p1_pages": (("pages",), {"element_id": "string", "number": "int", "text": "string", "rotate": "int"}),
    "p1_fields": (("fields",), {"element_id": "string", "name": "string", "field_type": "string", "value": "string", "read_only": "boolean", "required": "boolean"}),
}


def _record_table(name: str):
    tables, columns = RECORD_TABLES[name]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        records = dewey.flatten_records(table(spark, sf, "artifacts"), "artifact_id", "payload", "parsed_at", only=[t.rpartition(".")[2] for t in tables])
        return dewey.record_table(records, "artifact_id", tables, columns)

    return run


def p1_tables(spark: SparkSession, sf: str) -> DataFrame:
    """All tables written once by schema path: their records, the artifacts these come from, and those without a parent."""
    written = dewey.write_tables(p1_records(spark, sf), shared_place(spark, "tables"))
    return written.groupBy("schema_path", "list_name").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("artifact_id").alias("artifacts"), F.count_if(F.col("parent_path") == "").alias("at_top"))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.links(table(spark, sf, "dep_edges"), "object_path", "from_element_id", "target_element_id", F.col("target_kind") == "element")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("grp", "object_path").withColumnRenamed("node", "element_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _named(hierarchy.hierarchy(durable(_cells(spark, sf), "cells")))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.paths(durable(_cells(spark, sf), "cells"))


def p3_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _named(_paths(spark, sf).withColumn("path", hierarchy.joined(F.col("path"))).withColumnRenamed("path", "node_path"))


def p3_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.ancestors(_paths(spark, sf)).select(F.col("grp").alias("object_path"), F.col("ancestor").alias("ancestor_id"), F.col("node").alias("element_id"), "distance")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.replay(table(spark, sf, "manifest_entries"), "object_path", "snapshot_no", "name", "part_hash").select("object_path", "snapshot_no", "name", "change_kind")


def p5_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "manifest_entries")
    return snapshots.with_old_values(p5_found(spark, sf), rows, "object_path", "snapshot_no", "name", "part_hash", ["part_hash", "uncompressed_size"])


QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p1_tables": p1_tables, **{n: _record_table(n) for n in RECORD_TABLES}, "p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p5_found": p5_found, "p5_values": p5_values}

_TREE = """WITH RECURSIVE
e AS (SELECT object_path, lower(trim(from_element_id)) AS node, CASE WHEN target_kind = 'element' THEN lower(trim(target_element_id)) END AS parent FROM dep_edges),
n AS (SELECT object_path, node, min(parent) AS parent FROM (SELECT object_path, node, parent FROM e UNION ALL SELECT object_path, parent, NULL FROM e WHERE parent IS NOT NULL) WHERE node <> '' GROUP BY object_path, node),
t AS (SELECT object_path, node, node AS root_id, 0 AS node_depth FROM n WHERE parent IS NULL
      UNION ALL SELECT c.object_path, c.node, t.root_id, t.node_depth + 1 FROM t JOIN n c ON c.object_path = t.object_path AND c.parent = t.node)"""

_ENTRIES = """
e AS (SELECT object_path, snapshot_no, lower(ltrim(replace(name, chr(92), '/'), '/')) AS name, max(coalesce(lower(part_hash), '-')) AS hash
      FROM manifest_entries WHERE object_path IS NOT NULL AND snapshot_no IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2, 3),
d AS (SELECT object_path, snapshot_no, lag(snapshot_no) OVER w AS before_no, lead(snapshot_no) OVER w AS after_no
      FROM (SELECT DISTINCT object_path, snapshot_no FROM e) WINDOW w AS (PARTITION BY object_path ORDER BY snapshot_no)),
n AS (SELECT e.* FROM e JOIN d USING (object_path, snapshot_no) WHERE before_no IS NOT NULL),
o AS (SELECT e.object_path, d.after_no AS snapshot_no, e.name, e.hash AS old_hash FROM e JOIN d USING (object_path, snapshot_no) WHERE after_no IS NOT NULL)
"""

ORACLE = {
    "p3_found": _TREE
    + """, loose AS (SELECT n.* FROM n ANTI JOIN t ON n.object_path = t.object_path AND n.node = t.node),
walk AS (SELECT object_path, node AS start, parent AS here FROM loose UNION SELECT w.object_path, w.start, l.parent FROM walk w JOIN loose l ON l.object_path = w.object_path AND l.node = w.here),
ring AS (SELECT DISTINCT object_path, start AS node FROM walk WHERE start = here)
SELECT object_path, node AS element_id, root_id, CAST(node_depth AS INT) AS node_depth, 'tree' AS node_state FROM t
UNION ALL SELECT l.object_path, l.node, '', -1, CASE WHEN r.node IS NULL THEN 'below_cycle' ELSE 'cycle' END FROM loose l LEFT JOIN ring r ON l.object_path = r.object_path AND l.node = r.node""",
    "p3_paths": _TREE.replace("0 AS node_depth FROM n WHERE", "node AS node_path FROM n WHERE").replace("t.node_depth + 1", "t.node_path || '/' || c.node") + " SELECT object_path, node AS element_id, node_path FROM t",
    "p3_descendants": _TREE
    + """, up AS (SELECT t.object_path, t.node, n.parent AS ancestor, 1 AS distance FROM t JOIN n ON n.object_path = t.object_path AND n.node = t.node WHERE n.parent IS NOT NULL
      UNION ALL SELECT u.object_path, u.node, n.parent, u.distance + 1 FROM up u JOIN n ON n.object_path = u.object_path AND n.node = u.ancestor WHERE n.parent IS NOT NULL)
SELECT object_path, ancestor AS ancestor_id, node AS element_id, CAST(distance AS INT) AS distance FROM up""",
    "p5_found": "WITH" + _ENTRIES + """
SELECT coalesce(n.object_path, o.object_path) AS object_path, coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(n.name, o.name) AS name,
       CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM n FULL JOIN o ON n.object_path = o.object_path AND n.snapshot_no = o.snapshot_no AND n.name = o.name
WHERE o.name IS NULL OR n.name IS NULL OR n.hash <> o.old_hash""",
    "p5_values": "WITH" + _ENTRIES + """,
c AS (SELECT n.object_path, n.snapshot_no, d.before_no, n.name FROM n JOIN o USING (object_path, snapshot_no, name) JOIN d USING (object_path, snapshot_no) WHERE n.hash <> o.old_hash),
v AS (SELECT object_path, snapshot_no, lower(ltrim(replace(name, chr(92), '/'), '/')) AS name, max_by(part_hash, coalesce(lower(part_hash), '-')) AS part_hash, max_by(uncompressed_size, coalesce(lower(part_hash), '-')) AS uncompressed_size
      FROM manifest_entries GROUP BY 1, 2, 3)
SELECT c.object_path, c.before_no, c.name, c.snapshot_no, a.part_hash AS new_part_hash, a.uncompressed_size AS new_uncompressed_size, b.part_hash AS old_part_hash, b.uncompressed_size AS old_uncompressed_size
FROM c JOIN v a ON a.object_path = c.object_path AND a.snapshot_no = c.snapshot_no AND a.name = c.name
JOIN v b ON b.object_path = c.object_path AND b.snapshot_no = c.before_no AND b.name = c.name""",
}
