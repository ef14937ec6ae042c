"""Queries of the workspace operators: search, reads under a budget, grids, dependencies, versions, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import a1, ids
from quirelake.functions import text as tx
from quirelake.functions.formats import number_format
from quirelake.functions.recipes import recipe_key
from quirelake.operators import dependencies, grid, reads, search, status, versions
from quirelake.session import table
from quirelake.sources import packages
from quirelake.streaming import access

BLANKS = tx.BLANK
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fold(x: str) -> str:
    return f"translate({x}, '{UP}', '{LOW}')"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


def _sql_id(kind: str, *columns: str) -> str:
    parts = " || ".join(f"'/' || octet_length(encode({c})) || ':' || {c}" for c in columns)
    return f"'{ids.PREFIXES[kind]}_' || left(sha256('{kind}/{ids.SCHEMA_VERSION}' || {parts}), 24)"


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


# ---- search, globs, budgets

_LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) - 1 AS line_no FROM documents WHERE contains({_fold('text')}, 'margin')),
h AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, substring({_trim('line')}, 1, 160) AS snippet FROM l WHERE contains({_fold('line')}, 'margin'))
SELECT doc_id, line_no, snippet, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INT) AS hit_no FROM h QUALIFY hit_no <= 32"""


@query("search_lines", _LINES)
def search_lines(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.matching_lines(table(spark, sf, "documents"), "doc_id", "text", "margin")
    return search.cap_per_file(hits, "line_no").select(F.col("path").alias("doc_id"), "line_no", "snippet", "hit_no")


@query(
    "search_models",
    f"""
WITH t AS (SELECT v.artifact_id, j.key, j.type, substring(j.fullkey, 3) AS key_path, json_extract_string(j.atom, '$') AS leaf, j.value FROM (SELECT artifact_id, ltrim(payload, chr(65279)) AS payload FROM artifacts WHERE json_valid(ltrim(payload, chr(65279)))) v, json_tree(v.payload) j),
n AS (SELECT artifact_id, key_path, json_extract_string(value, '$.name') || ' → ' || coalesce(json_extract_string(value, '$.formula'), '') AS leaf FROM t WHERE type = 'OBJECT' AND regexp_matches(key_path, '(^|[.])named_ranges(\\[[0-9]+\\])?$') AND json_type(value, '$.name') = 'VARCHAR'),
s AS (SELECT artifact_id, key_path, leaf FROM t WHERE type = 'VARCHAR' AND key_path <> '' AND NOT regexp_matches(key_path, '(^|[.])named_ranges(\\[[0-9]+\\])?[.]') AND regexp_extract(key_path, '([^.\\[\\]]+)(\\[[0-9]+\\])*$', 1) NOT IN ({", ".join(f"'{k}'" for k in sorted(search.STRUCTURAL))}) UNION ALL SELECT * FROM n)
SELECT artifact_id, key_path, substring(leaf, 1, 160) AS snippet FROM s WHERE contains({_fold('leaf')}, 'margin')""",
)
def search_models(spark: SparkSession, sf: str) -> DataFrame:
    """Every content leaf of the models that holds the needle, and where it stands."""
    hits = search.search_models(table(spark, sf, "artifacts"), "artifact_id", "payload", "margin")
    return hits.select(F.col("path").cast("bigint").alias("artifact_id"), "key_path", "snippet")


@query("search_workspace")
def search_workspace(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_workspace(table(spark, sf, "artifacts"), "object_path", "payload", table(spark, sf, "access_log"), "object_path", "content", "access_id", "margin")


@query("search_not_indexed", "SELECT DISTINCT object_path AS path FROM documents WHERE object_path IS NOT NULL AND object_path NOT IN (SELECT object_path FROM artifacts WHERE object_path IS NOT NULL)")
def search_not_indexed(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("object_path is not null")
    return search.not_indexed(docs, "object_path", table(spark, sf, "artifacts"), "object_path")


#: Globs, and what they mean as regular expressions over a path and a slash behind it.
GLOBS = {
    "**": "^.*/$", "*": "^[^/]+/$", "*/*": "^[^/]+/[^/]+/$", "finance/*": "^finance/[^/]+/$", "finance/**": "^finance/.*$", "**/*.xlsx": "^(.*/)?[^/]*[.]xlsx/$", "*/memo-*.docx": "^[^/]+/memo-[^/]*[.]docx/$", "audit/2025/*": "^audit/2025/[^/]+/$",
    "*/2025/**/*.pptx": "^[^/]+/2025/(.*/)?[^/]*[.]pptx/$", "legal/forms/*-00000*.docx": "^legal/forms/[^/]*-00000[^/]*[.]docx/$", "**/forms/**": "^(.*/)?forms/.*$", "board/*.pdf": "^board/[^/]*[.]pdf/$", "nowhere/**": "^nowhere/.*$",
}


@query("glob_paths", 'WITH g("glob", rx) AS (VALUES ' + ", ".join(f"('{g}', '{rx}')" for g, rx in GLOBS.items()) + "), p AS (SELECT DISTINCT object_path FROM artifacts) SELECT g.\"glob\", count(*) AS paths, min(object_path) AS first_path FROM p, g WHERE regexp_matches(object_path || '/', g.rx) GROUP BY g.\"glob\"")
def glob_paths(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "artifacts").select("object_path").distinct()
    hits = F.filter(F.array(*[F.when(tx.matches_glob(F.col("object_path"), g), F.lit(g)) for g in GLOBS]), lambda x: x.isNotNull())
    return paths.select("object_path", F.explode(hits).alias("glob")).groupBy("glob").agg(F.count(F.lit(1)).alias("paths"), F.min("object_path").alias("first_path"))


@query("token_estimate", "SELECT access_id, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, count(*) AS arrivals FROM access_log WHERE content IS NOT NULL GROUP BY ALL")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "access_log").where("content is not null").select("access_id", tx.token_estimate(F.col("content")).alias("tokens"))
    return rows.groupBy("access_id", "tokens").agg(F.count(F.lit(1)).alias("arrivals"))


@query(
    "budget_first_slice",
    """
WITH h AS (SELECT doc_id, text, left(text, 400) AS head FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, text, head, CASE WHEN contains(head, chr(10)) THEN length(regexp_extract(head, '[^\\n]*$')) + 1 ELSE 0 END AS back FROM h)
SELECT doc_id, CASE WHEN length(text) <= 400 THEN length(text) WHEN back > 0 AND octet_length(encode(left(head, 400 - back))) > 200 THEN 400 - back + 1 ELSE 400 END AS chars, length(text) > 400 AS truncated FROM b""",
)
def budget_first_slice(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("text is not null")
    return rows.select("doc_id", tx.first_slice_chars(F.col("text"), 100).cast("bigint").alias("chars"), (F.char_length("text") > 400).alias("truncated"))


_PAGE = "CASE WHEN length({t}) - {a} <= 400 THEN length({t}) WHEN contains(substring({t}, {a} + 1, 400), chr(10)) AND octet_length(encode(regexp_extract(substring({t}, {a} + 1, 400), '(?s)^(.*)\\n', 1))) > 200 THEN {a} + length(regexp_extract(substring({t}, {a} + 1, 400), '(?s)^(.*)\\n', 1)) + 1 ELSE {a} + 400 END"


@query(
    "budget_pages",
    f"""WITH RECURSIVE p AS (SELECT doc_id, text, 0 AS page_no, 0 AS start_at, {_PAGE.format(t="text", a="0")} AS end_at FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, text, page_no + 1, end_at, {_PAGE.format(t="text", a="end_at")} FROM p WHERE end_at < length(text))
SELECT doc_id, CAST(page_no AS INT) AS page_no, CAST(start_at AS INT) AS start_at, CAST(end_at AS INT) AS end_at, CASE WHEN end_at < length(text) THEN CAST(octet_length(encode(left(text, end_at))) AS INT) END AS cursor FROM p""",
)
def budget_pages(spark: SparkSession, sf: str) -> DataFrame:
    """All answers a text is read in under a budget, with the cursor in bytes that the next one starts at."""
    schema = "array<struct<start_at: int, end_at: int, cursor: int>>"

    @F.pandas_udf(schema)
    def pages(texts):
        def one(t):
            out, done = [], 0
            for a, b in tx.paginate(t, 100):
                done += len(t[a:b].encode())
                out.append({"start_at": a, "end_at": b, "cursor": done if b < len(t) else None})
            return out

        return texts.map(one)

    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(pages("text")).alias("page_no", "p"))
    return rows.select("doc_id", "page_no", "p.start_at", "p.end_at", "p.cursor")


# ---- reads of documents, decks and forms


@query("docx_paragraphs", "SELECT object_path, idx, element_id, text FROM paragraphs WHERE idx >= 2 AND idx < 5")
def docx_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return reads.paragraph_range(table(spark, sf, "paragraphs"), 2, 5).select("object_path", "idx", "element_id", "text")


@query(
    "docx_inspect",
    f"SELECT object_path, count(*) AS paragraphs, count(*) FILTER (WHERE coalesce(starts_with({_fold('style_id')}, 'heading'), false) OR outline_level IS NOT NULL) AS headings, count(*) FILTER (WHERE in_table) AS in_tables, count(*) FILTER (WHERE NOT editable) AS locked, CAST(sum(coalesce(ceil(length(text) / 4.0), 0)) AS BIGINT) AS tokens FROM paragraphs GROUP BY object_path",
)
def docx_inspect(spark: SparkSession, sf: str) -> DataFrame:
    return reads.document_summary(table(spark, sf, "paragraphs"))


@query("pptx_inspect", "SELECT object_path, slide, count(*) AS shapes, min_by(text, ord) FILTER (WHERE text IS NOT NULL) AS preview, string_agg(name, '|' ORDER BY ord, name) AS names FROM shapes GROUP BY ALL")
def pptx_inspect(spark: SparkSession, sf: str) -> DataFrame:
    return reads.deck_summary(table(spark, sf, "shapes"))


@query("pptx_slide", "SELECT object_path, slide, ord, name, text FROM shapes WHERE lower(slide) IN ('slide 2', 'slide2', '2')")
def pptx_slide(spark: SparkSession, sf: str) -> DataFrame:
    return reads.slide_shapes(table(spark, sf, "shapes"), "Slide2").select("object_path", "slide", "ord", "name", "text")


@query("pdf_inspect", "SELECT object_path, count(*) AS pages, count(rotate) AS rotated, max(page_number) AS last_page, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM pdf_pages GROUP BY object_path")
def pdf_inspect(spark: SparkSession, sf: str) -> DataFrame:
    return reads.form_summary(table(spark, sf, "pdf_pages"), "page_number")


@query("pdf_page", "SELECT object_path, page_number, element_id, text, rotate FROM pdf_pages WHERE page_number = 2")
def pdf_page(spark: SparkSession, sf: str) -> DataFrame:
    return reads.page(table(spark, sf, "pdf_pages"), 2, "page_number").select("object_path", "page_number", "element_id", "text", "rotate")


# ---- addresses, grids

_ADDRESS = "regexp_extract(from_cell, '([^!]*)$', 1)"


def _sql_col(x: str) -> str:
    n, code = f"length({x})", lambda k: f"(ascii(substring({x}, length({x}) - {k}, 1)) - 64)"
    return f"(CASE WHEN {n} >= 3 THEN {code(2)} * 676 ELSE 0 END + CASE WHEN {n} >= 2 THEN {code(1)} * 26 ELSE 0 END + {code(0)})"


_CELLS_SQL = f"""
c AS (SELECT DISTINCT object_path, lower(trim(from_element_id)) AS element_id, regexp_extract(from_cell, '^(.*)!([^!]*)$', 1) AS sheet,
      CAST(regexp_extract({_ADDRESS}, '^([A-Z]+)([0-9]+)$', 2) AS INT) AS "row", CAST({_sql_col(f"regexp_extract({_ADDRESS}, '^([A-Z]+)([0-9]+)$', 1)")} AS INT) AS col FROM dep_edges)"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with formulas: object_path, element_id, sheet, row, col."""
    place = a1.after_sheet(F.col("from_cell"))
    return table(spark, sf, "dep_edges").select("object_path", F.lower(F.trim("from_element_id")).alias("element_id"), a1.sheet_of(F.col("from_cell")).alias("sheet"), a1.row_of(place).alias("row"), a1.col_of(place).alias("col")).distinct()


@query("a1_parse", f'WITH {_CELLS_SQL} SELECT object_path, element_id, sheet, "row", col FROM c')
def a1_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf)


@query("a1_address", "SELECT l_orderkey AS n, 1 AS k, CASE WHEN c > 702 THEN chr(CAST(65 + (c - 703) // 676 AS INT)) ELSE '' END || CASE WHEN c > 26 THEN chr(CAST(65 + ((c - 27) // 26) % 26 AS INT)) ELSE '' END || chr(CAST(65 + (c - 1) % 26 AS INT)) || CAST(l_orderkey % 1048576 + 1 AS VARCHAR) AS address, CAST(c AS INT) AS back FROM (SELECT DISTINCT l_orderkey, l_orderkey % 16384 + 1 AS c FROM lineitem)")
def a1_address(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey").distinct()
    addr = a1.address(F.col("l_orderkey") % 1048576 + 1, F.col("l_orderkey") % 16384 + 1)
    return rows.select(F.col("l_orderkey").alias("n"), F.lit(1).alias("k"), addr.alias("address"), a1.col_of(addr).alias("back"))


@query("sheet_summary", f'WITH {_CELLS_SQL} SELECT object_path, sheet, max("row") AS "rows", max(col) AS cols, count(*) AS cells, count(*) AS formula_count FROM c GROUP BY ALL')
def sheet_summary(spark: SparkSession, sf: str) -> DataFrame:
    return grid.sheet_summary(_cells(spark, sf).withColumn("formula", F.lit("=")))


def _order_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cells: a sheet for each status, rows by key, three columns of three kinds."""
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("object_path"), F.lit("Orders").alias("sheet"), (F.col("o_orderkey") % 997 + 1).cast("int").alias("row"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    one = rows.groupBy("object_path", "sheet", "row").agg(F.min(F.struct("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")).alias("m"))
    cell = lambda col, kind, s, n, i: F.struct(F.lit(col).alias("col"), F.lit(kind).alias("kind"), s.cast("string").alias("v_str"), n.cast("double").alias("v_num"), i.cast("bigint").alias("v_int"))
    none = F.lit(None)
    cells = F.array(cell(1, "integer", none, none, F.col("m.o_custkey")), cell(2, "float", none, F.col("m.o_totalprice"), none), cell(4, "string", F.col("m.o_orderpriority"), none, none))
    return one.select("object_path", "sheet", "row", F.explode(cells).alias("c")).select("object_path", "sheet", "row", "c.*", F.lit(None).cast("boolean").alias("v_bool"), F.lit(None).cast("string").alias("formula"))


_ORDER_CELLS = """
o AS (SELECT o_orderstatus AS object_path, 'Orders' AS sheet, CAST(o_orderkey % 997 + 1 AS INT) AS "row", min_by(o_custkey, o_orderkey) AS a, min_by(o_totalprice, o_orderkey) AS b, min_by(o_orderpriority, o_orderkey) AS d FROM orders GROUP BY ALL)"""


@query("range_lines", f'WITH {_ORDER_CELLS} SELECT object_path, sheet, "row", \'| \' || CAST(a AS VARCHAR) || \' | \' || CASE WHEN b = floor(b) THEN CAST(CAST(b AS BIGINT) AS VARCHAR) ELSE CAST(b AS VARCHAR) END || \' | \' || d || \' |\' AS line FROM o')
def range_lines(spark: SparkSession, sf: str) -> DataFrame:
    return grid.range_lines(_order_cells(spark, sf))


_LINE = "'| ' || CAST(a AS VARCHAR) || ' | ' || CASE WHEN b = floor(b) THEN CAST(CAST(b AS BIGINT) AS VARCHAR) ELSE CAST(b AS VARCHAR) END || ' | ' || d || ' |'"


@query("range_markdown", f"WITH {_ORDER_CELLS}, l AS (SELECT object_path, sheet, \"row\", row_number() OVER (PARTITION BY object_path ORDER BY \"row\") AS n, {_LINE} AS line FROM o WHERE \"row\" BETWEEN 1 AND 60) SELECT object_path, sheet, string_agg(line || CASE WHEN n = 1 THEN chr(10) || '| --- | --- | --- |' ELSE '' END, chr(10) ORDER BY \"row\") AS content FROM l GROUP BY ALL")
def range_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return grid.render_markdown(grid.select_range(_order_cells(spark, sf), "orders", 1, 1, 60, 4))


@query(
    "range_json",
    f"""WITH {_ORDER_CELLS}, v AS (SELECT object_path, sheet, "row", unnest([1, 2]) AS col, unnest([CAST(a AS VARCHAR), CASE WHEN b = floor(b) THEN CAST(CAST(b AS BIGINT) AS VARCHAR) ELSE CAST(b AS VARCHAR) END]) AS value FROM o WHERE "row" BETWEEN 5 AND 20),
n AS (SELECT *, CASE col WHEN 1 THEN 'A' ELSE 'B' END || "row" AS address FROM v), i AS (SELECT *, {_sql_id('cell', 'sheet', 'address')} AS id FROM n)
SELECT object_path, sheet, '[' || string_agg('{{"row":' || "row" || ',"col":' || col || ',"element_id":"' || id || '","address":"' || address || '","value":"' || value || '"}}', ',' ORDER BY "row", col) || ']' AS cells FROM i GROUP BY ALL""",
)
def range_json(spark: SparkSession, sf: str) -> DataFrame:
    cells = _order_cells(spark, sf).withColumn("element_id", ids.element_id("cell", F.col("sheet"), a1.address(F.col("row"), F.col("col"))))
    return grid.range_json(grid.select_range(cells, "Orders", 5, 1, 20, 2))


@query("header_rows", f"WITH {_ORDER_CELLS}, f AS (SELECT object_path, min(\"row\") AS header_row FROM o GROUP BY 1) SELECT object_path, 'Orders' AS sheet, header_row, CAST(1.0 / 3 AS FLOAT) AS confidence, false AS is_header FROM f")
def header_rows(spark: SparkSession, sf: str) -> DataFrame:
    return grid.header_rows(_order_cells(spark, sf))


@query("render_cap", f'WITH {_ORDER_CELLS}, c AS (SELECT object_path, "row", unnest([1, 2, 4]) AS col FROM o), r AS (SELECT object_path, row_number() OVER (PARTITION BY object_path ORDER BY "row", col) AS n, count(*) OVER (PARTITION BY object_path) AS total FROM c) SELECT object_path, count(*) AS shown, max(total) > 500 AS cut FROM r WHERE n <= 500 GROUP BY 1')
def render_cap(spark: SparkSession, sf: str) -> DataFrame:
    return grid.cap_cells(_order_cells(spark, sf), 500).groupBy("object_path").agg(F.count(F.lit(1)).alias("shown"), F.max("cut").alias("cut"))


@query("sheet_preview", f"WITH {_ORDER_CELLS}, r AS (SELECT object_path, sheet, \"row\", dense_rank() OVER (PARTITION BY object_path ORDER BY \"row\") AS n FROM o), c AS (SELECT object_path, sheet, \"row\", unnest([1, 2, 4]) AS col, unnest(['integer', 'float', 'string']) AS kind FROM r WHERE n <= 10), k AS (SELECT *, row_number() OVER (PARTITION BY object_path ORDER BY \"row\", col) AS cell_no FROM c) SELECT object_path, sheet, \"row\", col, kind, CAST(cell_no AS INT) AS cell_no FROM k WHERE cell_no <= 200")
def sheet_preview(spark: SparkSession, sf: str) -> DataFrame:
    cells = _order_cells(spark, sf)
    return grid.preview(cells, cells.select("object_path", "sheet").distinct().withColumn("idx", F.lit(0))).select("object_path", "sheet", "row", "col", "kind", "cell_no")


# ---- structure edits on coordinates


@query("axis_insert", f'WITH {_CELLS_SQL} SELECT object_path, element_id, CASE WHEN "row" >= 10 THEN "row" + 3 ELSE "row" END AS new_row, col FROM c')
def axis_insert(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).select("object_path", "element_id", a1.shift_insert(10, 3, F.col("row"), a1.MAX_ROWS).alias("new_row"), "col")


@query("axis_delete", f'WITH {_CELLS_SQL} SELECT object_path, element_id, CASE WHEN "row" < 10 THEN "row" WHEN "row" >= 15 THEN "row" - 5 END AS new_row FROM c')
def axis_delete(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).select("object_path", "element_id", a1.shift_delete(10, 5, F.col("row")).alias("new_row"))


_RANGES_SQL = f"""
p AS (SELECT DISTINCT object_path, lower(trim(from_element_id)) AS from_id, upper(regexp_extract(target_selector, '^(.*)!([^!]*)$', 1)) AS sheet_key, target_selector,
      regexp_extract(target_selector, '!([A-Z]+)([0-9]+)', 1) AS a, CAST(regexp_extract(target_selector, '!([A-Z]+)([0-9]+)', 2) AS INT) AS r1,
      regexp_extract(target_selector, '([A-Z]+)([0-9]+)$', 1) AS b, CAST(regexp_extract(target_selector, '([A-Z]+)([0-9]+)$', 2) AS INT) AS r2 FROM dep_edges WHERE target_kind = 'selector' AND target_selector IS NOT NULL),
r AS (SELECT object_path, from_id, sheet_key, target_selector, least(r1, r2) AS r1, greatest(r1, r2) AS r2, CAST(least({_sql_col('a')}, {_sql_col('b')}) AS INT) AS c1, CAST(greatest({_sql_col('a')}, {_sql_col('b')}) AS INT) AS c2 FROM p)"""


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "dep_edges").where("target_kind = 'selector' and target_selector is not null")
    rect = a1.rectangle(F.col("target_selector"))
    return rows.select("object_path", F.lower(F.trim("from_element_id")).alias("from_id"), F.upper(a1.sheet_of(F.col("target_selector"))).alias("sheet_key"), "target_selector", *[v.alias(k) for k, v in rect.items()]).distinct()


@query("range_parse", f"WITH {_RANGES_SQL} SELECT object_path, from_id, sheet_key, target_selector, r1, c1, r2, c2 FROM r")
def range_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _ranges(spark, sf)


@query("range_shift_delete", f"WITH {_RANGES_SQL} SELECT target_selector, object_path, from_id, CASE WHEN NOT (r1 >= 50 AND r2 < 250) THEN CASE WHEN r1 < 50 THEN r1 WHEN r1 >= 250 THEN r1 - 200 ELSE 50 END END AS new_r1, CASE WHEN NOT (r1 >= 50 AND r2 < 250) THEN CASE WHEN r2 < 50 THEN r2 WHEN r2 >= 250 THEN r2 - 200 ELSE 49 END END AS new_r2 FROM r")
def range_shift_delete(spark: SparkSession, sf: str) -> DataFrame:
    low, high = a1.shift_range_delete(50, 200, F.col("r1"), F.col("r2"))
    return _ranges(spark, sf).select("target_selector", "object_path", "from_id", low.alias("new_r1"), high.alias("new_r2"))


@query(
    "range_overlap",
    f"""WITH {_RANGES_SQL}, k AS (SELECT *, object_path || '|' || from_id || '|' || target_selector AS range_key FROM r)
SELECT a.range_key, count(*) AS overlaps FROM k a JOIN k b ON a.object_path = b.object_path AND a.sheet_key = b.sheet_key AND a.range_key <> b.range_key AND a.r1 <= b.r2 AND b.r1 <= a.r2 AND a.c1 <= b.c2 AND b.c1 <= a.c2 GROUP BY 1""",
)
def range_overlap(spark: SparkSession, sf: str) -> DataFrame:
    keyed = _ranges(spark, sf).withColumn("range_key", F.concat_ws("|", "object_path", "from_id", "target_selector"))
    return dependencies.overlapping(keyed.select("object_path", "sheet_key", "r1", "c1", "r2", "c2", "range_key"), "range_key")


# ---- dependencies

_EDGES_SQL = """
e AS (SELECT DISTINCT object_path, lower(trim(from_element_id)) AS from_id, target_kind, CASE WHEN target_kind = 'element' THEN lower(trim(target_element_id)) END AS target_id, CASE WHEN target_kind = 'selector' THEN target_selector END AS selector, CASE WHEN target_kind = 'named_range' THEN target_name END AS name FROM dep_edges)"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    rect = a1.rectangle(F.col("target_selector"))
    when = lambda kind, col: F.when(F.col("target_kind") == kind, col)
    rows = table(spark, sf, "dep_edges").select(
        "object_path", F.lower(F.trim("from_element_id")).alias("from_id"), "target_kind", when("element", F.lower(F.trim("target_element_id"))).alias("target_id"), when("selector", F.col("target_selector")).alias("selector"),
        when("selector", a1.sheet_of(F.col("target_selector"))).alias("sheet"), *[when("selector", v).alias(k) for k, v in rect.items()], when("named_range", F.col("target_name")).alias("name"),
    )
    return rows.distinct()


@query("deps_edges", f"WITH {_EDGES_SQL} SELECT * FROM e")
def deps_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).select("object_path", "from_id", "target_kind", "target_id", "selector", "name")


@query("deps_forward", f"WITH {_EDGES_SQL}, {_CELLS_SQL} SELECT e.* FROM e SEMI JOIN c s ON e.object_path = s.object_path AND e.from_id = s.element_id")
def deps_forward(spark: SparkSession, sf: str) -> DataFrame:
    """What all cells use."""
    return dependencies.forward(_edges(spark, sf), _cells(spark, sf)).select("object_path", "from_id", "target_kind", "target_id", "selector", "name")


_REVERSE_SQL = f"""{_EDGES_SQL}, {_CELLS_SQL}, {_RANGES_SQL},
v AS (SELECT object_path, target_id AS element_id, from_id FROM e WHERE target_kind = 'element' AND target_id IN (SELECT element_id FROM c WHERE c.object_path = e.object_path)
      UNION SELECT c.object_path, c.element_id, r.from_id FROM c JOIN r ON c.object_path = r.object_path AND upper(c.sheet) = r.sheet_key AND c."row" BETWEEN r.r1 AND r.r2 AND c.col BETWEEN r.c1 AND r.c2)"""


@query("deps_reverse", f"WITH {_REVERSE_SQL} SELECT object_path, element_id, from_id FROM v")
def deps_reverse(spark: SparkSession, sf: str) -> DataFrame:
    return dependencies.reverse(_edges(spark, sf), _cells(spark, sf))


@query("deps_impact", f"WITH {_REVERSE_SQL}, i AS (SELECT DISTINCT v.object_path, d.sheet || '!' || regexp_extract(t.from_cell, '([^!]*)$', 1) AS dependent FROM v JOIN c s ON s.object_path = v.object_path AND s.element_id = v.element_id JOIN c d ON d.object_path = v.object_path AND d.element_id = v.from_id JOIN (SELECT DISTINCT object_path, lower(trim(from_element_id)) AS element_id, from_cell FROM dep_edges) t ON t.object_path = d.object_path AND t.element_id = d.element_id) SELECT object_path, string_agg(dependent, ',' ORDER BY dependent) AS dependents FROM i GROUP BY 1")
def deps_impact(spark: SparkSession, sf: str) -> DataFrame:
    """The dependents of an edit of all cells of each workbook."""
    cells = _cells(spark, sf)
    return dependencies.impact(_edges(spark, sf), cells, cells).select("object_path", F.array_join("dependents", ",").alias("dependents"))


def _formula_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as formulas that refer to cells, ranges and names of their order."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("object_path"), "l_linenumber", "l_partkey", "l_suppkey").groupBy("object_path", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    formula = F.concat(F.lit('=SUM(Data!B2:C'), (F.col("p") % 90 + 3).cast("string"), F.lit(')+A'), (F.col("l_linenumber") + 1).cast("string"), F.lit('*Rate&"A1"'))
    return rows.select("object_path", F.concat(F.lit("c_"), F.col("l_linenumber").cast("string")).alias("element_id"), F.lit("Lines").alias("sheet"), F.col("l_linenumber").cast("int").alias("row"), F.lit(1).alias("col"), formula.alias("formula"))


@query(
    "formula_edges",
    """
WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS object_path, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
w AS (SELECT object_path, 'c_' || n AS from_id, 'selector' AS target_kind, CAST(NULL AS VARCHAR) AS target_id, 'Data' AS sheet, 2 AS r1, 2 AS c1, CAST(p % 90 + 3 AS INT) AS r2, 3 AS c2, CAST(NULL AS VARCHAR) AS name FROM l),
s AS (SELECT l.object_path, 'c_' || l.n AS from_id, CASE WHEN t.n IS NULL THEN 'selector' ELSE 'element' END AS target_kind, 'c_' || t.n AS target_id, 'Lines' AS sheet, CAST(l.n + 1 AS INT) AS r1, 1 AS c1, CAST(l.n + 1 AS INT) AS r2, 1 AS c2, CAST(NULL AS VARCHAR) AS name FROM l LEFT JOIN l t ON t.object_path = l.object_path AND t.n = l.n + 1),
q AS (SELECT object_path, 'c_' || n AS from_id, 'selector' AS target_kind, CAST(NULL AS VARCHAR) AS target_id, 'Inputs' AS sheet, 1 AS r1, 2 AS c1, 1 AS r2, 2 AS c2, CAST(NULL AS VARCHAR) AS name FROM l)
SELECT * FROM w UNION ALL SELECT * FROM s UNION ALL SELECT * FROM q""",
)
def formula_edges(spark: SparkSession, sf: str) -> DataFrame:
    cells = _formula_cells(spark, sf)
    names = cells.select("object_path").distinct().select("object_path", F.lit("rate").alias("name"), F.lit("Inputs!$B$1").alias("formula"))
    return dependencies.formula_edges(cells, names)


# ---- versions


@query("history_versions", "SELECT event_id, user_id, CAST(row_number() OVER w AS INT) AS version, CAST(lag(1) OVER w * (row_number() OVER w - 1) AS INT) AS parent_version FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def history_versions(spark: SparkSession, sf: str) -> DataFrame:
    return versions.number_versions(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "version", "parent_version")


@query(
    "apply_all_fold",
    "SELECT coalesce(c_custkey, user_id) AS cell, coalesce(last_value, c_acctbal) AS value, coalesce(last_kind, c_mktsegment) AS kind FROM customer FULL JOIN (SELECT user_id, max_by(value, (ts, event_id)) FILTER (WHERE event_type <> 'view') AS last_value, max_by(event_type, (ts, event_id)) AS last_kind FROM events GROUP BY 1) ON c_custkey = user_id",
)
def apply_all_fold(spark: SparkSession, sf: str) -> DataFrame:
    """All staged writes at once: events set the value (views do not) and the kind of their customer's cell."""
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("kind"))
    ops = table(spark, sf, "events").select(F.col("user_id").alias("cell"), "ts", "event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"), F.col("event_type").alias("kind"), F.expr("cast(array() as array<string>)").alias("cleared"))
    return versions.fold(base, ops, ["cell"], ["ts", "event_id"], ["value", "kind"])


_SNAP_SQL = "SELECT object_path, snapshot_no AS version, lower(ltrim(replace(name, chr(92), '/'), '/')) AS name, max(lower(part_hash)) AS part_hash FROM manifest_entries GROUP BY ALL"


def _snap_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "manifest_entries")
    return rows.groupBy("object_path", F.col("snapshot_no").alias("version"), F.lower(F.regexp_replace(F.translate("name", "\\", "/"), "^/+", "")).alias("name")).agg(F.max(F.lower("part_hash")).alias("part_hash"))


@query("history_as_of", f"WITH v AS ({_SNAP_SQL}) SELECT object_path, name, max_by(struct_pack(h := part_hash), version).h AS part_hash FROM v WHERE version <= 3 GROUP BY ALL")
def history_as_of(spark: SparkSession, sf: str) -> DataFrame:
    rows = _snap_rows(spark, sf)
    wanted = rows.select("object_path").distinct().withColumn("at_version", F.lit(3))
    return versions.as_of(rows, wanted, ["name"], ["part_hash"])


@query("history_revert", f"WITH v AS ({_SNAP_SQL}), b AS (SELECT object_path, name, max_by(struct_pack(h := part_hash), version).h AS part_hash FROM v WHERE version <= 1 GROUP BY ALL), h AS (SELECT object_path, max(version) + 1 AS version FROM v GROUP BY 1) SELECT object_path, h.version, 2 AS revert_of, b.name, b.part_hash FROM b JOIN h USING (object_path)")
def history_revert(spark: SparkSession, sf: str) -> DataFrame:
    rows = _snap_rows(spark, sf)
    return versions.revert(rows, rows.select("object_path").distinct().withColumn("version", F.lit(2)), ["name"], ["part_hash"])


@query("semantic_diff", "SELECT l_partkey AS part, CASE WHEN b IS NULL THEN 'removed' WHEN a IS NULL THEN 'added' ELSE 'changed' END AS change FROM (SELECT l_partkey, sum(l_quantity) FILTER (WHERE l_linenumber <= 2) AS a, sum(l_quantity) FILTER (WHERE l_linenumber >= 2) AS b FROM lineitem GROUP BY 1) WHERE (a IS NULL) <> (b IS NULL) OR a <> b")
def semantic_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    side = lambda cond: rows.where(cond).groupBy(F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("q"))
    return versions.semantic_diff(side("l_linenumber <= 2"), side("l_linenumber >= 2"), ["part"], ["q"]).select("part", "change")


@query("staging", "SELECT count(*) AS staged, count(*) FILTER (WHERE value > 10) AS conflicts FROM events")
def staging(spark: SparkSession, sf: str) -> DataFrame:
    """All events are staged, and all are delivered again, those of some value with another payload."""
    events = table(spark, sf, "events").select(F.col("event_id").alias("tx_id"), F.col("event_type").alias("payload"), "value")
    again = events.select("tx_id", F.when(F.col("value") > 10, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")).alias("payload"))
    after, conflicts = versions.stage(events.select("tx_id", "payload"), again)
    counts = after.select(F.lit(1).alias("staged"), F.lit(0).alias("conflicts")).unionByName(conflicts.select(F.lit(0).alias("staged"), F.lit(1).alias("conflicts")))
    return counts.agg(F.sum("staged").alias("staged"), F.sum("conflicts").alias("conflicts"))


# ---- status, metrics


@query("status_states", "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 5 <> 0 THEN 'fresh_fast_path' WHEN doc_id % 10 = 0 THEN 'stale' ELSE 'fresh_after_hash' END AS state FROM documents")
def status_states(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against a listing where some are gone, some only touched, and some changed."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.coalesce("n_chars", F.lit(0)).alias("size"), F.lit(1).alias("modified_ns"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_hash"))
    listing = docs.where("path % 11 <> 0").select("path", F.when(F.col("path") % 10 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("path") % 5 == 0, 2).otherwise(1).alias("modified_ns"), F.when(F.col("path") % 10 == 0, "changed").otherwise(F.col("source_hash")).alias("source_hash"))
    return status.freshness(docs, listing).select(F.col("path").alias("doc_id"), "state")


@query("access_rollup", "SELECT object_path, operation, count(*) AS accesses, count(*) FILTER (WHERE model_cache_hit) AS model_hits, count(*) FILTER (WHERE view_cache_hit) AS view_hits, coalesce(sum(estimated_tokens), 0)::BIGINT AS tokens_served, count(*) FILTER (WHERE truncated) AS truncated_reads FROM access_log GROUP BY ALL")
def access_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return status.access_rollup(table(spark, sf, "access_log"), "object_path", "operation")


@query("access_lines", "SELECT event_type AS operation, count(*) AS accesses FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def access_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as lines of the log, one in seven broken; broken lines are skipped."""
    line = F.to_json(F.struct(F.col("event_type").alias("operation"), F.lit("a.xlsx").alias("object_path"), F.col("event_id").alias("timestamp_unix_ms")))
    lines = table(spark, sf, "events").select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 20)).otherwise(line).alias("line"))
    return status.parse_access_lines(lines, "line").groupBy("operation").agg(F.count(F.lit(1)).alias("accesses"))


@query(
    "workspace_metrics",
    """SELECT (SELECT sum(s)::BIGINT FROM (SELECT object_path, max(length(payload)) AS s FROM artifacts GROUP BY 1)) AS source_bytes,
       (SELECT sum(greatest(v, 1) * s)::BIGINT FROM (SELECT object_path, max(length(payload)) AS s, count(*) AS v FROM artifacts GROUP BY 1)) AS full_copy_bytes,
       (SELECT sum(s // 4)::BIGINT FROM (SELECT object_path, max(length(payload)) AS s FROM artifacts GROUP BY 1)) AS dump_tokens,
       (SELECT sum(b)::BIGINT FROM (SELECT lower(part_hash) AS p, max(compressed_size) AS b FROM manifest_entries GROUP BY 1)) AS part_bytes,
       (SELECT count(*) FROM (SELECT DISTINCT lower(part_hash) FROM manifest_entries)) AS parts,
       (SELECT count(*) FILTER (WHERE model_cache_hit) FROM access_log) AS model_hits, (SELECT count(*) FILTER (WHERE view_cache_hit) FROM access_log) AS view_hits, (SELECT sum(estimated_tokens)::BIGINT FROM access_log) AS tokens_served""",
)
def workspace_metrics(spark: SparkSession, sf: str) -> DataFrame:
    objects = table(spark, sf, "artifacts").groupBy("object_path").agg(F.max(F.char_length("payload")).alias("size"), F.count(F.lit(1)).alias("version_count"))
    parts = table(spark, sf, "manifest_entries").select(F.lower("part_hash").alias("part_hash"), F.col("compressed_size").alias("bytes"))
    return status.workspace_metrics(objects, parts, table(spark, sf, "access_log"))


@query(
    "tree_rollup",
    """WITH f AS (SELECT object_path, sum(estimated_tokens) AS b, count(*) AS n FROM access_log GROUP BY 1),
d AS (SELECT array_to_string(list_slice(string_split(object_path, '/'), 1, k), '/') AS dir, b, n FROM f, unnest(generate_series(0, len(string_split(object_path, '/')) - 1)) AS g(k))
SELECT dir, sum(b)::BIGINT AS bytes, sum(n)::BIGINT AS files FROM d GROUP BY 1""",
)
def tree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return status.tree_rollup(table(spark, sf, "access_log"), "object_path", "estimated_tokens")


@query(
    "detect_format",
    """WITH a AS (SELECT DISTINCT artifact_id, object_path, schema_id, lower(regexp_extract(object_path, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM artifacts),
s AS (SELECT *, CASE WHEN artifact_id % 3 = 0 THEN NULL WHEN schema_id = 'pdf.document' THEN '255044462D' ELSE '504B0304' END AS magic, CASE WHEN artifact_id % 2 = 0 AND schema_id <> 'pdf.document' THEN 'xl/workbook.xml' WHEN schema_id <> 'pdf.document' THEN 'none' END AS part FROM a),
t AS (SELECT *, CASE WHEN ext = 'xlsx' AND part = 'xl/workbook.xml' THEN 100 WHEN part = 'xl/workbook.xml' THEN 80 WHEN ext = 'xlsx' AND magic = '504B0304' AND part IS NULL THEN 100 WHEN ext = 'xlsx' AND magic = '504B0304' THEN 10 WHEN ext = 'xlsx' THEN 40 ELSE 0 END AS x,
       CASE WHEN ext = 'docx' AND magic = '504B0304' AND part IS NULL THEN 100 WHEN ext = 'docx' AND magic = '504B0304' THEN 10 WHEN ext = 'docx' THEN 40 ELSE 0 END AS d,
       CASE WHEN ext = 'pptx' AND magic = '504B0304' AND part IS NULL THEN 100 WHEN ext = 'pptx' AND magic = '504B0304' THEN 10 WHEN ext = 'pptx' THEN 40 ELSE 0 END AS p,
       CASE WHEN ext = 'pdf' AND magic = '255044462D' THEN 100 WHEN magic = '255044462D' THEN 80 WHEN ext = 'pdf' THEN 40 ELSE 0 END AS f FROM s)
SELECT artifact_id, object_path, CASE WHEN greatest(x, d, p, f) = 0 THEN NULL WHEN f = greatest(x, d, p, f) THEN 'pdf' WHEN p = greatest(x, d, p, f) THEN 'pptx' WHEN d = greatest(x, d, p, f) THEN 'docx' ELSE 'xlsx' END AS detected, CAST(greatest(x, d, p, f) AS INT) AS score FROM t""",
)
def detect_format(spark: SparkSession, sf: str) -> DataFrame:
    """Formats of the artifacts' files, with first bytes and part names derived from their models."""
    rows = table(spark, sf, "artifacts").select("artifact_id", "object_path", "schema_id").distinct()
    office = F.col("schema_id") != "pdf.document"
    magic = F.when(F.col("artifact_id") % 3 == 0, F.lit(None)).when(F.col("schema_id") == "pdf.document", status.PDF_MAGIC).otherwise(status.OFFICE_MAGIC)
    parts = F.when((F.col("artifact_id") % 2 == 0) & office, F.array(F.lit("xl/workbook.xml"))).when(office, F.array(F.lit("none")))
    return status.detect_format(rows.withColumn("magic", magic).withColumn("parts", parts), "object_path", "magic", "parts").select("artifact_id", "object_path", "detected", "score")


@query("part_dedupe", "SELECT count(*) AS parts, sum(b)::BIGINT AS stored_bytes, sum(n * b)::BIGINT AS full_bytes FROM (SELECT lower(part_hash) AS h, max(compressed_size) AS b, count(*) AS n FROM manifest_entries WHERE part_hash IS NOT NULL GROUP BY 1)")
def part_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "manifest_entries").where("part_hash is not null").select(F.lower("part_hash").alias("part_hash"), F.col("compressed_size").alias("size"))
    return packages.dedupe_report(rows)


@query("snapshot_rebuild", "SELECT doc_id, sha256(text) AS source_hash, len(string_split(text, chr(10))) AS parts FROM documents WHERE text IS NOT NULL")
def snapshot_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Texts stored as deduplicated parts, a line each, and a manifest; put together again and verified by their hash."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("package_hash"), F.split("text", "\n").alias("lines"))
    pieces = docs.select(F.col("doc_id").cast("string").alias("object_path"), "package_hash", F.posexplode(F.transform("lines", lambda x, i: F.when(i < F.size("lines") - 1, F.concat(x, F.lit("\n"))).otherwise(x))).alias("pos", "line"))
    slices = pieces.select("object_path", "package_hash", "pos", F.lit("").alias("name"), F.lit("line").alias("slice"), F.sha2("line", 256).alias("part_hash"), F.octet_length("line").cast("bigint").alias("size"), F.col("line").cast("binary").alias("part"))
    manifest, parts = packages.snapshot_tables(slices)
    whole = packages.implode_packages(manifest, parts)
    counts = manifest.groupBy("object_path").agg(F.count(F.lit(1)).alias("parts"))
    return whole.where("intact").select("object_path", F.sha2("content", 256).alias("source_hash")).join(counts, "object_path").select(F.col("object_path").cast("bigint").alias("doc_id"), "source_hash", "parts")


@query("cache_hits", "SELECT count(*) AS hits FROM access_log l SEMI JOIN artifacts a ON l.object_path = a.object_path AND l.source_hash = a.source_hash")
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    return status.cached(table(spark, sf, "access_log"), table(spark, sf, "artifacts"), ["object_path", "source_hash"]).agg(F.count(F.lit(1)).alias("hits"))


@query("element_ids", f"SELECT unit_id, {_sql_id('paragraph', 'CAST(idx AS VARCHAR)', 'text')} AS element_id FROM (SELECT unit_id, idx, coalesce(text, '') AS text FROM paragraphs)")
def element_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "paragraphs").select("unit_id", ids.element_id("paragraph", F.col("idx"), F.col("text")).alias("element_id"))


@query("number_formats", "SELECT p_partkey, CASE p_size WHEN 1 THEN '0' WHEN 2 THEN '0.00' WHEN 3 THEN '#,##0' WHEN 4 THEN '#,##0.00' WHEN 5 THEN '$#,##0_);($#,##0)' WHEN 6 THEN '$#,##0_);[Red]($#,##0)' WHEN 7 THEN '$#,##0.00_);($#,##0.00)' WHEN 8 THEN '$#,##0.00_);[Red]($#,##0.00)' WHEN 9 THEN '0%' WHEN 10 THEN '0.00%' WHEN 11 THEN '0.00E+00' WHEN 12 THEN '# ?/?' WHEN 13 THEN '# ??/??' WHEN 14 THEN 'mm-dd-yy' WHEN 15 THEN 'd-mmm-yy' WHEN 16 THEN 'd-mmm' WHEN 17 THEN 'mmm-yy' WHEN 18 THEN 'h:mm AM/PM' WHEN 19 THEN 'h:mm:ss AM/PM' WHEN 20 THEN 'h:mm' WHEN 21 THEN 'h:mm:ss' WHEN 22 THEN 'm/d/yy h:mm' WHEN 37 THEN '#,##0;(#,##0)' WHEN 38 THEN '#,##0;[Red](#,##0)' WHEN 39 THEN '#,##0.00;(#,##0.00)' WHEN 40 THEN '#,##0.00;[Red](#,##0.00)' WHEN 45 THEN 'mm:ss' WHEN 46 THEN '[h]:mm:ss' WHEN 47 THEN 'mmss.0' WHEN 48 THEN '##0.0E+0' WHEN 49 THEN '@' END AS number_format FROM part")
def number_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Style numbers as format codes; the general format, and numbers that mean nothing, are null."""
    return table(spark, sf, "part").select("p_partkey", number_format(F.col("p_size")).alias("number_format"))


@query(
    "derivation_keys",
    """WITH a AS (SELECT DISTINCT artifact_id, coalesce(source_hash, '') AS s, lower(coalesce(format_id, '')) AS f, coalesce(schema_id, '') AS p, coalesce(CAST(schema_version AS VARCHAR), '') AS v FROM artifacts)
SELECT artifact_id, sha256('{"source_hash":"' || s || '","processor_id":"' || p || '","processor_version":"' || v || '","config_hash":"","input_hashes":["' || f || '","' || s || '"]}') AS recipe_key FROM a""",
)
def derivation_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The key that each artifact's model is cached under."""
    rows = table(spark, sf, "artifacts").select("artifact_id", "source_hash", F.lower(F.coalesce("format_id", F.lit(""))).alias("f"), "schema_id", "schema_version")
    key = recipe_key(F.col("source_hash"), F.col("schema_id"), F.col("schema_version").cast("string"), F.lit(None).cast("string"), F.array("f", "source_hash"))
    return rows.select("artifact_id", key.alias("recipe_key")).distinct()


@query("access_windows", "SELECT time_bucket(INTERVAL 1 DAY, epoch_ms(timestamp_unix_ms)) AS window_start, object_path, count(*) AS accesses, count(*) FILTER (WHERE model_cache_hit) AS model_hits, count(*) FILTER (WHERE view_cache_hit) AS view_hits, coalesce(sum(estimated_tokens), 0)::BIGINT AS tokens_served FROM access_log GROUP BY ALL")
def access_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The roll-up that the stream makes, over the whole log at once."""
    return access.windowed_rollup(table(spark, sf, "access_log"), "1 day")
