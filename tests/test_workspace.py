import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.functions import a1, formula, ids
from quirelake.functions import text as tx
from quirelake.operators import dependencies, grid, search, status, versions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# ---- text


def glob_matches(pattern: str, path: str) -> bool:
    def walk(p, s):
        if not p:
            return not s
        if p[0] == "**":
            return any(walk(p[1:], s[i:]) for i in range(len(s) + 1))
        return bool(s) and re.fullmatch("[^/]*".join(re.escape(x) for x in re.split(r"\*+", p[0])), s[0]) is not None and walk(p[1:], s[1:])

    return walk(pattern.split("/"), path.split("/"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "*", "**", "a*", "*b", "a**b", "."]), min_size=1, max_size=4), st.lists(st.sampled_from(["a", "b", "ab", "axb", ".", ""]), min_size=1, max_size=4))
def test_globs(pattern, path):
    assert bool(re.search(tx.glob_regex("/".join(pattern)), "/".join(path) + "/")) == glob_matches("/".join(pattern), "/".join(path))


def test_folding_trimming_tokens(spark):
    assert one(spark, tx.fold(F.lit("ÄBC ß"))) == "Äbc ß"
    assert one(spark, tx.trim(F.lit("  a b　\n"))) == "a b"
    assert one(spark, tx.lines(F.lit("a\r\nb\nc"))) == ["a", "b", "c"]
    assert [one(spark, tx.token_estimate(F.lit(t))) for t in ("", "abcd", "abcde", "👩" * 5)] == [0, 1, 2, 2]
    assert len(one(spark, tx.snippet(F.lit(" " + "x" * 500)))) == 160


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé漢\n ", max_size=200), st.integers(1, 12))
def test_pages_lose_nothing(text, budget):
    pages = tx.paginate(text, budget)
    assert "".join(text[a:b] for a, b in pages) == text and all(b - a <= budget * 4 for a, b in pages)


def test_first_slice_equals_first_page(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("aé漢\n ", k=rng.randrange(0, 120))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(tx.first_slice_chars(F.col("t"), 5).alias("n")).collect()]
    assert got == [tx.paginate(t, 5)[0][1] for t in texts]


# ---- addresses and formulas


def test_addresses(spark):
    numbers = [1, 26, 27, 52, 53, 702, 703, 704, 16_384, 18_278]
    df = spark.createDataFrame([(n,) for n in numbers], "n int").select("n", a1.column_letters(F.col("n")).alias("s"))
    rows = df.select("n", "s", a1.column_number(F.col("s")).alias("back")).collect()
    assert all(r.s == formula.column_name(r.n) and r.back == r.n == formula.column_index(r.s) for r in rows)
    rect = lambda text: tuple(spark.range(1).select(*[v.alias(k) for k, v in a1.rectangle(F.lit(text)).items()]).first())
    assert rect("Sheet!D20:$A$1") == (1, 1, 20, 4) and rect("b3") == (3, 2, 3, 2) and rect("It's!A1:") == (None,) * 4 and rect("A:A") == (None,) * 4
    assert one(spark, a1.sheet_of(F.lit("'It''s'!A1"))) == "It's" and one(spark, a1.sheet_of(F.lit("A1"))) is None


def test_shifts(spark):
    low, high = a1.shift_range_delete(5, 3, F.lit(2), F.lit(6))
    assert (one(spark, low), one(spark, high)) == (2, 4)
    low, high = a1.shift_range_delete(5, 3, F.lit(5), F.lit(7))
    assert (one(spark, low), one(spark, high)) == (None, None)
    low, high = a1.shift_range_delete(5, 3, F.lit(6), F.lit(9))
    assert (one(spark, low), one(spark, high)) == (5, 6)
    assert one(spark, a1.shift_insert(3, 2, F.lit(a1.MAX_ROWS), a1.MAX_ROWS)) is None and one(spark, a1.shift_insert(0, 1, F.lit(3), 10)) is None
    low, high = a1.shift_range_insert(3, 2, F.lit(2), F.lit(4), a1.MAX_ROWS)
    assert (one(spark, low), one(spark, high)) == (2, 6)


def names(text):
    return [x.name if isinstance(x, formula.Name) else (x.sheet, x.r1, x.c1, x.r2, x.c2) for x in formula.scan(text)]


def test_formula_scanner():
    assert names("=SUM(Inputs!A1:A10)") == [("Inputs", 1, 1, 10, 1)]
    assert names("=TaxRate * C2") == ["TaxRate", (None, 2, 3, 2, 3)]
    assert names("='It''s'!$A$1") == [("It's", 1, 1, 1, 1)]
    assert names("=[Book]S!A1+'[Book]S x'!B2+'dir/[B.xlsx]S'!C3:D4") == []
    assert names('=LOG10(A1)&"A2""B3"') == [(None, 1, 1, 1, 1)]
    assert names("=TRUE+FALSE+x.y_1") == ["x.y_1"]
    assert names("=XFE1+A1048577") == ["XFE1", "A1048577"] and names("=D4:A1") == [(None, 1, 1, 4, 4)]
    assert formula.references("=A1+A1+Rate")[0]["r1"] == 1 and len(formula.references("=A1+A1+Rate")) == 2 and formula.references(None) == []


def test_formula_rewrites():
    shift = lambda text, at, n, insert, axis="row": formula.shift_formula(text, "S", "S", axis, at, n, insert)
    assert shift("=A3+$B$3+T!A3+SUM(A1:A9)", 3, 2, True) == "=A5+$B$5+T!A3+SUM(A1:A11)"
    assert shift("=A3+SUM(A2:A4)+S!A9", 3, 1, False) == "=#REF!+SUM(A2:A3)+S!A8"
    assert shift("=S!A3:A4", 3, 2, False) == "=#REF!" and shift("=B1:D1", 3, 1, False, "col") == "=B1:C1"
    assert formula.shift_sqref("A1:A3 B5 C9", "row", 5, 1, False) == "A1:A3 C8" and formula.shift_sqref("B5", "row", 5, 1, False) is None
    assert formula.rename_sheet("=Inputs!A1+'In x'!B1+\"Inputs!A1\"", "inputs", "A1") == "='A1'!A1+'In x'!B1+\"Inputs!A1\""


# ---- dependencies


def test_dependency_graph(spark):
    cells = spark.createDataFrame(
        [("o", "i1", "Inputs", 1, 1, None), ("o", "i2", "Inputs", 1, 2, None), ("o", "s1", "Summary", 2, 2, "=inputs!A1"), ("o", "s2", "Summary", 2, 3, "=SUM(Inputs!A1:A10)"), ("o", "s3", "Summary", 2, 4, "=TaxRate * C2"), ("o", "s4", "Summary", 3, 4, "=Bare+Nope+[X]Y!A1"), ("p", "s1", "Summary", 2, 2, "=Inputs!A1")],
        "object_path string, element_id string, sheet string, row int, col int, formula string",
    )
    named = spark.createDataFrame([("o", "taxrate", "Inputs!$B$1"), ("o", "Bare", "A1*2")], "object_path string, name string, formula string")
    edges = dependencies.formula_edges(cells, named).cache()
    got = {(r.object_path, r.from_id, r.target_kind, r.target_id or (r.name or f"{r.sheet}{r.r1}:{r.r2}")) for r in edges.collect()}
    assert got == {("o", "s1", "element", "i1"), ("o", "s2", "selector", "Inputs1:10"), ("o", "s3", "element", "i2"), ("o", "s3", "element", "s2"), ("o", "s4", "named_range", "Bare"), ("p", "s1", "selector", "Inputs1:1")}
    target = cells.where("element_id = 'i1'")
    assert {r.from_id for r in dependencies.reverse(edges, target).collect()} == {"s1", "s2"}
    assert {r.target_id for r in dependencies.forward(edges, cells.where("element_id = 's3' and object_path = 'o'")).collect()} == {"i2", "s2"}
    assert dependencies.impact(edges, target, cells).first().dependents == ["Summary!B2", "Summary!C2"]


def test_range_joins_against_brute_force(spark):
    rng = random.Random(5)
    rect = lambda k, n, m: (k, *sorted(rng.sample(range(1, n), 2)), *sorted(rng.sample(range(1, m), 2)))
    boxes = [rect(k, 400, 60) for k in range(60)] + [(90, 1, 1_000_000, 1, 16_000), (91, 5, 5, 5, 5)]
    ranges = spark.createDataFrame([("o", "S", a, c, b, d, k) for k, a, b, c, d in boxes], "object_path string, sheet_key string, r1 int, c1 int, r2 int, c2 int, id int")
    cells = [(i, rng.randrange(1, 400), rng.randrange(1, 60)) for i in range(200)]
    placed = spark.createDataFrame([("o", "S", r, c, i) for i, r, c in cells], "object_path string, sheet_key string, row int, col int, cell int")
    got = {(r.cell, r.id) for r in dependencies.containing(placed, ranges, ["cell"], ["id"]).collect()}
    assert got == {(i, k) for i, r, c in cells for k, a, b, x, y in boxes if a <= r <= b and x <= c <= y}
    small = ranges.where("id < 90")
    seen = {r.id: r.overlaps for r in dependencies.overlapping(small, "id").collect()}
    want = {}
    for k, a, b, x, y in boxes[:60]:
        n = sum(1 for j, e, f, g, h in boxes[:60] if j != k and a <= f and e <= b and x <= h and g <= y)
        want |= {k: n} if n else {}
    assert seen == want


# ---- grids


GRID = "object_path string, sheet string, row int, col int, kind string, v_str string, v_num double, v_int bigint, v_bool boolean, formula string"


def test_rendering(spark):
    cells = spark.createDataFrame([("o", "S", 2, 1, "string", "Month", None, None, None, None), ("o", "S", 2, 4, "string", "Amount", None, None, None, None), ("o", "S", 5, 1, "string", "a|b", None, None, None, None), ("o", "S", 5, 4, "float", None, 100.0, None, None, "B2*2"), ("o", "S", 6, 4, "boolean", None, None, None, True, None)], GRID)
    assert grid.render_markdown(cells).first().content == "| Month | Amount |\n| --- | --- |\n| a/b | 100 (=B2*2) |\n|  | true |"
    assert tuple(grid.sheet_summary(cells).first()) == ("o", "S", 6, 4, 5, 1)
    head = grid.header_rows(cells).first()
    assert (head.header_row, head.confidence, head.is_header) == (2, 1.0, True)
    assert grid.select_range(cells, "s", 6, 4, 5, 1).count() == 3
    assert [r.cut for r in grid.cap_cells(cells, 4).select("cut").distinct().collect()] == [True] and grid.cap_cells(cells, 4).count() == 4


# ---- search, status, versions


def test_search_order_and_cap(spark):
    models = spark.createDataFrame([("o", '{"slides": [{"name": "S", "shapes": [{"text": "Rate 10%", "name": "K"}]}], "named_ranges": [{"name": "Rate", "formula": "A!B1"}], "kind": "rate", "n": 10, "b": true}'), ("p", "{broken rate")], "path string, payload string")
    views = spark.createDataFrame([("o", "\n".join(["rate"] * 40), 1)], "path string, content string, no int")
    got = search.search_workspace(models, "path", "payload", views, "path", "content", "no", "RATE").orderBy("hit_no").collect()
    assert len(got) == 32 and [(r.source, r.selector_kind) for r in got[:3]] == [("model", "named_ranges"), ("model", "slide"), ("view", None)]
    assert search.search_models(models, "path", "payload", "rate", structure=True).count() == 3
    assert [r.path for r in search.not_indexed(spark.createDataFrame([("x",), ("o",)], "path string"), "path", models, "path").collect()] == ["x"]


def test_status_and_refresh(spark):
    tracked = spark.createDataFrame([("a", 1, 1, "h"), ("b", 1, 1, "h"), ("c", 1, 1, "h"), ("d", 1, 1, "h")], "path string, size long, modified_ns long, source_hash string")
    listing = spark.createDataFrame([("a", 1, 1, "zz"), ("b", 1, 2, "h"), ("c", 2, 2, "x")], "path string, size long, modified_ns long, source_hash string")
    assert {r.path: r.state for r in status.freshness(tracked, listing).collect()} == {"a": "fresh_fast_path", "b": "fresh_after_hash", "c": "stale", "d": "missing"}
    assert {r.path: r.modified_ns for r in status.refresh(tracked, listing).collect()} == {"a": 1, "b": 2, "c": 1, "d": 1}
    rows = spark.createDataFrame([("a.xlsx", "504B0304", ["xl/workbook.xml"]), ("a.docx", "504B0304", ["xl/workbook.xml"]), ("b.pptx", None, None), ("c.pdf", "255044462D31", None), ("d.txt", "00", None), ("e.xlsx", "504B0304", ["x"])], "path string, magic string, parts array<string>")
    assert {r.path: (r.detected, r.score) for r in status.detect_format(rows, "path", "magic", "parts").collect()} == {"a.xlsx": ("xlsx", 100), "a.docx": ("xlsx", 80), "b.pptx": ("pptx", 40), "c.pdf": ("pdf", 100), "d.txt": (None, 0), "e.xlsx": ("xlsx", 10)}


def test_versions(spark):
    rows = spark.createDataFrame([("o", 1, "k", "a"), ("o", 2, "k", "b"), ("o", 2, "m", "c"), ("o", 4, "k", None)], "object_path string, version int, name string, value string")
    at = spark.createDataFrame([("o", 3)], "object_path string, at_version int")
    assert {r.name: r.value for r in versions.as_of(rows, at, ["name"], ["value"]).collect()} == {"k": "b", "m": "c"}
    back = versions.revert(rows, spark.createDataFrame([("o", 2)], "object_path string, version int"), ["name"], ["value"]).collect()
    assert [(r.version, r.revert_of, r.name, r.value) for r in back] == [(5, 2, "k", "a")]
    staged = spark.createDataFrame([("t1", "x")], "tx_id string, payload string")
    after, conflicts = versions.stage(staged, spark.createDataFrame([("t1", "x"), ("t2", "y")], "tx_id string, payload string"))
    assert after.count() == 2 and conflicts.count() == 0
    assert versions.stage(staged, spark.createDataFrame([("t1", "z")], "tx_id string, payload string"))[1].count() == 1
    diff = versions.semantic_diff(rows.where("version = 1"), rows.where("version >= 2 and value is not null"), ["name"], ["value"]).collect()
    assert {(r.name, r.change) for r in diff} == {("k", "changed"), ("m", "added")}
    journals = spark.createDataFrame([("t", "o", "b", "a", True), ("u", "p", "b", "a", False), ("v", "q", "b", "a", False)], "tx_id string, object_path string, before_hash string, after_hash string, committed boolean")
    listing = spark.createDataFrame([("o", "a"), ("p", "b"), ("q", "z")], "object_path string, source_hash string")
    assert {r.tx_id: r.action for r in versions.recover(journals, listing).collect()} == {"t": "finalize", "u": "drop", "v": "leave"}


def test_ids(spark):
    a, b = (one(spark, ids.element_id("cell", F.lit(x), F.lit(y))) for x, y in (("ab", "c"), ("a", "bc")))
    assert a != b and a == ids.element_id_of("cell", "ab", "c") and a.startswith("c_") and len(a) == 26
    assert one(spark, ids.element_id("sheet", F.lit(None), F.lit(3))) == ids.element_id_of("sheet", None, 3)


def test_queries_and_sql_have_the_same_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    with pytest.raises(KeyError):
        entry.queries()["nothing"]
