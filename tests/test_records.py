import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quirelake.operators import dewey, hierarchy, search, snapshots


def labels(payload):
    text = payload if isinstance(payload, (str, type(None))) else json.dumps(payload)
    return {(label, label[:cut]) for label, cut, *_ in dewey.label_records(text)}


def test_dewey_cases():
    assert labels({"sheets": [{"cells": [{"a": 1}, None, {"b": 2}]}]}) == {("sheets[0]", ""), ("sheets[0].cells[0]", "sheets[0]"), ("sheets[0].cells[2]", "sheets[0]")}
    assert labels({"slides": {"shapes": {"text": "x"}}}) == {("slides[0]", ""), ("slides[0].shapes[0]", "slides[0]")}
    assert labels({"pages": json.dumps([{"n": 1}, json.dumps({"n": 2})])}) == {("pages[0]", ""), ("pages[1]", "")}
    assert labels(json.dumps(json.dumps({"fields": [{}]}))) == {("fields[0]", "")}
    assert labels({"x": [{"tables": [{"meta": {"cells": [{}]}}]}]}) == {("x[0].tables[0]", ""), ("x[0].tables[0].meta.cells[0]", "x[0].tables[0]")}
    assert labels({"charts": "preserved", "items": [{"a": 1}], "cells": [[{"a": 1}]], "comments": None}) == set()
    assert labels("﻿" + json.dumps({"pages": [{}]})) == {("pages[0]", "")}
    for bad in (None, "", "   ", "null", "[]", '{"pages": [{}', '{"pages": [NaN]}', '{"pages": [{}]} x', "{'pages': [{}]}"):
        assert labels(bad) == set()


def test_dewey_deep_documents():
    deep = '{"x":' * 60_000 + '{"cells":[{"v":"é\\n"}]}' + "}" * 60_000
    assert len(labels(deep)) == 1
    assert labels(deep[:-1]) == set()
    for text in ('{"a":[1,2,{"b":null,"c":[]}],"d":{},"e":-1.5e3}', "[]", "{}", '"x"', '[1,{"a":[true,false]}]'):
        assert dewey._load_deep(text) == json.loads(text)
    for text in ("[1,]", '{"a"}', '{"a":1,}', "[1 2]", "{1:2}", "]", "[}", "[", "1 2"):
        with pytest.raises(ValueError):
            dewey._load_deep(text)


def test_dewey_rows(spark):
    t = [datetime(2025, 1, d) for d in (1, 2)]
    doc = json.dumps({"sheets": [{"name": "A", "cells": [{"address": "A1", "value": {"kind": "float", "value": 1.5}}]}]})
    df = spark.createDataFrame([(1, doc, t[0], "x"), (1, doc, t[1], "y"), (2, None, t[0], None), (3, "{", t[0], None), (None, doc, t[0], None), (4, doc, None, None)], "artifact_id long, payload string, parsed_at timestamp, record_path string")
    rows = dewey.flatten_records(df, "artifact_id", "payload", "parsed_at")
    assert sorted((r.artifact_id or 0, r.record_path, r.parent_path, r.schema_path, r.depth) for r in rows.collect()) == sorted((k, *x) for k in (0, 1, 4) for x in (("sheets[0]", "", "sheets", 1), ("sheets[0].cells[0]", "sheets[0]", "sheets.cells", 2)))
    cells = dewey.record_table(rows, "artifact_id", ("sheets.cells",), {"address": "string", "value.value": "double"}).where("artifact_id = 1").collect()
    assert [(c.address, c.value_value) for c in cells] == [("A1", 1.5)]
    assert dewey.flatten_records(df.limit(0), "artifact_id", "payload", "parsed_at").count() == 0


def test_dewey_keeps_numbers_and_survives_half_surrogates(spark):
    texts = [
        '{"pages": [{"text": "a\\ud800b", "n": 1.50, "big": 1e400, "long": 0.1234567890123456789012, "i": 12345678901234567890123, "ok": 2.5, "pair": "\\ud83d\\ude00", "back": "\\\\ud800"}]}',
        '{"pages": [{"text": "sound", "n": 2.5}]}',
        json.dumps({"pages": json.dumps([{"text": "in", "n": "x"}]).replace("in", "\\ud800").replace('"x"', "7.10")}),
    ]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "artifact_id long, payload string, parsed_at long")
    rows = {r.artifact_id: r.record for r in dewey.flatten_records(df, "artifact_id", "payload", "parsed_at").collect()}
    assert rows[0] == '{"text": "a\ufffdb", "n": 1.50, "big": 1e400, "long": 0.1234567890123456789012, "i": 12345678901234567890123, "ok": 2.5, "pair": "😀", "back": "\\\\ud800"}'
    assert rows[1] == '{"text": "sound", "n": 2.5}' and rows[2] == '{"text": "\ufffd", "n": 7.10}'
    pages = dewey.record_table(dewey.flatten_records(df, "artifact_id", "payload", "parsed_at"), "artifact_id", ("pages",), {"text": "string"})
    assert {r.artifact_id: r.text for r in pages.collect()} == {0: "a\ufffdb", 1: "sound", 2: "\ufffd"}
    deep = '{"x":' * 5_000 + '{"pages":[{"v":1.50}]}' + "}" * 5_000
    assert [dewey.own_fields(r, frozenset()) for *_, r in dewey.label_records(deep, as_written=True)] == ['{"v": 1.50}']
    assert [r.leaf for r in search.model_leaves(df.where("artifact_id = 0"), "artifact_id", "payload").where("key_path like '%text'").collect()] == ["a\ufffdb"]


def test_dewey_tables_by_schema_path(spark, tmp_path):
    docs = [{"sheets": [{"name": "A", "cells": [{"address": "A1"}, {"address": "A2"}]}]}, {"slides": [{"tables": [{"cells": {"row": 1}}], "shapes": [{"text": "x"}]}]}, {"model": {"sheets": [{"cells": [{"address": "B1"}]}]}}]
    df = spark.createDataFrame([(i, json.dumps(d), i, "z") for i, d in enumerate(docs)], "artifact_id long, payload string, parsed_at long, list_name string")
    rows = dewey.flatten_records(df, "artifact_id", "payload", "parsed_at")
    written = dewey.write_tables(rows, "file://" + str(tmp_path / "tables"))
    assert sorted(map(tuple, written.select(sorted(rows.columns)).collect())) == sorted(map(tuple, rows.select(sorted(rows.columns)).collect()))
    cells = dewey.record_table(written, "artifact_id", ("sheets.cells",), {"address": "string"})
    assert sorted((r.record_path, r.address) for r in cells.collect()) == [("model.sheets[0].cells[0]", "B1"), ("sheets[0].cells[0]", "A1"), ("sheets[0].cells[1]", "A2")]
    assert [r.record_path for r in dewey.record_table(written, "artifact_id", ("tables.cells",), {"row": "int"}).collect()] == ["slides[0].tables[0].cells[0]"]
    only = dewey.flatten_records(df, "artifact_id", "payload", "parsed_at", only=["shapes"])
    assert [r.schema_path for r in only.collect()] == ["slides.shapes"]


def brute(parents):
    out = {}
    for n in parents:
        seen, x = [], n
        while x is not None and x not in seen:
            seen.append(x)
            x = parents[x]
        if x is None:
            out[n] = (seen[-1], len(seen) - 1, "tree")
        else:
            out[n] = ("", -1, "cycle" if x == n else "below_cycle")
    return out


@pytest.mark.parametrize("fragment_rows", [7, 40, 100_000])
def test_hierarchy_against_brute_force(spark, fragment_rows):
    rng = random.Random(fragment_rows)
    groups = {}
    for g in ("a", "b", "big"):
        n = 160 if g == "big" else 25
        parents = {}
        for i in range(n):
            kind = rng.random()
            parents[f"c{i}"] = None if kind < 0.08 else f"c{rng.randrange(n)}" if kind < 0.35 else f"c{max(0, i - rng.randrange(1, 4))}" if i else None
        groups[g] = parents
    groups["ring"] = {f"c{i}": f"c{(i + 1) % 60}" for i in range(60)} | {f"d{i}": f"d{i - 1}" if i else "c3" for i in range(30)} | {"self": "self"}
    groups["chain"] = {f"c{i}": f"c{i - 1}" if i else None for i in range(120)}
    rows = [(g, n, p) for g, ps in groups.items() for n, p in ps.items()]
    nodes = spark.createDataFrame(rows, "grp string, node string, parent string")
    got = {(r.grp, r.node): (r.root_id, r.node_depth, r.node_state) for r in hierarchy.hierarchy(nodes, fragment_rows).collect()}
    assert got == {(g, n): v for g, ps in groups.items() for n, v in brute(ps).items()}


def test_hierarchy_paths_against_brute_force(spark):
    parents = {f"c{i}": f"c{i - 1}" if i else None for i in range(90)} | {f"r{i}": f"r{(i + 1) % 9}" for i in range(9)} | {"t": "r0", "u": "t"}
    parents |= {f"b{i}": f"b{i // 2}" if i else None for i in range(70)} | {"x\x1f1": "c5", "x\x1e0": "x\x1f1", "y": "x\x1e0"}

    def up(n):
        out = [n]
        while parents[out[-1]] is not None:
            out.append(parents[out[-1]])
        return out[::-1]

    nodes = spark.createDataFrame([("g", n, p) for n, p in parents.items()], "grp string, node string, parent string")
    want = {n: up(n) for n, (_, _, state) in brute(parents).items() if state == "tree"}
    for rows in (6, 30, None):
        assert {r.node: r.path for r in hierarchy.paths(nodes, rows).collect()} == want


def test_hierarchy_contracts_long_chains(spark):
    n = 60_000
    chain = spark.range(n).select(F.lit("g").alias("grp"), F.concat(F.lit("c"), "id").alias("node"), F.when(F.col("id") > 0, F.concat(F.lit("c"), F.col("id") - 1)).alias("parent"))
    levels = []
    solved = hierarchy.hierarchy(chain, n // 12, levels)
    assert solved.where(F.col("node_depth") != F.substring("node", 2, 9).cast("int")).isEmpty() and solved.count() == n
    assert len(levels) > 4 and all(b < 0.75 * a for a, b in zip(levels, levels[1:]))  # every level shrinks


def test_hierarchy_links_paths_and_empty(spark):
    rows = [("o", " C_1", "c_0 ", "element"), ("o", "c_1", "C_0", "element"), ("o", "c_2", "c_1", "element"), ("o", "c_3", "zz", "selector"), ("o", None, "c_1", "element"), ("o", " ", None, "element"), (None, "c_9", None, "element"), ("o", "c_4", None, "element"), ("p", "c_2", "c_1", None)]
    df = spark.createDataFrame(rows, "object_path string, f string, t string, k string")
    nodes = hierarchy.links(df, "object_path", "f", "t", F.col("k") == "element")
    solved = hierarchy.hierarchy(nodes)
    assert {(r.grp, r.node): r.node_depth for r in solved.collect()} == {("o", "c_0"): 0, ("o", "c_1"): 1, ("o", "c_2"): 2, ("o", "c_3"): 0, ("o", "c_4"): 0, ("p", "c_2"): 0}
    listed = hierarchy.paths(nodes)
    above = hierarchy.ancestors(listed)
    assert sorted((r.ancestor, r.node, r.distance) for r in above.collect()) == [("c_0", "c_1", 1), ("c_0", "c_2", 2), ("c_1", "c_2", 1)]
    assert {r.node: "/".join(r.path) for r in listed.where("grp = 'o'").collect()} == {"c_0": "c_0", "c_1": "c_0/c_1", "c_2": "c_0/c_1/c_2", "c_3": "c_3", "c_4": "c_4"}
    assert {(r.node, r.descendants, r.height) for r in hierarchy.descendant_counts(above).collect()} == {("c_0", 2, 2), ("c_1", 1, 1)}
    empty = nodes.limit(0)
    assert hierarchy.hierarchy(empty).count() == 0


SNAP = "object_path string, snapshot_no int, name string, part_hash string, hash string"


def test_snapshot_replay_and_index(spark):
    rows = [
        ("o", 1, "a.xml", "AA", "x"), ("o", 1, "/B.xml", None, "x"), ("o", 1, "c", "cc", None), ("o", 1, "c", "cc", None),
        ("o", 4, "A.XML", "aa", "y"), ("o", 4, "b.xml", "bb", "x"), ("o", 4, "\\d\\e", "dd", "x"),
        ("o", 5, "a.xml", None, "x"), ("o", 5, "b.xml", "BB", "x"), ("o", 5, "d/e", "dd", "x"),
        ("q", 2, "z", "1", "x"), (None, 1, "z", "1", "x"), ("q", None, "z", "1", "x"), ("q", 3, None, "1", "x"),
    ]
    df = spark.createDataFrame(rows, SNAP)
    got = sorted((r.object_path, r.snapshot_no, r.name, r.change_kind) for r in snapshots.replay(df, "object_path", "snapshot_no", "name", "part_hash").collect())
    want = [("o", 4, "b.xml", "changed"), ("o", 4, "c", "removed"), ("o", 4, "d/e", "added"), ("o", 5, "a.xml", "changed")]
    assert got == want
    assert snapshots.replay(df.limit(0), "object_path", "snapshot_no", "name", "part_hash").count() == 0
    names = ("object_path", "snapshot_no", "name", "part_hash")

    def drained(changes):
        return [(r.object_path, r.snapshot_no, r.name, r.change_kind) for r in changes.collect()]

    index, one_by_one = snapshots.SnapshotIndex(spark, buckets=4), []
    for no in (1, 4, 5):
        one_by_one += drained(index.deliver(df.where(f"snapshot_no = {no}"), *names))
    assert sorted(one_by_one) == want
    assert drained(index.deliver(df.where("snapshot_no = 4"), *names)) == []  # not newer than what is known


def test_snapshot_index_restart_and_untouched_buckets(spark, tmp_path):
    def snapshot(obj, no, **hashes):
        return spark.createDataFrame([(obj, no, n, h) for n, h in hashes.items()], "object_path string, snapshot_no int, name string, part_hash string")

    def files():
        return {str(f.relative_to(tmp_path)): f.stat().st_mtime_ns for f in (tmp_path / "index/data").rglob("*.parquet")}

    def drained(changes):
        return sorted((r.object_path, r.snapshot_no, r.name, r.change_kind) for r in changes.collect())

    names, place = ("object_path", "snapshot_no", "name", "part_hash"), "file://" + str(tmp_path / "index")
    index = snapshots.SnapshotIndex(spark, place, buckets=3)
    assert drained(index.deliver(snapshot("still", 1, a="1", b="2"), *names)) == []
    still = files()
    assert drained(index.deliver(snapshot("o", 1, a="1", b="2"), *names)) == []
    again = snapshots.SnapshotIndex(spark, place)  # as a driver that starts again
    assert (again.version, again.live, again.buckets) == (2, [0, 1], 3)
    with pytest.raises(ZeroDivisionError):
        again.deliver(snapshot("o", 2, a="9"), *names, sink=lambda changes: 1 / 0)
    both = snapshot("o", 2, a="1", c="3").unionByName(snapshot("o", 7, a="2", c="3"))
    assert drained(snapshots.SnapshotIndex(spark, place).deliver(both, *names)) == [("o", 2, "b", "removed"), ("o", 2, "c", "added"), ("o", 7, "a", "changed")]
    assert still.items() <= files().items()  # what was not delivered has not moved
    assert not any("gen=1/" in f or "gen=2/" in f for f in files())  # what no head names is gone
    index = snapshots.SnapshotIndex(spark, place)
    for k in range(snapshots.LIVE_GENERATIONS):
        index.deliver(snapshot(f"p{k}", 1, a="1"), *names)
    assert len(index.live) <= snapshots.LIVE_GENERATIONS
    assert drained(snapshots.SnapshotIndex(spark, place).deliver(snapshot("still", 2, a="1", b="3").unionByName(snapshot("p0", 3, b="1")), *names)) == [("p0", 3, "a", "removed"), ("p0", 3, "b", "added"), ("still", 2, "b", "changed")]


def test_snapshot_probe_needs_no_shuffle(spark):
    df = spark.createDataFrame([("o", s, f"n{k}", str(s * k % 3)) for s in range(40) for k in range(5)], "object_path string, snapshot_no int, name string, part_hash string")
    changes = snapshots.replay(df.where("snapshot_no < 4"), "object_path", "snapshot_no", "name", "part_hash")
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") + plan.count("BroadcastHashJoin") == 3 and "Exchange" not in plan
    brute = sum(str(s * k % 3) != str((s - 1) * k % 3) for s in range(1, 40) for k in range(5))
    assert snapshots.replay(df, "object_path", "snapshot_no", "name", "part_hash").count() == brute  # more probes than one plan holds
