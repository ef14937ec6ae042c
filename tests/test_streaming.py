import json

from pyspark.sql import functions as F

from quirelake.operators import snapshots, status
from quirelake.sources import files
from quirelake.streaming import access, arrivals


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_windowed_rollup_equals_batch(spark, tmp_path):
    rows = [(i, f"o{i % 3}", 1_700_000_000_000 + i * 40_000, i % 2 == 0, None if i % 5 == 0 else i) for i in range(200)]
    schema = "access_id long, object_path string, timestamp_unix_ms long, model_cache_hit boolean, estimated_tokens int"
    df = spark.createDataFrame([*rows, rows[7], rows[9]], schema).withColumn("view_cache_hit", F.lit(False))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    rolled = access.windowed_rollup(access.table_stream(spark, str(tmp_path / "in"), df, 10), "5 minutes", "1 day", "access_id")
    drain(rolled.writeStream.outputMode("complete").format("memory").queryName("rolled").start())
    got = {(r.window_start, r.object_path): (r.accesses, r.model_hits, r.tokens_served) for r in spark.table("rolled").collect()}
    once = df.dropDuplicates(["access_id"]).groupBy(F.window(F.timestamp_millis("timestamp_unix_ms"), "5 minutes").getField("start").alias("w"), "object_path").agg(F.count(F.lit(1)).alias("n"), F.count_if("model_cache_hit").alias("m"), F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("t"))
    assert got == {(r.w, r.object_path): (r.n, r.m, r.t) for r in once.collect()}


def test_access_lines_stream(spark, tmp_path):
    lines = [json.dumps({"operation": "read", "object_path": "a", "timestamp_unix_ms": 1, "estimated_tokens": 5}), "{broken", json.dumps({"object_path": "a"}), ""]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "access.jsonl").write_text("\n".join(lines))
    drain(access.access_stream(spark, str(tmp_path / "log")).writeStream.format("memory").queryName("lines").start())
    assert [(r.operation, r.estimated_tokens) for r in spark.table("lines").collect()] == [("read", 5)]
    assert status.access_rollup(spark.table("lines"), "object_path").first().tokens_served == 5


def test_snapshot_stream(spark, tmp_path):
    schema = "object_path string, snapshot_no int, name string, part_hash string"
    for no, rows in enumerate([[("o", 1, "a", "1"), ("o", 1, "b", "1")], [("o", 3, "A", "2"), ("o", 3, "c", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"batch={no}"))
    like = spark.createDataFrame([], schema)
    found = []
    index = snapshots.SnapshotIndex(spark, str(tmp_path / "index"), buckets=2)
    stream = access.table_stream(spark, str(tmp_path / "in"), like).select("object_path", "snapshot_no", "name", "part_hash")
    drain(access.snapshot_changes(stream, index, lambda df, n: found.extend((r.name, r.change_kind) for r in df.collect())).start())
    assert sorted(found) == [("a", "changed"), ("b", "removed"), ("c", "added")]


def test_version_stream(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([("o", f"t{k}a"), ("o", f"t{k}b"), (f"p{k}", "x")], "object_path string, tx_id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("object_path string, tx_id string").parquet(str(tmp_path / "in"))
    drain(access.version_stream(stream).writeStream.outputMode("append").format("memory").queryName("versions").start())
    got = {(r.object_path, r.version) for r in spark.table("versions").collect()}
    assert got == {("o", 1), ("o", 2), ("o", 3), ("o", 4), ("p0", 1), ("p1", 1)}


def test_file_arrivals(spark, tmp_path):
    from test_sources import deck, document

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.docx").write_bytes(document())
    (tmp_path / "in/note.txt").write_text("no document")
    store, batches = str(tmp_path / "objects"), []
    spark.createDataFrame([], "object_path string, source_hash string").write.parquet(store)

    def sink(objects, entities, number):
        objects.select("object_path", "source_hash").write.mode("append").parquet(store)
        batches.append(sorted({(r.object_path, r.entity) for r in entities.collect()}))

    def run():
        query = arrivals.parsed_arrivals(arrivals.file_stream(spark, "file://" + str(tmp_path / "in")), lambda: spark.read.parquet(store), sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    (tmp_path / "in/sub/b.pptx").write_bytes(deck())
    run()
    assert {p for b in batches for p, _ in b} == {"a.docx", "sub/b.pptx"} and len(batches) == 2
    assert {p for p, _ in batches[1]} == {"sub/b.pptx"}
    assert files.hashes(spark.createDataFrame([("a.docx",)], "path string"), str(tmp_path / "in")).first().source_hash == spark.read.parquet(store).where("object_path = 'a.docx'").first().source_hash
