"""What changed between full snapshots.

A key-to-hash index of the last snapshot is kept in buckets of the key (``SnapshotIndex``); the rows of a new snapshot
probe it bucket by bucket, without a shuffle; old values are fetched only for the keys that changed; then the index of
the new snapshot takes the old one's place by a moved pointer. ``replay`` takes a whole history through such an index:
every delivery is one generation of it, and probes the generation before.

Defined cases: names compare without case, leading slashes and direction of slashes, hashes without case; a null hash
is a value of its own; of rows that repeat a name within a snapshot the greatest hash counts (a null only if there is no
other); rows with a null object, snapshot number or name are no entries; the first snapshot of an object gives nothing;
a snapshot that is not newer than the last delivered one of its object is no news; extra columns are ignored; empty
tables give none.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.session import durable, files_in, make_folder, partitions_for, read_text, remove, shared_place, write_text

NO_HASH = "-"
#: Rows of one bucket over all generations that are written together.
BUCKET_ROWS = 500_000
#: Probes that one plan holds; longer histories write the changes of so many deliveries before they go on.
PLAN_PROBES = 32
#: Generations that may hold last snapshots before they are written together into one.
LIVE_GENERATIONS = 8


def plain_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(name, "\\", "/"), "^/+", ""))


def plain_hash(value: Column) -> Column:
    """The hash in lower case; a marker that is no hash, and sorts before all, for null."""
    return F.coalesce(F.lower(value), F.lit(NO_HASH))


#: The probe of the last index by new rows: one row for each key added, removed or changed.
PROBE = """SELECT object_path, coalesce(n.snapshot_no, o.next_no) AS snapshot_no, name,
       CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' ELSE 'changed' END AS change_kind, o.hash AS old_hash, n.hash
FROM ({new}) n FULL JOIN ({index}) o USING (object_path, name) WHERE n.hash IS NULL OR o.hash IS NULL OR n.hash <> o.hash"""


def _delivered(rows: DataFrame) -> DataFrame:
    """(object_path, snapshot_no, entries) of each snapshot; reads no hashes."""
    return rows.groupBy("object_path", "snapshot_no").agg(F.count(F.lit(1)).alias("entries"))


class SnapshotIndex:
    """The key-to-hash index of the last snapshot of every object, on files, in buckets of (object, name).

    Each delivery is a *generation*: a partition of one bucketed table, so that new rows and the index they probe lie in
    the same buckets and meet without a shuffle, and a hot object is spread over all of them. A table of heads says which
    generation holds the last snapshot of each object; what was not delivered stays where it is. The swap writes the
    heads, then a numbered pointer file by one rename; what no head names any more is removed after it. A driver that
    starts again reads the pointer, and removes what a broken delivery left behind.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.buckets = spark, buckets
        self.path = path or shared_place(spark, "index")
        self.table = f"quirelake_index_{zlib.crc32(self.path.encode()):08x}"
        self.version, self.live = 0, []
        for version in sorted((int(n[8:-5]) for n in files_in(spark, self.path) if n.startswith("pointer-") and n.endswith(".json")), reverse=True)[:1]:
            kept = json.loads(read_text(spark, f"{self.path}/pointer-{version}.json"))
            self.version, self.live, self.buckets = version, kept["live"], kept["buckets"]
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self._registered = False

    # ---- generations

    def _register(self) -> None:
        if not self._registered:
            make_folder(self.spark, f"{self.path}/data")
            self.spark.sql(
                f"CREATE TABLE {self.table} (object_path STRING, name STRING, hash STRING, snapshot_no BIGINT, next_no BIGINT, gen INT) USING parquet PARTITIONED BY (gen) "
                f"CLUSTERED BY (object_path, name) INTO {self.buckets} BUCKETS LOCATION '{self.path}/data'"
            )
            self._registered = True
        self.spark.sql(f"MSCK REPAIR TABLE {self.table}")

    def heads(self) -> DataFrame:
        """(object_path, snapshot_no, gen) of the last snapshot of each object."""
        schema = "object_path string, snapshot_no bigint, gen int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/heads-{self.version}") if self.version else self.spark.createDataFrame([], schema)

    def _append(self, rows: DataFrame) -> None:
        """Write (object_path, name, hash, snapshot_no, next_no, gen) in buckets."""
        names = ["object_path", "name", "hash", "snapshot_no", "next_no", "gen"]
        for number in {int(n[4:]) for n in files_in(self.spark, f"{self.path}/data") if n.startswith("gen=")} - set(self.live):
            remove(self.spark, f"{self.path}/data/gen={number}")  # of a delivery that broke off
        self._register()
        rows.select(names).write.mode("append").format("parquet").partitionBy("gen").bucketBy(self.buckets, "object_path", "name").saveAsTable(self.table)
        self._register()

    # ---- deliveries

    def probe_all(self, df: DataFrame, obj: str, seq: str, name: str, value: str) -> tuple[DataFrame, DataFrame]:
        """What the snapshots in ``df`` change, in the order of their numbers, and (object_path, snapshot_no, gen) of the last of each object.

        Nothing is swapped yet. Snapshots of different objects that are equally far in their object's order share a generation.
        """
        spark = df.sparkSession  # of a stream's batch, this is another one
        rows = df.select(F.col(obj).alias("object_path"), F.col(seq).cast("bigint").alias("snapshot_no"), F.col(name).alias("name"), F.col(value).alias("value"))
        rows = rows.where("object_path is not null and snapshot_no is not null and name is not null")
        order = Window.partitionBy("object_path").orderBy("snapshot_no")
        old = self.heads().select("object_path", F.col("snapshot_no").alias("head_no"), F.col("gen").alias("head_gen"))
        news = _delivered(rows).join(old, "object_path", "left").where("head_no is null or snapshot_no > head_no") if self.version else _delivered(rows).withColumns({"head_no": F.lit(None).cast("bigint"), "head_gen": F.lit(None).cast("int")})
        first = max(self.live, default=-1) + 1
        # small and written: the planner sees its size, and whether it may be sent to all
        known = durable(news.select("object_path", "snapshot_no", "entries", "head_no", "head_gen", (F.row_number().over(order) - 1 + first).cast("int").alias("gen"), F.lead("snapshot_no").over(order).alias("next_no")), "deliveries")
        last_gen, entries = known.agg(F.max("gen"), F.sum("entries")).first()
        nothing = spark.createDataFrame([], "object_path string, snapshot_no bigint, name string, change_kind string, old_hash string, hash string")
        if last_gen is None:
            return nothing, known.select("object_path", "snapshot_no", "gen")
        self.buckets = self.buckets or partitions_for(spark, entries, BUCKET_ROWS)
        placed = rows.join(known.select("object_path", "snapshot_no", "gen", "next_no"), ["object_path", "snapshot_no"]).select("object_path", plain_name(F.col("name")).alias("name"), "snapshot_no", "gen", "next_no", plain_hash(F.col("value")).alias("hash"))
        self._append(placed.repartition(self.buckets, "object_path", "name").groupBy("object_path", "name", "snapshot_no", "gen", "next_no").agg(F.max("hash").alias("hash")))
        generation = f"SELECT object_path, name, hash, snapshot_no, next_no FROM {self.table} WHERE gen = "
        probes, met = [], {}
        for gen in self.live:  # at most LIVE_GENERATIONS
            met[f"met{gen}"] = known.where((F.col("gen") == first) & (F.col("head_gen") == gen)).select("object_path", F.col("snapshot_no").alias("new_no"))
            probes.append(PROBE.format(
                new=f"{generation}{first} AND object_path IN (SELECT object_path FROM {{met{gen}}})",
                index=f"SELECT object_path, name, hash, new_no AS next_no FROM ({generation}{gen}) JOIN {{met{gen}}} USING (object_path)",
            ))
        probes += [PROBE.format(new=f"{generation}{gen}", index=f"{generation}{gen - 1} AND next_no IS NOT NULL") for gen in range(first + 1, last_gen + 1)]
        blocks = [spark.sql(" UNION ALL ".join(probes[at : at + PLAN_PROBES]), **met) for at in range(0, len(probes), PLAN_PROBES)]
        changes = blocks[0] if len(blocks) == 1 else reduce(DataFrame.unionByName, [durable(block, "changes") for block in blocks], nothing)
        changes = changes.withColumn("snapshot_no", F.col("snapshot_no").cast(df.schema[seq].dataType))
        return changes, known.where("next_no is null").select("object_path", "snapshot_no", "gen")

    def deliver(self, df: DataFrame, obj: str, seq: str, name: str, value: str, sink: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Take full snapshots of some objects, give what changed (first to ``sink``, if there is one), and swap the index.

        If the sink fails, the index stays as it was.
        """
        changes, last = self.probe_all(df, obj, seq, name, value)
        changes = durable(changes, "changes")
        if sink:
            sink(changes)
        self._swap(last)
        return changes

    def _swap(self, last: DataFrame) -> None:
        if last.isEmpty():
            return
        kept = self.heads().join(last, "object_path", "left_anti").unionByName(last)
        heads = f"{self.path}/heads-{self.version + 1}"
        remove(self.spark, heads)
        kept.select("object_path", "snapshot_no", "gen").write.parquet(heads)
        live = sorted(r[0] for r in self.spark.read.parquet(heads).select("gen").distinct().collect())
        if len(live) > LIVE_GENERATIONS:
            live = [self._together(heads, live)]
        version, gone = self.version + 1, set(self.live) - set(live)
        write_text(self.spark, f"{self.path}/pointer-{version}.json", json.dumps({"live": live, "buckets": self.buckets}))
        self.version, self.live = version, live
        for number in {int(n[4:]) for n in files_in(self.spark, f"{self.path}/data") if n.startswith("gen=")} - set(live) | gone:
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (gen={number})")
            remove(self.spark, f"{self.path}/data/gen={number}")
        remove(self.spark, f"{self.path}/heads-{version - 1}")
        remove(self.spark, f"{self.path}/pointer-{version - 1}.json")
        self.spark.catalog.refreshTable(self.table)

    def _together(self, heads: str, live: list[int]) -> int:
        """Write the last snapshots of all generations into one, each bucket from its own rows."""
        number = max(live) + 1
        known = self.spark.read.parquet(heads)
        rows = self.spark.table(self.table).where(F.col("gen").isin(live)).join(known.select("object_path", "gen"), ["object_path", "gen"], "left_semi")
        self.live = live
        self._append(rows.withColumn("gen", F.lit(number)).withColumn("next_no", F.lit(None).cast("bigint")).repartition(self.buckets, "object_path", "name"))
        moved = durable(known.withColumn("gen", F.lit(number)), "heads")
        moved.write.mode("overwrite").parquet(heads)
        return number


def replay(df: DataFrame, obj: str, seq: str, name: str, value: str) -> DataFrame:
    """(object_path, snapshot_no, name, change_kind, old_hash, hash) over all deliveries of all objects, through an index."""
    return SnapshotIndex(df.sparkSession).probe_all(df, obj, seq, name, value)[0]


def with_old_values(changes: DataFrame, df: DataFrame, obj: str, seq: str, name: str, value: str, columns: list[str]) -> DataFrame:
    """Changed entries with the old and new of ``columns``: read only for the keys that changed."""
    hit = changes.where("change_kind = 'changed'")
    order = Window.partitionBy("object_path").orderBy("snapshot_no")
    delivered = df.where(F.col(obj).isNotNull() & F.col(seq).isNotNull() & F.col(name).isNotNull()).select(F.col(obj).alias("object_path"), F.col(seq).alias("snapshot_no"))
    known = delivered.distinct().withColumn("before_no", F.lag("snapshot_no").over(order))
    hit = hit.select("object_path", "snapshot_no", "name").join(known, ["object_path", "snapshot_no"])
    wanted = hit.select("object_path", F.explode(F.array("snapshot_no", "before_no")).alias("snapshot_no"), "name").distinct()
    rows = df.select(F.col(obj).alias("object_path"), F.col(seq).alias("snapshot_no"), plain_name(F.col(name)).alias("name"), F.col(value).alias("_hash"), *[F.col(c) for c in columns])
    found = rows.join(wanted, ["object_path", "snapshot_no", "name"], "left_semi").groupBy("object_path", "snapshot_no", "name").agg(*[F.max_by(c, plain_hash(F.col("_hash"))).alias(c) for c in columns])
    old = found.select("object_path", F.col("snapshot_no").alias("before_no"), "name", *[F.col(c).alias(f"old_{c}") for c in columns])
    new = found.select("object_path", "snapshot_no", "name", *[F.col(c).alias(f"new_{c}") for c in columns])
    return hit.join(new, ["object_path", "snapshot_no", "name"]).join(old, ["object_path", "before_no", "name"])
