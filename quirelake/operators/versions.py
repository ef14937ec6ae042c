"""Append-only versions: staging, applying, discarding, reverting, and the history they leave.

Nothing is updated in place. Staged edits, history, cancellations and model versions are rows that are added; what
holds now is the last row of its key. Aggregations with ``max_by`` pre-aggregate before their shuffle, so one hot object
costs a row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stage(staged: DataFrame, new: DataFrame, key: str = "tx_id", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(staged after, conflicts): a known transaction with the same payload changes nothing, with another it is a conflict."""
    known = staged.select(F.col(key), F.col(payload).alias("old_payload"))
    seen = new.join(known, key, "left")
    conflicts = seen.where(F.col("old_payload").isNotNull() & (F.col("old_payload") != F.col(payload))).select(*new.columns)
    added = seen.where(F.col("old_payload").isNull()).select(*new.columns)
    return staged.unionByName(added), conflicts


def staged_in_order(staged: DataFrame) -> DataFrame:
    """The order edits are applied in: by the time as a number, then by transaction."""
    return staged.withColumn("apply_no", F.row_number().over(Window.partitionBy("object_path").orderBy(F.col("staged_at_ms").cast("bigint"), "tx_id")))


def fold(base: DataFrame, ops: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Independent upserts applied at once: of each key and column the last value given wins, others stay.

    ops has the keys, the order and ``columns`` (null: not given) and ``cleared``, the names of columns set to null.
    """
    rank = F.struct(*order)
    last = ops.groupBy(*keys).agg(*[F.max(F.when(F.col(c).isNotNull() | F.array_contains("cleared", c), F.struct(rank.alias("o"), F.col(c).alias("v"), F.lit(True).alias("set")))).alias(f"_{c}") for c in columns])
    both = base.join(last, keys, "full_outer")
    return both.select(*keys, *[F.when(F.col(f"_{c}.set"), F.col(f"_{c}.v")).otherwise(F.col(c)).alias(c) for c in columns])


def last_writes(ops: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key in the given order."""
    rest = [c for c in columns if c not in order]
    return ops.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in columns])


def number_versions(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Versions of each object from 1 on, without gaps, each with its parent."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("version", F.row_number().over(w)).withColumn("parent_version", F.lag("version").over(w))


def next_versions(history: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Numbers for new versions behind the last known ones; only the heads of the history meet the new rows."""
    heads = history.groupBy(key).agg(F.max("version").alias("head"))
    w = Window.partitionBy(key).orderBy(*order)
    return new.join(heads, key, "left").withColumn("version", F.coalesce("head", F.lit(0)) + F.row_number().over(w)).drop("head")


def as_of(versions: DataFrame, wanted: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows as they stood at a version: of each key the last at or before it.

    wanted: object_path, at_version; versions: object_path, version, keys, columns.
    """
    seen = versions.join(wanted, "object_path").where(F.col("version") <= F.col("at_version"))
    return last_writes(seen, ["object_path", *keys], ["version"], columns)


def revert(versions: DataFrame, wanted: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """What a revert of a version adds: a new version with the rows from before it, naming what it reverts.

    wanted: object_path, version (the one to undo).
    """
    heads = versions.groupBy("object_path").agg(F.max("version").alias("head"))
    back = as_of(versions, wanted.select("object_path", (F.col("version") - 1).alias("at_version")), keys, columns)
    undone = wanted.select("object_path", F.col("version").alias("revert_of"))
    return back.join(heads, "object_path").join(undone, "object_path").select("object_path", (F.col("head") + 1).alias("version"), "revert_of", *keys, *columns)


def semantic_diff(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, change, before, after): rows added, removed or changed, with both values as JSON."""
    pack = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    a = before.select(*keys, pack(columns).alias("before"))
    b = after.select(*keys, pack(columns).alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return a.join(b, keys, "full_outer").withColumn("change", kind).where(F.col("change").isNotNull())


def discard(staged: DataFrame, tx_ids: DataFrame, at_ms: Column | int) -> tuple[DataFrame, DataFrame]:
    """(staged after, audit rows of what was dropped)."""
    gone = staged.join(tx_ids, "tx_id", "left_semi")
    return staged.join(tx_ids, "tx_id", "left_anti"), gone.select("tx_id", "object_path", (F.lit(at_ms) if isinstance(at_ms, int) else at_ms).alias("cancelled_at_ms"))


def history_summary(history: DataFrame) -> DataFrame:
    """(object_path, version, summary): the kind of each operation and what it was done to, in order of versions."""
    first = F.get("semantic_diff", F.lit(0))["target"]
    kinds = F.array_join(F.transform("ops", lambda o: o["kind"]), ", ")
    return history.select("object_path", "version", F.concat_ws(" ", kinds, first).alias("summary"), "tx_id", "revert_of")


def recover(journals: DataFrame, listing: DataFrame) -> DataFrame:
    """What to do with journals left behind: finalize those whose result is in place, drop those whose source is untouched."""
    seen = journals.join(listing.select("object_path", F.col("source_hash").alias("now_hash")), "object_path", "left")
    action = F.when(F.col("now_hash") == F.col("after_hash"), "finalize").when(~F.col("committed") & (F.col("now_hash") == F.col("before_hash")), "drop").otherwise("leave")
    return seen.select("tx_id", "object_path", action.alias("action"))
