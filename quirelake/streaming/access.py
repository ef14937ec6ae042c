"""Streams over the two append-only logs: accesses rolled up by windows, snapshots compared as they arrive, files parsed.

Late rows: the watermark says how long a window waits; what comes later is dropped by it, and a repeated row within the
watermark counts once. Sinks that need exactly-once keep their state by batch number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators.snapshots import SnapshotIndex
from quirelake.operators.status import parse_access_lines


def windowed_rollup(log: DataFrame, window: str = "5 minutes", late: str = "10 minutes", key: str | None = None) -> DataFrame:
    """(window_start, object_path, accesses, model_hits, view_hits, tokens_served) of a streaming access log.

    ``key`` names a column that is the same in both copies of a row that arrives twice.
    """
    timed = log.withColumn("ts", F.timestamp_millis("timestamp_unix_ms")).withWatermark("ts", late)
    once = timed.dropDuplicatesWithinWatermark([key]) if key else timed
    rolled = once.groupBy(F.window("ts", window).alias("w"), "object_path").agg(F.count(F.lit(1)).alias("accesses"), F.count_if("model_cache_hit").alias("model_hits"), F.count_if("view_cache_hit").alias("view_hits"), F.coalesce(F.sum(F.col("estimated_tokens").cast("bigint")), F.lit(0)).alias("tokens_served"))
    return rolled.select(F.col("w.start").alias("window_start"), "object_path", "accesses", "model_hits", "view_hits", "tokens_served")


def access_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of the access log as they are appended; broken lines are skipped."""
    return parse_access_lines(spark.readStream.format("text").load(folder), "value")


def table_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a table as they arrive."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def snapshot_changes(stream: DataFrame, index: SnapshotIndex, sink: Callable[[DataFrame, int], None]):
    """A writer that compares each micro-batch of full snapshots with the index of the last and passes on what changed.

    A batch that is run again after a failure finds the index as it was before: the pointer moves only when the sink is done.
    """

    def run(batch: DataFrame, number: int) -> None:
        index.deliver(batch, "object_path", "snapshot_no", "name", "part_hash", lambda changes: sink(changes, number))

    return stream.writeStream.foreachBatch(run)


def version_stream(stream: DataFrame, schema: str = "object_path string, version bigint, tx_id string"):
    """Versions numbered as edits arrive, by a state that holds the head of each object.

    stream: object_path, tx_id. Rows of one micro-batch are numbered by transaction.
    """
    import pandas as pd

    def run(key, frames, state):
        head = state.get[0] if state.exists else 0
        for frame in frames:
            ordered = frame.sort_values("tx_id")
            numbers = range(head + 1, head + 1 + len(ordered))
            head += len(ordered)
            yield pd.DataFrame({"object_path": key[0], "version": list(numbers), "tx_id": ordered["tx_id"].to_list()})
        state.update((head,))

    return stream.groupBy("object_path").applyInPandasWithState(run, schema, "head bigint", "append", "NoTimeout")
