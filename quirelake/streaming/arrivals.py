"""Files as they arrive: freshness against what is known, then parsing, batch by batch.

A file that arrives again with the bytes that are known is passed over; one with other bytes is parsed again. A batch
that is run again after a failure finds what its sink has kept, so parsed files are not parsed twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.sources import files

ARRIVAL = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(object_path, size, modified_ns, source_hash, content) of files as they appear below a folder; paths are relative to it."""
    found = spark.readStream.format("binaryFile").schema(ARRIVAL).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.as_files(found, folder)


def parsed_arrivals(stream: DataFrame, known: Callable[[], DataFrame], sink: Callable[[DataFrame, DataFrame, int], None]):
    """A writer that parses what is new or changed of each micro-batch.

    ``known`` gives (object_path, source_hash) of what was parsed before; ``sink`` takes the fresh objects (object_path,
    format_id, size, modified_ns, source_hash), their entities (rows of ``files.scan``) and the number of the batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        before = known().select("object_path", "source_hash").distinct()
        fresh = files.with_format(batch).join(before, ["object_path", "source_hash"], "left_anti")
        sink(fresh.select("object_path", "format_id", "size", "modified_ns", "source_hash"), files.scan(fresh), number)

    return stream.writeStream.foreachBatch(run)
