"""Session helpers: table access and places that survive the loss of an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; columns are pruned by what is selected later."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own_folder() -> str:
    """A temporary folder that goes when the driver does."""
    path = tempfile.mkdtemp(prefix="quirelake-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: what ``spark.checkpoint.dir`` names.

    Only where the session names none (tests on one machine) is a temporary folder made and remembered.
    """
    place = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quirelake.shared.dir", "")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + _own_folder()
        spark.conf.set("quirelake.shared.dir", place)
    return place.rstrip("/")


def shared_place(spark: SparkSession, label: str) -> str:
    """A new place of this application in the shared folder; ``forget`` removes it."""
    return f"{shared_folder(spark)}/quirelake/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_place(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quirelake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what ``durable`` wrote, once nothing is read from it any more."""
    remove(df.sparkSession, df._quirelake_path)


def forget(spark: SparkSession) -> None:
    """Remove what ``durable`` wrote for this application; to be called when its results have been used."""
    remove(spark, f"{shared_folder(spark)}/quirelake/{spark.sparkContext.applicationId}")


def _place(spark: SparkSession, path: str):
    """(file system, path) of a place in the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def files_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no folder."""
    fs, place = _place(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def make_folder(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.mkdirs(place)


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _place(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: beside its place first, then by one rename."""
    fs, place = _place(spark, path)
    _, beside = _place(spark, path + ".part")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(beside, place):
        raise OSError(f"{path} cannot be written")


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """How many partitions hold ``rows`` with at most about ``per_partition`` each; at least the session's parallelism."""
    floor = max(1, spark.sparkContext.defaultParallelism)
    return max(floor, -(-rows // per_partition))


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_quirelake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(_own_folder()) / "quirelake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path("quirelake") / file.relative_to(root))
    context.addPyFile(str(target))
    context._quirelake_shipped = True
