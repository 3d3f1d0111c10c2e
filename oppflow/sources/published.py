"""Published tables: numbered snapshots behind a pointer, and a history by run of which the last runs stay.

A snapshot is written whole into a folder of its own before anybody can see it.
Publishing is the creation of one pointer file that must not exist yet; readers
take the highest pointer. A run that ends in between leaves the old snapshot in
place, and of two runs that start from the same snapshot only one can publish.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Outrun(RuntimeError):
    """Another run has published since this one began."""


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and what makes its paths."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    return path_of(path).getFileSystem(spark._jsc.hadoopConfiguration()), path_of


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path_of = _fs(spark, folder)
    at = path_of(folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def current_version(spark: SparkSession, root: str) -> int:
    """The number of the published snapshot, 0 if there is none."""
    return max((int(n) for n in _names(spark, f"{root}/pointers") if n.isdigit()), default=0)


def read_published(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The published snapshot, or an earlier one by its number; None if there is none."""
    version = current_version(spark, root) if version is None else version
    if not version:
        return None
    folder = spark.read.text(f"{root}/pointers/{version:012d}").first()
    return spark.read.parquet(f"{root}/snapshots/{folder.value}")


def publish(df: DataFrame, root: str, based_on: int) -> int:
    """Write ``df`` as a snapshot and publish it after version ``based_on``; its number.

    Fails with :class:`Outrun` if another version was published meanwhile: the caller reads that one and merges again.
    A folder that was never published is of no use to anybody and may be deleted.
    """
    spark, folder, version = df.sparkSession, uuid.uuid4().hex, based_on + 1
    df.write.parquet(f"{root}/snapshots/{folder}")
    if current_version(spark, root) != based_on:
        raise Outrun(f"version {based_on} is no longer the last one of {root}")
    fs, path_of = _fs(spark, root)
    # written under another name first, so that a pointer is never half there
    draft, pointer = path_of(f"{root}/drafts/{folder}"), path_of(f"{root}/pointers/{version:012d}")
    out = fs.create(draft, False)
    out.write(bytearray(folder.encode()))
    out.close()
    fs.mkdirs(pointer.getParent())
    if fs.exists(pointer) or not fs.rename(draft, pointer):
        raise Outrun(f"version {version} of {root} is another run's")
    return version


def drop_versions(spark: SparkSession, root: str, keep: int = 10) -> list[int]:
    """Delete all but the last ``keep`` snapshots and their pointers; the numbers that went."""
    fs, path_of = _fs(spark, root)
    gone = sorted(int(n) for n in _names(spark, f"{root}/pointers") if n.isdigit())[:-keep]
    for n in gone:
        folder = spark.read.text(f"{root}/pointers/{n:012d}").first().value
        fs.delete(path_of(f"{root}/pointers/{n:012d}"), True)
        fs.delete(path_of(f"{root}/snapshots/{folder}"), True)
    return gone


def append_run(status: DataFrame, root: str, run: str, keep: int = 10) -> list[str]:
    """Write a run's status rows into a partition of its own and drop all but the last ``keep`` runs; the runs that went.

    ``run`` names the run and sorts by time, such as ``20260105T060000``. A run that is repeated takes the place of its
    first try. No row of another run is read or written.
    """
    spark = status.sparkSession
    status.write.mode("overwrite").parquet(f"{root}/run={run}")
    fs, path_of = _fs(spark, root)
    gone = [n for n in _names(spark, root) if n.startswith("run=")][:-keep]
    for n in gone:
        fs.delete(path_of(f"{root}/{n}"), True)
    return [n.removeprefix("run=") for n in gone]


def read_runs(spark: SparkSession, root: str, last: int | None = None) -> DataFrame:
    """The rows of the last runs with the column ``run``; only their partitions are read."""
    runs = [n.removeprefix("run=") for n in _names(spark, root) if n.startswith("run=")]
    rows = spark.read.option("basePath", root).schema(spark.read.parquet(f"{root}/run={runs[-1]}").schema.add("run", "string")).parquet(root)
    return rows if last is None else rows.filter(F.col("run") >= runs[-last:][0])
