"""Lineage cuts through the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Where it is unset (tests, laptops) a folder
below /tmp/checkpoints is set, which is only right because everything then runs in one process.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_DEFAULT = "/tmp/checkpoints/corrweave"
#: Rows of a few numbers that ``broadcast_if_small`` lets be broadcast: some tens of megabytes.
MAX_BROADCAST_ROWS = 1_000_000
#: Folders that ``materialize`` made, in order.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as the URI the session names."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{LOCAL_DEFAULT}"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/corrweave-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: a lineage cut that survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files behind frames that ``materialize`` returned, once nothing reads them any more."""
    for frame in frames:
        for file in frame.inputFiles()[:1]:
            path = file.rpartition("/")[0]
            delete(spark, path)
            _made[:] = [p for p in _made if p.rpartition("/")[2] != path.rpartition("/")[2]]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end whatever was materialised inside.

    Operators drop what their results do not read; a result itself reads some folders, so a caller that has written it
    elsewhere leaves the block, and nothing stays in the shared folder.
    """
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            delete(spark, path)
        del _made[before:]


def broadcast_if_small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A frame of a few numbers a row, hinted for a broadcast if it has been counted and is small enough; beyond that the join shuffles, with the same result. For frames that ``materialize`` returned: counting reads no data."""
    return F.broadcast(df) if df.count() <= rows else df


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of a frame's bytes, from the sizes of its files; 0 where it has none. No job runs."""
    found = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return found if found < 1 << 60 else 0
