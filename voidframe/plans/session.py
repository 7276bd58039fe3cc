"""Where multi-round plans put their intermediate results."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may be sent to every executor.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint, if Spark's own estimate of its size (from the files behind it) is within BROADCAST_BYTES; else as it is, and adaptive
    execution chooses the join by the size that it meets."""
    said = re.match(r"sizeInBytes=([0-9.]+) (B|KiB|MiB)\b", df._jdf.queryExecution().optimizedPlan().stats().simpleString())
    size = float(said[1]) * {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20}[said[2]] if said else float("inf")  # larger units are not small
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by files in the folder of spark.checkpoint.dir (a fresh one is set only where that is unset)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = at or f"/tmp/spark-checkpoints-{uuid.uuid4().hex[:12]}"
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint(eager=True)


def fits(df: DataFrame) -> bool:
    """Whether df may be sent to every executor, by its rows, counted. For checkpointed tables of a row a structure: Spark's estimate of a join is its
    inputs' sizes multiplied, so `small` takes none that came from one."""
    return df.count() * sum(16 + (f.dataType.jsonValue() == "string") * 48 for f in df.schema.fields) <= BROADCAST_BYTES


def beside(df: DataFrame, few: bool) -> DataFrame:
    """df (few: as `fits` says) for a join with rows that were made from fewer by explode, such as voxels: Spark estimates these by what they were made
    from, and would send them to every executor instead of df. Where df doesn't fit, both sides are merged by key."""
    return F.broadcast(df) if few else df.hint("merge")


def spread(df: DataFrame) -> int:
    """How many parts few rows that are about to become many are dealt to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
