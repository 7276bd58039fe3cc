"""What several corpus operators share: sizes, shared folders, text columns."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: What an Arrow batch on its way to a Python task holds at most. Both sides keep several copies of a batch outside the heap, on the JVM's side in
#: buffers that double; of 27 MB (a whole task's texts) these add up to hundreds of MB in an executor that runs two tasks.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def lean(spark: SparkSession) -> None:
    """From now on this session's Arrow batches hold BATCH_BYTES at most, unless the session has a limit of its own. A batch is cut by rows: no result
    depends on it. It stays set, since frames that operators return are computed later."""
    if not spark._jsparkSession.sessionState().conf().contains(BATCH):
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")


#: What operators keep in a Python worker from task to task, by the operator's name.
kept: dict[str, dict] = {}


def task(run: Callable, keeps: str = "") -> Callable:
    """run, a function over Arrow batches, as the task of a worker that serves many operators: what others than `keeps` have kept goes before it,
    and freed memory goes back to the system after it, where the C library would hold on to it."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in kept.keys() - {keeps}:
            kept[name].clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return within


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's own
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; set to a fresh one only where it is unset and all run on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"/tmp/spark-checkpoints-{uuid.uuid4().hex[:12]}"
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: columns that a reader leaves out are not read again."""
    lean(df.sparkSession)
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def portions(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices with about `most` bytes of text each, so that what a task holds of a batch does not depend on how long its texts are."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end
