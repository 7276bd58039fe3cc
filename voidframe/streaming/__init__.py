"""Structures that arrive as files, analysed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import elements
from ..sources import structures


def watch_gro(spark: SparkSession, path: str, handle: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run handle(atoms, boxes, batch) on the GRO files that each micro-batch brings; atoms have radius and mass bound."""
    found = spark.readStream.format("text").option("wholetext", True).load(path)
    files = found.select(F.input_file_name().alias("structure_id"), F.col("value").alias("text"))

    def each(batch: DataFrame, number: int) -> None:
        atoms, boxes = structures.read_gro(structures.lines(batch))
        bound = elements.bind(atoms.withColumnRenamed("z", "_z"), *elements.tables(spark)).withColumnRenamed("z", "z_number").withColumnRenamed("_z", "z")
        handle(bound, boxes, number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
