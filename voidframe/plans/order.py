"""Running totals and ranks inside groups of any size: a group is cut into parts by ranges of its order, so no task has to hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .session import checkpointed

#: How a total is folded: the aggregate, and how the total of earlier parts is added to the one inside a part.
FOLDS = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def in_parts(df: DataFrame, *order: str | Column, parts: int | None = None) -> DataFrame:
    """df with `part`, the number of the range of `order` that a row lies in; the ranges are about equally large, as many as `parts` or as the session
    has shuffle partitions with enough bytes. The rows are written once, so that a task that is run again finds the same ranges."""
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return checkpointed(dealt.withColumn("part", F.spark_partition_id()))


def running(df: DataFrame, by: list[str], order: list[str | Column], totals: dict[str, tuple[str, Column]], whole: bool = False) -> DataFrame:
    """df, whose column `part` grows with `order` inside each group of `by`, with each named total over the rows of its group that come before
    a row (0 for the first); whole: also <name>_all, over the whole group. totals: name to ("sum" or "xor", column of longs).

    Windows run inside (group, part); what earlier parts add is one row for each of these pairs. Keys must not be null (wrap them in a struct)."""
    inside = Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero, none = F.lit(0).cast("long"), Window.partitionBy(*by)
    parts = df.groupBy(*by, "part").agg(*[FOLDS[f][0](c).alias(n) for n, (f, c) in totals.items()])
    earlier = parts.select(
        *by,
        "part",
        *[F.coalesce(FOLDS[f][0](n).over(before), zero).alias(f"_{n}") for n, (f, _) in totals.items()],
        *[FOLDS[f][0](n).over(none).alias(f"{n}_all") for n, (f, _) in totals.items() if whole],
    )
    local = df.withColumns({n: F.coalesce(FOLDS[f][0](c).over(inside), zero) for n, (f, c) in totals.items()})
    both = local.join(earlier, [*by, "part"])
    return both.withColumns({n: FOLDS[f][1](F.col(n), F.col(f"_{n}")) for n, (f, _) in totals.items()}).drop(*[f"_{n}" for n in totals])


def ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with `at`, the number of its rows of the same group of `by` that come before it."""
    return running(in_parts(df, *by, *order), by, list(order), {"at": ("sum", F.lit(1).cast("long"))}).drop("part")
