"""Fields on the voxel grid: block means, smoothing, the six fields of cube output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import tanh_smooth
from .percolation import ACCESSIBLE, TRAPPED
from ..plans.session import small


def cube_step(grid: float, space: float | None = None) -> int:
    """How many voxels a cube cell takes along an axis."""
    return max(1, round((max(0.05, grid) if space is None else space) / grid))


def downsampled(vox: DataFrame, grids: DataFrame, k: int, values: list[str], how: Callable[[str], Column] = F.avg) -> DataFrame:
    """Block aggregates of k x k x k voxels; an incomplete tail is left out. k of 1 or less changes nothing; more than an axis is an error."""
    if k <= 1:
        return vox.select("structure_id", "ix", "iy", "iz", *values)
    g = grids.select("structure_id", *[F.when(F.col(f"g{c}") >= k, F.expr(f"g{c} div {k}")).otherwise(F.raise_error(F.lit("the block is larger than the grid"))).alias(f"_n{c}") for c in "xyz"])
    own = vox.join(small(g), "structure_id").withColumns({f"i{c}": F.expr(f"cast(i{c} div {k} as int)") for c in "xyz"})
    own = own.where(" and ".join(f"i{c} < _n{c}" for c in "xyz"))
    return own.groupBy("structure_id", "ix", "iy", "iz").agg(*[how(v).alias(v) for v in values])


def fields(labels: DataFrame, grid: float, smooth: bool = False) -> DataFrame:
    """labels with the fields void, occ, acc, trap as numbers (times the tanh weight if smooth); occ is 1 - void."""
    weight = tanh_smooth(F.col("dmin"), grid) if smooth else F.lit(1.0)
    out = labels.withColumn("f_void", F.col("void").cast("double") * weight)
    return out.withColumns({"f_occ": 1 - F.col("f_void"), "f_acc": (F.col("label") == ACCESSIBLE).cast("double") * weight, "f_trap": (F.col("label") == TRAPPED).cast("double") * weight})
