"""Boxes, grids and voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import linear_id
from ..plans.session import spread


def with_box(atoms: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms, structures): a box with an axis that is not positive is inferred from the atoms' extent, and the atoms shifted to it."""
    extent = atoms.groupBy("structure_id").agg(*[f(F.col(c) + s * F.col("radius")).alias(f"{n}{c}") for c in "xyz" for n, f, s in (("lo", F.min, -1), ("hi", F.max, 1))])
    found = boxes.join(extent, "structure_id")
    missing = (F.col("lx") <= 0) | (F.col("ly") <= 0) | (F.col("lz") <= 0)
    sized = found.select("structure_id", *[F.when(missing, F.col(f"hi{c}") - F.col(f"lo{c}")).otherwise(F.col(f"l{c}")).alias(f"l{c}") for c in "xyz"], missing.alias("box_inferred"), *[F.when(missing, F.col(f"lo{c}")).otherwise(0.0).alias(f"o{c}") for c in "xyz"])
    moved = atoms.join(sized.select("structure_id", "ox", "oy", "oz"), "structure_id")
    moved = moved.withColumns({c: F.col(c) - F.col(f"o{c}") for c in "xyz"}).select(atoms.columns)
    return moved, sized.select("structure_id", "lx", "ly", "lz", "box_inferred")


def sized(structures: DataFrame, grid: float, most_error: float = 0.05) -> DataFrame:
    """structures with gx, gy, gz and the true spacings dgx, dgy, dgz; a spacing too far from `grid` is an error."""
    out = structures.withColumns({f"g{c}": F.greatest(F.rint(F.col(f"l{c}") / grid).cast("int"), F.lit(1)) for c in "xyz"})
    out = out.withColumns({f"dg{c}": F.col(f"l{c}") / F.col(f"g{c}") for c in "xyz"})
    error = F.greatest(*[F.abs(F.col(f"dg{c}") - grid) / grid for c in "xyz"])
    return out.withColumn("gx", F.when(error <= most_error, F.col("gx")).otherwise(F.raise_error(F.lit("the grid does not fit the box"))))


def voxels(grids: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per voxel: structure_id, ix, iy, iz, vid, x, y, z. Slabs of x are dealt out before they are expanded, so one large
    structure is spread over the cluster."""
    keep = ["structure_id", "gy", "gz", "dgx", "dgy", "dgz"]
    slabs = grids.select(*keep, F.explode(F.sequence(F.lit(0), F.col("gx") - 1)).alias("ix"))
    # a number that is given stands: tiny slabs would else be put together in one task
    slabs = slabs.repartition(partitions or spread(grids), "structure_id", "ix")
    rows = slabs.select("*", F.explode(F.sequence(F.lit(0), F.col("gy") - 1)).alias("iy")).select("*", F.explode(F.sequence(F.lit(0), F.col("gz") - 1)).alias("iz"))
    return rows.select("structure_id", "ix", "iy", "iz", linear_id(F.col("ix"), F.col("iy"), F.col("iz"), F.col("gy"), F.col("gz")).alias("vid"), *[((F.col(f"i{c}") + 0.5) * F.col(f"dg{c}")).alias(c) for c in "xyz"])
