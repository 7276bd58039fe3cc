"""Signed distance of voxels to the nearest atom surface.

The neighbour join is an equi-join on spatial buckets: every atom is put into its own and the neighbouring cells (distinct after
wrapping), so a voxel meets all atoms within one cell length. A minimum that an atom beyond that could undercut is open; open voxels go
on to cells twice as long, round by round, until the cells around a voxel are the whole box, so the distance is always exact.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cell_count, cell_index, distance
from ..plans.session import beside, checkpointed, fits, small, spread

_BOX = ("lx", "ly", "lz")


def cells(structures: DataFrame, atoms: DataFrame, grid: float, probe: float = 0.0, pore: bool = False) -> DataFrame:
    """structures with cell (the least cell edge), nx, ny, nz and rmax."""
    widest = atoms.groupBy("structure_id").agg(F.max("radius").alias("rmax"))
    reach = (F.col("rmax") + probe) * (2.0 if pore else 1.0)
    out = structures.join(widest, "structure_id").withColumn("cell", F.greatest(reach, F.lit(grid)))
    return out.withColumns({f"n{c}": cell_count(F.col(f"l{c}"), F.col("cell")) for c in "xyz"})


def in_cells(atoms: DataFrame, celled: DataFrame, few: bool | None = None) -> DataFrame:
    """atoms with box, cell counts and one row for each distinct cell in their 27-cell neighbourhood: cx, cy, cz. few: whether celled fits, if counted."""
    own = celled.select("structure_id", *_BOX, "nx", "ny", "nz")
    placed = atoms.join(small(own) if few is None else beside(own, few), "structure_id")
    around = lambda c: F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(cell_index(F.col(c), F.col(f"l{c}"), F.col(f"n{c}")) + d, F.col(f"n{c}"))))
    for c in "xyz":
        placed = placed.withColumn(f"c{c}", F.explode(around(c)))
    return placed


def located(points: DataFrame, celled: DataFrame, few: bool | None = None) -> DataFrame:
    """points with the cell they lie in. few: whether celled fits, if counted."""
    own = celled.select("structure_id", *_BOX, "nx", "ny", "nz")
    placed = points.join(small(own) if few is None else beside(own, few), "structure_id")
    return placed.withColumns({f"c{c}": cell_index(F.col(c), F.col(f"l{c}"), F.col(f"n{c}")) for c in "xyz"})


def surface_gap(p: str, a: str) -> Column:
    """Distance from point p to the surface of atom a, both given as aliases; the box is the point's."""
    own = distance(tuple(F.col(f"{p}.{c}") for c in "xyz"), tuple(F.col(f"{a}.{c}") for c in "xyz"), tuple(F.col(f"{p}.{b}") for b in _BOX))
    return own - F.col(f"{a}.radius")


def neighbour_gaps(points: DataFrame, keys: list[str], atoms: DataFrame, celled: DataFrame) -> DataFrame:
    """(keys, atom_id, gap) for every point and atom in adjacent cells."""
    p, a = located(points, celled).alias("p"), in_cells(atoms, celled).select("structure_id", "atom_id", "x", "y", "z", "radius", "cx", "cy", "cz").alias("a")
    return p.join(a, ["structure_id", "cx", "cy", "cz"]).select("structure_id", *[F.col(f"p.{k}") for k in keys], F.col("a.atom_id"), surface_gap("p", "a").alias("gap"))


def all_gaps(points: DataFrame, keys: list[str], atoms: DataFrame, structures: DataFrame) -> DataFrame:
    """(keys, atom_id, gap) for every point and every atom of its structure: the fallback for points far from all atoms."""
    p = points.join(small(structures.select("structure_id", *_BOX)), "structure_id").alias("p")
    a = atoms.select("structure_id", "atom_id", "x", "y", "z", "radius").alias("a")
    return p.join(a, "structure_id").select("structure_id", *[F.col(f"p.{k}") for k in keys], F.col("a.atom_id"), surface_gap("p", "a").alias("gap"))


def nearest(points: DataFrame, centres: DataFrame, boxes: DataFrame, periodic: bool = True, most_rounds: int = 40) -> DataFrame:
    """points (structure_id, vid, x, y, z, ..) with gap, the least distance to the surface of one of the centres (structure_id, x, y, z, radius) of their
    structure, and round, from 0, in which it was settled. boxes: structure_id, lx, ly, lz, rmax (greatest radius) and edge (least cell edge of the first
    round). Points of a structure without centres are left out. Lineage is cut once a round."""
    boxes = checkpointed(boxes)
    few, left, parts = fits(boxes), points, []
    # few rows that become many: dealt out first, a small file would else be one task
    centres = centres.select("structure_id", "x", "y", "z", "radius").repartition(spread(points), "structure_id", "x", "y", "z")
    for k in range(most_rounds):
        sized = boxes.withColumns({f"n{c}": cell_count(F.col(f"l{c}"), F.col("edge") * float(1 << k)) for c in "xyz"})
        # beyond this distance a centre may lie outside the cells around; an axis with few cells is covered whole
        bound = F.least(*[F.when(F.col(f"n{c}") <= (3 if periodic else 2), F.lit(float("inf"))).otherwise(F.col(f"l{c}") / F.col(f"n{c}")) for c in "xyz"])
        sized = sized.withColumn("_bound", bound - F.col("rmax"))
        # a point on the far face of a box that does not wrap is in the last cell
        cell = lambda c: cell_index(F.col(c), F.col(f"l{c}"), F.col(f"n{c}")) if periodic else F.least(F.floor(F.col(c) / F.col(f"l{c}") * F.col(f"n{c}")).cast("int"), F.col(f"n{c}") - 1)

        def around(c: str) -> Column:
            near = F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: cell(c) + d)
            if periodic:
                return F.array_distinct(F.transform(near, lambda i: F.pmod(i, F.col(f"n{c}"))))
            return F.filter(near, lambda i: (i >= 0) & (i < F.col(f"n{c}")))

        a = centres.join(beside(sized, few), "structure_id")
        for c in "xyz":
            a = a.withColumn(f"c{c}", F.explode(around(c)))
        a = a.select("structure_id", "cx", "cy", "cz", *[F.col(c).alias(f"_a{c}") for c in "xyz"], "radius")
        p = left.join(beside(sized.select("structure_id", *_BOX, "nx", "ny", "nz", "_bound"), few), "structure_id").withColumns({f"c{c}": cell(c) for c in "xyz"})
        if k:  # the cells that open points lie in are few
            a = a.join(p.select("structure_id", "cx", "cy", "cz").distinct(), ["structure_id", "cx", "cy", "cz"], "left_semi")
        gap = [F.col(c) - F.col(f"_a{c}") for c in "xyz"]
        gap = [d - F.rint(d / F.col(f"l{c}")) * F.col(f"l{c}") for d, c in zip(gap, "xyz", strict=True)] if periodic else gap
        met = p.join(a, ["structure_id", "cx", "cy", "cz"], "left").withColumn("gap", F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]) - F.col("radius"))
        # what follows from the key is carried, not hashed
        rest = [F.first(c).alias(c) for c in (*points.columns, "_bound") if c not in ("structure_id", "vid")]
        # a point is in one cell: with the first, small cells among the keys it stays in the join's task; large cells are grouped apart
        key = ("structure_id", "vid") if k else ("structure_id", "cx", "cy", "cz", "vid")
        found = checkpointed(met.groupBy(*key).agg(F.min("gap").alias("gap"), *rest).drop("cx", "cy", "cz"))
        settled = (F.col("_bound") == float("inf")) | F.coalesce(F.col("gap") <= F.col("_bound"), F.lit(False))
        parts.append(found.where(settled).select(*points.columns, "gap", F.lit(k).alias("round")))
        left = found.where(~settled).select(points.columns)
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"distances are open after {most_rounds} rounds")
    return reduce(lambda x, y: x.unionByName(y), parts)


def nearest_gap(vox: DataFrame, atoms: DataFrame, celled: DataFrame, probe: float = 0.0) -> DataFrame:
    """voxels with gap, the exact distance to the nearest atom surface, and filled (whether cells of twice the greatest radius left it open)."""
    boxes = celled.select("structure_id", *_BOX, "rmax", F.greatest(2 * F.col("rmax"), F.lit(1e-3)).alias("edge"))
    return nearest(vox, atoms, boxes).withColumn("filled", F.col("round") > 0).drop("round")


def masked(gaps: DataFrame, grids: DataFrame, probe: float = 0.0) -> DataFrame:
    """voxels with dmin (probe subtracted), vdw, void and boundary."""
    edge = F.greatest("dgx", "dgy", "dgz") * 0.7071068 + 1e-6
    own = gaps.join(small(grids.select("structure_id", edge.alias("_edge"))), "structure_id").withColumn("dmin", F.col("gap") - probe)
    return own.withColumns({"vdw": F.col("gap") > 0, "void": F.col("dmin") > 0, "boundary": F.abs("dmin") < F.col("_edge")}).drop("_edge", "gap")


def field(atoms: DataFrame, grids: DataFrame, grid: float, probe: float = 0.0, pore: bool = False) -> DataFrame:
    """voxels with dmin, vdw, void, boundary, filled."""
    from .grid import voxels

    return masked(nearest_gap(voxels(grids), atoms, cells(grids, atoms, grid, probe, pore), probe), grids, probe)


SIX = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def shifted(vox: DataFrame, offsets, grids: DataFrame | None = None) -> DataFrame:
    """A row per voxel and offset, at the shifted ix, iy, iz (wrapped if grids are given); the voxel's own vid is kept as vid."""
    moves = F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("xyz", o, strict=True)]) for o in offsets])
    out = vox.withColumn("_o", F.explode(moves))
    if grids is None:
        return out.withColumns({f"i{c}": F.col(f"i{c}") + F.col(f"_o.{c}") for c in "xyz"}).drop("_o")
    out = out.join(small(grids.select("structure_id", "gx", "gy", "gz")), "structure_id")
    return out.withColumns({f"i{c}": F.pmod(F.col(f"i{c}") + F.col(f"_o.{c}"), F.col(f"g{c}")) for c in "xyz"}).drop("_o", "gx", "gy", "gz")


def on_border(grids_alias: str = "") -> Column:
    g = f"{grids_alias}." if grids_alias else ""
    hit = F.lit(False)
    for c in "xyz":
        hit = hit | (F.col(f"i{c}") == 0) | (F.col(f"i{c}") == F.col(f"{g}g{c}") - 1)
    return hit


def solid_boundary(vox: DataFrame, grids: DataFrame) -> DataFrame:
    """Solid voxels on the grid's border or beside a void voxel (six neighbours)."""
    beside = shifted(vox.where("void").select("structure_id", "ix", "iy", "iz"), SIX).select("structure_id", "ix", "iy", "iz").distinct().withColumn("_beside", F.lit(True))
    own = vox.where("not void").join(small(grids.select("structure_id", "gx", "gy", "gz")), "structure_id").join(beside, ["structure_id", "ix", "iy", "iz"], "left")
    return own.where(on_border() | F.coalesce("_beside", F.lit(False))).select(vox.columns)


def void_boundary(vox: DataFrame) -> DataFrame:
    """Void voxels with fewer than six void neighbours (outside the grid counts as not void)."""
    void = vox.where("void").select("structure_id", "ix", "iy", "iz", "vid")
    met = shifted(void, SIX).join(void.select("structure_id", "ix", "iy", "iz"), ["structure_id", "ix", "iy", "iz"]).groupBy("structure_id", "vid").count().where("count = 6")
    return void.join(met, ["structure_id", "vid"], "left_anti")


def _envelope(f: np.ndarray, step: float, periodic: bool) -> np.ndarray:
    """Along axis 0: the least of f[j] + (distance from i to j)^2, over all j. Offsets stop where even a value of 0 could not improve anything."""
    out, n = f.copy(), len(f)
    for k in range(1, n // 2 + 1 if periodic else n):
        rise = (k * step) ** 2
        if rise >= out.max():
            break
        if periodic:
            np.minimum(out, np.roll(f, k, axis=0) + rise, out=out)
            np.minimum(out, np.roll(f, -k, axis=0) + rise, out=out)
        else:
            np.minimum(out[k:], f[:-k] + rise, out=out[k:])
            np.minimum(out[:-k], f[k:] + rise, out=out[:-k])
    return out


def _planes(periodic: bool):
    """A plane of one ix: squared distances to its targets, along z and y. Rows in: one a target line; rows out: one a line of the plane."""

    def run(table: pa.Table) -> pa.Table:
        first = {c: table[c][0].as_py() for c in ("gy", "gz", "dgy", "dgz")}
        f = np.full((first["gy"], first["gz"]), np.inf)
        for iy, zs in zip(table["iy"].to_pylist(), table["zs"].to_pylist(), strict=True):
            f[iy, zs] = 0.0
        f = _envelope(f.T, first["dgz"], periodic).T
        f = _envelope(f, first["dgy"], periodic)
        n = len(f)
        return pa.table({"structure_id": table["structure_id"].take(pa.array([0] * n)), "ix": table["ix"].take(pa.array([0] * n)), "iy": pa.array(range(n), pa.int32()), "f": pa.array(list(f), pa.list_(pa.float64()))})

    return run


def _across(periodic: bool):
    """A plane of one iy: squared distances with x counted too. Lines that lack (planes without a target) are infinitely far."""

    def run(table: pa.Table) -> pa.Table:
        gx, step = table["gx"][0].as_py(), table["dgx"][0].as_py()
        lines = table["f"].combine_chunks()
        f = np.full((gx, len(lines[0])), np.inf)
        f[table["ix"].to_numpy()] = lines.values.to_numpy().reshape(len(lines), -1)
        d = np.sqrt(_envelope(f, step, periodic))
        same = pa.array([0] * gx)
        return pa.table({"structure_id": table["structure_id"].take(same), "ix": pa.array(range(gx), pa.int32()), "iy": table["iy"].take(same), "d": pa.array(list(d), pa.list_(pa.float64()))})

    return run


def to_targets(vox: DataFrame, targets: DataFrame, grids: DataFrame, periodic: bool, correction: float = 0.0) -> DataFrame:
    """(structure_id, vid, d): distance of each voxel to the nearest target voxel, less correction * grid, not below zero. Structures without
    a target are left out. An exact separable transform: the least sum of squares over z and y is found in the planes of one ix, then over x in
    the planes of one iy; a task holds one plane, and two shuffles of planes are all, however far the targets are."""
    kind = dict(targets.dtypes)["structure_id"]
    g = small(grids.select("structure_id", "gx", "gy", "gz", "dgx", "dgy", "dgz"))
    lines = targets.groupBy("structure_id", "ix", "iy").agg(F.collect_list("iz").alias("zs")).select("structure_id", F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), "zs").join(g, "structure_id")
    planes = lines.groupBy("structure_id", "ix").applyInArrow(_planes(periodic), f"structure_id {kind}, ix int, iy int, f array<double>")
    found = planes.join(g, "structure_id").groupBy("structure_id", "iy").applyInArrow(_across(periodic), f"structure_id {kind}, ix int, iy int, d array<double>")
    asked = vox.select("structure_id", "vid", "ix", "iy", "iz").join(found, ["structure_id", "ix", "iy"]).join(small(grids.select("structure_id", "dgx")), "structure_id")
    return asked.select("structure_id", "vid", F.greatest(F.get("d", F.col("iz")) - correction * F.col("dgx"), F.lit(0.0)).alias("d"))
