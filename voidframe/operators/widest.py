"""Widest paths through a voxel grid: the greatest value whose voxels still join two opposite faces.

An edge between neighbouring voxels weighs the lesser of their values. Only the edges of a maximum spanning forest matter for such a path, so a slab of
the grid is replaced by its forest (Boruvka rounds over arrays), and the forest by its skeleton: the tree paths between voxels on the slab's outer
planes and the two faces. Slabs next to each other are put together, few at a time, until one is left. A task holds a slab of about `most` voxels, or a few
skeletons, whose size goes with the area of a plane and not with the volume. An axis has two face nodes of its own, or paths could take a short
cut along another axis's face.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpointed, small

LOW, HIGH = -1, -2
ARITY = 4


def forest(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The edges (by number) of a maximum spanning forest."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    place = np.empty(len(w), dtype=np.int64)
    order = np.argsort(-w, kind="stable")
    place[order] = np.arange(len(w))  # ties are broken by number, so there are no cycles
    comp, left, taken = np.arange(len(names)), np.arange(len(w)), []
    while True:
        ca, cb = comp[a[left]], comp[b[left]]
        left, ca, cb = (x[ca != cb] for x in (left, ca, cb))
        if not len(left):
            return np.unique(np.concatenate(taken)) if taken else left
        best = np.full(len(names), len(w))
        np.minimum.at(best, ca, place[left])
        np.minimum.at(best, cb, place[left])
        own = np.flatnonzero(best < len(w))
        edge = order[best[own]]
        taken.append(edge)
        other = comp[a[edge]] + comp[b[edge]] - own
        up = np.arange(len(names))
        up[own] = other
        both = own[(up[up[own]] == own) & (own < up[own])]
        up[both] = both
        while not np.array_equal(again := up[up], up):
            up = again
        comp = up[comp]


def skeleton(u: np.ndarray, v: np.ndarray, w: np.ndarray, kept: set[int]) -> list[tuple[int, int, float]]:
    """A forest's tree paths between the nodes of `kept`: dead ends go, and a node on the way between two others gives way to an edge as narrow
    as the narrower of its two."""
    near: dict[int, dict[int, float]] = {}
    for p, q, x in zip(u.tolist(), v.tolist(), w.tolist(), strict=True):
        near.setdefault(p, {})[q] = x
        near.setdefault(q, {})[p] = x
    todo = [p for p, of in near.items() if len(of) < 3 and p not in kept]
    while todo:
        p = todo.pop()
        of = near.get(p)
        if of is None or len(of) > 2:
            continue
        ends = list(of.items())
        for q, _ in ends:
            del near[q][p]
        del near[p]
        if len(ends) == 2:
            (q, x), (r, y) = ends
            near[q][r] = near[r][q] = min(x, y)
        else:
            todo += [q for q, _ in ends if len(near[q]) < 3 and q not in kept]
    return [(p, q, x) for p, of in near.items() for q, x in of.items() if p < q]


def _reduced(u: np.ndarray, v: np.ndarray, w: np.ndarray, x0: int, x1: int, gx: int, plane: int) -> list[tuple[int, int, float]]:
    keep = forest(u, v, w)
    u, v, w = u[keep], v[keep], w[keep]
    nodes = np.unique(np.concatenate([u, v]))
    ix = nodes // plane
    outer = nodes[(nodes < 0) | ((x0 > 0) & (ix == x0 - 1)) | ((x1 < gx) & (ix == x1 - 1))]
    return skeleton(u, v, w, set(outer.tolist()))


def _out(table: pa.Table, part: int, rows: list[tuple[int, int, int, float]]) -> pa.Table:
    """rows: (axis, u, v, w), with what a part is known by."""
    same = pa.array([0] * len(rows), pa.int64())
    axis, u, v, w = zip(*rows, strict=True) if rows else ((), (), (), ())
    own = {"structure_id": table["structure_id"].take(same), "part": pa.array([part] * len(rows), pa.int64()), "axis": pa.array(axis, pa.int32()), "u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "w": pa.array(w, pa.float64())}
    return pa.table(own | {c: table[c].take(same) for c in ("gx", "gy", "gz", "thick")})


def _slab(table: pa.Table) -> pa.Table:
    """The skeletons, one an axis, of the voxels of one slab; the plane before the slab is there too, for the edges that lead into it."""
    gx, gy, gz, thick, part = (table[c][0].as_py() for c in ("gx", "gy", "gz", "thick", "part"))
    x0, x1 = part * thick, min(gx, (part + 1) * thick)
    at = [table[c].to_numpy() for c in ("ix", "iy", "iz")]
    d = np.full((x1 - x0 + 1, gy, gz), np.nan)
    d[at[0] - x0 + 1, at[1], at[2]] = table["_d"].to_numpy()
    ids = (np.arange(x0 - 1, x1)[:, None, None] * gy + np.arange(gy)[:, None]) * gz + np.arange(gz)
    u, v, w = [], [], []
    for near, far, of, to in ((d[:-1], d[1:], ids[:-1], ids[1:]), (d[1:, :-1], d[1:, 1:], ids[1:, :-1], ids[1:, 1:]), (d[1:, :, :-1], d[1:, :, 1:], ids[1:, :, :-1], ids[1:, :, 1:])):
        least = np.minimum(near, far)
        met = ~np.isnan(least)
        u.append(of[met])
        v.append(to[met])
        w.append(least[met])
    u, v, w = (np.concatenate(x) for x in (u, v, w))
    keep = forest(u, v, w)
    u, v, w = u[keep], v[keep], w[keep]
    own, ids = d[1:], ids[1:]
    faces = ((own[:1] if x0 == 0 else own[:0], ids[:1], own[-1:] if x1 == gx else own[:0], ids[-1:]), (own[:, :1], ids[:, :1], own[:, -1:], ids[:, -1:]), (own[:, :, :1], ids[:, :, :1], own[:, :, -1:], ids[:, :, -1:]))
    rows = []
    for axis, (low, low_ids, high, high_ids) in enumerate(faces):
        a, b = ~np.isnan(low), ~np.isnan(high)
        on_low, on_high = low_ids[: len(low)][a], high_ids[: len(high)][b]
        ends = np.concatenate([np.full(len(on_low), LOW), np.full(len(on_high), HIGH)])
        rows += [(axis, *e) for e in _reduced(np.concatenate([u, ends]), np.concatenate([v, on_low, on_high]), np.concatenate([w, low[a], high[b]]), x0, x1, gx, gy * gz)]
    return _out(table, part, rows)


def _joined(span: int):
    """The skeletons of a part that is `span` slabs long, from the skeletons of its parts."""

    def run(table: pa.Table) -> pa.Table:
        gx, gy, gz, thick, part = (table[c][0].as_py() for c in ("gx", "gy", "gz", "thick", "part"))
        axis, u, v, w = (table[c].to_numpy() for c in ("axis", "u", "v", "w"))
        x0, x1 = part * thick * span, min(gx, (part + 1) * thick * span)
        rows = [(k, *e) for k in range(3) if (own := axis == k).any() for e in _reduced(u[own], v[own], w[own], x0, x1, gx, gy * gz)]
        return _out(table, part, rows)

    return run


def spanning_value(d: DataFrame, grids: DataFrame, most: int = 200_000) -> DataFrame:
    """(structure_id, w): the greatest value of _d such that voxels of at least that value lead from one face to the opposite one along some axis;
    structures without such a path are left out. d: structure_id, ix, iy, iz, _d."""
    g = grids.select("structure_id", "gx", "gy", "gz", F.greatest(F.lit(1), F.floor(F.lit(most) / (F.col("gy").cast("long") * F.col("gz")))).cast("long").alias("thick"))
    own = d.select("structure_id", "ix", "iy", "iz", "_d").join(small(g), "structure_id").withColumn("part", F.floor(F.col("ix") / F.col("thick")))
    last = (F.col("ix") % F.col("thick") == F.col("thick") - 1) & (F.col("ix") < F.col("gx") - 1)
    own = own.withColumn("part", F.explode(F.when(last, F.array("part", F.col("part") + 1)).otherwise(F.array("part"))))
    kind = dict(d.dtypes)["structure_id"]
    schema = f"structure_id {kind}, part long, axis int, u long, v long, w double, gx int, gy int, gz int, thick long"
    found = own.groupBy("structure_id", "part").applyInArrow(_slab, schema)
    parts = g.agg(F.max(F.ceil(F.col("gx") / F.col("thick")))).first()[0] or 1
    span = 1
    while parts > 1:
        parts, span = -(-parts // ARITY), span * ARITY
        found = checkpointed(found).withColumn("part", F.floor(F.col("part") / ARITY)).groupBy("structure_id", "part").applyInArrow(_joined(span), schema)
    return found.where(f"u = {HIGH} and v = {LOW}").groupBy("structure_id").agg(F.max("w").alias("w"))
