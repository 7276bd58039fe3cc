"""Percolation: connected void that spans the grid is accessible, other void is trapped.

The grid is cut into blocks of BLOCK voxels an edge. A block's void is put into parts in one task, so the graph that is left has a node per part and an
edge where parts of two blocks meet. A component that touches both faces of an axis is accessible. Connectivity is not periodic.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.components import connected_components
from .distance import shifted
from ..plans.session import checkpointed, small

SOLID, TRAPPED, ACCESSIBLE = 0, 1, 2


def runs(void: DataFrame) -> DataFrame:
    """Maximal runs of void voxels along z: structure_id, ix, iy, z0, z1, run (the vid of the first voxel)."""
    island = F.col("iz") - F.row_number().over(Window.partitionBy("structure_id", "ix", "iy").orderBy("iz"))
    own = void.select("structure_id", "ix", "iy", "iz", "vid").withColumn("_island", island)
    return own.groupBy("structure_id", "ix", "iy", "_island").agg(F.min("iz").alias("z0"), F.max("iz").alias("z1"), F.min("vid").alias("run")).drop("_island")


def touch_bits(grids: DataFrame, found: DataFrame) -> DataFrame:
    """found (voxels) with bits: which of the six faces a voxel touches."""
    g = found.join(small(grids.select("structure_id", "gx", "gy", "gz")), "structure_id")
    bit = lambda c, n: F.when(c, n).otherwise(0)
    faces = [F.col("ix") == 0, F.col("ix") == F.col("gx") - 1, F.col("iy") == 0, F.col("iy") == F.col("gy") - 1, F.col("iz") == 0, F.col("iz") == F.col("gz") - 1]
    bits: Column = bit(faces[0], 1)
    for k, face in enumerate(faces[1:], 1):
        bits = bits.bitwiseOR(bit(face, 1 << k))
    return g.withColumn("bits", bits).drop("gx", "gy", "gz")


def spans(bits: Column) -> Column:
    """Whether both faces of some axis are touched."""
    hit = F.lit(False)
    for k in (0, 2, 4):
        hit = hit | (bits.bitwiseAND(F.lit(3 << k)) == 3 << k)
    return hit


def component_labels(found: DataFrame, grids: DataFrame) -> DataFrame:
    """(structure_id, component, label) of the components of found (voxels with component)."""
    whole = touch_bits(grids, found).groupBy("structure_id", "component").agg(F.bit_or("bits").alias("_bits"))
    return whole.select("structure_id", "component", F.when(spans(F.col("_bits")), ACCESSIBLE).otherwise(TRAPPED).alias("label"))


def labelled(vox: DataFrame, grids: DataFrame) -> DataFrame:
    """vox (with void) with component (null for solid) and label: 0 solid, 1 trapped, 2 accessible."""
    found = checkpointed(placed_components(vox, 6))
    named = found.select("structure_id", "vid", "component").join(component_labels(found, grids), ["structure_id", "component"])
    out = vox.drop("component", "label").join(named, ["structure_id", "vid"], "left")
    return out.withColumn("label", F.coalesce("label", F.lit(SOLID)))


def half_steps(neighbours: int) -> list[tuple[int, int, int]]:
    """One of each two opposite steps to the 6 or 26 neighbours of a voxel; the first axis that changes goes up."""
    steps = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    return [d for d in steps if d > (0, 0, 0) and (neighbours == 26 or sum(map(abs, d)) == 1)]


#: Voxels along an edge of a block: what a task holds at once.
BLOCK = 48
_PLACE = ("ix", "iy", "iz")


def in_blocks(vox: DataFrame) -> DataFrame:
    """vox with bx, by, bz: the block that a voxel lies in."""
    return vox.withColumns({f"b{c}": F.expr(f"cast(i{c} div {BLOCK} as int)") for c in "xyz"})


def first_in_block(c: str) -> Column:
    """Whether a voxel is in the first plane of its block along an axis."""
    return F.col(c) % BLOCK == 0


def _on_faces() -> Column:
    """Whether a voxel lies on a face of its block."""
    return reduce(lambda p, q: p | q, [(F.col(c) % BLOCK).isin(0, BLOCK - 1) for c in _PLACE])


def _meeting(at: np.ndarray, steps: list[tuple[int, int, int]]):
    """For each step, the pairs of numbers in the grid `at` (-1: none) that are a step apart."""
    for step in steps:
        near = at[tuple(slice(max(0, -d), at.shape[k] - max(0, d)) for k, d in enumerate(step))]
        far = at[tuple(slice(max(0, d), at.shape[k] - max(0, -d)) for k, d in enumerate(step))]
        met = (near >= 0) & (far >= 0)
        yield near[met], far[met]


def least_of_parts(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Of each of the numbers 0..n-1, the least that edges u, v lead to."""
    up = np.arange(n)
    while len(u):
        a, b = up[u], up[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(again := up[up], up):
            up = again
    return up


def _parts(neighbours: int):
    """The task of one block: its void voxels with part, the least vid that is reached inside the block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vid")
        place = [table[c].to_numpy().astype(np.int64) for c in _PLACE]
        place = [p - p.min() for p in place]
        at = np.full([p.max() + 1 for p in place], -1)
        at[tuple(place)] = np.arange(len(table))
        met = list(_meeting(at, half_steps(neighbours)))
        least = least_of_parts(np.concatenate([p for p, _ in met]), np.concatenate([q for _, q in met]), len(table))
        return table.select(["structure_id", *_PLACE, "vid"]).append_column("part", table["vid"].take(pa.array(least)))

    return run


def placed_components(vox: DataFrame, neighbours: int) -> DataFrame:
    """(structure_id, ix, iy, iz, vid, component) of void voxels."""
    void = vox.where("void").select("structure_id", *_PLACE, F.col("vid").cast("long").alias("vid"))
    kinds = dict(void.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("structure_id", *_PLACE, "vid")) + ", part long"
    found = checkpointed(in_blocks(void).groupBy("structure_id", "bx", "by", "bz").applyInArrow(_parts(neighbours), schema))
    faces = in_blocks(found.where(_on_faces()))
    to = faces.select("structure_id", *_PLACE, F.col("part").alias("other"))
    met = shifted(faces, half_steps(neighbours)).where(" or ".join(f"i{c} div {BLOCK} <> b{c}" for c in "xyz")).join(to, ["structure_id", *_PLACE])
    node = lambda c: F.struct("structure_id", F.col(c).alias("id"))
    named = connected_components(met.select(node("part").alias("a"), node("other").alias("b")).distinct(), "a", "b")
    named = named.select(F.col("node.structure_id").alias("structure_id"), F.col("node.id").alias("part"), F.col("component.id").alias("component"))
    return found.join(named, ["structure_id", "part"], "left").select("structure_id", *_PLACE, "vid", F.coalesce("component", "part").alias("component"))


def voxel_components(vox: DataFrame, offsets: int = 6) -> DataFrame:
    """(structure_id, vid, component) of void voxels, joined by 6 or by 26 neighbours; component is the least vid of it."""
    return placed_components(vox, offsets).select("structure_id", "vid", "component")


def haloed(vox: DataFrame) -> DataFrame:
    """vox with bx, by, bz: a row for the block that a voxel lies in and for each one beside it that it touches. own: whether it lies there."""
    for c in "xyz":
        beside = F.array_distinct(F.array(*[F.floor((F.col(f"i{c}") + d) / BLOCK).cast("int") for d in (-1, 0, 1)]))
        vox = vox.withColumn(f"b{c}", F.explode(beside)).where(F.col(f"b{c}") >= 0)
    return vox.withColumn("own", reduce(lambda p, q: p & q, [F.col(f"b{c}") == F.floor(F.col(f"i{c}") / BLOCK) for c in "xyz"]))


def by_block(vox: DataFrame, task, schema: str) -> DataFrame:
    """What task makes of each block of vox, its rows and those of other blocks that touch it (own is false)."""
    return haloed(vox).groupBy("structure_id", "bx", "by", "bz").applyInArrow(task, schema)


def framed(table: pa.Table, column: str, none):
    """(grid, places): a column's values in a grid with a rim, none where there is no row; and the rows' flat places in it."""
    place = [table[c].to_numpy().astype(np.int64) for c in _PLACE]
    place = [p - p.min() + 1 for p in place]
    grid = np.full([p.max() + 2 for p in place], none)
    at = np.ravel_multi_index(place, grid.shape)
    grid.ravel()[at] = table[column].fill_null(none).to_numpy()
    return grid, at


def _moves(neighbours: int, shape: tuple[int, ...]) -> np.ndarray:
    """The steps to all neighbours, in flat places."""
    half = np.array([(x * shape[1] + y) * shape[2] + z for x, y, z in half_steps(neighbours)])
    return np.concatenate([half, -half])


_FAR = 1 << 30


def _passed_on(neighbours: int):
    """The task of one block: depths are passed on inside it, from the least up, a level at a time."""

    def run(table: pa.Table) -> pa.Table:
        grid, at = framed(table, "depth", _FAR)
        depth, moves = grid.ravel(), _moves(neighbours, grid.shape)
        void = np.zeros(len(depth), bool)
        void[at] = True
        known = at[depth[at] < _FAR]
        known = known[np.argsort(depth[known], kind="stable")]
        levels = depth[known]
        level, new = (levels[0] if len(levels) else 0), known[:0]
        while len(new) or level <= levels[-1:].max(initial=-1):
            given = known[np.searchsorted(levels, level) : np.searchsorted(levels, level, "right")]
            front = np.concatenate([new, given[depth[given] == level]])
            to = (front[:, None] + moves).ravel()
            new = np.unique(to[void[to] & (depth[to] > level + 1)])
            level += 1
            depth[new] = level
        own = table["own"].to_numpy(zero_copy_only=False)
        got = depth[at[own]]
        return table.filter(table["own"]).drop_columns(["bx", "by", "bz", "own"]).rename_columns({"depth": "_was"}).append_column("depth", pa.array(got, pa.int32(), mask=got == _FAR))

    return run


def _with_parent(neighbours: int):
    """The task of one block: of each voxel, the least neighbour one step nearer."""

    def run(table: pa.Table) -> pa.Table:
        grid, at = framed(table, "depth", _FAR)
        none = np.iinfo(np.int64).max
        vid, depth = framed(table, "vid", none)[0].ravel(), grid.ravel()
        at = at[table["own"].to_numpy(zero_copy_only=False)]
        parent = np.full(len(at), none)
        for move in _moves(neighbours, grid.shape):
            nearer = depth[at + move] == depth[at] - 1
            parent[nearer] = np.minimum(parent[nearer], vid[at + move][nearer])
        return table.filter(table["own"]).select(["structure_id", "vid", "depth"]).append_column("parent", pa.array(parent, pa.int64(), mask=parent == none))

    return run


def depths(vox: DataFrame, components: DataFrame, neighbours: int = 6) -> tuple[DataFrame, int]:
    """(structure_id, ix, iy, iz, vid, component, depth) of void voxels, depth being the steps from the least voxel of the component (components
    must be of the same neighbourhood), and the rounds taken.

    A round passes depths on inside each block, from those that the blocks beside it had, so the rounds grow with the blocks that a shortest path goes
    through and not with its length. A component that a round leaves as it was is done, and takes no part in later rounds: no neighbour is then more
    than a step further, so every depth is the least."""
    void = vox.where("void").select("structure_id", *_PLACE, F.col("vid").cast("long").alias("vid"))
    first = F.when(F.col("vid") == F.col("component"), 0)
    live = checkpointed(void.join(components, ["structure_id", "vid"]).withColumn("depth", first))
    kinds = dict(live.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("structure_id", "vid", *_PLACE, "component")) + ", _was int, depth int"
    done, rounds = [], 0
    while not live.isEmpty():
        rounds += 1
        state = checkpointed(by_block(live, _passed_on(neighbours), schema))
        moved = checkpointed(state.where(~F.col("depth").eqNullSafe(F.col("_was"))).select("structure_id", "component").distinct())
        done.append(checkpointed(state.join(moved, ["structure_id", "component"], "left_anti").drop("_was")))
        live = checkpointed(state.join(moved, ["structure_id", "component"], "left_semi").drop("_was"))
    return reduce(DataFrame.union, done, live), rounds


def bfs_parents(vox: DataFrame, components: DataFrame, neighbours: int = 6) -> DataFrame:
    """(structure_id, vid, depth, parent): breadth-first depth from the least voxel of each component; the parent is the least neighbour one step
    nearer, null for the first voxel."""
    found, _ = depths(vox, components, neighbours)
    kind = dict(found.dtypes)["structure_id"]
    own = found.select("structure_id", *_PLACE, "vid", "depth")
    return by_block(own, _with_parent(neighbours), f"structure_id {kind}, vid long, depth int, parent long")
