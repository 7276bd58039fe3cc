"""Refinement of boundary voxels by an octree, and percolation through its leaves.

A node's place is its path: the child numbers from the root, in base 8 behind a leading 1. Each level is one step: nodes that need
it are expanded into eight children, evaluated against their root's nearest atoms, which are flat columns. There are no pointers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.geometry import min_image
from ..plans.components import connected_components
from .distance import SIX, cells, in_cells, located, on_border, shifted, surface_gap
from .percolation import ACCESSIBLE, TRAPPED, first_in_block, in_blocks, least_of_parts
from ..plans.session import checkpointed, fits, small, spread

TOP = 3


def candidates(roots: DataFrame, atoms: DataFrame, celled: DataFrame, probe: float, top: int = TOP, in_cell: bool = False) -> DataFrame:
    """roots (voxels) with their `top` nearest distinct atoms by surface distance, ties by atom_id, as flat columns: atom1, ax1, ay1, az1, ar1, atom2, ..;
    null where there are fewer in the cells around. A voxel meets all its atoms in one task, so the group limit keeps `top` of them before the shuffle.
    in_cell: there is none, the voxel is ranked and grouped in the task of its cell; for even atoms, since adaptive execution can't split a crowded cell then."""
    celled = checkpointed(celled)
    few = fits(celled)
    dealt = atoms.select("structure_id", "atom_id", "x", "y", "z", "radius").repartition(spread(atoms), "structure_id", "atom_id")  # few rows that become many
    p = located(roots, celled, few).alias("p")
    a = in_cells(dealt, celled, few).select("structure_id", "atom_id", "x", "y", "z", "radius", "cx", "cy", "cz").alias("a")
    key = ["structure_id", "cx", "cy", "cz", "vid"] if in_cell else ["structure_id", "vid"]
    own = [F.col(f"p.{c}") for c in roots.columns if c != "structure_id"]
    near = p.join(a, ["structure_id", "cx", "cy", "cz"], "left").select("structure_id", "cx", "cy", "cz", *own, (surface_gap("p", "a") - probe).alias("_score"), F.col("a.atom_id").alias("_atom"), *[F.col(f"a.{c}").alias(f"_a{c[0]}") for c in ("x", "y", "z", "radius")])
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_score", "_atom"))
    best = near.withColumn("_k", rank).where(F.col("_k") <= top)
    flat = [F.max(F.when(F.col("_k") == k, F.col(f"_{c}"))).alias(f"{c}{k}") for k in range(1, top + 1) for c in ("atom", "ax", "ay", "az", "ar")]
    rest = [F.first(c).alias(c) for c in roots.columns if c not in ("structure_id", "vid")]
    return best.groupBy(*key).agg(*rest, *flat).select(*roots.columns, *[f"{c}{k}" for k in range(1, top + 1) for c in ("atom", "ax", "ay", "az", "ar")])


def evaluated(probe: float, top: int = TOP) -> Column:
    """Distance of (x, y, z) to the nearest of the candidates, less the probe; far away without candidates."""

    def gap(k: int) -> Column:
        dx, dy, dz = (min_image(F.col(c) - F.col(f"a{c}{k}"), F.col(f"l{c}")) for c in "xyz")
        return F.sqrt(dx * dx + dy * dy + dz * dz) - F.col(f"ar{k}") - probe

    return F.coalesce(F.least(*[gap(k) for k in range(1, top + 1)]) if top > 1 else gap(1), F.lit(1e9))


def _roots(vox: DataFrame, atoms: DataFrame, grids: DataFrame, grid: float, probe: float, pore: bool) -> DataFrame:
    """Boundary voxels (root, ix, iy, iz, x, y, z) with their candidates, box and spacings."""
    roots = candidates(vox.where("boundary").select("structure_id", "ix", "iy", "iz", "vid", "x", "y", "z"), atoms, cells(grids, atoms, grid, probe, pore), probe, in_cell=True)
    return roots.join(small(grids.select("structure_id", "lx", "ly", "lz", "dgx", "dgy", "dgz")), "structure_id").withColumnRenamed("vid", "root")


def forest(vox: DataFrame, atoms: DataFrame, grids: DataFrame, grid: float, probe: float = 0.0, max_level: int = 4, min_size: float = 0.001, pore: bool = False) -> DataFrame:
    """structure_id, root (vid), ix, iy, iz, path, level, x, y, z, d, void, is_leaf. A level is one expansion: a node that is split gives itself and its
    eight children, any other gives itself, so all levels are made in one pass over the roots, without a union or a second derivation."""
    here = _roots(vox, atoms, grids, grid, probe, pore)
    here = here.withColumns({"path": F.lit(1).cast("long"), "level": F.lit(0), "is_leaf": F.lit(True), "d": evaluated(probe)})
    with_children, alone = (F.array(*map(F.lit, ks)) for ks in (range(-1, 8), (-1,)))
    for level in range(max_level - 1):
        half, step = F.greatest("dgx", "dgy", "dgz") * (0.5 / 2**level), 0.5 / 2 ** (level + 1)
        split = (F.col("level") == level) & (half > min_size * 0.5) & (F.abs("d") <= half * 1.4142136 + 1e-6)
        here = here.withColumn("_split", split).withColumn("_k", F.explode(F.when(F.col("_split"), with_children).otherwise(alone)))
        born = F.col("_k") >= 0
        sign = lambda b: F.when(F.shiftright("_k", b).bitwiseAND(1) == 1, 1.0).otherwise(-1.0)
        here = here.withColumns({c: F.when(born, F.col(c) + sign(b) * F.col(f"dg{c}") * step).otherwise(F.col(c)) for b, c in enumerate("xyz")})
        here = here.withColumns({
            "path": F.when(born, F.col("path") * 8 + F.col("_k")).otherwise(F.col("path")),
            "level": F.when(born, F.lit(level + 1)).otherwise(F.col("level")),
            "is_leaf": born | (F.col("is_leaf") & ~F.col("_split")),
            "d": F.when(born, evaluated(probe)).otherwise(F.col("d")),
        }).drop("_split", "_k")
    return here.select("structure_id", "root", "ix", "iy", "iz", "path", "level", "x", "y", "z", "d", (F.col("d") > 0).alias("void"), "is_leaf")


def _words(n: int) -> list[str]:
    """The columns of a part's faces, lower and upper on each axis: a bit for each of n x n squares, 64 to a long."""
    return [f"{side}{axis}_{w}" for side in ("lo", "up") for axis in range(3) for w in range(-(-n * n // 64))]


def _spread_out(part: np.ndarray) -> np.ndarray:
    """part (roots, n, n, n) and what is beside it."""
    out = part.copy()
    for axis in (1, 2, 3):
        low, high = (tuple(slice(a, b) if k == axis else slice(None) for k in range(4)) for a, b in ((None, -1), (1, None)))
        out[low] |= part[high]
        out[high] |= part[low]
    return out


def _refined(own: dict[str, np.ndarray], probe: float, max_level: int, min_size: float, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(void, nodes, leaves) of some roots: void by the smallest places of a root (n x n x n), and counts. The steps are those of `forest`, in its order."""
    count, n = len(own["x"]), 1 << (max_level - 1)
    void, nodes, leaves = np.zeros((count, n, n, n), bool), np.zeros(count, np.int64), np.zeros(count, np.int64)
    at = {c: own[c][:, None] for c in "xyz"}
    widest = np.maximum(np.maximum(own["dgx"], own["dgy"]), own["dgz"])
    r, place = np.arange(count), [np.zeros(count, np.int64)] * 3
    for level in range(max_level):
        d = np.full(len(r), np.inf)
        for k in range(1, top + 1):
            gaps = []
            for c, p in zip("xyz", place, strict=True):
                gap, length = at[c][r, p] - own[f"a{c}{k}"][r], own[f"l{c}"][r]
                gaps.append(gap - np.rint(gap / length) * length)
            gap = np.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]) - own[f"ar{k}"][r] - probe
            d = np.fmin(d, gap)
        d[np.isinf(d)] = 1e9
        half = widest[r] * (0.5 / 2**level)
        split = (half > min_size * 0.5) & (np.abs(d) <= half * 1.4142136 + 1e-6) & (level < max_level - 1)
        nodes += np.bincount(r, minlength=count)
        leaves += np.bincount(r[~split], minlength=count)
        held, size = ~split & (d > 0), n >> level
        here = np.zeros((count, *[1 << level] * 3), bool)
        here[(r[held], *[p[held] for p in place])] = True
        void |= here.repeat(size, 1).repeat(size, 2).repeat(size, 3)
        step, child = 0.5 / 2 ** (level + 1), np.arange(8)
        for c in "xyz":
            move = own[f"dg{c}"][:, None]
            at[c] = np.stack([at[c] + -1.0 * move * step, at[c] + 1.0 * move * step], -1).reshape(count, -1)
        r, place = r[split].repeat(8), [(2 * p[split][:, None] + (child >> b & 1)).ravel() for b, p in enumerate(place)]
    return void, nodes, leaves


def _parted(probe: float, max_level: int, min_size: float, top: int, portion: int = 512):
    """The task that turns roots into the parts of their void."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 1 << (max_level - 1)
        names = ["x", "y", "z", "lx", "ly", "lz", "dgx", "dgy", "dgz", *[f"{c}{k}" for k in range(1, top + 1) for c in ("ax", "ay", "az", "ar")]]
        for batch in (b.slice(k, portion) for b in batches for k in range(0, b.num_rows, portion)):
            free, nodes, leaves = _refined({c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}, probe, max_level, min_size, top)
            of, faces, share, count = [], [], [], batch.num_rows
            left = np.arange(count)
            while len(left := left[free[left].any((1, 2, 3))]):
                inside = free[left]
                part = np.zeros_like(inside)
                part.reshape(len(left), -1)[np.arange(len(left)), inside.reshape(len(left), -1).argmax(1)] = True
                grows = np.arange(len(left))
                while len(grows):
                    more = _spread_out(part[grows]) & inside[grows]
                    moved = (more != part[grows]).any((1, 2, 3))
                    part[grows] = more
                    grows = grows[moved]
                free[left] = inside & ~part
                of.append(left)
                share.append(part.sum((1, 2, 3)) / n**3)
                sides = [np.take(part, end, axis).reshape(len(left), -1) for end in (0, n - 1) for axis in (1, 2, 3)]
                bits = [np.packbits(x, axis=1, bitorder="little") for x in sides]
                faces.append(np.concatenate([np.pad(x, ((0, 0), (0, -x.shape[1] % 8))).view("<i8") for x in bits], axis=1))
            solid = np.setdiff1d(np.arange(count), of[0] if of else [])
            of = np.concatenate([*of, solid]).astype(np.int64)
            share = np.concatenate([*share, np.zeros(len(solid))])
            faces = np.concatenate([*faces, np.zeros((len(solid), len(_words(n))), np.int64)])
            first = np.zeros(len(of), bool)
            first[np.unique(of, return_index=True)[1]] = True  # a root's counts are in its first row
            rows = [batch.column(c).take(pa.array(of)) for c in ("structure_id", "root", "ix", "iy", "iz")]
            rows += [pa.array(np.where(first, x[of], 0)) for x in (nodes, leaves)] + [pa.array(share)] + [pa.array(np.ascontiguousarray(x)) for x in faces.T]
            yield pa.RecordBatch.from_arrays(rows, names=["structure_id", "root", "ix", "iy", "iz", "nodes", "leaves", "share", *_words(n)])

    return run


def root_parts(vox: DataFrame, atoms: DataFrame, grids: DataFrame, grid: float, probe: float = 0.0, max_level: int = 4, min_size: float = 0.001, pore: bool = False) -> DataFrame:
    """What percolation needs of `forest`, without its nodes as rows: structure_id, root, ix, iy, iz, nodes and leaves (counts, in one row of a root), node (a
    number), share (of the voxel) and lo0_0 .. up2_0 (squares of the faces) for each part of a root's void leaves that share faces inside it; a share of 0
    for a root without void. A root's tree is made, parted and left in one task."""
    here = _roots(vox, atoms, grids, grid, probe, pore)
    kinds = dict(here.dtypes)
    schema = [f"{c} {kinds[c]}" for c in ("structure_id", "root", "ix", "iy", "iz")] + ["nodes long", "leaves long", "share double"] + [f"{w} long" for w in _words(1 << (max_level - 1))]
    asked = here.select("structure_id", "root", "ix", "iy", "iz", "x", "y", "z", *[f"{a}{c}" for a in ("l", "dg") for c in "xyz"], *[f"{c}{k}" for k in range(1, TOP + 1) for c in ("ax", "ay", "az", "ar")])
    return asked.mapInArrow(_parted(probe, max_level, min_size, TOP), ", ".join(schema)).withColumn("node", F.monotonically_increasing_id())


def _met(words: int):
    """The task of one block of roots: its parts with `part`, the number of one of those that they are joined with inside the block."""

    def run(table: pa.Table) -> pa.Table:
        place = [table[c].to_numpy().astype(np.int64) for c in ("ix", "iy", "iz")]
        place = [p - p.min() for p in place]
        shape = [p.max() + 2 for p in place]  # what lies ahead of the last plane is empty
        at = np.ravel_multi_index(place, shape)
        order = np.argsort(at, kind="stable")
        table, at = table.take(pa.array(order)), at[order]
        start, count = np.zeros(np.prod(shape), np.int64), np.bincount(at, minlength=np.prod(shape))
        start[1:] = np.cumsum(count)[:-1]
        u, v = [], []
        for k, ahead in enumerate((shape[1] * shape[2], shape[2], 1)):
            there = count[at + ahead]
            a = np.repeat(np.arange(len(at)), there)
            b = np.repeat(start[at + ahead], there) + np.arange(len(a)) - np.repeat(np.cumsum(there) - there, there)
            same = np.zeros(len(a), bool)
            for w in range(words):
                same |= (table[f"up{k}_{w}"].to_numpy()[a] & table[f"lo{k}_{w}"].to_numpy()[b]) != 0
            u.append(a[same])
            v.append(b[same])
        least = least_of_parts(np.concatenate(u), np.concatenate(v), len(at))
        return table.drop_columns(["bx", "by", "bz"]).append_column("part", table["node"].take(pa.array(least)))

    return run


def part_components(parts: DataFrame) -> DataFrame:
    """Parts of roots (as `root_parts` gives them, checkpointed) that hold void, with component: parts of neighbouring roots meet where they hold the same
    square of the face between them; inside a block in one task, then across the faces of blocks."""
    words = sum(c.startswith("lo0_") for c in parts.columns)
    faces = [c for c in parts.columns if c.startswith(("lo", "up"))]
    kinds = dict(parts.dtypes)
    own = parts.where("share > 0").select("structure_id", "root", "ix", "iy", "iz", "share", "node", *faces)
    schema = ", ".join(f"{c} {kinds[c]}" for c in own.columns) + ", part long"
    own = checkpointed(in_blocks(own).groupBy("structure_id", "bx", "by", "bz").applyInArrow(_met(words), schema))
    ahead = [F.struct(F.lit(k).alias("axis"), *[(F.col(f"i{c}") + (1 if a == k else 0)).alias(f"i{c}") for a, c in enumerate("xyz")], *[F.col(f"up{k}_{w}").alias(f"u{w}") for w in range(words)]) for k in range(3)]
    of_axis = lambda x, y, z: F.when(F.col("axis") == 0, x).when(F.col("axis") == 1, y).otherwise(z)
    first = [first_in_block(f"i{c}") for c in "xyz"]
    a = own.select(F.col("part").alias("a"), "structure_id", F.explode(F.array(*ahead)).alias("f")).select("a", "structure_id", "f.*").where(of_axis(*first))
    b = own.where(reduce(lambda p, q: p | q, first)).select(F.col("part").alias("b"), "structure_id", "ix", "iy", "iz", *[c for c in faces if c.startswith("lo")])
    meets = reduce(lambda p, q: p | q, [F.col(f"u{w}").bitwiseAND(of_axis(*[F.col(f"lo{k}_{w}") for k in range(3)])) != 0 for w in range(words)])
    named = connected_components(a.join(b, ["structure_id", "ix", "iy", "iz"]).where(meets).select("a", "b").distinct(), "a", "b").withColumnRenamed("node", "part")
    found = own.select("structure_id", "root", "ix", "iy", "iz", "share", "part")
    return found.join(named, "part", "left").withColumn("component", F.coalesce("component", "part")).drop("part")


#: Parts of a voxel's edge in which leaves are placed: deeper levels than this has bits are not told apart.
PARTS = 1 << 16


def leaf_edges(leaves: DataFrame, grids: DataFrame) -> DataFrame:
    """(a, b) of the node numbers of leaves that share part of a face, in one root or in neighbouring roots. Leaves lie on a grid of
    PARTS to a voxel, so upper faces meet lower faces by an equi-join on axis, plane and voxel column; only those of one plane and column
    are compared."""
    g = small(grids.select("structure_id", "dgx", "dgy", "dgz"))
    own = leaves.join(g, "structure_id").withColumn("_n", (PARTS / F.pow(F.lit(2.0), F.col("level"))).cast("long"))
    own = own.withColumns({f"_{c}": F.rint(F.col(c) / F.col(f"dg{c}") * PARTS - F.col("_n") / 2).cast("long") for c in "xyz"})

    def faces(upper: bool) -> DataFrame:
        each = []
        for axis, (c, u, v) in enumerate((("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))):
            plane = F.col(f"_{c}") + F.col("_n") if upper else F.col(f"_{c}")
            each.append(F.struct(F.lit(axis).alias("axis"), plane.alias("plane"), F.col(f"i{u}").alias("iu"), F.col(f"i{v}").alias("iv"), F.col(f"_{u}").alias("u"), F.col(f"_{v}").alias("v")))
        return own.select("structure_id", "node", "_n", F.explode(F.array(*each)).alias("f")).select("structure_id", "node", "_n", "f.*")

    a, b = faces(True).alias("a"), faces(False).alias("b")
    meets = F.lit(True)
    for k in ("structure_id", "axis", "plane", "iu", "iv"):
        meets = meets & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    for k in "uv":
        meets = meets & (F.col(f"a.{k}") < F.col(f"b.{k}") + F.col("b._n")) & (F.col(f"b.{k}") < F.col(f"a.{k}") + F.col("a._n"))
    return a.join(b, meets).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def leaf_components(nodes: DataFrame, grids: DataFrame) -> DataFrame:
    """Void leaves with component, a number."""
    leaves = checkpointed(nodes.where("is_leaf and void").withColumn("node", F.monotonically_increasing_id()))
    named = connected_components(leaf_edges(leaves, grids), "a", "b")
    return leaves.join(named, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")


def labelled_leaves(found: DataFrame, coarse: DataFrame, grids: DataFrame) -> DataFrame:
    """Void leaves with label: a component is accessible if one of its leaves lies in a border voxel or beside a coarse accessible voxel."""
    places = found.select("structure_id", "ix", "iy", "iz", F.col("root").alias("vid")).distinct()
    beside = shifted(places, SIX).join(coarse.where(F.col("label") == ACCESSIBLE).select("structure_id", "ix", "iy", "iz"), ["structure_id", "ix", "iy", "iz"], "left_semi").select("structure_id", F.col("vid").alias("root")).distinct().withColumn("_beside", F.lit(True))
    own = found.join(small(grids.select("structure_id", "gx", "gy", "gz")), "structure_id").join(beside, ["structure_id", "root"], "left")
    hit = on_border() | F.coalesce("_beside", F.lit(False))
    by = own.groupBy("component").agg(F.bool_or(hit).alias("_hit"))
    return found.join(by, "component").withColumn("label", F.when(F.col("_hit"), ACCESSIBLE).otherwise(TRAPPED)).drop("_hit")


def backfilled(coarse: DataFrame, leaves: DataFrame) -> DataFrame:
    """Coarse voxels with the greater of their own label and their leaves'."""
    most = leaves.groupBy("structure_id", F.col("root").alias("vid")).agg(F.max("label").alias("_leaf"))
    return coarse.join(most, ["structure_id", "vid"], "left").withColumn("label", F.greatest("label", F.coalesce("_leaf", F.lit(0)))).drop("_leaf")


def percolation(coarse: DataFrame, nodes: DataFrame, grids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(final voxel labels, labelled void leaves). nodes: of `forest`, or what `root_parts` gives, checkpointed; then parts stand for leaves."""
    own = leaf_components(nodes, grids) if "is_leaf" in nodes.columns else part_components(nodes)
    leaves = checkpointed(labelled_leaves(checkpointed(own), coarse, grids))
    return backfilled(coarse, leaves), leaves


def leaf_volumes(nodes: DataFrame, grids: DataFrame) -> DataFrame:
    """structure_id, void, volume, leaves: total volume of leaves by class."""
    # shares of a voxel add up without rounding
    own = nodes.where("is_leaf").groupBy("structure_id", "void").agg(F.sum(F.pow(F.lit(8.0), -F.col("level"))).alias("_voxels"), F.count(F.lit(1)).alias("leaves"))
    volume = F.col("_voxels") * (F.col("dgx") * F.col("dgy") * F.col("dgz"))
    return own.join(small(grids.select("structure_id", "dgx", "dgy", "dgz")), "structure_id").select("structure_id", "void", volume.alias("volume"), "leaves")
