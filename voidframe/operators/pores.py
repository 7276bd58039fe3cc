"""Pores from a distance field: local maxima, pruned balls, the graph between them, size distribution, limiting diameter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.geometry import min_image, sphere_volume
from ..plans.order import ranked
from ..plans.session import beside, checkpointed, fits, small
from .percolation import ACCESSIBLE, by_block, component_labels, framed, placed_components
from .widest import spanning_value

CONTAINED, OVERLAP = "contained", "overlap"


def _peaks(rmin: float, strict: bool):
    """The task of one block: its voxels that no neighbour exceeds."""

    def run(table: pa.Table) -> pa.Table:
        high, at = framed(table, "dmin", -np.inf)
        low = framed(table, "dmin", np.inf)[0]
        for axis in range(3):  # the rim is empty, so what rolls over the end is nothing
            high = np.maximum(high, np.maximum(np.roll(high, 1, axis), np.roll(high, -1, axis)))
            low = np.minimum(low, np.minimum(np.roll(low, 1, axis), np.roll(low, -1, axis)))
        d = table["dmin"].to_numpy()
        keep = table["own"].to_numpy(zero_copy_only=False) & (d >= rmin) & (d >= high.ravel()[at])
        keep = keep & (low.ravel()[at] < d) if strict else keep
        return table.select(["structure_id", "vid"]).filter(pa.array(keep))

    return run


def local_maxima(labels: DataFrame, rmin: float = 0.005, strict: bool = True) -> DataFrame:
    """Accessible voxels with dmin >= rmin that no accessible voxel of their 26 neighbours exceeds; strict: and that exceed one of these.
    The greatest and least value around come from three passes along one axis each, in blocks of the grid."""
    own = labels.where(F.col("label") == ACCESSIBLE).select("structure_id", "ix", "iy", "iz", "vid", "dmin")
    kinds = dict(own.dtypes)
    found = checkpointed(by_block(own, _peaks(rmin, strict), f"structure_id {kinds['structure_id']}, vid {kinds['vid']}"))
    return labels.join(beside(found, fits(found)), ["structure_id", "vid"], "left_semi").select(labels.columns)


def nodes_of(maxima: DataFrame) -> DataFrame:
    """structure_id, node_id, x, y, z, r of maxima with a positive radius."""
    return maxima.where("dmin > 0").select("structure_id", F.col("vid").alias("node_id"), "x", "y", "z", F.col("dmin").alias("r"))


def _bucketed(nodes: DataFrame, grids: DataFrame, reach: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes in buckets no shorter than their structure's reach, and nodes spread over neighbouring buckets."""
    g = small(grids.select("structure_id", "lx", "ly", "lz").join(reach, "structure_id"))
    own = nodes.join(g, "structure_id")
    n = {c: F.greatest(F.floor(F.col(f"l{c}") / F.col("reach")).cast("int"), F.lit(1)) for c in "xyz"}
    own = own.withColumns({f"n{c}": n[c] for c in "xyz"})
    own = own.withColumns({f"c{c}": F.pmod(F.floor(F.col(c) / F.col(f"l{c}") * F.col(f"n{c}")), F.col(f"n{c}")).cast("int") for c in "xyz"})
    spread = own
    for c in "xyz":
        near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col(f"c{c}") + d, F.col(f"n{c}"))))
        spread = spread.withColumn(f"c{c}", F.explode(near))
    return own, spread


def _apart(a: str, b: str) -> Column:
    gap = [min_image(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), F.col(f"{a}.l{c}")) for c in "xyz"]
    return gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]


def dominance(nodes: DataFrame, grids: DataFrame, mode: str, eps: Column | float) -> DataFrame:
    """(structure_id, i, j): ball i, larger (ties: of lower node_id), would remove ball j. eps may be a column of grids."""
    extra = grids.select("structure_id", (eps if isinstance(eps, Column) else F.lit(float(eps))).alias("eps"))
    scale = 1 if mode == CONTAINED else 2
    reach = nodes.groupBy("structure_id").agg(F.greatest(F.max("r") * scale, F.lit(1e-9)).alias("reach"))
    own, spread = _bucketed(nodes, grids, reach)
    i = own.join(small(extra), "structure_id").alias("i")
    j = spread.alias("j")
    first = (F.col("i.r") > F.col("j.r")) | ((F.col("i.r") == F.col("j.r")) & (F.col("i.node_id") < F.col("j.node_id")))
    met = i.join(j, ["structure_id", "cx", "cy", "cz"]).where(first)
    d2 = _apart("i", "j")
    if mode == CONTAINED:
        most = F.col("i.r") - F.col("j.r") + F.col("i.eps")
        hit = (d2 <= F.col("i.r") * F.col("i.r")) & (most > 0) & (d2 <= most * most)
    else:
        most = F.col("i.r") + F.col("j.r") - F.col("i.eps")
        hit = (most > 0) & (d2 < most * most)
    return met.where(hit).select("structure_id", F.col("i.node_id").alias("i"), F.col("j.node_id").alias("j")).distinct()


def pruned(nodes: DataFrame, grids: DataFrame, mode: str = OVERLAP, eps: Column | float = 1e-6) -> DataFrame:
    """The balls that a greedy walk by falling radius keeps. In rounds: an undecided ball without an undecided dominator stays, what it
    dominates goes, until none is undecided; the outcome is the walk's."""
    order = checkpointed(dominance(nodes, grids, mode, eps))
    key = lambda c: ["structure_id", c]
    left = checkpointed(nodes.select("structure_id", "node_id"))
    kept = None
    while not left.isEmpty():
        stays = left.join(order.select("structure_id", F.col("j").alias("node_id")).distinct(), key("node_id"), "left_anti")
        goes = order.join(stays.withColumnRenamed("node_id", "i"), key("i"), "left_semi").select("structure_id", F.col("j").alias("node_id")).distinct()
        kept = stays if kept is None else kept.union(stays)
        kept = checkpointed(kept)
        left = checkpointed(left.join(stays, key("node_id"), "left_anti").join(goes, key("node_id"), "left_anti"))
        alive = left
        order = checkpointed(order.join(alive.withColumnRenamed("node_id", "i"), key("i"), "left_semi").join(alive.withColumnRenamed("node_id", "j"), key("j"), "left_semi"))
    return nodes if kept is None else nodes.join(kept, key("node_id"), "left_semi")


def nearest_nodes(nodes: DataFrame, grids: DataFrame, k: int = 12, within: float | None = None) -> DataFrame:
    """(structure_id, a, b, d, rank): each node's k nearest others, periodic, ties by node_id; with within, only those nearer than
    so many times the structure's largest radius, which meet in buckets of that reach."""
    if within is None:
        g = grids.select("structure_id", "lx", "ly", "lz")
        a, b, on = nodes.join(g, "structure_id").alias("a"), nodes.alias("b"), ["structure_id"]
    else:
        reach = nodes.groupBy("structure_id").agg(F.greatest(F.max("r") * within, F.lit(1e-9)).alias("reach"))
        own, spread = _bucketed(nodes, grids, reach)
        a, b, on = own.alias("a"), spread.alias("b"), ["structure_id", "cx", "cy", "cz"]
    met = a.join(b, on).where("a.node_id <> b.node_id").select("structure_id", F.col("a.node_id").alias("a"), F.col("b.node_id").alias("b"), F.sqrt(_apart("a", "b")).alias("d"), F.col("a.r").alias("ra"), F.col("b.r").alias("rb"))
    rank = F.row_number().over(Window.partitionBy("structure_id", "a").orderBy("d", "b"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def centreline(nodes: DataFrame, grids: DataFrame, k: int = 12, alpha: float = 1.2, most: float | None = None) -> DataFrame:
    """(structure_id, a, b): undirected edges between near nodes whose balls nearly touch. Longer ones than two largest balls allow are
    never edges, so the k nearest are looked for within that reach."""
    near = nearest_nodes(nodes, grids, k, 2 * alpha).where(F.col("d") <= alpha * (F.col("ra") + F.col("rb")))
    near = near if most is None else near.where(F.col("d") <= most)
    return near.select("structure_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def pore_nodes(labels: DataFrame, grids: DataFrame, rmin: float = 0.005, strict: bool = True, prune: bool = True) -> DataFrame:
    """Maxima, without balls inside others, without overlapping balls (prune)."""
    eps = 2 * F.sqrt(F.col("dgx") * F.col("dgx") + F.col("dgy") * F.col("dgy") + F.col("dgz") * F.col("dgz"))
    nodes = checkpointed(nodes_of(local_maxima(labels, rmin, strict)))
    nodes = checkpointed(pruned(nodes, grids, CONTAINED, eps))
    return checkpointed(pruned(nodes, grids, OVERLAP, eps)) if prune else nodes


def size_distribution(nodes: DataFrame, bin_size: float) -> DataFrame:
    """structure_id, bin (from 1), diameter (bin centre), n, volume (share), cumulative. Bins are [k b, (k+1) b)."""
    own = nodes.withColumns({"d": 2 * F.col("r"), "v": sphere_volume(F.col("r"))})
    # the bin by comparison with its edges, since d / b may round across one
    k = F.floor(F.col("d") / bin_size).cast("int")
    k = F.when(F.col("d") < k * F.lit(bin_size), k - 1).when(F.col("d") >= (k + 1) * F.lit(bin_size), k + 1).otherwise(k)
    counted = own.withColumn("k", k).groupBy("structure_id", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    bins = own.groupBy("structure_id").agg(F.max("d").alias("most"), F.sum("v").alias("all"))
    bins = bins.select("structure_id", "all", F.explode(F.sequence(F.lit(0), F.ceil((F.col("most") + 10 * bin_size) / bin_size).cast("int") - 2)).alias("k"))
    out = bins.join(counted, ["structure_id", "k"], "left").select("structure_id", (F.col("k") + 1).alias("bin"), ((F.col("k") + 0.5) * bin_size).alias("diameter"), F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("v", F.lit(0.0)) / F.col("all")).alias("volume"))
    up_to = Window.partitionBy("structure_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cumulative", F.sum("volume").over(up_to))


def centres(nodes: DataFrame) -> DataFrame:
    """structure_id, n (from 1, by falling radius), x, y, z, diameter."""
    rank = F.row_number().over(Window.partitionBy("structure_id").orderBy(F.desc("r"), "node_id"))
    return nodes.select("structure_id", rank.alias("n"), "x", "y", "z", (2 * F.col("r")).alias("diameter"))


def percolates(vox: DataFrame, grids: DataFrame, value: str, at_least: Column) -> DataFrame:
    """(structure_id, hit): whether voxels with value >= at_least span the grid."""
    held = vox.withColumn("void", F.col(value) >= at_least)
    found = component_labels(placed_components(held, 6), grids).groupBy("structure_id").agg(F.max("label").alias("label"))
    return grids.select("structure_id").join(found, "structure_id", "left").select("structure_id", F.coalesce(F.col("label") == ACCESSIBLE, F.lit(False)).alias("hit"))


def _bisection(size: Column, spans: Column, steps: int = 40) -> Column:
    """The steps of a bisection over 0..size-1 in which k succeeds up to spans: array of (step, lo, hi, mid, best), each after its update."""
    start = F.struct(F.lit(0).alias("lo"), (size - 1).alias("hi"), F.lit(0).alias("best"), F.expr("cast(array() as array<struct<step:int,lo:int,hi:int,mid:int,best:int>>)").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        hit = mid <= spans
        lo, hi, best = F.when(hit, mid + 1).otherwise(acc["lo"]), F.when(hit, acc["hi"]).otherwise(mid - 1), F.when(hit, mid).otherwise(acc["best"])
        new = F.struct(lo.alias("lo"), hi.alias("hi"), best.alias("best"), F.array_append(acc["out"], F.struct(i.alias("step"), lo.alias("lo"), hi.alias("hi"), mid.alias("mid"), best.alias("best"))).alias("out"))
        return F.when(acc["lo"] <= acc["hi"], new).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), start, step, lambda acc: acc["out"])


def spanning(vox: DataFrame, grids: DataFrame, less: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(values, found): the distinct dmin - less that are not negative, numbered by k from 0 (over ranges of them, so that no task numbers a structure
    alone), and of each structure the greatest k whose voxels span the grid (-1 if none does), with its count and most."""
    d = checkpointed(vox.select("structure_id", "ix", "iy", "iz", (F.col("dmin") - less).alias("_d")).where("_d >= 0"))
    values = checkpointed(ranked(d.select("structure_id", "_d").distinct(), ["structure_id"], ["_d"]).select("structure_id", "_d", F.col("at").cast("int").alias("k")))
    top = values.groupBy("structure_id").agg((F.max("k") + 1).alias("size"), F.max("_d").alias("most"))
    best = spanning_value(d, grids).withColumnRenamed("w", "_d").join(values, ["structure_id", "_d"]).select("structure_id", F.col("k").alias("spans"))
    found = grids.select("structure_id").join(best, "structure_id", "left").join(top, "structure_id", "left")
    return values, checkpointed(found.withColumn("spans", F.coalesce("spans", F.lit(-1))))


def limiting_diameter(vox: DataFrame, grids: DataFrame, grid: float, probe: float = 0.0, compat: bool = True, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(structure_id, pld): twice the largest radius whose voxels span the grid, over the distinct values of dmin. compat: the probe is
    subtracted once more, and of the bisection over these values that stops where it has narrowed below half a grid step, the last middle
    counts, spanning or not; else the largest spanning value does. known: what `spanning` gives."""
    values, found = known or spanning(vox, grids, probe if compat else 0.0)
    at = lambda c: values.select("structure_id", F.col("k").alias(c), F.col("_d").alias(f"_{c}"))
    chosen = found.where("spans >= 0 and most > 0").select("structure_id", F.col("spans").alias("best"))
    if compat:
        walk = found.where("spans >= 0 and spans < size - 1 and most > 0").select("structure_id", F.explode(_bisection(F.col("size"), F.col("spans"))).alias("s")).select("structure_id", "s.*")
        walk = walk.join(at("lo"), ["structure_id", "lo"], "left").join(at("hi"), ["structure_id", "hi"], "left")
        close = F.coalesce(F.col("_hi") - F.col("_lo"), F.lit(-1.0)) < grid / 2
        ended = walk.groupBy("structure_id").agg(F.min_by("mid", F.when(close, F.col("step"))).alias("_mid"), F.max_by("best", "step").alias("_best"))
        chosen = chosen.join(ended, "structure_id", "left").select("structure_id", F.coalesce("_mid", "_best", "best").alias("best"))
    r = chosen.join(at("best"), ["structure_id", "best"])
    return grids.select("structure_id").join(r, "structure_id", "left").select("structure_id", (2 * F.coalesce("_best", F.lit(0.0))).alias("pld"))


def largest_ball(vox: DataFrame, nodes: DataFrame, grids: DataFrame) -> DataFrame:
    """vox with ball: the radius of the largest pore ball (grown by the widest grid step) that holds the voxel, else 0; of equal
    radii the later node counts."""
    g = grids.select("structure_id", "lx", "ly", "lz", F.greatest("dgx", "dgy", "dgz").alias("eps"))
    reach = nodes.groupBy("structure_id").agg(F.max("r").alias("rmax")).join(g, "structure_id").select("structure_id", (F.col("rmax") + F.col("eps")).alias("reach"))
    _, spread = _bucketed(nodes, grids, reach)
    own, _ = _bucketed(vox.select("structure_id", "vid", "x", "y", "z"), grids, reach)
    v, n = own.join(small(g.select("structure_id", "eps")), "structure_id").alias("v"), spread.alias("n")
    limit = F.col("n.r") + F.col("v.eps")
    met = v.join(n, ["structure_id", "cx", "cy", "cz"]).where(_apart("v", "n") <= limit * limit)
    most = met.groupBy("structure_id", F.col("v.vid").alias("vid")).agg(F.max_by("n.r", F.struct("n.r", "n.node_id")).alias("ball"))
    return vox.join(most, ["structure_id", "vid"], "left").withColumn("ball", F.coalesce("ball", F.lit(0.0)))
