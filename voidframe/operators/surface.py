"""Surface areas by points on atom spheres: a point counts if no other atom covers it, and is accessible if its voxel or one of the
six around it is.

Which of an atom's points a neighbour covers is a mask of one bit a direction, 64 to a long; masks are combined by bit_or before anything is
shuffled, and counts are popcounts. Rows for single points exist only where their place is asked for, in the task that holds their atom."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import min_image, sphere_area, wrap
from .distance import SIX, in_cells, located
from .percolation import ACCESSIBLE
from ..plans.session import small, spread

SAMPLES = 1000


def directions(spark: SparkSession, samples: int = SAMPLES) -> DataFrame:
    """s, ux, uy, uz: a Fibonacci lattice on the unit sphere."""
    k = F.col("id") + 0.5
    z = 1 - 2 * k / samples
    turn = F.pi() * (3 - F.sqrt(F.lit(5.0))) * k
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    return spark.range(samples).select(F.col("id").cast("int").alias("s"), (r * F.cos(turn)).alias("ux"), (r * F.sin(turn)).alias("uy"), z.alias("uz"))


def samples(atoms: DataFrame, grids: DataFrame, probe: float = 0.0, n: int = SAMPLES, keep: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """structure_id, atom_id, s, x, y, z (wrapped) of the points at radius + probe, and columns to keep; where: which (atom, s) are made at all."""
    around = F.broadcast(directions(atoms.sparkSession, n))  # n rows
    own = atoms.join(small(grids.select("structure_id", "lx", "ly", "lz")), "structure_id").crossJoin(around)
    own = own if where is None else own.where(where)
    return own.select("structure_id", "atom_id", "s", *keep, *[wrap(F.col(c) + (F.col("radius") + probe) * F.col(f"u{c}"), F.col(f"l{c}")).alias(c) for c in "xyz"])


def atom_neighbours(atoms: DataFrame, celled: DataFrame, probe: float = 0.0) -> DataFrame:
    """(structure_id, atom_id, other) with both places, radii and the box: pairs of atoms whose spheres (radius + probe) meet, each once: an atom lies in
    one cell and is seen once from each distinct cell around. celled needs cells as long as two such spheres' radii together, so that no neighbour is
    missed."""
    a = located(atoms, celled).alias("a")
    b = in_cells(atoms, celled).select("structure_id", "atom_id", "x", "y", "z", "radius", "cx", "cy", "cz").alias("b")
    d2 = sum((min_image(F.col(f"a.{c}") - F.col(f"b.{c}"), F.col(f"a.l{c}")) ** 2 for c in "yz"), min_image(F.col("a.x") - F.col("b.x"), F.col("a.lx")) ** 2)
    reach = F.col("a.radius") + F.col("b.radius") + 2 * probe
    met = a.join(b, ["structure_id", "cx", "cy", "cz"]).where((F.col("a.atom_id") != F.col("b.atom_id")) & (d2 < reach * reach))
    box = [F.col(f"a.l{c}").alias(f"l{c}") for c in "xyz"]
    return met.select("structure_id", F.col("a.atom_id").alias("atom_id"), F.col("b.atom_id").alias("other"), *[F.col(f"a.{c}").alias(c) for c in "xyz"], (F.col("a.radius") + probe).alias("r"), *[F.col(f"b.{c}").alias(f"o{c}") for c in "xyz"], (F.col("b.radius") + probe).alias("other_r"), *box)


def _words(n: int) -> int:
    return -(-n // 64)


def _covered(n: int, portion: int = 256):
    """The task that turns pairs into masks: bit s of word s // 64 says that the other sphere covers point s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = np.arange(n) + 0.5
        z = 1 - 2 * k / n
        turn, flat = np.pi * (3 - np.sqrt(5.0)) * k, np.sqrt(np.maximum(0.0, 1 - z * z))
        unit = (flat * np.cos(turn), flat * np.sin(turn), z)
        for batch in batches:
            own = {c: batch.column(c).to_numpy() for c in ("x", "y", "z", "r", "ox", "oy", "oz", "other_r", "lx", "ly", "lz")}
            words = np.zeros((batch.num_rows, _words(n) * 8), dtype=np.uint8)
            for at in range(0, batch.num_rows, portion):
                cut = slice(at, at + portion)
                d2 = 0.0
                for c, u in zip("xyz", unit, strict=True):
                    length = own[f"l{c}"][cut, None]
                    gap = own[c][cut, None] + own["r"][cut, None] * u - own[f"o{c}"][cut, None]
                    gap -= np.rint(gap / length) * length
                    d2 = d2 + gap * gap
                bits = np.packbits(d2 < (own["other_r"][cut] ** 2)[:, None], axis=1, bitorder="little")
                words[cut, : bits.shape[1]] = bits
            words = words.view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("structure_id"), batch.column("atom_id"), *[pa.array(np.ascontiguousarray(words[:, w])) for w in range(_words(n))]], names=["structure_id", "atom_id", *[f"m{w}" for w in range(_words(n))]])

    return run


def masks(atoms: DataFrame, grids: DataFrame, probe: float = 0.0, n: int = SAMPLES) -> DataFrame:
    """atoms with m0, m1, ..: the points of their spheres that other atoms cover."""
    from .distance import cells

    celled = cells(grids, atoms.withColumn("radius", 2 * (F.col("radius") + probe)), 0.0)
    pairs = atom_neighbours(atoms.repartition(spread(atoms), "structure_id", "atom_id"), celled, probe)  # few rows that become many
    names = [f"m{w}" for w in range(_words(n))]
    kinds = {f.name: f.dataType.simpleString() for f in atoms.schema.fields}
    found = pairs.mapInArrow(_covered(n), ", ".join([f"structure_id {kinds['structure_id']}", f"atom_id {kinds['atom_id']}", *[f"{m} long" for m in names]]))
    each = found.groupBy("structure_id", "atom_id").agg(*[F.bit_or(m).alias(m) for m in names])
    return atoms.join(each, ["structure_id", "atom_id"], "left").withColumns({m: F.coalesce(m, F.lit(0).cast("long")) for m in names})


def open_count(n: int = SAMPLES) -> Column:
    """How many of n points a row of masks leaves open."""
    return F.lit(n) - sum((F.bit_count(f"m{w}") for w in range(1, _words(n))), F.bit_count("m0"))


def open_points(atoms: DataFrame, grids: DataFrame, probe: float = 0.0, n: int = SAMPLES, masked: DataFrame | None = None) -> DataFrame:
    """The samples that lie in no other atom's sphere: structure_id, atom_id, s, x, y, z. masked: what `masks` gives, if it is there already."""
    own = masks(atoms, grids, probe, n) if masked is None else masked
    bit = F.getbit(F.get(F.array(*[f"m{w}" for w in range(_words(n))]), F.shiftright("s", 6)), F.col("s").bitwiseAND(63))
    return samples(own.repartition(spread(atoms), "structure_id", "atom_id"), grids, probe, n, where=bit == 0)


def _beside_accessible(labels: DataFrame, g: DataFrame) -> DataFrame:
    """structure_id, ix, iy, iz of voxels that are accessible or beside (periodic) one that is; these are few next to points."""
    moves = F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("xyz", o, strict=True)]) for o in ((0, 0, 0), *SIX)])
    good = labels.where(F.col("label") == ACCESSIBLE).select("structure_id", "ix", "iy", "iz").join(g, "structure_id").withColumn("_o", F.explode(moves))
    return good.select("structure_id", *[F.pmod(F.col(f"i{c}") + F.col(f"_o.{c}"), F.col(f"g{c}")).alias(f"i{c}") for c in "xyz"]).distinct()


def accessible_counts(points: DataFrame, labels: DataFrame, grids: DataFrame) -> DataFrame:
    """(structure_id, atom_id, n_acc): each atom's points in or beside (periodic) an accessible voxel. An atom's points are counted by voxel where they
    are made; only these counts are shuffled."""
    g = small(grids.select("structure_id", "gx", "gy", "gz", "dgx", "dgy", "dgz"))
    at = points.join(g, "structure_id").select("structure_id", "atom_id", *[F.pmod(F.floor(F.col(c) / F.col(f"dg{c}")), F.col(f"g{c}")).cast("int").alias(f"i{c}") for c in "xyz"])
    voxels = at.groupBy("structure_id", "atom_id", "ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"))
    return voxels.join(_beside_accessible(labels, g), ["structure_id", "ix", "iy", "iz"], "left_semi").groupBy("structure_id", "atom_id").agg(F.sum("n").alias("n_acc"))


def areas(atoms: DataFrame, labels: DataFrame, grids: DataFrame, probe: float = 0.0, n: int = SAMPLES) -> DataFrame:
    """structure_id, s_acc, s_total in nm2: each atom's sphere times its share of points that count."""
    from ..plans.session import checkpointed

    masked = checkpointed(masks(atoms.select("structure_id", "atom_id", "x", "y", "z", "radius"), grids, probe, n))
    acc = accessible_counts(open_points(atoms, grids, probe, n, masked), labels, grids)
    own = masked.withColumn("n_total", open_count(n)).join(acc, ["structure_id", "atom_id"], "left")
    area = sphere_area(F.col("radius") + probe) / n
    return own.groupBy("structure_id").agg(F.sum(area * F.coalesce("n_acc", F.lit(0))).alias("s_acc"), F.sum(area * F.col("n_total")).alias("s_total"))
