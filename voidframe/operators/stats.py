"""Scalar results per structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .percolation import ACCESSIBLE, TRAPPED

AVOGADRO = 6.02214076e23


def masses(atoms: DataFrame, grids: DataFrame) -> DataFrame:
    """structure_id, atoms, mass (g/mol), defaulted (atoms of unknown elements, if atoms says so), density (g/cm3), v_cell."""
    defaulted = F.count_if("defaulted") if "defaulted" in atoms.columns else F.lit(0).cast("long")
    own = atoms.groupBy("structure_id").agg(F.count(F.lit(1)).alias("atoms"), F.sum("mass").alias("mass"), defaulted.alias("defaulted"))
    cell = F.col("lx") * F.col("ly") * F.col("lz")
    return own.join(grids.select("structure_id", cell.alias("v_cell")), "structure_id").withColumn("density", F.col("mass") / AVOGADRO / (F.col("v_cell") * 1e-21))


def volumes(labels: DataFrame, grids: DataFrame, leaves: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """structure_id, v_void, v_acc, v_trap, counts. With an octree, boundary voxels are replaced by their leaves: nodes (all) and
    leaves (void ones, labelled), or the parts of roots for both."""
    is_ = {"void": F.col("void"), "acc": F.col("label") == ACCESSIBLE, "trap": F.col("label") == TRAPPED}
    own = labels.groupBy("structure_id").agg(F.count(F.lit(1)).alias("voxels"), *[F.count_if(c).alias(f"n_{k}") for k, c in is_.items()], F.count_if("boundary").alias("n_boundary"), *[F.count_if(c & F.col("boundary")).alias(f"b_{k}") for k, c in is_.items()], F.max("dmin").alias("dmax"))
    own = own.join(grids.select("structure_id", (F.col("dgx") * F.col("dgy") * F.col("dgz")).alias("voxel")), "structure_id")
    if leaves is None or nodes is None:
        zero = F.lit(0).cast("long")
        return own.select("structure_id", "voxels", "n_void", "n_acc", "n_trap", "n_boundary", "dmax", "voxel", *[(F.col(f"n_{k}") * F.col("voxel")).alias(f"v_{k}") for k in is_], zero.alias("nodes"), zero.alias("leaves"))
    share = F.col("share") if "share" in leaves.columns else F.pow(F.lit(8.0), -F.col("level"))
    fine = leaves.groupBy("structure_id").agg(F.sum(share).alias("l_void"), F.sum(F.when(F.col("label") == ACCESSIBLE, share).otherwise(0.0)).alias("l_acc"), F.sum(F.when(F.col("label") == TRAPPED, share).otherwise(0.0)).alias("l_trap"))
    counts = (F.count(F.lit(1)), F.count_if("is_leaf")) if "is_leaf" in nodes.columns else (F.sum("nodes"), F.sum("leaves"))
    size = nodes.groupBy("structure_id").agg(*[n.alias(c) for n, c in zip(counts, ("nodes", "leaves"), strict=True)])
    own = own.join(fine, "structure_id", "left").join(size, "structure_id", "left")
    volume = lambda k: ((F.col(f"n_{k}") - F.col(f"b_{k}") + F.coalesce(f"l_{k}", F.lit(0.0))) * F.col("voxel")).alias(f"v_{k}")
    return own.select("structure_id", "voxels", "n_void", "n_acc", "n_trap", "n_boundary", "dmax", "voxel", *[volume(k) for k in is_], F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("leaves", F.lit(0)).alias("leaves"))


def record(grids: DataFrame, mass: DataFrame, volume: DataFrame, surface: DataFrame | None, pore: DataFrame | None) -> DataFrame:
    """One row per structure with all figures. Without pore analysis PLD and LCD are -1; without surface the areas are 0."""
    out = grids.join(mass, "structure_id", "left").join(volume, "structure_id", "left")
    out = out.join(surface, "structure_id", "left") if surface is not None else out.withColumns({"s_acc": F.lit(0.0), "s_total": F.lit(0.0)})
    out = out.join(pore, "structure_id", "left") if pore is not None else out.withColumns({c: F.lit(-1.0) for c in ("pld", "lcd", "lcd_global")})
    grams = F.col("mass") / AVOGADRO
    return out.withColumns({
        "v_probe": F.col("v_cell") - F.col("v_void"),
        **{f"{k}_frac": F.col(f"v_{k}") / F.col("v_cell") for k in ("void", "acc", "trap")},
        **{f"{k}_per_g": F.when(grams > 0, F.col(k) * 1e-18 / grams).otherwise(0.0) for k in ("s_acc", "s_total")},
    })


def nested(found: DataFrame, settings: dict, run: dict, timings: dict, octree: bool) -> DataFrame:
    """structure_id and the record as it is written: info, settings, stats, run_envs, timings. found: what `record` gives."""
    col, lit = F.col, F.lit
    per = lambda c: F.array(*[col(f"{c}{x}") for x in "xyz"])
    tree = lambda c: (col(c) if octree else lit(0)).cast("long")
    # The names of the record's fields.
    info = {
        "box_nm": per("l"), "box_inferred": col("box_inferred"), "grid_shape": per("g"), "voxels": col("voxels"), "grid_space_set_nm": lit(settings["grid"]), "grid_space_real_nm": per("dg"),
        "voxel_volume_nm3": col("voxel"), "probe_nm": lit(settings["probe"]), "octree_used": lit(octree), "octree_root_voxels": tree("n_boundary"), "octree_nodes": tree("nodes"),
        "octree_root_nodes": tree("n_boundary"), "octree_leaf_nodes": tree("leaves"), "defaulted_elements": col("defaulted"),
    }
    stats = {
        "atoms": "atoms", "mass_g/mol": "mass", "density_g/cm3": "density", "Vcell_nm3": "v_cell", "Vvoid_nm3": "v_void", "Vprobe_nm3": "v_probe", "Vacc_nm3": "v_acc", "Vtrap_nm3": "v_trap",
        "Vvoid_frac": "void_frac", "Vacc_frac": "acc_frac", "Vtrap_frac": "trap_frac", "Sacc_nm2": "s_acc", "Sacc_m2/g": "s_acc_per_g", "Stotal_nm2": "s_total", "Stotal_m2/g": "s_total_per_g",
        "PLD_nm": "pld", "LCD_nm": "lcd", "LCD_global_nm": "lcd_global",
    }
    of = lambda d: F.struct(*[(v if not isinstance(v, (str, int, float)) else lit(v)).alias(k) for k, v in d.items()])
    return found.select("structure_id", of(info).alias("info"), of(settings).alias("settings"), F.struct(*[col(v).alias(k) for k, v in stats.items()]).alias("stats"), of(run).alias("run_envs"), of(timings).alias("timings"))
