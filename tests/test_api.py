"""The whole analysis of small structures, by call and by command line."""

import json

import pytest
from pyspark.sql import functions as F

from voidframe import cli
from voidframe.api import analyse
from voidframe.operators import distance, grid
from voidframe.plans.session import checkpointed


def gro(path, atoms, box):
    lines = [f"{1:5d}{'UNL':5s}{'H':>5s}{i % 99999:5d}" + "".join(f"{v:8.3f}" for v in p) for i, p in enumerate(atoms)]
    path.write_text("\n".join(["title", str(len(atoms)), *lines, " ".join(f"{b:.3f}" for b in box), ""]))
    return str(path)


def test_single_atom(spark, tmp_path):
    (tmp_path / "own.atoms").write_text("# symbol Z mass sigma epsilon\nH 1 1.0 0.2571 0\n")
    path = gro(tmp_path / "one.gro", [(0.2, 0.2, 0.2)], (0.4, 0.4, 0.4))
    found = analyse(spark, path, grid=0.05, probe=0.01, atoms=str(tmp_path / "own.atoms"), pore=True, stats=True, no_octree=True)
    s = found.stats.first()
    assert (s.n_void, s.n_acc, s.n_trap, s.n_boundary) == (424, 424, 0, 128)
    assert abs(s.lcd_global / 2 - 0.164559) < 1e-6 and abs(s.density - 0.025946) < 1e-6 and s.pld > 0
    names = {p.name for p in tmp_path.iterdir()}
    assert {"one_g_0.05_p_0.01_stats.json", "one_g_0.05_p_0.01_psd.txt", "one_g_0.05_p_0.01_center.txt"} <= names


def test_closed_shell_traps_its_void(spark, tmp_path):
    """Atoms on all faces of a cube: the void inside is trapped."""
    steps = [0.25 + 0.1 * i for i in range(6)]
    shell = [(x, y, z) for x in steps for y in steps for z in steps if {x, y, z} & {steps[0], steps[-1]}]
    found = analyse(spark, gro(tmp_path / "shell.gro", shell, (1.0, 1.2, 1.4)), grid=0.05, no_surface=True)
    inside = found.voxels.where(" and ".join(f"{c} between 0.4 and 0.6" for c in "xyz") + " and void")
    assert inside.count() > 0 and inside.where("label <> 1").count() == 0 and found.stats.first().v_trap > 0
    shape = found.structures.first()
    assert (shape.gx, shape.gy, shape.gz) == (20, 24, 28)


def test_command_line(spark, tmp_path, capsys):
    path = gro(tmp_path / "two.gro", [(0.2, 0.2, 0.2), (0.3, 0.2, 0.25)], (0.4, 0.5, 0.6))
    cli.main([path, "--grid", "0.1", "--no_octree", "--no_surface", "--stats"])
    assert (tmp_path / "two_g_0.1_p_0.0_stats.json").exists() and capsys.readouterr().out


@pytest.mark.parametrize("box", [(0.8, 0.8, 0.8), (0.6, 1.1, 1.9)])
def test_few_voxels_need_wider_cells(spark, box):
    """All axes differ; every distance is that of all atoms, and most are settled in the first round."""
    from voidframe.operators.distance import all_gaps

    atoms = checkpointed(spark.range(90).select(F.lit("s").alias("structure_id"), F.col("id").cast("int").alias("atom_id"), *[(F.col("id") * p % 101 / 101 * b).alias(c) for c, p, b in zip("xyz", (37, 53, 71), box, strict=True)], F.lit(0.1).alias("radius"), F.lit(1.0).alias("mass")))
    grids = checkpointed(grid.sized(spark.createDataFrame([("s", *box)], "structure_id string, lx double, ly double, lz double"), 0.05))
    vox = checkpointed(distance.field(atoms, grids, 0.05))
    want = all_gaps(grid.voxels(grids), ["vid"], atoms, grids).groupBy("vid").agg(F.min("gap").alias("want"))
    assert vox.join(want, "vid").where(F.abs(F.col("dmin") - F.col("want")) > 1e-12).count() == 0 and vox.count() == want.count()
    assert vox.where("filled").count() < 0.05 * vox.count()


def test_record_has_every_field(spark, tmp_path):
    (tmp_path / "a.pdb").write_text("\n".join([f"CRYST1{4.0:9.3f}{5.0:9.3f}{6.0:9.3f}{90.0:7.2f}{90.0:7.2f}{90.0:7.2f}"] + [f"ATOM  {i:5d} {n:4s} UNL A   1    {x:8.3f}{2.0:8.3f}{2.0:8.3f}{1.0:6.2f}{0.0:6.2f}          {e:>2s}" for i, (n, e, x) in enumerate([("H", "H", 1.0), ("Q", "*", 2.5), ("C", "C", 3.5)])] + ["END"]))
    path = str(tmp_path / "a.pdb")
    found = analyse(spark, path, grid=0.1, stats=True, pore=True, atoms="UFF.atoms", oct_level=2)
    got = json.loads(next((tmp_path / "a_g_0.1_p_0.0_stats.json").glob("*.json")).read_text())
    assert set(got) == {"structure_id", "info", "settings", "stats", "run_envs", "timings"}
    assert set(got["info"]) >= {"box_nm", "grid_shape", "voxels", "grid_space_set_nm", "grid_space_real_nm", "voxel_volume_nm3", "probe_nm", "octree_used", "octree_root_voxels", "octree_nodes", "octree_root_nodes", "octree_leaf_nodes", "box_inferred"}
    assert set(got["stats"]) == {"atoms", "mass_g/mol", "density_g/cm3", "Vcell_nm3", "Vvoid_nm3", "Vprobe_nm3", "Vacc_nm3", "Vtrap_nm3", "Vvoid_frac", "Vacc_frac", "Vtrap_frac", "Sacc_nm2", "Sacc_m2/g", "Stotal_nm2", "Stotal_m2/g", "PLD_nm", "LCD_nm", "LCD_global_nm"}
    assert set(got["timings"]) == {"init", "io", "cell", "grid", "octree", "volume", "surface", "pore", "cube", "stats"} and got["timings"]["grid"] > 0
    assert set(got["run_envs"]) == {"python_exe", "cwd", "platform", "full_command", "time", "execution_time"}
    assert got["info"]["grid_shape"] == [4, 5, 6] and got["info"]["voxels"] == 120 and got["info"]["octree_used"] and not got["info"]["box_inferred"]
    assert got["info"]["octree_nodes"] >= got["info"]["octree_leaf_nodes"] > 0 and got["info"]["defaulted_elements"] == 1
    # the packaged table's values: hydrogen 1, carbon 12, and the unknown atom as carbon
    assert abs(got["stats"]["mass_g/mol"] - 25.0) < 1e-9
    assert found.timings["stats"] > 0
    with pytest.raises(Exception, match="unknown element"):
        analyse(spark, path, grid=0.1, cube=True, no_octree=True, no_surface=True)


def test_atom_table_by_path_or_by_name(spark, tmp_path):
    from voidframe.functions import elements

    (tmp_path / "UFF.atoms").write_text("H 1 1.0 0.25\nD 1 2.0 0.50\nQ 7 5.0 0.1\nQ 8 6.0 0.2\n")
    own = elements.read_parameters(elements.parameter_lines(spark, str(tmp_path / "UFF.atoms")))
    names, values = elements.tables(spark, own)
    by_z = {r.z: (r.mass, r.radius_ang) for r in values.collect()}
    assert by_z[1] == (2.0, 2.5) and by_z[7] == (5.0, 0.5) and by_z[8] == (6.0, 1.0)
    assert {r.symbol: r.z for r in names.collect()}["Q"] == 8
    gaps = {r.z: r.mass for r in elements.tables(spark, own, overwrite=False)[1].collect()}
    assert gaps[1] == 1.008
    packaged = elements.read_parameters(elements.parameter_lines(spark, "no/such/folder/UFF.atoms"))
    assert packaged.count() == 95 and packaged.where("symbol = 'C'").first().mass == 12
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        elements.parameter_lines(spark, "no/such/other.atoms")
