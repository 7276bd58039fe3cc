import pytest
from pyspark.sql import functions as F

from voidframe.functions import elements
from voidframe.sources import sinks, structures

GRO = "title\n2\n    1UNL     CU    1   0.745   0.100   0.000\n    1UNL     H1    2   0.833   0.642   2.491\n   2.6   2.5\t2.4\n"
XYZ = "\n2\ncomment\nCu 7.445 1.0 0.0\nO 8.33 6.42 24.9\n"
PDB = (
    "COMPND    X\nCRYST1   26.288   25.000   24.000  90.00  90.00  90.00 P1          1\n"
    "ATOM      1  CU  UNL A   1       7.450   7.450   0.000  1.00  0.00           C  \n"
    "HETATM    2  O   UNL A   1       8.330   6.420  24.910  1.00  0.00\nEND\n"
)
CIF = """data_x
_cell_length_a 10.0
_cell_length_b 10.0(2)
_cell_length_c 10.0
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 90
loop_
_symmetry_equiv_pos_as_xyz
x,y,z
'-x,1/2+y,-z'
loop_
_atom_site_label
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
Zn1 Zn 0.25 0.1 0.5
O1 O 0.0 0.0(1) 0.0
"""


def rows(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    atoms, boxes = structures.read_structures(spark, str(tmp_path / name))
    return [(r.element, *(round(r[c], 5) for c in "xyz")) for r in atoms.orderBy("atom_id").collect()], [round(v, 5) for v in boxes.first()[1:]]


def test_formats(spark, tmp_path):
    assert rows(spark, tmp_path, "a.gro", GRO) == ([("Cu", 0.745, 0.1, 0.0), ("H", 0.833, 0.642, 2.491)], [2.6, 2.5, 2.4])
    assert rows(spark, tmp_path, "a.xyz", XYZ) == ([("Cu", 0.7445, 0.1, 0.0), ("O", 0.833, 0.642, 2.49)], [0, 0, 0])
    assert rows(spark, tmp_path, "a.PDB", PDB) == ([("C", 0.745, 0.745, 0.0), ("O", 0.833, 0.642, 2.491)], [2.6288, 2.5, 2.4])
    atoms, box = rows(spark, tmp_path, "a.cif", CIF)
    assert sorted(atoms) == [("O", 0.0, 0.0, 0.0), ("O", 0.0, 0.5, 0.0), ("Zn", 0.25, 0.1, 0.5), ("Zn", 0.75, 0.6, 0.5)] and box == [1, 1, 1]


def test_operators_that_permute_axes(spark, tmp_path):
    text = CIF.replace("x,y,z\n'-x,1/2+y,-z'", "x,y,z\n'z,x,y'\n'y+1/2,z,x'\n'-x,-y,-z'").replace("O1 O 0.0 0.0(1) 0.0\n", "").replace("0.25 0.1 0.5", "0.1 0.2 0.3")
    atoms, _ = rows(spark, tmp_path, "p.cif", text)
    assert sorted(atoms) == [("Zn", 0.1, 0.2, 0.3), ("Zn", 0.3, 0.1, 0.2), ("Zn", 0.7, 0.3, 0.1), ("Zn", 0.9, 0.8, 0.7)]


def test_unknown_format_and_skewed_cell(spark, tmp_path):
    with pytest.raises(Exception, match="Unsupported file format"):
        rows(spark, tmp_path, "a.mol", GRO)
    with pytest.raises(Exception, match="orthorhombic"):
        rows(spark, tmp_path, "b.pdb", PDB.replace("  90.00  90.00  90.00", "  90.00  80.00  90.00"))


def test_guess_element(spark):
    names = {" CL1": "Cl", "C1": "C", "CR": "C", "": "X", "zr": "Z", "1H": "1", "NA": "Na", "o": "O"}
    got = spark.createDataFrame([(k,) for k in names], "n string").select("n", elements.guess_element(F.col("n")).alias("e")).collect()
    assert {r.n: r.e for r in got} == names


def test_parameters(spark):
    lines = spark.createDataFrame(list(enumerate(["# c", "", "C 6 12 0.3431 52.8", "Zn 30 65 0.2 1", "Zn 30 66 0.3 1"])), "lineno int, value string")
    updates = elements.read_parameters(lines)
    atoms = spark.createDataFrame([("Zn",), ("C",), ("Zr",), ("??",)], "element string")
    got = {r.element: (r.z, round(r.radius, 5), r.mass) for r in elements.bind(atoms, *elements.tables(spark, updates)).collect()}
    assert got == {"Zn": (30, 0.15, 66.0), "C": (6, 0.17155, 12.0), "Zr": (40, 0.17155, 91.224), "??": (6, 0.17155, 12.0)}
    fill = {r.element: round(r.radius, 5) for r in elements.bind(atoms, *elements.tables(spark, updates, overwrite=False)).collect()}
    assert fill["Zn"] == 0.21 and fill["C"] == 0.17
    with pytest.raises(Exception, match="unknown element"):
        elements.bind(atoms, *elements.tables(spark), strict=True).collect()
    with pytest.raises(Exception, match="four columns"):
        elements.read_parameters(spark.createDataFrame([(0, "C 6 12")], "lineno int, value string")).collect()


def test_gro_round_trip(spark, tmp_path):
    (tmp_path / "a.gro").write_text(GRO)
    atoms, boxes = structures.read_structures(spark, str(tmp_path / "a.gro"))
    one = atoms.withColumn("structure_id", F.lit("s"))
    sinks.write_lines(sinks.gro_lines(one, boxes.withColumn("structure_id", F.lit("s"))), str(tmp_path / "out"))
    again, _ = structures.read_gro(structures.lines(spark.read.text(str(tmp_path / "out" / "structure_id=s"), wholetext=True).select(F.lit("s").alias("structure_id"), F.col("value").alias("text"))))
    assert again.orderBy("atom_id").collect() == one.orderBy("atom_id").collect()


def test_bad_files_are_named(spark, tmp_path):
    bad = {
        "count.gro": "title\nmany\n",
        "short.gro": GRO.rsplit("\n", 2)[0] + "\n",
        "one.gro": "title\n",
        "word.gro": GRO.replace("0.745", "x.745"),
        "box.gro": GRO.replace("2.6   2.5\t2.4", "2.6 2.5"),
        "short.xyz": XYZ.replace("\n2\n", "\n3\n"),
        "blank.xyz": "\n\n",
        "three.xyz": XYZ.replace(" 24.9", ""),
        "none.pdb": PDB.split("ATOM")[0],
        "empty.cif": "",
    }
    for name, text in bad.items():
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match=name.replace(".", "[.]")):
            atoms, boxes = structures.read_structures(spark, [str(tmp_path / name)])
            atoms.collect(), boxes.collect()


def test_a_file_is_split_over_tasks_and_read_once(spark, tmp_path):
    """Files of all formats in one folder, in splits of a few lines: the same atoms as from whole texts."""
    folder = tmp_path / "a folder"
    folder.mkdir()
    n = 3000
    big = "\n".join(["title", str(n), *[f"    1UNL  {'CU' if i % 3 else 'H1':>5s}{i % 99999:5d}{i / 1000:8.3f}{0.5:8.3f}{i % 7:8.3f}" for i in range(n)], "9.0 8.0 7.0", ""])
    for name, text in {"big.gro": big, "b.GRO": GRO, "c.xyz": "\n" + XYZ, "d.pdb": PDB, "e.cif": CIF}.items():
        (folder / name).write_text(text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = structures.file_lines(spark, [str(folder)], "gro")
        assert rows.where("structure_id like '%big.gro'").select(F.spark_partition_id()).distinct().count() > 8
        atoms, boxes = structures.read_structures(spark, str(folder))
        got = {(r.structure_id.rpartition("/")[2], r.atom_id): (r.element, r.x, r.z) for r in atoms.collect()}
        assert boxes.count() == 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {k: v for k, v in got.items() if k[0] == "big.gro"} == {("big.gro", i): ("Cu" if i % 3 else "H", float(f"{i / 1000:.3f}"), float(i % 7)) for i in range(n)}
    assert len(got) == n + 2 + 2 + 2 + 4
    # the parsed tables come from what was read once
    assert "FileScan" not in atoms._jdf.queryExecution().toString()


def test_files_that_arrive(spark, tmp_path):
    from voidframe.streaming import watch_gro

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gro").write_text(GRO)
    seen = []

    def handle(atoms, boxes, batch):
        seen.append((batch, [(r.element, r.x, r.z_number, r.mass) for r in atoms.orderBy("atom_id").collect()], boxes.first().lz))

    for k in range(2):
        query = watch_gro(spark, str(tmp_path / "in"), handle, str(tmp_path / "state"))
        query.awaitTermination(120)
        (tmp_path / "in" / "b.gro").write_text(GRO.replace("0.745", "0.845"))
    assert [s[0] for s in seen] == [0, 1] and seen[0][1][0] == ("Cu", 0.745, 29, 63.546) and seen[1][1][0][1] == 0.845 and seen[0][2] == 2.4


@pytest.mark.parametrize("parts", [7, None])
def test_parts_of_a_text_and_whole_files(spark, tmp_path, parts):
    """A cube of one large structure is written by several tasks; parts in order, and the file put together, hold its lines in order."""
    g = (12, 9, 5)
    cells = spark.range(g[0] * g[1] * g[2]).select(*[F.expr(e).cast("int").alias(c) for c, e in (("ix", "id div 45"), ("iy", "id div 5 % 9"), ("iz", "id % 5"))], (F.col("id") / 7).alias("f"))
    field = cells.withColumn("structure_id", F.lit("file:///a b/c=1+2.gro")).union(cells.where("ix < 2 and iy < 2 and iz < 2").withColumn("structure_id", F.lit("tiny")))
    atoms = spark.createDataFrame([("file:///a b/c=1+2.gro", i, 6, 0.1 * i, 0.2, 0.3) for i in range(11)] + [("tiny", 0, 1, 0.0, 0.0, 0.0)], "structure_id string, atom_id int, z_number int, x double, y double, z double")
    lines = sinks.cube_lines(field, "f", 0.1, atoms)
    want = {}
    for r in sorted(lines.collect(), key=lambda r: (r.structure_id, r.order)):
        want.setdefault(r.structure_id, []).append(r.line)
    sinks.write_lines(lines, str(tmp_path / "cube"), parts)
    found = sinks.part_files(spark, str(tmp_path / "cube")).orderBy("structure_id", "number").collect()
    assert {r.structure_id for r in found} == set(want)
    if parts:
        assert sum(r.structure_id != "tiny" for r in found) >= 5
    out = {r.structure_id: r for r in sinks.whole_files(spark, str(tmp_path / "cube"), str(tmp_path / "whole"), ".cube").collect()}
    again = sinks.whole_files(spark, str(tmp_path / "cube"), f"file:{tmp_path}/whole", ".cube")
    assert again.count() == len(out) == len(list((tmp_path / "whole").iterdir())) == 2
    for name, own in want.items():
        text = open(out[name].path).read()
        assert text.splitlines() == own and len(text) == out[name].bytes
    assert out["tiny"].path.endswith("/tiny.cube") and len(want["tiny"]) == 6 + 1 + 4
    rows = want["file:///a b/c=1+2.gro"]
    assert len(rows) == 6 + 11 + 12 * 9 and rows[-1] == " ".join(f"{(535 + k) / 7:.8f}" for k in range(5))
