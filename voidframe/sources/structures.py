"""Structure files as tables: GRO, XYZ, PDB and CIF by extension, many files at once.

Files are listed first: an extension that is none of these, or an empty file, is an error that names the files before anything is read. Only
the formats that occur are read, and each file once. GRO, XYZ and PDB are read line by line, so a large file is split over many tasks; a CIF,
which states one cell, is a row of text. Lines are parsed by column expressions. What is wrong inside a file is an error with its name.
Coordinates come out in nanometres. A box that a file does not state is zero, and `operators.grid.with_box` infers it.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.elements import guess_element
from ..plans.session import checkpointed, small

FORMATS = ("gro", "xyz", "pdb", "cif")


def listed(spark: SparkSession, paths: list[str]) -> set[str]:
    """The formats of the files."""
    found = spark.read.format("binaryFile").load(paths)
    names = found.inputFiles()
    form = lambda name: name.rpartition(".")[2].lower()
    if bad := [n for n in names if form(n) not in FORMATS]:
        raise ValueError(f"Unsupported file format: {', '.join(bad)}")
    if found.select("length").count() < len(names):  # Spark skips empty files
        plain = lambda name: unquote(name).replace("file:///", "file:/")
        full = {r.path for r in found.select("path").collect()}
        raise ValueError(f"Empty files: {', '.join(n for n in names if plain(n) not in full)}")
    return {form(n) for n in names}


def _only(spark: SparkSession, form: str):
    return spark.read.option("pathGlobFilter", "*." + "".join(f"[{c}{c.upper()}]" for c in form))


def file_lines(spark: SparkSession, paths: list[str], form: str) -> DataFrame:
    """structure_id (the path), at (from 0), line of the files of one format. A split numbers its own lines; how many lines the splits before it
    hold is a row for each split."""
    own = _only(spark, form).text(paths).select(F.input_file_name().alias("structure_id"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    own = checkpointed(own)
    splits = own.groupBy("structure_id", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("structure_id").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("structure_id", "_start", (before - F.col("_first")).alias("_shift"))
    return own.join(small(splits), ["structure_id", "_start"]).select("structure_id", (F.col("_id") + F.col("_shift")).alias("at"), "line")


def lines(texts: DataFrame) -> DataFrame:
    """structure_id, at, line of whole texts (structure_id, text)."""
    return texts.select("structure_id", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("at", "line"))


def _must(ok: Column, value: Column, said: str) -> Column:
    """value, or an error that names the file."""
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"{said}: "), "structure_id")))


def _number(text: Column, form: str, kind: str = "double") -> Column:
    value = F.trim(text).try_cast(kind)
    return _must(value.isNotNull(), value, f"{form}: a number is needed")


def _column(first: int, length: int) -> Column:
    return F.trim(F.substring("line", first, length))


def _atoms(rows: DataFrame, order: str, scale: float) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("structure_id").orderBy(order)) - 1
    return _placed(rows.withColumn("_n", number), F.col("_n"), scale)


def _placed(rows: DataFrame, number: Column, scale: float) -> DataFrame:
    return rows.select("structure_id", number.cast("int").alias("atom_id"), "element", *[(F.col(c).cast("double") * scale).alias(c) for c in "xyz"])


def _box(rows: DataFrame, values: list[Column], scale: float) -> DataFrame:
    return rows.select("structure_id", *[(v.cast("double") * scale).alias(n) for v, n in zip(values, ("lx", "ly", "lz"), strict=True)])


def read_gro(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with fixed columns after a title and a count; the box is the line after the atoms, of which three numbers count."""
    counts = rows.groupBy("structure_id").agg(F.max(F.when(F.col("at") == 1, F.col("line"))).alias("line"))
    counts = counts.select("structure_id", _number(F.col("line"), "GRO", "int").alias("n"))
    placed = rows.join(counts, "structure_id")
    atoms = placed.where("at between 2 and n + 1").select("structure_id", "at", guess_element(_column(11, 5)).alias("element"), *[_number(_column(a, 8), "GRO").alias(c) for c, a in (("x", 21), ("y", 29), ("z", 37))])
    last = placed.where("at = n + 2").select("structure_id", F.split(F.trim("line"), r"\s+").alias("c"))
    # a file that ends before its box has none
    last = counts.join(last, "structure_id", "left").withColumn("c", _must(F.size("c") >= 3, F.col("c"), "GRO: the box line needs three numbers"))
    return _placed(atoms, F.col("at") - 2, 1.0), _box(last, [_number(F.col("c")[i], "GRO") for i in range(3)], 1.0)


def read_xyz(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of blanks, then a count, a comment, `symbol x y z` in Angstrom; no box."""
    counts = rows.groupBy("structure_id").agg(F.min(F.when(F.trim("line") != "", F.struct("at", "line"))).alias("c"), F.max("at").alias("last"))
    counts = counts.select("structure_id", F.col("c.at").alias("first"), _number(F.col("c.line"), "XYZ", "int").alias("n"), "last")
    counts = counts.withColumn("n", _must(F.col("first") + F.col("n") + 1 <= F.col("last"), F.col("n"), "XYZ: fewer atoms than stated"))
    body = rows.join(counts, "structure_id").where("at between first + 2 and first + n + 1").select("structure_id", (F.col("at") - F.col("first") - 2).alias("at"), F.split(F.trim("line"), r"\s+").alias("c"))
    body = body.withColumn("c", _must(F.size("c") >= 4, F.col("c"), "XYZ: four columns are needed"))
    atoms = body.select("structure_id", "at", F.col("c")[0].alias("element"), *[_number(F.col("c")[i + 1], "XYZ").alias(n) for i, n in enumerate("xyz")])
    return _placed(atoms, F.col("at"), 0.1), _box(counts, [F.when(F.col("n") >= 0, 0.0)] * 3, 1.0)


def read_pdb(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ATOM and HETATM records of all models; the last CRYST1 gives the box and must be orthorhombic."""
    rows = rows.withColumn("kind", F.rtrim(F.substring("line", 1, 6)))
    is_atom = F.col("kind").isin("ATOM", "HETATM")
    given = _column(77, 2)
    atoms = rows.where(is_atom).select("structure_id", "at", F.when(given != "", given).otherwise(guess_element(_column(13, 4))).alias("element"), *[_number(_column(a, 8), "PDB").alias(c) for c, a in (("x", 31), ("y", 39), ("z", 47))])
    cell = rows.groupBy("structure_id").agg(F.max(F.when(F.col("kind") == "CRYST1", F.struct("at", "line"))).alias("c"), F.count_if(is_atom).alias("n"))
    cell = cell.select("structure_id", _must(F.col("n") > 0, F.col("c.line"), "PDB: no atoms").alias("line"))
    right = F.greatest(*[F.abs(_number(_column(a, 7), "PDB") - 90) for a in (34, 41, 48)]) <= 1e-6
    cell = cell.withColumn("line", F.when(F.col("line").isNotNull(), _must(right, F.col("line"), "PDB: only orthorhombic cells")))
    edges = [F.when(F.col("line").isNull(), 0.0).otherwise(_number(_column(a, 9), "PDB")) for a in (7, 16, 25)]
    return _atoms(atoms, "at", 0.1), _box(cell, edges, 0.1)


def _applied(op: Column) -> Column:
    """One coordinate of a symmetry operator such as 1/2-x, at the fractional position sx, sy, sz (names that no result has: inside a
    lambda, Spark takes a result of the same select before an input column)."""
    parts = F.regexp_extract_all(F.lower(F.regexp_replace(op, r"\s+", "")), F.lit(r"[+-]?[^+-]+"), F.lit(0))

    def value(t: Column) -> Column:
        sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
        body = F.regexp_replace(t, r"^[+-]", "")
        axis = F.regexp_extract(body, "([xyz])", 1)
        factor = F.regexp_extract(body, r"^([0-9.]+)", 1)
        over = F.regexp_extract(body, r"/([0-9.]+)", 1)
        number = F.when(factor == "", 1.0).otherwise(factor.try_cast("double")) / F.when(over == "", 1.0).otherwise(over.try_cast("double"))
        return sign * number * F.when(axis == "x", F.col("sx")).when(axis == "y", F.col("sy")).when(axis == "z", F.col("sz")).otherwise(1.0)

    return F.aggregate(F.transform(parts, value), F.lit(0.0), lambda a, b: a + b)


def read_cif(found: DataFrame, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Sites times symmetry operators, wrapped into the cell, coincident copies of a site (within tolerance, fractional) folded."""
    text = F.regexp_replace(F.regexp_replace("text", "\r\n|\r", "\n"), r"(?m)^\s*#.*$", "")
    cut = found.select("structure_id", text.alias("text"))
    tag = lambda name: F.regexp_extract("text", rf"(?mi)^\s*{name}\s+([0-9.]+)", 1).try_cast("double")
    cell = cut.select("structure_id", *[tag(f"_cell_length_{x}").alias(x) for x in "abc"], *[tag(f"_cell_angle_{x}").alias(x) for x in ("alpha", "beta", "gamma")])
    right = F.greatest(*[F.abs(F.coalesce(F.col(x), F.lit(90.0)) - 90) for x in ("alpha", "beta", "gamma")]) <= 1e-6
    cell = cell.withColumn("a", _must(right, F.col("a"), "CIF: only orthorhombic cells"))
    loops = cut.select("structure_id", F.explode(F.split("text", r"(?mi)^\s*loop_\s*$")).alias("loop")).withColumn("lines", F.filter(F.transform(F.split("loop", "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    until = lambda xs, stop: F.coalesce(F.nullif(F.array_position(F.transform(xs, stop), True), F.lit(0).cast("long")), F.size(xs) + 1).cast("int")
    loops = loops.withColumn("n", until(F.col("lines"), lambda x: ~x.startswith("_")) - 1)
    loops = loops.withColumn("tags", F.transform(F.slice("lines", F.lit(1), F.col("n")), F.lower)).withColumn("values", F.slice("lines", F.col("n") + 1, F.size("lines")))
    # values end where the next tag or data block begins
    with_values = loops.withColumn("values", F.slice("values", F.lit(1), until(F.col("values"), lambda x: x.rlike("^(_|data_|#|;)")) - 1))
    is_ops = F.exists("tags", lambda t: t.isin("_symmetry_equiv_pos_as_xyz", "_space_group_symop_operation_xyz"))
    ops = with_values.where(is_ops).select("structure_id", F.explode("values").alias("v")).select("structure_id", F.regexp_extract("v", r"([0-9xyzXYZ+\-/.* ]+,[0-9xyzXYZ+\-/.* ]+,[0-9xyzXYZ+\-/.* ]+)", 1).alias("op")).where("op <> ''")
    ops = ops.withColumn("op", F.trim(F.regexp_replace("op", r"^\s*\d+\s+(?=[-+xyzXYZ0-9])", "")))
    ops = cut.select("structure_id").join(ops, "structure_id", "left").withColumn("op", F.coalesce("op", F.lit("x,y,z"))).distinct()
    site_tags = F.array_position("tags", "_atom_site_fract_x") > 0
    sites = with_values.where(site_tags).select("structure_id", "tags", F.posexplode("values").alias("site", "v")).withColumn("c", F.split("v", r"\s+")).where(F.size("c") >= F.size("tags"))
    at = lambda name: F.get(F.col("c"), (F.array_position("tags", name) - 1).cast("int"))
    number = lambda name: F.regexp_replace(at(name), r"\(.*\)", "").cast("double")
    named = F.coalesce(F.when(F.array_position("tags", "_atom_site_type_symbol") > 0, at("_atom_site_type_symbol")), at("_atom_site_label"))
    sites = sites.select("structure_id", "site", F.regexp_extract(named, r"^([A-Z][a-z]?)", 1).alias("element"), *[number(f"_atom_site_fract_{x}").alias(f"s{x}") for x in "xyz"])
    spread = sites.join(ops, "structure_id").withColumn("p", F.split("op", ","))
    pos = spread.select("structure_id", "site", "element", *[F.pmod(_applied(F.col("p")[i]), F.lit(1.0)).alias(f"f{x}") for i, x in enumerate("xyz")])
    # A copy goes if an earlier one lies within the tolerance: copies meet in buckets of the cell and the buckets around.
    edge = 64
    pos = pos.distinct()  # so that the numbering has no ties
    pos = pos.withColumn("n", F.row_number().over(Window.partitionBy("structure_id").orderBy("site", "fx", "fy", "fz")))
    pos = pos.withColumns({f"b{x}": F.pmod(F.floor(F.col(f"f{x}") * edge), F.lit(edge)).cast("int") for x in "xyz"})
    around = pos
    for x in "xyz":
        around = around.withColumn(f"b{x}", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col(f"b{x}") + d, F.lit(edge)))))
    p, q = pos.alias("p"), around.alias("q")
    meets = (F.col("p.structure_id") == F.col("q.structure_id")) & (F.col("q.n") < F.col("p.n"))
    for x in "xyz":
        gap = F.col(f"p.f{x}") - F.col(f"q.f{x}")
        meets = meets & (F.col(f"p.b{x}") == F.col(f"q.b{x}")) & (F.abs(gap - F.rint(gap)) < tolerance)
    pos = p.join(q, meets, "left_anti")
    atoms = pos.join(cell, "structure_id").select("structure_id", F.struct("site", "fx", "fy", "fz").alias("at"), "element", *[(F.col(f"f{x}") * F.col(c)).alias(x) for x, c in zip("xyz", "abc", strict=True)])
    return _atoms(atoms, "at", 0.1), _box(cell, [F.col(c) for c in "abc"], 0.1)


def read_structures(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(atoms, boxes) of files of any of the formats."""
    paths = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    line_readers = {"gro": read_gro, "xyz": read_xyz, "pdb": read_pdb}
    each = []
    for form in sorted(listed(spark, paths)):
        if form == "cif":
            texts = _only(spark, form).text(paths, wholetext=True)
            each.append(read_cif(checkpointed(texts.select(F.input_file_name().alias("structure_id"), F.col("value").alias("text")))))
        else:
            each.append(line_readers[form](file_lines(spark, paths, form)))
    atoms, boxes = each[0]
    for a, b in each[1:]:
        atoms, boxes = atoms.unionByName(a), boxes.unionByName(b)
    return atoms, boxes
