"""Element data as small relations, and the joins that give atoms their number, radius and mass.

Unknown symbols count as carbon unless `strict`. A table of atom parameters replaces values for one call; nothing global changes.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Symbol, name, number, mass in g/mol, Bondi radius in Angstrom (- where none is known).
_TABLE = """
H Hydrogen 1 1.008 1.20
He Helium 2 4.0026 -
Li Lithium 3 6.94 1.82
Be Beryllium 4 9.0122 -
B Boron 5 10.81 1.92
C Carbon 6 12.011 1.70
N Nitrogen 7 14.007 1.55
O Oxygen 8 15.999 1.52
F Fluorine 9 18.998 1.47
Ne Neon 10 20.180 -
Na Sodium 11 22.990 2.27
Mg Magnesium 12 24.305 1.73
Al Aluminum 13 26.982 2.00
Si Silicon 14 28.085 2.10
P Phosphorus 15 30.974 1.80
S Sulfur 16 32.06 1.80
Cl Chlorine 17 35.45 1.75
Ar Argon 18 39.948 -
K Potassium 19 39.098 2.75
Ca Calcium 20 40.078 2.31
Sc Scandium 21 44.956 -
Ti Titanium 22 47.867 -
V Vanadium 23 50.942 -
Cr Chromium 24 51.996 -
Mn Manganese 25 54.938 2.00
Fe Iron 26 55.845 2.00
Co Cobalt 27 58.933 2.00
Ni Nickel 28 58.693 2.00
Cu Copper 29 63.546 2.00
Zn Zinc 30 65.38 2.10
Ga Gallium 31 69.723 -
Ge Germanium 32 72.63 -
As Arsenic 33 74.922 -
Se Selenium 34 78.96 -
Br Bromine 35 79.904 1.85
Kr Krypton 36 83.798 -
Rb Rubidium 37 85.468 -
Sr Strontium 38 87.62 -
Y Yttrium 39 88.906 -
Zr Zirconium 40 91.224 -
Nb Niobium 41 92.906 -
Mo Molybdenum 42 95.96 -
Tc Technetium 43 98 -
Ru Ruthenium 44 101.07 -
Rh Rhodium 45 102.91 -
Pd Palladium 46 106.42 -
Ag Silver 47 107.87 -
Cd Cadmium 48 112.41 -
In Indium 49 114.82 -
Sn Tin 50 118.71 -
Sb Antimony 51 121.76 -
Te Tellurium 52 127.60 -
I Iodine 53 126.90 1.98
Xe Xenon 54 131.29 -
Cs Cesium 55 132.91 -
Ba Barium 56 137.33 -
W Tungsten 74 183.84 -
Pt Platinum 78 195.08 -
Au Gold 79 196.97 -
Hg Mercury 80 200.59 -
Pb Lead 82 207.2 -
"""
#: Elements that a two-letter guess may give.
TWO_LETTERS = ("Cl", "Br", "Na", "Li", "Al", "Si", "Ca", "Fe", "Zn", "Mg", "Cu", "Mn", "Co", "Ni")
_ROWS = [r.split() for r in _TABLE.split("\n") if r]
CARBON = 6


def guess_element(name: Column) -> Column:
    """The element that an atom name begins with: two letters where these are one of TWO_LETTERS, else the first; X if empty."""
    s = F.trim(name)
    second = F.substring(s, 2, 1)
    pair = F.concat(F.upper(F.substring(s, 1, 1)), F.when(second.rlike(r"^\p{L}$"), F.lower(second)).otherwise(F.lit("")))
    return F.when(s == "", F.lit("X")).when(pair.isin(*TWO_LETTERS), pair).otherwise(F.upper(F.substring(s, 1, 1)))


def symbols(spark: SparkSession) -> DataFrame:
    """symbol, z: symbols and English names."""
    rows = [(k, int(r[2])) for r in _ROWS for k in (r[0], r[1])]
    return spark.createDataFrame(rows, "symbol string, z int")


def parameters(spark: SparkSession) -> DataFrame:
    """z, mass, radius_ang (null where unknown)."""
    return spark.createDataFrame([(int(r[2]), float(r[3]), None if r[4] == "-" else float(r[4])) for r in _ROWS], "z int, mass double, radius_ang double")


def packaged(name: str) -> Path:
    """Where a table of this name lies in the package (UFF.atoms)."""
    return Path(__file__).parent.parent / "data" / Path(name).name


def parameter_lines(spark: SparkSession, path: str) -> DataFrame:
    """(lineno, value) of an atom file; if there is none at the path, of the packaged table of that name."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        if not packaged(path).exists():
            raise
        return spark.createDataFrame(list(enumerate(packaged(path).read_text().splitlines())), "lineno int, value string")  # about a hundred lines
    return text.select(F.posexplode(F.split("value", "\n")).alias("lineno", "value"))


def read_parameters(lines: DataFrame) -> DataFrame:
    """symbol, z, mass, radius_ang, lineno from (lineno, value) rows of an atom file: `symbol Z mass sigma_nm ...`, # comments. The radius is half
    of sigma; of lines with one symbol and number the last counts; a line with fewer than four columns is an error."""
    cut = lines.select("lineno", F.trim("value").alias("s")).where("s <> '' and s not like '#%'").select("lineno", "s", F.split("s", r"\s+").alias("c"))
    checked = cut.withColumn("c", F.when(F.size("c") >= 4, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("atom file: four columns are needed: "), "s"))))
    rows = checked.select("lineno", F.col("c")[0].alias("symbol"), F.col("c")[1].cast("int").alias("z"), F.col("c")[2].cast("double").alias("mass"), (F.col("c")[3].cast("double") * 10 * 0.5).alias("radius_ang"))
    last = F.row_number().over(Window.partitionBy("symbol", "z").orderBy(F.desc("lineno")))
    return rows.withColumn("_n", last).where("_n = 1").select("symbol", "z", "mass", "radius_ang", "lineno")


def tables(spark: SparkSession, updates: DataFrame | None = None, overwrite: bool = True) -> tuple[DataFrame, DataFrame]:
    """(symbols, parameters), with the rows of an atom file put over the built-in ones, or only into their gaps. Of lines with one symbol, and of
    lines with one number, whatever their symbols, the last counts; in gaps the first."""
    names, values = symbols(spark), parameters(spark)
    if updates is None:
        return names, values
    counts = (lambda c: F.max_by(c, "lineno")) if overwrite else (lambda c: F.min_by(c, "lineno"))
    new_names = updates.groupBy("symbol").agg(counts("z").alias("new_z"))
    first, second = ("new_z", "z") if overwrite else ("z", "new_z")
    names = names.join(new_names, "symbol", "full").select("symbol", F.coalesce(first, second).alias("z"))
    by_z = updates.groupBy("z").agg(counts("mass").alias("m2"), counts("radius_ang").alias("r2"))
    pick = (lambda a, b: F.coalesce(b, a)) if overwrite else F.coalesce
    values = values.join(by_z, "z", "full").select("z", pick(F.col("mass"), F.col("m2")).alias("mass"), pick(F.col("radius_ang"), F.col("r2")).alias("radius_ang"))
    return names, values


def bind(atoms: DataFrame, names: DataFrame, values: DataFrame, strict: bool = False) -> DataFrame:
    """atoms with z, radius (nm), mass, and defaulted (the element is unknown and counts as carbon; strict: an error). The element tables have a row
    per element, so they are broadcast."""
    known = atoms.join(F.broadcast(names.withColumnRenamed("symbol", "element")), "element", "left")
    z = F.coalesce("z", F.raise_error(F.concat(F.lit("unknown element "), "element")) if strict else F.lit(CARBON)).cast("int")
    carbon = values.where(F.col("z") == CARBON).select(F.col("mass").alias("_cm"), F.col("radius_ang").alias("_cr"))
    out = known.withColumns({"z": z, "defaulted": F.col("z").isNull()}).join(F.broadcast(values), "z", "left").join(F.broadcast(carbon))
    return out.select(*atoms.columns, "z", (F.coalesce("radius_ang", "_cr") * 0.1).alias("radius"), F.coalesce("mass", "_cm").alias("mass"), "defaulted")
