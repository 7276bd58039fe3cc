"""Writers: cube fields, pore size tables, pore centres, statistics, intermediate tables.

A text result is a table of (structure_id, order, line). Many tasks write it, each a range of the order of (structure_id, order), so one
structure's text is spread over parts in a folder of its own, in order of their numbers. `whole_files` puts the parts of each structure
together as one file, part after part, in a job with a task for each structure that streams bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import checkpointed

#: Bohr per nm.
BOHR = 10.0 / 0.529177210903


def _line(key: Column, text: Column) -> list[Column]:
    return ["structure_id", key.alias("order"), text.alias("line")]


def _key(part: int, a: Column | int = 0, b: Column | int = 0) -> Column:
    as_long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    return F.array(F.lit(part).cast("long"), as_long(a), as_long(b))


def cube_lines(field: DataFrame, value: str, step: float, atoms: DataFrame) -> DataFrame:
    """A Gaussian cube: titles, atom count, axes (count and step in Bohr), atoms, then a line of values for each (ix, iy)."""
    shape = field.groupBy("structure_id").agg(*[(F.max(f"i{c}") + 1).alias(f"g{c}") for c in "xyz"])
    count = atoms.groupBy("structure_id").agg(F.count(F.lit(1)).alias("atoms"))
    head, s = shape.join(count, "structure_id"), F.lit(step * BOHR)
    zero = F.lit(0.0)
    axis = lambda n, x, y, z: F.format_string("%5d %12.6f %12.6f %12.6f", F.col(n), x, y, z)
    titles = [F.lit("Gaussian cube"), F.lit("Volumetric data"), F.format_string("%6d %12.6f %12.6f %12.6f", "atoms", zero, zero, zero), axis("gx", s, zero, zero), axis("gy", zero, s, zero), axis("gz", zero, zero, s)]
    parts = [head.select(*_line(_key(0, i), t)) for i, t in enumerate(titles)]
    at = [(F.col(c) * BOHR) for c in "xyz"]
    parts.append(atoms.select(*_line(_key(1, F.col("atom_id")), F.format_string("%5d %12.6f %12.6f %12.6f %12.6f", F.col("z_number"), F.col("z_number").cast("double"), *at))))
    row = field.groupBy("structure_id", "ix", "iy").agg(F.array_sort(F.collect_list(F.struct("iz", F.col(value).alias("v")))).alias("zs"))
    parts.append(row.select(*_line(_key(2, F.col("ix"), F.col("iy")), F.array_join(F.transform("zs", lambda z: F.format_string("%.8f", z["v"])), " "))))
    return reduce(lambda a, b: a.union(b), parts)


def psd_lines(psd: DataFrame) -> DataFrame:
    head = psd.select("structure_id").distinct().select(*_line(_key(0), F.lit("#N diameters_nm count volume cumulative")))
    # exponents as C writes them
    sci = lambda c: F.regexp_replace(F.format_string("%.10e", c), r"e([+-])(\d)$", r"e$10$2")
    body = F.concat_ws("\t", F.col("bin").cast("string"), F.format_string("%.6f", "diameter"), F.col("n").cast("string"), sci(F.col("volume")), sci(F.col("cumulative")))
    return head.union(psd.select(*_line(_key(1, F.col("bin")), body)))


def centre_lines(centres: DataFrame, structures: DataFrame) -> DataFrame:
    """Extended XYZ: positions in Angstrom, diameters in nm."""
    n = centres.groupBy("structure_id").count().join(structures, "structure_id")
    first = n.select(*_line(_key(0), F.col("count").cast("string")))
    about = F.format_string('Properties=species:S:1:pos:R:3:diameter_nm:R:1 Lattice="%.6f 0 0 0 %.6f 0 0 0 %.6f" pbc="T T T"', *[F.col(f"l{c}") * 10 for c in "xyz"])
    second = n.select(*_line(_key(1), about))
    rows = centres.select(*_line(_key(2, F.col("n")), F.format_string("He %.6f %.6f %.6f %.6f", *[F.col(c) * 10 for c in "xyz"], "diameter")))
    return first.union(second).union(rows)


def gro_lines(atoms: DataFrame, structures: DataFrame) -> DataFrame:
    """A GRO file of atoms with element, x, y, z in nm."""
    n = atoms.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n")).join(structures, "structure_id")
    head = n.select(*_line(_key(0), F.lit("written by Spark"))).union(n.select(*_line(_key(0, 1), F.format_string("%5d", "n"))))
    rows = atoms.select(*_line(_key(1, F.col("atom_id")), F.format_string("%5d%-5s%5s%5d%8.3f%8.3f%8.3f", F.lit(1), F.lit("UNL"), F.col("element"), (F.col("atom_id") % 100000).cast("int"), *[F.col(c) for c in "xyz"])))
    return head.union(rows).union(n.select(*_line(_key(2), F.format_string("%10.5f%10.5f%10.5f", "lx", "ly", "lz"))))


def write_lines(lines: DataFrame, path: str, parts: int | None = None) -> None:
    """A folder structure_id=<id> for each structure. Parts are ranges of about equal size, as many as given or as adaptive execution finds
    worth a task; lines of one structure in several parts go on from part to part."""
    dealt = lines.repartitionByRange(parts, "structure_id", "order") if parts else lines.repartitionByRange("structure_id", "order")
    dealt.sortWithinPartitions("structure_id", "order").select("structure_id", "line").write.partitionBy("structure_id").text(path)


#: Bytes that are held while a part is copied.
COPY_BYTES = 8 << 20


def part_files(spark: SparkSession, path: str) -> DataFrame:
    """structure_id, number and path of the parts under a folder of write_lines."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("path")
    return found.select(F.url_decode(F.replace(F.regexp_extract("path", "/structure_id=([^/]*)/", 1), F.lit("+"), F.lit("%2B"))).alias("structure_id"), F.regexp_extract("path", r"/part-(\d+)-", 1).cast("long").alias("number"), "path")


def whole_files(spark: SparkSession, path: str, to: str, ending: str = "") -> DataFrame:
    """Each structure of a folder of write_lines as one file in the folder `to`, which all executors reach; (structure_id, path, bytes). A file is
    written under a name of its task's own and then renamed, so a task that is run again leaves a whole file. Characters of a structure's name
    that a file name can't hold become _; the names are told apart by a hash of the name then."""
    safe = F.regexp_replace("structure_id", r"[^A-Za-z0-9._-]", "_")
    name = F.concat(F.when(safe == F.col("structure_id"), safe).otherwise(F.concat(safe, F.lit("-"), F.hex(F.xxhash64("structure_id")))), F.lit(ending))
    each = part_files(spark, path).groupBy("structure_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "path"))), lambda p: p["path"]).alias("paths"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for target, paths in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                files, place = _filesystem(target)
                files.create_dir(place.rpartition("/")[0], recursive=True)
                own, size = f"{place}.{uuid.uuid4().hex[:12]}.tmp", 0
                with files.open_output_stream(own) as out:
                    for p in paths:
                        source, at = _filesystem(p)
                        with source.open_input_stream(at) as part:
                            while chunk := part.read(COPY_BYTES):
                                size += out.write(chunk)
                files.move(own, place)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["structure_id", "path", "bytes"])

    # the parts of a structure are names here, not text
    named = each.select("structure_id", F.concat(F.lit(to.rstrip("/") + "/"), name).alias("path"), "paths").repartition("structure_id")
    return checkpointed(named.mapInArrow(joined, "structure_id string, path string, bytes long"))


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI as Spark writes it (file:/a stands for file:///a), and the path in it."""
    if ":/" not in path:
        return pyarrow.fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, rest = path.split("://", 1)
    return pyarrow.fs.FileSystem.from_uri(f"{scheme}://{rest.partition('/')[0]}/")[0], rest if scheme not in ("hdfs", "viewfs") else "/" + rest.partition("/")[2]


def write_stats(record: DataFrame, path: str) -> None:
    record.write.json(path)


def write_debug(tables: dict[str, DataFrame], path: str) -> None:
    """Each intermediate table as Parquet, in a folder of its name."""
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
