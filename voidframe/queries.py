"""Queries over the given tables, and the same in SQL.

`customer` serves as a table of atoms: a nation is a structure, a customer an atom, its key gives the position and its market segment
the element. The box grows with the cube root of the number of atoms, so the density does not depend on the table's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import elements, geometry
from .operators import distance, fields, grid, octree, percolation, pores, stats, surface
from .sources import sinks, structures
from .plans.session import small

GRID = 0.1
#: Segment, element, radius in nm (half of sigma), mass, number.
ELEMENTS = (("BUILDING", "C", 0.17155, 12.0, 6), ("FURNITURE", "O", 0.1559, 16.0, 8), ("AUTOMOBILE", "H", 0.12855, 1.0, 1), ("MACHINERY", "N", 0.16305, 14.007, 7), ("HOUSEHOLD", "Zn", 0.1231, 65.38, 30))
_PRIMES = {"x": 7919, "y": 104729, "z": 1299709}


def _case(of: str, i: int) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"cast({v} as double)" if isinstance(v, float) else str(v)
    return f"case {of} " + " ".join(f"when '{e[0]}' then {show(e[i])}" for e in ELEMENTS) + " end"


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(atoms, grids) of the customer table."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("structure_id"), "c_custkey", "c_mktsegment")
    edge = F.greatest(F.round(F.lit(0.25) * F.cbrt(F.count(F.lit(1)).cast("double")), 1), F.lit(0.5))
    s = c.groupBy("structure_id").agg(edge.alias("lx")).select("structure_id", "lx", F.col("lx").alias("ly"), F.col("lx").alias("lz"))
    placed = c.join(small(s), "structure_id")  # a row per nation
    atoms = placed.select("structure_id", F.col("c_custkey").alias("atom_id"), F.expr(_case("c_mktsegment", 1)).alias("element"), *[((F.col("c_custkey") * p % 20011).cast("double") / 20011.0 * F.col("lx")).alias(a) for a, p in _PRIMES.items()], F.expr(_case("c_mktsegment", 2)).alias("radius"), F.expr(_case("c_mktsegment", 3)).alias("mass"), F.expr(_case("c_mktsegment", 4)).alias("z_number"))
    return atoms, grid.sized(s, GRID)


_SQL_BASE = f"""
s as (select c_nationkey as structure_id, greatest(round(0.25::double * cbrt(count(*)::double), 1), 0.5::double) as l from customer group by 1),
g as (select structure_id, l, greatest(cast(round_even(l / {GRID}::double, 0) as int), 1) as n, l / greatest(cast(round_even(l / {GRID}::double, 0) as int), 1) as dg from s),
a as (select c_nationkey as structure_id, c_custkey as atom_id, {_case("c_mktsegment", 1)} as element,
  {", ".join(f"((c_custkey * {p}) % 20011)::double / 20011.0::double * l as {x}" for x, p in _PRIMES.items())},
  {_case("c_mktsegment", 2)} as radius, {_case("c_mktsegment", 3)} as mass, {_case("c_mktsegment", 4)} as z_number
  from customer join s on c_nationkey = structure_id)"""
_SQL_VOXELS = f"""{_SQL_BASE},
v as (select structure_id, l, n, dg, i.i as ix, j.i as iy, k.i as iz, (i.i * n + j.i) * n + k.i as vid, (i.i + 0.5::double) * dg as x, (j.i + 0.5::double) * dg as y, (k.i + 0.5::double) * dg as z
  from g, range(200) i(i), range(200) j(i), range(200) k(i) where i.i < n and j.i < n and k.i < n)"""


def _sql_gap(p: str, q: str, length: str) -> str:
    d = [f"({p}.{c} - {q}.{c} - round_even(({p}.{c} - {q}.{c}) / {length}, 0) * {length})" for c in "xyz"]
    return "sqrt(" + " + ".join(f"{x} * {x}" for x in d) + ")"


def _sql_field(probe: float = 0.0) -> str:
    return f"""{_SQL_VOXELS},
d0 as (select v.structure_id, v.l, v.n, v.dg, v.ix, v.iy, v.iz, v.vid, v.x, v.y, v.z, min({_sql_gap("v", "a", "v.l")} - a.radius) as gap from v join a on v.structure_id = a.structure_id group by all),
d as (select *, gap - {probe}::double as dmin, gap > 0 as vdw, gap - {probe}::double > 0 as void, abs(gap - {probe}::double) < dg * 0.7071068::double + 1e-6::double as boundary from d0)"""


_SIX = "(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)"


def _sql_flood() -> str:
    """Accessible void voxels: flooded from a low face, then back from the high face that was reached."""
    parts = []
    for c in "xyz":
        step = "join (values " + _SIX + ") o(a, b, c) on true join w on w.structure_id = f.structure_id and w.ix = f.ix + o.a and w.iy = f.iy + o.b and w.iz = f.iz + o.c"
        parts.append(f"up{c} as (select structure_id, ix, iy, iz from w where i{c} = 0 union select w.structure_id, w.ix, w.iy, w.iz from up{c} f {step}),")
        parts.append(f"dn{c} as (select u.structure_id, u.ix, u.iy, u.iz from up{c} u join g on g.structure_id = u.structure_id where u.i{c} = g.n - 1 union select w.structure_id, w.ix, w.iy, w.iz from dn{c} f {step}),")
    return f"""w as (select structure_id, ix, iy, iz from d where void),
{chr(10).join(parts)}
acc as (select * from dnx union select * from dny union select * from dnz),
lab as (select d.*, case when not void then 0 when acc.ix is not null then 2 else 1 end as label from d left join acc using (structure_id, ix, iy, iz))"""


def _field(spark: SparkSession, sf_dir: str, probe: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    atoms, grids = tables(spark, sf_dir)
    return atoms, grids, distance.field(atoms, grids, GRID, probe)


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from .plans.session import checkpointed

    atoms, grids, vox = _field(spark, sf_dir)
    return atoms, grids, checkpointed(percolation.labelled(checkpointed(vox), grids))


QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


@query("p1_guess_element", f"""select p_partkey, case when p_name = '' then 'X' when pair in ({", ".join(repr(x) for x in elements.TWO_LETTERS)}) then pair else upper(p_name[1]) end as element
from (select p_partkey, trim(p_name) as p_name, upper(trim(p_name)[1]) || case when regexp_matches(trim(p_name)[2], '^\\p{{L}}$') then lower(trim(p_name)[2]) else '' end as pair from part)""")
def p1(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", elements.guess_element(F.col("p_name")).alias("element"))


@query("j16_element_parameters", f"""with {_SQL_BASE} select structure_id, atom_id, case element when 'C' then 6 when 'O' then 8 when 'H' then 1 when 'N' then 7 else 30 end as z,
round(case element when 'C' then 1.70 when 'O' then 1.52 when 'H' then 1.20 when 'N' then 1.55 else 2.10 end::double * 0.1::double, 6) as radius,
case element when 'C' then 12.011 when 'O' then 15.999 when 'H' then 1.008 when 'N' then 14.007 else 65.38 end::double as mass from a""")
def j16(spark, sf_dir):
    atoms, _ = tables(spark, sf_dir)
    bound = elements.bind(atoms.select("structure_id", "atom_id", "element"), *elements.tables(spark))
    return bound.select("structure_id", "atom_id", "z", F.round("radius", 6).alias("radius"), "mass")


@query("s6_atom_parameters", """with l as (select p_partkey, 'Q' || (p_partkey % 50) as symbol, (p_partkey % 50)::int as z, p_size::double as mass, p_retailprice / 1000 as sigma from part)
select symbol, z, arg_max(mass, p_partkey) as mass, round(arg_max(sigma, p_partkey) * 10 * 0.5::double, 6) as radius_ang from l group by symbol, z""")
def s6(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    lines = part.select(F.col("p_partkey").alias("lineno"), F.concat_ws(" ", F.concat(F.lit("Q"), F.col("p_partkey") % 50), F.col("p_partkey") % 50, F.col("p_size"), F.col("p_retailprice") / 1000, F.lit("0")).alias("value"))
    return elements.read_parameters(lines).select("symbol", "z", "mass", F.round("radius_ang", 6).alias("radius_ang"))


@query("s6_shared_numbers", """with l as (select p_partkey, 'Q' || (p_partkey % 50) as symbol, (200 + p_partkey % 20)::int as z, p_size::double as mass, p_retailprice / 1000 as sigma from part)
select z, arg_max(mass, p_partkey) as mass, round(arg_max(sigma, p_partkey) * 10 * 0.5::double, 6) as radius_ang, (select string_agg(symbol, ',' order by symbol) from (select symbol, arg_max(z, p_partkey) as last from l group by 1) n where n.last = l.z) as symbols from l group by z""")
def s6_shared(spark, sf_dir):
    """Symbols that share a number, and change it: the last line with a number gives its values, the last with a symbol its number."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    lines = part.select(F.col("p_partkey").alias("lineno"), F.concat_ws(" ", F.concat(F.lit("Q"), F.col("p_partkey") % 50), F.lit(200) + F.col("p_partkey") % 20, F.col("p_size"), F.col("p_retailprice") / 1000).alias("value"))
    names, values = elements.tables(spark, elements.read_parameters(lines))
    by = names.where("z >= 200").groupBy("z").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("symbols"))
    return values.where("z >= 200").join(by, "z", "left").select("z", "mass", F.round("radius_ang", 6).alias("radius_ang"), "symbols")


@query("p6_box_inference", f"""with {_SQL_BASE} select structure_id, {", ".join(f"round(max({c} + radius) - min({c} - radius), 9) as l{c}" for c in "xyz")}, true as box_inferred from a group by 1""")
def p6(spark, sf_dir):
    atoms, grids = tables(spark, sf_dir)
    _, sized = grid.with_box(atoms, grids.select("structure_id", *[F.lit(0.0).alias(f"l{c}") for c in "xyz"]))
    return sized.select("structure_id", *[F.round(f"l{c}", 9).alias(f"l{c}") for c in "xyz"], "box_inferred")


@query("p7_grid_sizing", f"with {_SQL_BASE} select structure_id, n as gx, n as gy, n as gz, round(dg, 9) as dgx from g")
def p7(spark, sf_dir):
    return tables(spark, sf_dir)[1].select("structure_id", "gx", "gy", "gz", F.round("dgx", 9).alias("dgx"))


@query("p9_cell_index", f"""with {_SQL_BASE}, n as (select a.structure_id, greatest(floor(l / greatest(max(radius), {GRID}::double))::int, 1) as nx, l from a join s using (structure_id) group by a.structure_id, l)
select structure_id, atom_id, {", ".join(f"floor({c} / l * nx)::int % nx as c{c}" for c in "xyz")} from a join n using (structure_id)""")
def p9(spark, sf_dir):
    atoms, grids = tables(spark, sf_dir)
    return distance.located(atoms, distance.cells(grids, atoms, GRID)).select("structure_id", "atom_id", "cx", "cy", "cz")


@query("j2_voxel_nearest", f"with {_sql_field(0.02)} select structure_id, vid, round(dmin, 6) as dmin, vdw, void, boundary from d")
def j2(spark, sf_dir):
    return _field(spark, sf_dir, 0.02)[2].select("structure_id", "vid", F.round("dmin", 6).alias("dmin"), "vdw", "void", "boundary")


_SQL_LONG = f"""with {_SQL_BASE},
b as (select structure_id, l as lx, round(l * 1.3::double, 1) as ly, round(l * 0.8::double, 1) as lz from s),
h as (select *, {", ".join(f"greatest(cast(round_even(l{c} / {GRID}::double, 0) as int), 1) as g{c}" for c in "xyz")} from b),
p as (select a.structure_id, a.radius, {", ".join(f"a.{c} / s.l * b.l{c} as {c}" for c in "xyz")} from a join s using (structure_id) join b using (structure_id)),
v as (select h.*, {", ".join(f"({i}.{i} + 0.5::double) * (l{c} / g{c}) as {c}" for c, i in zip("xyz", "ijk"))} from h, range(200) i(i), range(200) j(j), range(200) k(k) where i.i < gx and j.j < gy and k.k < gz),
d as (select v.structure_id, gx, gy, gz, lx, ly, lz, v.x, v.y, v.z, min(sqrt({" + ".join(f"pow(v.{c} - p.{c} - round_even((v.{c} - p.{c}) / l{c}, 0) * l{c}, 2)" for c in "xyz")}) - p.radius) as gap from v join p on p.structure_id = v.structure_id group by all)
select structure_id, gx, gy, gz, count(*) as voxels, count_if(gap > 0)::bigint as n_void, count_if(abs(gap) < greatest(lx / gx, ly / gy, lz / gz) * 0.7071068::double + 1e-6::double)::bigint as n_boundary, round(sum(gap), 5) as total from d group by 1, 2, 3, 4"""


@query("j2_long_boxes", _SQL_LONG)
def j2_long(spark, sf_dir):
    """Boxes whose axes differ, so none can stand for another."""
    atoms, cubes = tables(spark, sf_dir)
    boxes = cubes.select("structure_id", "lx", F.round(F.col("lx") * 1.3, 1).alias("ly"), F.round(F.col("lx") * 0.8, 1).alias("lz"))
    cube = cubes.select("structure_id", F.col("lx").alias("_l"))
    grids = grid.sized(boxes, GRID)
    moved = atoms.join(small(cube), "structure_id").join(small(boxes), "structure_id").withColumns({c: F.col(c) / F.col("_l") * F.col(f"l{c}") for c in "xyz"}).select(atoms.columns)
    vox = distance.field(moved, grids, GRID).groupBy("structure_id").agg(F.count(F.lit(1)).alias("voxels"), F.count_if("void").alias("n_void"), F.count_if("boundary").alias("n_boundary"), F.round(F.sum("dmin"), 5).alias("total"))
    return grids.select("structure_id", "gx", "gy", "gz").join(vox, "structure_id")


@query("j3_all_atoms", f"with {_sql_field()} select structure_id, round(sum(gap), 4) as total, count(*) as voxels from d group by 1")
def j3(spark, sf_dir):
    atoms, grids = tables(spark, sf_dir)
    gaps = distance.all_gaps(grid.voxels(grids), ["vid"], atoms, grids).groupBy("structure_id", "vid").agg(F.min("gap").alias("gap"))
    return gaps.groupBy("structure_id").agg(F.round(F.sum("gap"), 4).alias("total"), F.count(F.lit(1)).alias("voxels"))


_TOP = f"""{_sql_field()},
nn as (select a.structure_id, greatest(floor(l / greatest(max(radius), {GRID}::double))::int, 1) as nx from a join s using (structure_id) group by a.structure_id, l),
c0 as (select d.structure_id, d.vid, a.atom_id, {_sql_gap("d", "a", "d.l")} - a.radius as score from d join a on a.structure_id = d.structure_id join nn on nn.structure_id = d.structure_id
  where d.boundary and {" and ".join(f"abs((floor(d.{c} / d.l * nx)::int % nx) - (floor(a.{c} / d.l * nx)::int % nx)) in (0, 1, nx - 1)" for c in "xyz")}),
c as (select *, row_number() over (partition by structure_id, vid order by score, atom_id) - 1 as rank from c0)"""


@query("j4_top_atoms", f"with {_TOP} select structure_id, vid, rank::int as rank, atom_id from c where rank < 3")
def j4(spark, sf_dir):
    atoms, grids, vox = _field(spark, sf_dir)
    found = octree.candidates(vox.where("boundary"), atoms, distance.cells(grids, atoms, GRID), 0.0, in_cell=True)
    ranks = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.col(f"atom{k + 1}").alias("atom_id")) for k in range(octree.TOP)]))
    return found.select("structure_id", "vid", ranks.alias("c")).select("structure_id", "vid", "c.rank", "c.atom_id").where("atom_id is not null")


@query("p15_solid_boundary", f"""with {_sql_field()} select structure_id, count(*) as n from d where not void and (ix = 0 or iy = 0 or iz = 0 or ix = n - 1 or iy = n - 1 or iz = n - 1
 or exists (select 1 from d e, (values {_SIX}) o(a, b, c) where e.void and e.structure_id = d.structure_id and e.ix = d.ix + o.a and e.iy = d.iy + o.b and e.iz = d.iz + o.c)) group by 1""")
def p15(spark, sf_dir):
    _, grids, vox = _field(spark, sf_dir)
    return distance.solid_boundary(vox, grids).groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"))


_SQL_VOID_EDGE = f"""{_sql_field()},
e as (select d.* from d where void and (select count(*) from d f, (values {_SIX}) o(a, b, c) where f.void and f.structure_id = d.structure_id and f.ix = d.ix + o.a and f.iy = d.iy + o.b and f.iz = d.iz + o.c) < 6)"""


@query("j19_void_edge_distance", f"""with {_SQL_VOID_EDGE} select d.structure_id, d.vid, round(greatest(min(sqrt((d.x - e.x) * (d.x - e.x) + (d.y - e.y) * (d.y - e.y) + (d.z - e.z) * (d.z - e.z))) - 0.5::double * d.dg, 0), 6) as dist
from d join e on d.structure_id = e.structure_id where d.void group by d.structure_id, d.vid, d.dg""")
def j19(spark, sf_dir):
    _, grids, vox = _field(spark, sf_dir)
    found = distance.to_targets(vox.where("void"), distance.void_boundary(vox), grids, False, 0.5)
    return found.select("structure_id", "vid", F.round("d", 6).alias("dist"))


@query("j18_boundary_distance", f"""with {_sql_field()} select d.structure_id, d.vid, round(min({_sql_gap("d", "e", "d.l")}), 6) as dist from d join d e on d.structure_id = e.structure_id and e.boundary where d.void group by d.structure_id, d.vid""")
def j18(spark, sf_dir):
    _, grids, vox = _field(spark, sf_dir)
    return distance.to_targets(vox.where("void"), vox.where("boundary"), grids, True).select("structure_id", "vid", F.round("d", 6).alias("dist"))


@query("g1_percolation", f"with recursive {_sql_field()}, {_sql_flood()} select structure_id, vid, label from lab")
def g1(spark, sf_dir):
    return _labels(spark, sf_dir)[2].select("structure_id", "vid", "label")


@query("g8_components_26", f"""with recursive {_sql_field()}, w as (select structure_id, vid, ix, iy, iz from d where void),
near as (select p.structure_id, p.vid as a, q.vid as b from w p join w q on q.structure_id = p.structure_id and q.vid <> p.vid and abs(q.ix - p.ix) <= 1 and abs(q.iy - p.iy) <= 1 and abs(q.iz - p.iz) <= 1),
reach as (select structure_id, vid as src, vid from w union select r.structure_id, r.src, n.b from reach r join near n on n.structure_id = r.structure_id and n.a = r.vid and n.b > r.src)
select structure_id, vid, min(src) as component from reach group by 1, 2""")
def g8(spark, sf_dir):
    return percolation.voxel_components(_field(spark, sf_dir)[2], 26)


def _sql_steps(near: str) -> str:
    """Depths by a queue: a voxel is kept with the depth at which it is first reached."""
    return f"""{_sql_field()}, w as (select structure_id, vid, ix, iy, iz from d where void),
near as (select p.structure_id, p.vid as a, q.vid as b from w p join w q on q.structure_id = p.structure_id and {near}),
reach as (select structure_id, vid as src, vid from w union select r.structure_id, r.src, n.b from reach r join near n on n.structure_id = r.structure_id and n.a = r.vid and n.b > r.src),
first as (select structure_id, vid from reach group by 1, 2 having min(src) = vid),
steps(structure_id, vid, depth) using key (structure_id, vid) as (select structure_id, vid, 0 from first
  union select s.structure_id, n.b, min(s.depth + 1) from steps s join near n on n.structure_id = s.structure_id and n.a = s.vid left join recurring.steps k on k.structure_id = n.structure_id and k.vid = n.b where k.vid is null group by 1, 2)
select s.structure_id, s.vid, any_value(s.depth)::int as depth, min(p.vid) as parent from steps s left join near n on n.structure_id = s.structure_id and n.a = s.vid
left join steps p on p.structure_id = n.structure_id and p.vid = n.b and p.depth = s.depth - 1 group by 1, 2"""


def _bfs(neighbours: int):
    def run(spark, sf_dir):
        from .plans.session import checkpointed

        vox = checkpointed(_field(spark, sf_dir)[2])
        return percolation.bfs_parents(vox, checkpointed(percolation.voxel_components(vox, neighbours)), neighbours)

    return run


query("g8_parents", "with recursive " + _sql_steps("abs(q.ix - p.ix) + abs(q.iy - p.iy) + abs(q.iz - p.iz) = 1"))(_bfs(6))
query("g8_parents_26", "with recursive " + _sql_steps("q.vid <> p.vid and abs(q.ix - p.ix) <= 1 and abs(q.iy - p.iy) <= 1 and abs(q.iz - p.iz) <= 1"))(_bfs(26))


@query("g3_runs", f"""with {_sql_field()}, r as (select *, iz - row_number() over (partition by structure_id, ix, iy order by iz) as k from d where void)
select structure_id, ix::int as ix, iy::int as iy, min(iz)::int as z0, max(iz)::int as z1, min(vid) as run from r group by structure_id, ix, iy, k""")
def g3(spark, sf_dir):
    return percolation.runs(_field(spark, sf_dir)[2].where("void")).select("structure_id", "ix", "iy", "z0", "z1", "run")


@query("a9_void_volume", f"""with {_sql_field()} select structure_id, count(*) as voxels, count_if(void)::bigint as n_void, count_if(boundary)::bigint as n_boundary, round(count_if(void) * dg * dg * dg, 9) as v_void, round(max(dmin), 6) as dmax from d group by structure_id, dg""")
def a9(spark, sf_dir):
    _, grids, vox = _field(spark, sf_dir)
    found = stats.volumes(vox.withColumn("label", F.lit(0)), grids)
    return found.select("structure_id", "voxels", "n_void", "n_boundary", F.round("v_void", 9).alias("v_void"), F.round("dmax", 6).alias("dmax"))


@query("a12_density", f"with {_SQL_BASE} select structure_id, count(*) as atoms, round(sum(mass), 6) as mass, round(sum(mass) / 6.02214076e23::double / (l * l * l * 1e-21::double), 6) as density from a join s using (structure_id) group by structure_id, l")
def a12(spark, sf_dir):
    return stats.masses(*tables(spark, sf_dir)).select("structure_id", "atoms", F.round("mass", 6).alias("mass"), F.round("density", 6).alias("density"))


@query("a13_volume_fractions", f"""with recursive {_sql_field()}, {_sql_flood()} select structure_id, round(count_if(void)::double / count(*), 6) as void_frac, round(count_if(label = 2)::double / count(*), 6) as acc_frac, round(count_if(label = 1)::double / count(*), 6) as trap_frac from lab group by 1""")
def a13(spark, sf_dir):
    atoms, grids, labels = _labels(spark, sf_dir)
    found = stats.record(grids, stats.masses(atoms, grids), stats.volumes(labels, grids), None, None)
    return found.select("structure_id", *[F.round(f"{k}_frac", 6).alias(f"{k}_frac") for k in ("void", "acc", "trap")])


_EVAL = "coalesce(list_min(list_transform(cand, lambda c: sqrt({}) - c.radius)), 1e9)".format(" + ".join(f"pow({{{c}}} - c.{c} - round_even(({{{c}}} - c.{c}) / l, 0) * l, 2)" for c in "xyz"))
_LEVELS = 4


def _sql_tree() -> str:
    """Nodes of all levels; a level's are born from those above that are split."""
    own = "structure_id, root, l, dg, ix, iy, iz, path, level, x, y, z, cand"
    parts = [f"""{_TOP},
k as (select c.structure_id, c.vid, list({{'radius': a.radius, 'x': a.x, 'y': a.y, 'z': a.z}} order by rank) as cand from c join a using (structure_id, atom_id) where rank < 3 group by 1, 2),
c0_ as (select d.structure_id, d.vid as root, d.l, d.dg, d.ix, d.iy, d.iz, 1::bigint as path, 0 as level, x, y, z, cand from d left join k using (structure_id, vid) where boundary)"""]
    for level in range(_LEVELS):
        half = 0.5 / 2**level
        split = f"abs(dist) <= {half} * dg * 1.4142136::double + 1e-6::double" if level + 1 < _LEVELS else "false"
        parts.append(f"t{level} as (select *, {split} as split from (select {own}, {_EVAL.format(x='x', y='y', z='z')} as dist from c{level}_))")
        if level + 1 < _LEVELS:
            born = ", ".join(f"{c} + (case when o & {1 << b} > 0 then 1 else -1 end) * dg * {half / 2} as {c}" for b, c in enumerate("xyz"))
            parts.append(f"c{level + 1}_ as (select structure_id, root, l, dg, ix, iy, iz, path * 8 + o as path, {level + 1} as level, {born}, cand from t{level}, range(8) r(o) where split)")
    parts.append("tree as (" + " union all ".join(f"select structure_id, root, ix, iy, iz, path, level, x, y, z, dist, split, dg from t{level}" for level in range(_LEVELS)) + ")")
    return ",\n".join(parts)


_SQL_TREE = _sql_tree()


@query("h1_octree", f"with {_SQL_TREE} select structure_id, level, count(*) as nodes, count_if(not split)::bigint as leaves, count_if(dist > 0 and not split)::bigint as void_leaves from tree group by 1, 2")
def h1(spark, sf_dir):
    atoms, grids, vox = _field(spark, sf_dir)
    nodes = octree.forest(vox, atoms, grids, GRID)
    return nodes.groupBy("structure_id", "level").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("is_leaf").alias("leaves"), F.count_if(F.col("void") & F.col("is_leaf")).alias("void_leaves"))


@query("a8_leaf_volumes", f"with {_SQL_TREE} select structure_id, dist > 0 as void, round(sum(pow(8.0::double, -level)) * any_value(dg * dg * dg), 12) as volume, count(*) as leaves from tree where not split group by 1, 2")
def a8(spark, sf_dir):
    atoms, grids, vox = _field(spark, sf_dir)
    found = octree.leaf_volumes(octree.forest(vox, atoms, grids, GRID), grids)
    return found.select("structure_id", "void", F.round("volume", 12).alias("volume"), "leaves")


_SQL_LEAVES = f"""{_SQL_TREE}, {_sql_flood()},
leaf as (select row_number() over () as id, structure_id, root, ix, iy, iz, level, dg, (65536 / pow(2, level))::bigint as s, round_even(x / dg * 65536 - 32768 / pow(2, level), 0)::bigint as x0, round_even(y / dg * 65536 - 32768 / pow(2, level), 0)::bigint as y0, round_even(z / dg * 65536 - 32768 / pow(2, level), 0)::bigint as z0 from tree where not split and dist > 0),
touch as ({" union all ".join(f"select a.id as a, b.id as b from leaf a join leaf b on a.structure_id = b.structure_id and a.{c}0 + a.s = b.{c}0 and a.i{u} = b.i{u} and a.i{v} = b.i{v} and a.{u}0 < b.{u}0 + b.s and b.{u}0 < a.{u}0 + a.s and a.{v}0 < b.{v}0 + b.s and b.{v}0 < a.{v}0 + a.s" for c, u, v in ("xyz", "yxz", "zxy"))}),
ways as (select a, b from touch union all select b, a from touch),
seed as (select leaf.id from leaf join g using (structure_id) where ix in (0, n - 1) or iy in (0, n - 1) or iz in (0, n - 1)
  union select f.id from leaf f, (values {_SIX}) o(a, b, c), lab where lab.label = 2 and lab.structure_id = f.structure_id and lab.ix = f.ix + o.a and lab.iy = f.iy + o.b and lab.iz = f.iz + o.c),
reach as (select id from seed union select w.b from reach join ways w on w.a = reach.id),
named as (select leaf.*, case when reach.id is not null then 2 else 1 end as label from leaf left join reach using (id)),
most as (select structure_id, root, max(label) as label from named group by 1, 2),
fin as (select lab.structure_id, lab.dg, lab.void, lab.boundary, greatest(lab.label, coalesce(most.label, 0)) as label from lab left join most on most.structure_id = lab.structure_id and most.root = lab.vid),
fine as (select structure_id, sum(pow(8.0::double, -level)) as f_void, sum(case when label = 2 then pow(8.0::double, -level) else 0 end) as f_acc, sum(case when label = 1 then pow(8.0::double, -level) else 0 end) as f_trap from named group by 1),
size as (select structure_id, count(*) as nodes, count_if(not split)::bigint as leaves from tree group by 1)"""


@query("g5_octree_percolation", f"""with recursive {_SQL_LEAVES} select f.structure_id, any_value(coalesce(nodes, 0)) as nodes, any_value(coalesce(leaves, 0)) as leaves, count_if(label = 2)::bigint as n_acc, count_if(label = 1)::bigint as n_trap,
{", ".join(f"round((count_if({w} and not boundary) + any_value(coalesce(f_{k}, 0))) * any_value(dg * dg * dg), 12) as v_{k}" for k, w in (("void", "void"), ("acc", "label = 2"), ("trap", "label = 1")))}
from fin f left join fine using (structure_id) left join size using (structure_id) group by 1""")
def g5(spark, sf_dir):
    from .plans.session import checkpointed

    atoms, grids, labels = _labels(spark, sf_dir)
    parts = checkpointed(octree.root_parts(labels, atoms, grids, GRID))
    final, leaves = octree.percolation(labels, parts, grids)
    found = stats.volumes(final, grids, leaves, parts)
    return found.select("structure_id", "nodes", "leaves", "n_acc", "n_trap", *[F.round(f"v_{k}", 12).alias(f"v_{k}") for k in ("void", "acc", "trap")])


_N = surface.SAMPLES
_SQL_POINTS = f"""u as (select i as s, sqrt(greatest(0.0::double, 1 - zz * zz)) * cos(t) as ux, sqrt(greatest(0.0::double, 1 - zz * zz)) * sin(t) as uy, zz as uz from (select i, 1 - 2 * (i + 0.5::double) / {_N} as zz, pi() * (3 - sqrt(5.0::double)) * (i + 0.5::double) as t from range({_N}) r(i))),
q0 as (select a.structure_id, a.atom_id, a.radius, u.s, l, {", ".join(f"a.{c} + a.radius * u{c} as {c}" for c in "xyz")} from a join g using (structure_id), u),
q as (select structure_id, atom_id, radius, s, l, {", ".join(f"{c} - floor({c} / l) * l as {c}" for c in "xyz")} from q0),
hid as (select distinct q.structure_id, q.atom_id, q.s from q join a on a.structure_id = q.structure_id and a.atom_id <> q.atom_id where pow({_sql_gap("q", "a", "q.l")}, 2) < a.radius * a.radius)"""


@query("j12_open_surface", f"with {_SQL_BASE}, {_SQL_POINTS} select structure_id, sum(n)::bigint as open_points, round(sum(4 * pi() * radius * radius * n / {_N}), 6) as s_total from (select structure_id, atom_id, any_value(radius) as radius, count(*) as n from q anti join hid using (structure_id, atom_id, s) group by 1, 2) group by 1")
def j12(spark, sf_dir):
    atoms, grids = tables(spark, sf_dir)
    own = surface.masks(atoms, grids).withColumn("n", surface.open_count()).where("n > 0")
    return own.groupBy("structure_id").agg(F.sum("n").alias("open_points"), F.round(F.sum(geometry.sphere_area(F.col("radius")) * F.col("n") / _N), 6).alias("s_total"))


@query("a14_accessible_surface", f"""with recursive {_sql_field()}, {_sql_flood()}, {_SQL_POINTS},
open_ as (select q.*, g.n, g.dg, {", ".join(f"(floor({c} / g.dg)::int % g.n + g.n) % g.n as i{c}" for c in "xyz")} from q anti join hid using (structure_id, atom_id, s) join g using (structure_id)),
hit as (select distinct p.structure_id, p.atom_id, p.s, p.radius from open_ p, (values (0,0,0),{_SIX}) o(a, b, c), lab where lab.structure_id = p.structure_id and lab.label = 2 and lab.ix = (p.ix + o.a + p.n) % p.n and lab.iy = (p.iy + o.b + p.n) % p.n and lab.iz = (p.iz + o.c + p.n) % p.n)
select g.structure_id, round(coalesce(sum(4 * pi() * radius * radius / {_N}), 0), 6) as s_acc from g left join hit using (structure_id) group by 1""")
def a14(spark, sf_dir):
    atoms, grids, labels = _labels(spark, sf_dir)
    return surface.areas(atoms, labels, grids).select("structure_id", F.round("s_acc", 6).alias("s_acc"))


_SQL_MAXIMA = f"""{_sql_field()}, {_sql_flood()},
m as (select p.structure_id, p.l, p.n, p.dg, p.vid, p.x, p.y, p.z, p.dmin as r from lab p join lab q on q.structure_id = p.structure_id and q.label = 2 and q.vid <> p.vid and abs(q.ix - p.ix) <= 1 and abs(q.iy - p.iy) <= 1 and abs(q.iz - p.iz) <= 1
 where p.label = 2 and p.dmin >= 0.005 group by all having max(q.dmin) <= p.dmin and min(q.dmin) < p.dmin)"""


@query("w1_local_maxima", f"with recursive {_SQL_MAXIMA} select structure_id, vid, round(r, 6) as r from m")
def w1(spark, sf_dir):
    return pores.nodes_of(pores.local_maxima(_labels(spark, sf_dir)[2])).select("structure_id", F.col("node_id").alias("vid"), F.round("r", 6).alias("r"))


def _nodes(spark, sf_dir):
    from .plans.session import checkpointed

    _, grids, labels = _labels(spark, sf_dir)
    return grids, checkpointed(pores.nodes_of(pores.local_maxima(labels)))


@query("j13_ball_overlaps", f"""with recursive {_SQL_MAXIMA} select i.structure_id, i.vid as i, j.vid as j from m i join m j on i.structure_id = j.structure_id and (i.r > j.r or (i.r = j.r and i.vid < j.vid)) and i.r + j.r - 1e-6::double > 0 and pow({_sql_gap("i", "j", "i.l")}, 2) < pow(i.r + j.r - 1e-6::double, 2)""")
def j13(spark, sf_dir):
    grids, nodes = _nodes(spark, sf_dir)
    return pores.dominance(nodes, grids, pores.OVERLAP, 1e-6)


@query("g9_pruned_balls", f"""with recursive {_SQL_MAXIMA}, o as (select *, row_number() over (partition by structure_id order by r desc, vid) as k from m),
walk as (select structure_id, k, [{{'x': x, 'y': y, 'z': z, 'r': r, 'vid': vid}}] as kept from o where k = 1
  union all select o.structure_id, o.k, case when len(list_filter(w.kept, lambda b: b.r + o.r - 1e-6::double > 0 and {" + ".join(f"pow(b.{c} - o.{c} - round_even((b.{c} - o.{c}) / o.l, 0) * o.l, 2)" for c in "xyz")} < pow(b.r + o.r - 1e-6::double, 2))) > 0 then w.kept else list_append(w.kept, {{'x': o.x, 'y': o.y, 'z': o.z, 'r': o.r, 'vid': o.vid}}) end as kept
    from walk w join o on o.structure_id = w.structure_id and o.k = w.k + 1),
ends as (select structure_id, arg_max(kept, k) as kept from walk group by 1)
select structure_id, b.vid as node_id, round(b.r, 6) as r from ends, unnest(kept) u(b)""")
def g9(spark, sf_dir):
    grids, nodes = _nodes(spark, sf_dir)
    return pores.pruned(nodes, grids, pores.OVERLAP, 1e-6).select("structure_id", "node_id", F.round("r", 6).alias("r"))


@query("g10_centreline_edges", f"""with recursive {_SQL_MAXIMA}, n as (select i.structure_id, i.vid as a, j.vid as b, {_sql_gap("i", "j", "i.l")} as d, i.r as ra, j.r as rb, row_number() over (partition by i.structure_id, i.vid order by {_sql_gap("i", "j", "i.l")}, j.vid) as k from m i join m j on i.structure_id = j.structure_id and i.vid <> j.vid)
select distinct structure_id, least(a, b) as a, greatest(a, b) as b from n where k <= 12 and d <= 1.2::double * (ra + rb)""")
def g10(spark, sf_dir):
    grids, nodes = _nodes(spark, sf_dir)
    return pores.centreline(nodes, grids)


@query("a16_size_distribution", f"""with recursive {_SQL_MAXIMA}, b as (select structure_id, max(2 * r) as most, sum(4.0::double / 3 * pi() * r * r * r) as total from m group by 1),
e as (select structure_id, total, k from b, range(400) t(k) where k <= ceil((most + 10 * 0.1::double) / 0.1::double) - 2),
c as (select e.structure_id, e.k, e.total, count(m.vid) as n, coalesce(sum(4.0::double / 3 * pi() * m.r * m.r * m.r), 0) as v from e left join m on m.structure_id = e.structure_id and 2 * m.r >= e.k * 0.1::double and 2 * m.r < (e.k + 1) * 0.1::double group by 1, 2, 3)
select structure_id, (k + 1)::int as bin, round((k + 0.5::double) * 0.1::double, 6) as diameter, n, round(v / total, 6) as volume, round(sum(v / total) over (partition by structure_id order by k), 6) as cumulative from c""")
def a16(spark, sf_dir):
    _, nodes = _nodes(spark, sf_dir)
    found = pores.size_distribution(nodes, 0.1)
    return found.select("structure_id", "bin", F.round("diameter", 6).alias("diameter"), "n", F.round("volume", 6).alias("volume"), F.round("cumulative", 6).alias("cumulative"))


@query("w4_centres", f"with recursive {_SQL_MAXIMA} select structure_id, row_number() over (partition by structure_id order by r desc, vid)::int as n, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(2 * r, 6) as diameter from m")
def w4(spark, sf_dir):
    _, nodes = _nodes(spark, sf_dir)
    return pores.centres(nodes).select("structure_id", "n", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "diameter")])


_SQL_WALK = """{0}o as (select *, row_number() over (partition by structure_id order by r desc, vid) as k from {1}),
{0}w as (select structure_id, k, [{{'x': x, 'y': y, 'z': z, 'r': r, 'vid': vid}}] as kept from {0}o where k = 1
  union all select o.structure_id, o.k, case when len(list_filter(w.kept, lambda b: {2})) > 0 then w.kept else list_append(w.kept, {{'x': o.x, 'y': o.y, 'z': o.z, 'r': o.r, 'vid': o.vid}}) end as kept
    from {0}w w join {0}o o on o.structure_id = w.structure_id and o.k = w.k + 1),
{0} as (select e.structure_id, g.l, g.dg, b.vid, b.x, b.y, b.z, b.r from (select structure_id, arg_max(kept, k) as kept from {0}w group by 1) e join g using (structure_id), unnest(kept) u(b))"""
_SQL_D2 = "(" + " + ".join(f"pow(b.{c} - o.{c} - round_even((b.{c} - o.{c}) / o.l, 0) * o.l, 2)" for c in "xyz") + ")"
_SQL_EPS = "2 * sqrt(3 * o.dg * o.dg)"


@query("g11_pore_nodes", f"""with recursive {_SQL_MAXIMA},
{_SQL_WALK.format("alone", "m", f"{_SQL_D2} <= b.r * b.r and b.r - o.r + {_SQL_EPS} > 0 and {_SQL_D2} <= pow(b.r - o.r + {_SQL_EPS}, 2)")},
{_SQL_WALK.format("apart", "alone", f"b.r + o.r - {_SQL_EPS} > 0 and {_SQL_D2} < pow(b.r + o.r - {_SQL_EPS}, 2)")}
select structure_id, vid as node_id, round(r, 6) as r from apart""")
def g11(spark, sf_dir):
    _, grids, labels = _labels(spark, sf_dir)
    return pores.pore_nodes(labels, grids).select("structure_id", "node_id", F.round("r", 6).alias("r"))


@query("k2_size_lines", f"""with recursive {_SQL_MAXIMA}, b as (select structure_id, max(2 * r) as most, sum(4.0::double / 3 * pi() * r * r * r) as total from m group by 1),
e as (select structure_id, total, k from b, range(400) t(k) where k <= ceil((most + 10 * 0.1::double) / 0.1::double) - 2),
c as (select e.structure_id, e.k, e.total, count(m.vid) as n, coalesce(sum(4.0::double / 3 * pi() * m.r * m.r * m.r), 0) / e.total as v from e left join m on m.structure_id = e.structure_id and 2 * m.r >= e.k * 0.1::double and 2 * m.r < (e.k + 1) * 0.1::double group by 1, 2, 3)
select structure_id, (k + 1)::bigint as at, concat_ws(chr(9), k + 1, printf('%.6f', (k + 0.5::double) * 0.1::double), n, printf('%.10e', v), printf('%.10e', sum(v) over (partition by structure_id order by k))) as line from c
union all select structure_id, 0, '#N diameters_nm count volume cumulative' from b""")
def k2(spark, sf_dir):
    _, nodes = _nodes(spark, sf_dir)
    found = pores.size_distribution(nodes, 0.1)
    return sinks.psd_lines(found).select("structure_id", F.when(F.col("order")[0] == 0, 0).otherwise(F.col("order")[1]).alias("at"), "line")


@query("k3_centre_lines", f"""with recursive {_SQL_MAXIMA}, n as (select *, row_number() over (partition by structure_id order by r desc, vid) as k from m)
select structure_id, k + 1 as at, printf('He %.6f %.6f %.6f %.6f', x * 10, y * 10, z * 10, 2 * r) as line from n
union all select structure_id, 0, count(*)::varchar from m group by 1
union all select structure_id, 1, any_value(printf('Properties=species:S:1:pos:R:3:diameter_nm:R:1 Lattice="%.6f 0 0 0 %.6f 0 0 0 %.6f" pbc="T T T"', l * 10, l * 10, l * 10)) from m group by 1""")
def k3(spark, sf_dir):
    grids, nodes = _nodes(spark, sf_dir)
    lines = sinks.centre_lines(pores.centres(nodes), grids.select("structure_id", "lx", "ly", "lz"))
    part = F.col("order")[0]
    return lines.select("structure_id", F.when(part < 2, part).otherwise(F.col("order")[1] + 1).alias("at"), "line")


@query("a15_largest_cavity", f"with recursive {_SQL_MAXIMA} select structure_id, round(2 * max(r), 6) as lcd from m group by 1")
def a15(spark, sf_dir):
    _, nodes = _nodes(spark, sf_dir)
    return nodes.groupBy("structure_id").agg(F.round(2 * F.max("r"), 6).alias("lcd"))


@query("j15_largest_ball", f"""with recursive {_SQL_MAXIMA} select v.structure_id, v.vid, round(coalesce(arg_max(m.r, {{'r': m.r, 'v': m.vid}}), 0), 6) as ball from d v left join m on m.structure_id = v.structure_id and pow({_sql_gap("v", "m", "v.l")}, 2) <= pow(m.r + v.dg, 2) group by 1, 2""")
def j15(spark, sf_dir):
    from .plans.session import checkpointed

    _, grids, labels = _labels(spark, sf_dir)
    nodes = checkpointed(pores.nodes_of(pores.local_maxima(labels)))
    return pores.largest_ball(labels, nodes, grids).select("structure_id", "vid", F.round("ball", 6).alias("ball"))


def _sql_spans(name: str, asked: str) -> str:
    """Of the levels in asked (structure_id, k, r), the greatest whose voxels lead from a low face to the one opposite."""
    face = "case f.a when 0 then {0}.ix when 1 then {0}.iy else {0}.iz end"
    return f"""{name}q as ({asked}),
{name}f as (select w.structure_id, q.k, q.r, f.a, w.ix, w.iy, w.iz from d w join {name}q q on q.structure_id = w.structure_id and w.dmin >= q.r, (values (0), (1), (2)) f(a) where {face.format("w")} = 0
  union select w.structure_id, f.k, f.r, f.a, w.ix, w.iy, w.iz from {name}f f join (values {_SIX}) o(a, b, c) on true join d w on w.structure_id = f.structure_id and w.ix = f.ix + o.a and w.iy = f.iy + o.b and w.iz = f.iz + o.c and w.dmin >= f.r),
{name} as (select f.structure_id, max(f.k) as k from {name}f f join g using (structure_id) where {face.format("f")} = g.n - 1 group by 1)"""


_EVERY = 24
_SQL_PLD = f"""{_sql_field()},
vals as (select structure_id, dmin as r, row_number() over (partition by structure_id order by dmin) - 1 as k from (select distinct structure_id, dmin from d where dmin >= 0)),
top as (select structure_id, count(*) as n, max(r) as most from vals group by 1),
{_sql_spans("pa", f"select * from vals where k % {_EVERY} = 0")},
{_sql_spans("pb", f"select vals.* from vals join pa using (structure_id) where vals.k >= pa.k and vals.k < pa.k + {_EVERY}")},
walk as (select structure_id, 0 as step, 0::bigint as lo, n - 1 as hi, 0::bigint as best, pb.k as spans, pb.k = n - 1 as done from top join pb using (structure_id)
  union all select structure_id, step + 1, lo2, hi2, case when close then mid else best2 end, spans, close from (
    select s.*, coalesce(h.r - l.r, -1) < {GRID}::double / 2 as close from (
      select *, (lo + hi) // 2 as mid, case when (lo + hi) // 2 <= spans then (lo + hi) // 2 + 1 else lo end as lo2, case when (lo + hi) // 2 <= spans then hi else (lo + hi) // 2 - 1 end as hi2,
        case when (lo + hi) // 2 <= spans then (lo + hi) // 2 else best end as best2 from walk where not done and lo <= hi) s
    left join vals l on l.structure_id = s.structure_id and l.k = s.lo2 left join vals h on h.structure_id = s.structure_id and h.k = s.hi2)),
ended as (select structure_id, arg_max(case when step = 0 then spans else best end, step) as k from walk group by 1)
select g.structure_id, round(coalesce(2 * c.r, 0), 6) as pld, round(coalesce(2 * e.r, 0), 6) as pld_exact from g
left join ended using (structure_id) left join vals c on c.structure_id = g.structure_id and c.k = ended.k left join pb on pb.structure_id = g.structure_id left join vals e on e.structure_id = g.structure_id and e.k = pb.k"""


@query("g12_limiting_diameter", f"with recursive {_SQL_PLD}")
def g12(spark, sf_dir):
    from .plans.session import checkpointed

    _, grids, vox = _field(spark, sf_dir)
    vox = checkpointed(vox)
    known = pores.spanning(vox, grids)
    found = [pores.limiting_diameter(vox, grids, GRID, compat=compat, known=known).select("structure_id", F.round("pld", 6).alias(name)) for compat, name in ((True, "pld"), (False, "pld_exact"))]
    return found[0].join(found[1], "structure_id")


@query("a21_percolates", f"""with recursive {_sql_field()}, {_sql_spans("pa", "select structure_id, 0 as k, 0.05::double as r from g")}
select g.structure_id, pa.k is not null as hit from g left join pa using (structure_id)""")
def a21(spark, sf_dir):
    _, grids, vox = _field(spark, sf_dir)
    return pores.percolates(vox, grids, "dmin", F.lit(0.05))


@query("a18_block_means", f"""with {_sql_field()} select structure_id, (ix // 2)::int as ix, (iy // 2)::int as iy, (iz // 2)::int as iz, round(avg(void::int::double), 6) as f_void, round(avg(0.5::double * (1 + tanh(dmin / 0.1::double))), 6) as smooth from d
where ix < n // 2 * 2 and iy < n // 2 * 2 and iz < n // 2 * 2 group by 1, 2, 3, 4""")
def a18(spark, sf_dir):
    _, grids, vox = _field(spark, sf_dir)
    own = vox.withColumns({"f_void": F.col("void").cast("double"), "smooth": geometry.tanh_smooth(F.col("dmin"), 0.1)})
    found = fields.downsampled(own, grids, 2, ["f_void", "smooth"])
    return found.select("structure_id", "ix", "iy", "iz", F.round("f_void", 6).alias("f_void"), F.round("smooth", 6).alias("smooth"))


@query("p17_smoothing", f"""with {_sql_field()} select structure_id, vid, round(case when dmin / 0.05::double > 60 then 1 when dmin / 0.05::double < -60 then 0 else 1 / (1 + exp(-dmin / 0.05::double)) end, 6) as fermi,
round(case when dmin <= -0.1::double then 0 when dmin >= 0.1::double then 1 else pow((dmin + 0.1::double) / 0.2::double, 2) * (3 - 2 * (dmin + 0.1::double) / 0.2::double) end, 6) as step from d""")
def p17(spark, sf_dir):
    vox = _field(spark, sf_dir)[2]
    return vox.select("structure_id", "vid", F.round(geometry.fermi_smooth(F.col("dmin"), 0.05), 6).alias("fermi"), F.round(geometry.smoothstep(F.col("dmin"), 0.1), 6).alias("step"))


@query("s2_gro_round_trip", f"with {_SQL_BASE} select structure_id::varchar as structure_id, (row_number() over (partition by structure_id order by atom_id) - 1)::int as atom_id, element, printf('%.3f', x)::double as x, printf('%.3f', y)::double as y, printf('%.3f', z)::double as z from a")
def s2(spark, sf_dir):
    atoms, grids = tables(spark, sf_dir)
    lines = sinks.gro_lines(atoms, grids.select("structure_id", "lx", "ly", "lz"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "line"))), lambda x: x["line"]), "\n")
    files = lines.groupBy("structure_id").agg(text.alias("text")).withColumn("structure_id", F.col("structure_id").cast("string"))
    return structures.read_gro(structures.lines(files))[0]


@query("k1_cube_rows", f"""with {_sql_field()} select structure_id, ix::int as ix, iy::int as iy, string_agg(printf('%.8f', void::int::double), ' ' order by iz) as line from d group by 1, 2, 3""")
def k1(spark, sf_dir):
    atoms, grids, vox = _field(spark, sf_dir)
    lines = sinks.cube_lines(vox.withColumn("f", F.col("void").cast("double")), "f", GRID, atoms)
    return lines.where(F.col("order")[0] == 2).select("structure_id", F.col("order")[1].cast("int").alias("ix"), F.col("order")[2].cast("int").alias("iy"), "line")


_BOHR = 10.0 / 0.529177210903


@query("k1_cube_head", f"""with {_SQL_BASE}, n as (select structure_id, count(*) as atoms, any_value(g.n) as n from a join g using (structure_id) group by 1)
select structure_id, i as at, case i when 0 then 'Gaussian cube' when 1 then 'Volumetric data' when 2 then printf('%6d %12.6f %12.6f %12.6f', atoms, 0.0::double, 0.0::double, 0.0::double)
 when 3 then printf('%5d %12.6f %12.6f %12.6f', n, s, 0.0::double, 0.0::double) when 4 then printf('%5d %12.6f %12.6f %12.6f', n, 0.0::double, s, 0.0::double) else printf('%5d %12.6f %12.6f %12.6f', n, 0.0::double, 0.0::double, s) end as line
 from n, range(6) r(i), (select {GRID}::double * {_BOHR}::double as s)
union all select structure_id, 10 + atom_id, printf('%5d %12.6f %12.6f %12.6f %12.6f', z_number, z_number::double, {", ".join(f"{c} * {_BOHR}::double" for c in "xyz")}) from a""")
def k1_head(spark, sf_dir):
    atoms, grids = tables(spark, sf_dir)
    vox = grid.voxels(grids).withColumn("f", F.lit(1.0))
    lines = sinks.cube_lines(vox, "f", GRID, atoms)
    part, at = F.col("order")[0], F.col("order")[1]
    return lines.where(part < 2).select("structure_id", F.when(part == 0, at).otherwise(at + 10).alias("at"), "line")
