"""Operators against brute force in numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voidframe.operators import distance, fields, grid, octree, percolation, pores, stats, surface, widest
from voidframe.plans.components import connected_components
from voidframe.plans.session import checkpointed

G, L, N = 0.1, 0.8, 8


@pytest.fixture(scope="module")
def cell(spark):
    rng = np.random.default_rng(4)
    pos, rad = rng.random((14, 3)) * L, rng.uniform(0.11, 0.17, 14)
    atoms = checkpointed(spark.createDataFrame([("s", i, *map(float, p), float(r), 1.0) for i, (p, r) in enumerate(zip(pos, rad, strict=True))], "structure_id string, atom_id int, x double, y double, z double, radius double, mass double"))
    grids = checkpointed(grid.sized(spark.createDataFrame([("s", L, L, L)], "structure_id string, lx double, ly double, lz double"), G))
    vox = checkpointed(distance.field(atoms, grids, G, 0.01))
    c = (np.arange(N) + 0.5) * (L / N)
    at = np.stack(np.meshgrid(c, c, c, indexing="ij"), -1)
    d = at[..., None, :] - pos
    d -= np.rint(d / L) * L
    dmin = (np.sqrt((d**2).sum(-1)) - rad).min(-1) - 0.01
    return {"atoms": atoms, "grids": grids, "vox": vox, "pos": pos, "rad": rad, "dmin": dmin}


def dense(df, column, kind=float):
    out = np.zeros((N, N, N), kind)
    for r in df.select("ix", "iy", "iz", column).collect():
        out[r[0], r[1], r[2]] = r[3]
    return out


def flood(void, offsets=6):
    label, parts = np.full(void.shape, -1), []
    steps = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o) and (offsets == 26 or sum(map(abs, o)) == 1)]
    for start in zip(*np.nonzero(void), strict=True):
        if label[start] >= 0:
            continue
        todo, own = [start], []
        label[start] = len(parts)
        while todo:
            p = todo.pop()
            own.append(p)
            for o in steps:
                q = tuple(np.add(p, o))
                if all(0 <= x < N for x in q) and void[q] and label[q] < 0:
                    label[q] = len(parts)
                    todo.append(q)
        parts.append(np.array(own))
    return label, parts


def coarse(void):
    out = np.zeros(void.shape, int)
    for p in flood(void)[1]:
        spans = any(p[:, a].min() == 0 and p[:, a].max() == N - 1 for a in range(3))
        out[tuple(p.T)] = 2 if spans else 1
    return out


def test_distance(cell):
    assert np.allclose(dense(cell["vox"], "dmin"), cell["dmin"])
    assert cell["vox"].count() == N**3
    edge = L / N * 0.7071068 + 1e-6
    assert (dense(cell["vox"], "boundary", bool) == (abs(cell["dmin"]) < edge)).all()


def test_percolation(cell):
    labels = percolation.labelled(cell["vox"], cell["grids"])
    want = coarse(cell["dmin"] > 0)
    assert (dense(labels, "label", int) == want).all() and {1, 2} & set(want.ravel())
    for offsets in (6, 26):
        got = percolation.voxel_components(cell["vox"], offsets).collect()
        label, parts = flood(cell["dmin"] > 0, offsets)
        flat = label.ravel()
        least = [int(min(np.ravel_multi_index(p.T, label.shape))) for p in parts]
        assert {r.vid: r.component for r in got} == {v: least[c] for v, c in enumerate(flat) if c >= 0}


def nearest_steps(void, offsets):
    """Depth from the least voxel of each component, and the least neighbour one step nearer, by a queue."""
    steps = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o) and (offsets == 26 or sum(map(abs, o)) == 1)]
    depth, number = {}, lambda p: int(np.ravel_multi_index(p, void.shape))
    for start in map(tuple, np.argwhere(void)):
        if start in depth:
            continue
        depth[start], todo = 0, [start]
        for p in todo:
            for q in (tuple(np.add(p, o)) for o in steps):
                if all(0 <= x < n for x, n in zip(q, void.shape, strict=True)) and void[q] and q not in depth:
                    depth[q] = depth[p] + 1
                    todo.append(q)
    nearer = lambda p: [number(q) for o in steps if depth.get(q := tuple(np.add(p, o))) == depth[p] - 1]
    return {number(p): (d, min(nearer(p), default=None)) for p, d in depth.items()}


@pytest.mark.parametrize("offsets", [6, 26])
def test_bfs_depth_and_parent(cell, offsets):
    comp = percolation.voxel_components(cell["vox"], offsets)
    got = percolation.bfs_parents(cell["vox"], comp, offsets).collect()
    want = nearest_steps(cell["dmin"] > 0, offsets)
    assert {r.vid: (r.depth, r.parent) for r in got} == want and len(got) == len(want)


def test_bfs_rounds_go_with_bends(spark):
    """Two structures of different shape: an open box with a wall, and a corridor that turns back four times."""
    box = np.ones((24, 6, 5), bool)
    box[12, :5] = False
    snake = np.zeros((24, 9, 1), bool)
    snake[:, ::2] = True
    snake[23, 1], snake[0, 3], snake[23, 5], snake[0, 7] = True, True, True, True
    rows = [(s, *map(int, p), int(np.ravel_multi_index(p, v.shape)), True) for s, v in (("box", box), ("snake", snake)) for p in np.argwhere(v)]
    vox = checkpointed(spark.createDataFrame(rows, "structure_id string, ix int, iy int, iz int, vid int, void boolean"))
    found, rounds = percolation.depths(vox, percolation.voxel_components(vox))
    got = {(r.structure_id, r.vid): r.depth for r in found.collect()}
    assert got == {(s, k): d for s, v in (("box", box), ("snake", snake)) for k, (d, _) in nearest_steps(v, 6).items()}
    assert max(got.values()) > 100 and rounds < 24 / 3
    empty = percolation.bfs_parents(vox.where("false"), percolation.voxel_components(vox.where("false")))
    assert empty.count() == 0


def test_maxima_and_pruning(cell):
    labels = checkpointed(percolation.labelled(cell["vox"], cell["grids"]))
    label, d = coarse(cell["dmin"] > 0), cell["dmin"]
    want = []
    for p in zip(*np.nonzero(label == 2), strict=True):
        near = [d[q] for o in itertools.product((-1, 0, 1), repeat=3) if any(o) for q in [tuple(np.add(p, o))] if all(0 <= x < N for x in q) and label[q] == 2]
        if d[p] >= 0.005 and near and max(near) <= d[p] and min(near) < d[p]:
            want.append(int(np.ravel_multi_index(p, d.shape)))
    nodes = checkpointed(pores.nodes_of(pores.local_maxima(labels)))
    assert sorted(r.node_id for r in nodes.collect()) == sorted(want) and want
    c = (np.stack(np.unravel_index(want, d.shape), -1) + 0.5) * (L / N)
    r = np.array([d.ravel()[v] for v in want])
    gap = c[:, None] - c
    gap -= np.rint(gap / L) * L
    gap = np.sqrt((gap**2).sum(-1))
    for mode, eps in ((pores.OVERLAP, 1e-6), (pores.CONTAINED, 0.2)):
        alive, order = np.ones(len(r), bool), sorted(range(len(r)), key=lambda i: (-r[i], want[i]))
        for i in order:
            if alive[i]:
                for j in range(len(r)):
                    rhs = r[i] + r[j] - eps if mode == pores.OVERLAP else r[i] - r[j] + eps
                    hit = gap[i, j] < rhs if mode == pores.OVERLAP else (gap[i, j] <= rhs and gap[i, j] <= r[i] and r[j] <= r[i] + eps)
                    if j != i and rhs > 0 and hit:
                        alive[j] = False
        kept = pores.pruned(nodes, cell["grids"], mode, eps)
        assert sorted(x.node_id for x in kept.collect()) == sorted(np.array(want)[alive].tolist())


def bisected(d, tol, spanning):
    """The compatible search, step by step."""
    if d.max() <= 0 or not spanning(0.0):
        return 0.0
    if spanning(d.max()):
        return 2 * d.max()
    values = np.unique(d[d >= 0])
    lo, hi, best = 0, len(values) - 1, 0
    while lo <= hi:
        mid = (lo + hi) // 2
        if spanning(values[mid]):
            best, lo = mid, mid + 1
        else:
            hi = mid - 1
        if values[hi] - values[lo] < tol:
            best = mid
            break
    return 2 * values[best]


def test_limiting_diameter(cell, spark):
    """Of several boxes at once; the last has no void."""
    rng = np.random.default_rng(11)
    fields = {"a": cell["dmin"], "b": rng.normal(0.1, 0.1, (N, N, N)), "c": rng.random((N, N, N)), "d": np.full((N, N, N), 0.25), "e": np.full((N, N, N), -1.0)}
    ids = np.arange(N**3).reshape(N, N, N)
    rows = [(k, *map(int, p), int(ids[p]), float(f[p])) for k, f in fields.items() for p in zip(*np.nonzero(ids >= 0), strict=True)]
    vox = checkpointed(spark.createDataFrame(rows, "structure_id string, ix int, iy int, iz int, vid long, dmin double"))
    grids = checkpointed(grid.sized(spark.createDataFrame([(k, L, L, L) for k in fields], "structure_id string, lx double, ly double, lz double"), G))
    plain = {r.structure_id: r.pld for r in pores.limiting_diameter(vox, grids, G, 0.01, compat=False).collect()}
    compat = {r.structure_id: r.pld for r in pores.limiting_diameter(vox, grids, G, 0.01).collect()}
    for k, f in fields.items():
        spanning = lambda r, f=f: (coarse(f >= r) == 2).any()
        best = max((v for v in np.unique(f[f >= 0]) if spanning(v)), default=0.0)
        assert abs(plain[k] - 2 * best) < 1e-9, k
        assert abs(compat[k] - bisected(f - 0.01, G / 2, lambda r, f=f: (coarse(f - 0.01 >= r) == 2).any())) < 1e-9, k
    assert plain["a"] > 0 and plain["d"] == 0.5 and plain["e"] == 0


def test_octree_volume_nears_the_sphere(spark):
    atoms = checkpointed(spark.createDataFrame([("s", 0, 0.2, 0.2, 0.2, 0.12855, 1.0)], "structure_id string, atom_id int, x double, y double, z double, radius double, mass double"))
    grids = checkpointed(grid.sized(spark.createDataFrame([("s", 0.4, 0.4, 0.4)], "structure_id string, lx double, ly double, lz double"), 0.05))
    vox = checkpointed(distance.field(atoms, grids, 0.05, 0.0))
    assert vox.where("void").count() == 456
    labels = checkpointed(percolation.labelled(vox, grids))
    nodes = checkpointed(octree.forest(vox, atoms, grids, 0.05, max_level=3))
    final, leaves = octree.percolation(labels, nodes, grids)
    v = stats.volumes(final, grids, leaves, nodes).first()
    exact = 0.4**3 - 4 / 3 * np.pi * 0.12855**3
    assert abs(v.v_void - exact) < 0.01 * exact and abs(v.v_acc - v.v_void) < 1e-12 and v.v_trap == 0
    area = surface.areas(atoms, final, grids, n=200).first()
    assert abs(area.s_total - 4 * np.pi * 0.12855**2) < 1e-9 and area.s_acc == area.s_total


def test_block_means(cell):
    got = dense(fields.downsampled(cell["vox"], cell["grids"], 3, ["dmin"]), "dmin")[:2, :2, :2]
    want = cell["dmin"][:6, :6, :6].reshape(2, 3, 2, 3, 2, 3).mean((1, 3, 5))
    assert np.allclose(got, want)
    with pytest.raises(Exception, match="larger than the grid"):
        fields.downsampled(cell["vox"], cell["grids"], 9, ["dmin"]).collect()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_grid_must_fit(spark):
    with pytest.raises(Exception, match="does not fit"):
        grid.sized(spark.createDataFrame([("s", 0.25, 0.25, 0.25)], "structure_id string, lx double, ly double, lz double"), 0.1).collect()


def test_inferred_box(spark):
    atoms = spark.createDataFrame([("s", 0, 1.0, 2.0, 3.0, 0.1), ("s", 1, 2.0, 2.0, 3.5, 0.2)], "structure_id string, atom_id int, x double, y double, z double, radius double")
    boxes = spark.createDataFrame([("s", 0.0, 0.0, 0.0)], "structure_id string, lx double, ly double, lz double")
    moved, sized = grid.with_box(atoms, boxes)
    s = sized.first()
    assert s.box_inferred and np.allclose([s.lx, s.ly, s.lz], [1.3, 0.4, 0.8])
    assert np.allclose([moved.orderBy("atom_id").first()[c] for c in "xyz"], [0.1, 0.2, 0.1])


def lattice(n):
    k = np.arange(n) + 0.5
    z = 1 - 2 * k / n
    turn = np.pi * (3 - np.sqrt(5.0)) * k
    return np.stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z], -1)


@pytest.mark.parametrize("n", [100, 1000])
def test_covered_points_in_a_long_box(spark, n):
    """Masks, counts and open points against plain loops; axes differ, so none can be taken for another."""
    rng, box = np.random.default_rng(n), np.array([0.8, 1.1, 1.7])
    pos, rad = rng.random((25, 3)) * box, rng.uniform(0.1, 0.25, 25)
    atoms = spark.createDataFrame([("s", i, *map(float, p), float(r)) for i, (p, r) in enumerate(zip(pos, rad, strict=True))] + [("alone", 0, 0.1, 0.1, 0.1, 0.1)], "structure_id string, atom_id int, x double, y double, z double, radius double")
    grids = checkpointed(grid.sized(spark.createDataFrame([("s", *map(float, box)), ("alone", 1.0, 1.0, 1.0)], "structure_id string, lx double, ly double, lz double"), G))
    got = {r.atom_id: r.n for r in surface.masks(atoms, grids, 0.02, n).withColumn("n", surface.open_count(n)).where("structure_id = 's'").collect()}
    points = {(r.atom_id, r.s): (r.x, r.y, r.z) for r in surface.open_points(atoms, grids, 0.02, n).where("structure_id = 's'").collect()}
    grown = rad + 0.02
    for i in range(25):
        at = pos[i] + grown[i] * lattice(n)
        gap = at[:, None] - np.delete(pos, i, 0)
        gap -= np.rint(gap / box) * box
        free = ~((gap**2).sum(-1) < np.delete(grown, i) ** 2).any(1)
        assert got[i] == free.sum() and {s for a, s in points if a == i} == set(np.flatnonzero(free))
        for s in np.flatnonzero(free):
            assert np.allclose(points[i, s], np.mod(at[s], box))
    assert surface.open_points(atoms, grids, 0.02, n).where("structure_id = 'alone'").count() == n


def test_candidates_keep_three_before_the_shuffle(cell):
    g, vox = cell["grids"], cell["vox"]
    found = octree.candidates(vox.where("boundary"), cell["atoms"], distance.cells(g, cell["atoms"], G, 0.01), 0.01)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    c = (np.arange(N) + 0.5) * (L / N)
    for r in found.collect()[::7]:
        d = np.array([c[r.ix], c[r.iy], c[r.iz]]) - cell["pos"]
        d -= np.rint(d / L) * L
        best = np.argsort(np.sqrt((d**2).sum(-1)) - cell["rad"], kind="stable")
        assert r.atom1 == best[0] and all(r[f"ar{k}"] == cell["rad"][r[f"atom{k}"]] for k in (1, 2, 3) if r[f"atom{k}"] is not None)


@pytest.mark.parametrize("periodic", [True, False])
def test_distance_transform(spark, periodic):
    """A box with three different axes, one with a single target and one without any."""
    rng, shape, step = np.random.default_rng(2), (7, 9, 12), np.array([0.1, 0.11, 0.09])
    grids = checkpointed(spark.createDataFrame([(k, *map(int, shape), *map(float, step)) for k in "abc"], "structure_id string, gx int, gy int, gz int, dgx double, dgy double, dgz double"))
    ids = np.arange(np.prod(shape)).reshape(shape)
    rows = [(k, *map(int, p), int(ids[tuple(p)])) for k in "abc" for p in np.argwhere(ids >= 0)]
    vox = spark.createDataFrame(rows, "structure_id string, ix int, iy int, iz int, vid long")
    where = {"a": np.argwhere(rng.random(shape) < 0.02), "b": np.array([[6, 0, 11]])}
    targets = spark.createDataFrame([(k, *map(int, p)) for k, v in where.items() for p in v], "structure_id string, ix int, iy int, iz int")
    got = distance.to_targets(vox, targets, grids, periodic, 0.5).collect()
    assert {r.structure_id for r in got} == {"a", "b"} and len(got) == 2 * ids.size
    for r in got:
        gap = np.array(np.unravel_index(r.vid, shape)) - where[r.structure_id]
        gap = gap - np.rint(gap / shape) * shape if periodic else gap
        assert abs(r.d - max(0, np.sqrt(((gap * step) ** 2).sum(-1)).min() - 0.05)) < 1e-9


@pytest.mark.parametrize("most", [20, 90, 10**6])
def test_widest_path(spark, most):
    """Grids of different axes, cut into many slabs, few and none; ties and holes; against a search by flooding."""
    rng, shapes = np.random.default_rng(6), {"a": (9, 4, 5), "b": (13, 3, 2), "c": (1, 6, 6), "d": (20, 2, 2), "e": (6, 6, 6)}
    fields = {k: np.round(rng.random(s), 2) for k, s in shapes.items()}
    fields["a"][rng.random(shapes["a"]) < 0.3] = -1
    fields["e"][:] = -1
    fields["e"][2, 2, 2] = 0.5
    rows = [(k, *map(int, p), float(f[tuple(p)])) for k, f in fields.items() for p in np.argwhere(f >= 0)]
    d = spark.createDataFrame(rows, "structure_id string, ix int, iy int, iz int, _d double")
    grids = checkpointed(spark.createDataFrame([(k, *s) for k, s in shapes.items()], "structure_id string, gx int, gy int, gz int"))
    got = {r.structure_id: r.w for r in widest.spanning_value(d, grids, most).collect()}
    for k, f in fields.items():
        best = None
        for value in np.unique(f[f >= 0]):
            open_ = f >= value
            for axis in range(3):
                seen = np.zeros(f.shape, bool)
                todo = [tuple(p) for p in np.argwhere(open_) if p[axis] == 0]
                for p in todo:
                    seen[p] = True
                while todo:
                    p = todo.pop()
                    for o in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)):
                        q = tuple(np.add(p, o))
                        if all(0 <= x < n for x, n in zip(q, f.shape, strict=True)) and open_[q] and not seen[q]:
                            seen[q] = True
                            todo.append(q)
                if seen.take(-1, axis).any():
                    best = value
        assert got.get(k) == best, k
    assert "e" not in got and len(got) == 4
