"""Work that is cut into blocks of the grid, with blocks so small that parts meet across many of them."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_geometry import G, N, cell, flood, nearest_steps  # noqa: F401

from voidframe.operators import octree, percolation, pores, stats
from voidframe.plans.session import checkpointed

CUT = 3


@pytest.fixture(scope="module")
def grains(spark):
    void = np.random.default_rng(7).random((N, N, N)) < 0.42
    void[5] = False
    rows = [("s", *map(int, p), int(np.ravel_multi_index(p, void.shape)), bool(void[tuple(p)])) for p in np.argwhere(void | ~void)]
    vox = checkpointed(spark.createDataFrame(rows, "structure_id string, ix int, iy int, iz int, vid int, void boolean"))
    grids = checkpointed(spark.createDataFrame([("s", N, N, N)], "structure_id string, gx int, gy int, gz int"))
    return void, vox, grids


@pytest.mark.parametrize("offsets", [6, 26])
def test_components_across_blocks(grains, monkeypatch, offsets):
    monkeypatch.setattr(percolation, "BLOCK", CUT)
    void, vox, _ = grains
    label, parts = flood(void, offsets)
    least = [int(min(np.ravel_multi_index(p.T, label.shape))) for p in parts]
    got = percolation.voxel_components(vox, offsets).collect()
    assert {r.vid: r.component for r in got} == {v: least[c] for v, c in enumerate(label.ravel()) if c >= 0} and len(parts) > 1


def test_labels_across_blocks(grains, monkeypatch):
    monkeypatch.setattr(percolation, "BLOCK", CUT)
    void, vox, grids = grains
    want = np.zeros(void.shape, int)
    for p in flood(void)[1]:
        want[tuple(p.T)] = 2 if any(p[:, a].min() == 0 and p[:, a].max() == N - 1 for a in range(3)) else 1
    got = {r.vid: r.label for r in percolation.labelled(vox, grids).collect()}
    assert got == dict(enumerate(want.ravel().tolist())) and {0, 1, 2} == set(got.values())


@pytest.mark.parametrize("offsets", [6, 26])
def test_depths_across_blocks(grains, monkeypatch, offsets):
    monkeypatch.setattr(percolation, "BLOCK", CUT)
    void, vox, _ = grains
    got = percolation.bfs_parents(vox, percolation.voxel_components(vox, offsets), offsets).collect()
    want = nearest_steps(void, offsets)
    assert {r.vid: (r.depth, r.parent) for r in got} == want and len(got) == len(want)


def test_maxima_across_blocks(grains, monkeypatch):
    monkeypatch.setattr(percolation, "BLOCK", CUT)
    void, vox, _ = grains
    d = np.random.default_rng(3).integers(-2, 9, (N, N, N)) / 8
    labels = vox.withColumns({"label": F.when(F.col("void"), 2).otherwise(1), "dmin": F.get(F.lit(d.ravel().tolist()), F.col("vid"))})
    for strict in (True, False):
        want = set()
        for p in map(tuple, np.argwhere(void)):
            near = [d[q] for o in itertools.product((-1, 0, 1), repeat=3) if any(o) for q in [tuple(np.add(p, o))] if all(0 <= x < N for x in q) and void[q]]
            if d[p] >= 0.005 and max(near, default=-9) <= d[p] and (not strict or min(near, default=9) < d[p]):
                want.add(int(np.ravel_multi_index(p, d.shape)))
        got = pores.local_maxima(labels, strict=strict)
        assert got.columns == labels.columns and sorted(r.vid for r in got.collect()) == sorted(want) and want


@pytest.mark.parametrize("levels", [3, 4, 5])
def test_parts_of_roots_stand_for_leaves(cell, monkeypatch, levels):  # noqa: F811
    monkeypatch.setattr(percolation, "BLOCK", CUT)
    atoms, grids = cell["atoms"], cell["grids"]
    labels = checkpointed(percolation.labelled(cell["vox"], grids))
    found = []
    for way in (octree.forest, octree.root_parts):
        own = checkpointed(way(labels, atoms, grids, G, 0.01, levels))
        final, leaves = octree.percolation(labels, own, grids)
        found.append((sorted(map(tuple, final.select("vid", "label").collect())), stats.volumes(final, grids, leaves, own).collect()))
    assert found[0] == found[1] and len(found[0][0]) == N**3
