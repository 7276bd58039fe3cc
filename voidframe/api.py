"""The whole analysis of many structures in one call."""

from __future__ import annotations

import os
import platform
import sys
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import elements
from .operators import distance, fields, grid, octree, percolation, pores, stats, surface
from .plans.session import checkpointed
from .sources import sinks, structures


# The stages that a run's timings name.
STAGES = ("init", "io", "cell", "grid", "octree", "volume", "surface", "pore", "cube", "stats")


# The options of a run, their order and defaults.
@dataclass(frozen=True)
class Config:
    input: str | list[str]
    grid: float = 0.01
    probe: float = 0.0
    atoms: str | None = None
    threads: int = 0
    out_prefix: str | None = None
    no_surface: bool = False
    pore: bool = False
    porevis: bool = False
    no_octree: bool = False
    oct_level: int = 4
    oct_grid: float = 0.001
    cube: bool = False
    cube_space: float | None = None
    smooth: bool = False
    stats: bool = False
    debug: bool = False
    debug_print: bool = False


@dataclass
class Result:
    """Tables of an analysis; each is a DataFrame keyed by structure_id."""

    config: Config
    stats: DataFrame
    atoms: DataFrame
    structures: DataFrame
    voxels: DataFrame
    octree: DataFrame | None = None
    leaves: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    psd: DataFrame | None = None
    centres: DataFrame | None = None
    out: str | None = None
    run: dict = field(default_factory=dict)
    timings: dict = field(default_factory=dict)


class Timer:
    """Seconds of the stages of a run. A stage's tables are computed before it ends."""

    def __init__(self):
        self.timings, self.began = dict.fromkeys(STAGES, 0.0), time.time()
        self.last = self.began

    def ended(self, stage: str) -> None:
        now = time.time()
        self.timings[stage] += now - self.last
        self.last = now


def run_metadata() -> dict:
    return {"python_exe": sys.executable, "cwd": os.getcwd(), "platform": platform.platform(), "full_command": " ".join(sys.argv), "time": time.strftime("%Y-%m-%d %H:%M:%S")}


def out_path(config: Config) -> str:
    """Beside the first input: its name, grid and probe, unless a prefix is given."""
    first = config.input if isinstance(config.input, str) else config.input[0]
    folder, name = os.path.split(first)
    stem = config.out_prefix or f"{os.path.splitext(name)[0].replace('*', 'all')}_g_{config.grid}_p_{config.probe}"
    return os.path.join(folder, stem)


def analyse_tables(config: Config, atoms: DataFrame, boxes: DataFrame, timer: Timer | None = None) -> Result:
    """atoms (structure_id, atom_id, element, x, y, z, z_number, radius, mass) and boxes (structure_id, lx, ly, lz)."""
    timer = timer or Timer()
    moved, sized = grid.with_box(atoms, boxes)
    grids = checkpointed(grid.sized(sized, config.grid))
    moved = checkpointed(moved)
    timer.ended("cell")
    vox = checkpointed(distance.field(moved, grids, config.grid, config.probe, config.pore))
    timer.ended("grid")
    labels = checkpointed(percolation.labelled(vox, grids))
    timer.ended("volume")
    tree = leaves = None
    if not config.no_octree:
        tree = checkpointed(octree.forest(vox, moved, grids, config.grid, config.probe, config.oct_level, config.oct_grid, config.pore))
        labels, leaves = octree.percolation(labels, tree, grids)
        labels, leaves = checkpointed(labels), checkpointed(leaves)
        timer.ended("octree")
    area = None if config.no_surface else checkpointed(surface.areas(moved, labels, grids, config.probe))
    timer.ended("surface")
    nodes = edges = psd = centres = pore = None
    if config.pore:
        nodes = pores.pore_nodes(labels, grids)
        edges = pores.centreline(nodes, grids)
        psd, centres = pores.size_distribution(nodes, config.grid), pores.centres(nodes)
        pld = pores.limiting_diameter(vox, grids, config.grid, config.probe)
        lcd = nodes.groupBy("structure_id").agg((2 * F.max("r")).alias("lcd"))
        top = vox.groupBy("structure_id").agg((2 * F.max("dmin")).alias("lcd_global"))
        pore = checkpointed(pld.join(lcd, "structure_id", "left").join(top, "structure_id", "left"))
        timer.ended("pore")
    record = checkpointed(stats.record(grids, stats.masses(moved, grids), stats.volumes(labels, grids, leaves, tree), area, pore))
    timer.ended("stats")
    return Result(config, record, moved, grids, labels, tree, leaves, nodes, edges, psd, centres, timings=timer.timings)


def analyse(spark: SparkSession, input: str | list[str], **options) -> Result:  # noqa: A002
    """Read structure files, analyse them together and write what the options ask for."""
    config, timer = Config(input, **options), Timer()
    atoms, boxes = structures.read_structures(spark, config.input)
    updates = elements.read_parameters(elements.parameter_lines(spark, config.atoms)) if config.atoms else None
    timer.ended("init")
    names, values = elements.tables(spark, updates)
    # a cube names its atoms by number, so none may be guessed
    bound = elements.bind(atoms.withColumnRenamed("z", "_z"), names, values, strict=config.cube).withColumnsRenamed({"z": "z_number"}).withColumnRenamed("_z", "z")
    bound = checkpointed(bound)
    timer.ended("io")
    found = analyse_tables(config, bound, boxes, timer)
    out = out_path(config)
    if config.cube:
        k = fields.cube_step(config.grid, config.cube_space)
        names = ["f_void", "f_occ", "f_acc", "f_trap", "dmin"]
        vox = fields.fields(found.voxels, config.grid, config.smooth)
        if config.porevis and config.pore:
            vox, names = pores.largest_ball(vox, found.nodes, found.structures), [*names, "ball"]
        small = checkpointed(fields.downsampled(vox, found.structures, k, names))
        for name in names:
            sinks.write_lines(sinks.cube_lines(small, name, k * config.grid, found.atoms), f"{out}_{name.removeprefix('f_')}.cube")
        timer.ended("cube")
    run = {**run_metadata(), "execution_time": time.time() - timer.began}
    if config.stats:
        settings = {k: v for k, v in asdict(config).items() if v is not None and k != "input"}
        sinks.write_stats(stats.nested(found.stats, settings, run, timer.timings, not config.no_octree), f"{out}_stats.json")
        if config.pore:
            sinks.write_lines(sinks.psd_lines(found.psd), f"{out}_psd.txt")
            sinks.write_lines(sinks.centre_lines(found.centres, found.structures), f"{out}_center.txt")
    if config.debug:
        tables = {"voxels": found.voxels, "octree": found.octree, "leaves": found.leaves, "nodes": found.nodes, "edges": found.edges}
        sinks.write_debug({k: v for k, v in tables.items() if v is not None}, f"{out}_debug")
    found.out, found.run, found.timings = out, run, timer.timings
    return found
