"""Command line: the options of api.Config."""

from __future__ import annotations

import argparse
import logging
from dataclasses import fields as _fields

from .api import Config, analyse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m voidframe", description="Pore and free-volume analysis on Spark")
    p.add_argument("input", nargs="+", help=".gro, .xyz, .pdb or .cif files or globs, orthorhombic cells")
    for f in _fields(Config):
        if f.name == "input":
            continue
        names = [f"--{f.name.replace('_', '-')}"] + [f"--{f.name}"] * ("_" in f.name) + {"grid": ["-g"], "probe": ["-p"]}.get(f.name, [])
        if f.default is False:
            p.add_argument(*names, dest=f.name, action="store_true")
        else:
            kind = float if f.name in ("grid", "probe", "oct_grid", "cube_space") else int if f.name in ("threads", "oct_level") else str
            p.add_argument(*names, dest=f.name, type=kind, default=f.default)
    return p


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    options = vars(parser().parse_args(argv))
    spark = SparkSession.builder.appName("voidframe").getOrCreate()
    try:
        found = analyse(spark, options.pop("input"), **options)
        for row in found.stats.toLocalIterator():
            for name, value in row.asDict().items():
                print(f"{name} : {value:12.6f}" if isinstance(value, float) else f"{name} : {value}")
    except Exception as e:  # one line for the user; the log has the rest
        logging.getLogger(__name__).debug("failed", exc_info=True)
        print(f"error: {str(e).splitlines()[0]}")
        return 1
    return 0
