"""Volumes from the command line: export a chunk tree, look at an archive, read a box, verify.

    spark-submit voxspark/__main__.py export SOURCE ROOT VOLUME [--q 1] [--falloff 0.6] [--coarse 3] [--alpha 0.5]
    python -m voxspark stats ROOT VOLUME
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from voxspark.model import Box
from voxspark.plans import export
from voxspark.sources import zarr
from voxspark.sources.archive import Archive


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="voxspark", description=__doc__.split("\n")[0])
    commands = top.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [commands.add_parser(name), *map(commands.choices[name].add_argument, args)][0]
    one = add("export", "source", "root", "volume")
    one.add_argument("--q", type=float, default=1.0)
    one.add_argument("--falloff", type=float, default=0.6)
    one.add_argument("--coarse", type=int)
    one.add_argument("--alpha", type=float)
    add("stats", "root", "volume").add_argument("--lod", type=int, default=0)
    box = add("box", "root", "volume", "out")
    box.add_argument("box", type=int, nargs=6, metavar=("X0", "Y0", "Z0", "X1", "Y1", "Z1"))
    box.add_argument("--lod", type=int, default=0)
    check = add("verify", "root", "volume", "source")
    check.add_argument("--stride", type=int, default=97)
    check.add_argument("--most", type=int)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("voxspark").getOrCreate()
    if a.command == "export":
        archive = export.to_archive(spark, a.source, a.root, a.volume, a.q, a.falloff, a.coarse, a.alpha)
        archive.stats().show()
    elif a.command == "stats":
        archive = Archive(spark, a.root, a.volume)
        archive.stats(a.lod).show()
        archive.accounting(a.lod).show()
    elif a.command == "box":
        Archive(spark, a.root, a.volume).read_box(Box(*a.box), a.lod).write.parquet(a.out)
    else:
        Archive(spark, a.root, a.volume).verify(zarr.voxels(spark, a.source), a.stride, a.most).show()


if __name__ == "__main__":
    main()
