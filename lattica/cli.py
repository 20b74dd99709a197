"""Command line: the power spectrum of a snapshot, as text."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lattica.plans.power_spectrum import default_grid, power_spectrum
from lattica.sources.h5part import h5part_particles
from lattica.sources.snapshots import read_step, write_spectrum


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="power_spectrum", description=__doc__)
    p.add_argument("--checkpoint", required=True, help="folder of a snapshot, or HDF5 steps: a file or folder named .h5, .hdf5 or .h5part")
    p.add_argument("--stepNo", type=int, default=-1, help="step; negative: the last one")
    p.add_argument("--gridSize", type=int, help="cells along an axis; else the cube root of the number of particles")
    p.add_argument("--numShells", type=int, help="shells; else half the grid size")
    p.add_argument("--backend", default="auto", help="accepted; there is one")
    p.add_argument("--interpolation", default="nearest", help="nearest, cell_avg or sph; others mean nearest")
    p.add_argument("--field", default="velocity", choices=("velocity", "density"))
    p.add_argument("--output", default="power_spectrum.txt")
    p.add_argument("--pencils", action="store_true", help="transform one axis at a time")
    for ignored in ("--cuda-aware-mpi", "--cuda-aware-full-pack"):
        p.add_argument(ignored, action="store_true", help="accepted without effect")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("power_spectrum").getOrCreate()
    read = h5part_particles if args.checkpoint.rstrip("/").endswith((".h5", ".hdf5", ".h5part")) else read_step
    particles = read(spark, args.checkpoint, args.stepNo)
    grid = args.gridSize or default_grid(particles)
    fill = args.interpolation != "sph"
    spec = power_spectrum(particles, grid, args.numShells, args.field, args.interpolation, fill, "pencil" if args.pencils else None)
    write_spectrum(spec, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
