"""Command line: build a dataset from a folder of deposition files."""

from __future__ import annotations

import argparse
import logging
import math
import os
from dataclasses import fields

from coilworks.params import FORMATS, PRESETS, SCORE_TYPES, Filters, filters


def _flag(text: str) -> bool:
    if text.lower() in ("true", "yes", "1", "on"):
        return True
    if text.lower() in ("false", "no", "0", "off"):
        return False
    raise argparse.ArgumentTypeError(f"{text!r} is neither true nor false")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    p.add_argument("--input-dir", "-d", default=".", help="folder of deposition files, or of folders of them")
    p.add_argument("--output-prefix", "--output", dest="output", default="./dataset", help="folder the parts are written to; the format is added to its name")
    p.add_argument("--output-format", choices=FORMATS, default="csv", help="long rows or one peptide a line")
    p.add_argument("--cache-dir", help="shared folder whose finished stages a later run reuses")
    p.add_argument("--BMRB-file-pattern", "--file-pattern", dest="file_pattern", default=r"bmr(\d+)_3\.str", help="regular expression of file names; its first group is the entry id")
    p.add_argument("--processes", type=int, default=8, help="cores of a local session; a cluster's own settings win")
    p.add_argument("--progress", action=argparse.BooleanOptionalAction, default=True, help="progress of the stages on the console")
    p.add_argument("--debug", action="store_true", help="log every step")
    p.add_argument("--coil-tables", help="folder of neighbour.csv and combination.csv")
    p.add_argument("--filter-defaults", choices=sorted(PRESETS), default="tolerant")
    p.add_argument("--score-types", nargs="+", choices=SCORE_TYPES, default=list(SCORE_TYPES))
    p.add_argument("--offset-correction", type=_flag, default=True)
    p.add_argument("--precision", type=int, default=4)
    p.add_argument("--include-shifts", action="store_true")
    p.add_argument("--no-shift-averaging", action="store_true")
    for f in fields(Filters):
        name, value = f"--{f.name.replace('_', '-')}", f.default
        if isinstance(value, bool):
            p.add_argument(name, type=_flag, default=argparse.SUPPRESS)
        elif isinstance(value, tuple) and f.name.endswith("range"):
            p.add_argument(name, type=float, nargs="+", default=argparse.SUPPRESS)
        elif isinstance(value, tuple):
            p.add_argument(name, nargs="*", default=argparse.SUPPRESS)
        else:
            p.add_argument(name, type=type(value), default=argparse.SUPPRESS)
    return p


def options(argv: list[str] | None = None) -> tuple[argparse.Namespace, Filters]:
    """The preset fills what is not given; explicit options win. A range of one number is open above."""
    args = parser().parse_args(argv)
    given = {f.name: getattr(args, f.name) for f in fields(Filters) if hasattr(args, f.name)}
    for name, value in given.items():
        if name.endswith("range"):
            given[name] = (value[0], value[1] if len(value) > 1 else math.inf)
        elif isinstance(value, list):
            given[name] = tuple(value)
    return args, filters(args.filter_defaults, **given)


def _submitted() -> bool:
    """Whether a launcher has chosen the master already."""
    from pyspark import SparkContext

    return SparkContext._active_spark_context is not None or "PYSPARK_GATEWAY_PORT" in os.environ


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from coilworks.functions.coil_tables import load_tables
    from coilworks.plans import dataset

    args, f = options(argv)
    logging.basicConfig(level=logging.DEBUG if args.debug else logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    logging.info("options: %s", vars(args))
    builder = SparkSession.builder.appName("coilworks").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", str(args.progress).lower())
    if "SPARK_MASTER" not in os.environ and "MASTER" not in os.environ and not _submitted():
        builder = builder.master(f"local[{args.processes}]")
    spark = builder.getOrCreate()
    out = f"{args.output}.{args.output_format}"
    report = dataset.run(spark, args.input_dir, out, f, args.output_format, args.file_pattern, load_tables(args.coil_tables), args.offset_correction, args.precision, tuple(args.score_types), args.include_shifts, not args.no_shift_averaging, args.cache_dir)
    report.show(200, truncate=False)


if __name__ == "__main__":
    main()
