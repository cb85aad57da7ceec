"""Random-coil shifts of one sequence: python -m coilworks.predict SEQUENCE PH TEMPERATURE IONIC.

Prints a fixed-width table (residue number and letter, then N C CA CB H HA HB,
missing as 0). The ends have no prediction; at pH 7 there are no pH terms.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from coilworks.functions.coil_tables import CoilTables, load_tables
from coilworks.operators import coil
from coilworks.sources import sinks

SHORTEST = 5


def table(spark: SparkSession, seq: str, ph: float, temperature: float, ionic: float, tables: CoilTables | None = None) -> DataFrame:
    """pos, line of the sequence; under SHORTEST residues is an error."""
    if len(seq) < SHORTEST:
        raise ValueError(f"at least {SHORTEST} residues are needed")
    rows = spark.createDataFrame([(1, seq.upper(), float(temperature), float(ph), float(ionic))], "id int, seq string, temperature double, ph double, ionic double")
    return sinks.shifty_lines(coil.predict(rows, "id", tables), "id").select("pos", "line").orderBy("pos")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("sequence")
    for name in ("ph", "temperature", "ionic"):
        p.add_argument(name, type=float)
    p.add_argument("--coil-tables", help="folder of neighbour.csv and combination.csv")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("coilworks").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    for r in table(spark, args.sequence, args.ph, args.temperature, args.ionic, load_tables(args.coil_tables)).collect():
        print(r.line)


if __name__ == "__main__":
    main()
