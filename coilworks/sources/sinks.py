"""Dataset sinks: nested JSON lines, long CSV, fixed-width shift tables.

Arrays are built here only; a peptide's arrays are as long as its sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coilworks.functions.chi import ATOMS, rounded

OFFSETS = [f"off_{a}" for a in ATOMS]
SHIFTY_ATOMS = ("N", "C", "CA", "CB", "H", "HA", "HB")


def nested_scores(scored: DataFrame, digits: int = 4) -> DataFrame:
    """One row a peptide: id, k, zscores, pscores as arrays by position, offsets; scores rounded half-even."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.col("k3").cast("bigint").alias("k3"), rounded(F.col("z3"), digits).alias("z3"), rounded(F.col("p3"), digits).alias("p3"))))
    out = scored.groupBy("pep").agg(rows.alias("_r"), *[F.max(f"off{j}").alias(o) for j, o in enumerate(OFFSETS)])
    return out.select(F.col("pep").cast("string").alias("id"), F.col("_r.k3").alias("k"), F.col("_r.z3").alias("zscores"), F.col("_r.p3").alias("pscores"), *OFFSETS)


def long_scores(nested: DataFrame) -> DataFrame:
    """One row a residue: id, seq_index (1-based), k, zscores, pscores.

    Arrays of unequal length are an error, since zipping would pad them with nulls.
    """
    same = (F.size("k") == F.size("zscores")) & (F.size("k") == F.size("pscores"))
    checked = nested.withColumn("k", F.when(same, F.col("k")).otherwise(F.raise_error(F.lit("score arrays of unequal length")).cast("array<bigint>")))
    rows = checked.select("id", F.posexplode(F.arrays_zip("k", "zscores", "pscores")).alias("_p", "_e"))
    return rows.select("id", (F.col("_p") + 1).alias("seq_index"), "_e.k", "_e.zscores", "_e.pscores")


def write_dataset(nested: DataFrame, path: str, kind: str = "csv") -> None:
    """Writes ``csv`` (long, one row a residue) or ``json`` (lines, one peptide each, nulls written)."""
    if kind == "csv":
        long_scores(nested).write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        nested.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown output format {kind!r}: csv or json")


def shifty_lines(predicted: DataFrame, id_column: str = "ent_row") -> DataFrame:
    """Fixed-width lines of predicted shifts (id, pos, line): number, residue, then N C CA CB H HA HB, missing as 0.

    ``predicted`` is long: id, pos, aa, atom, shift.
    """
    values = [F.coalesce(F.max(F.when(F.col("atom") == a, F.col("shift"))), F.lit(0.0)).alias(a) for a in SHIFTY_ATOMS]
    wide = predicted.groupBy(id_column, "pos", "aa").agg(*values)
    return wide.select(id_column, "pos", F.format_string("%-4d %s" + " %8.3f" * 7, "pos", "aa", *SHIFTY_ATOMS).alias("line"))


def write_shifty(predicted: DataFrame, path: str, id_column: str = "ent_row") -> None:
    lines = shifty_lines(predicted, id_column)
    lines.sortWithinPartitions(id_column, "pos").select(id_column, "line").write.mode("overwrite").partitionBy(id_column).text(path)
