"""Backbone shifts of peptides: checks, filters, renaming, averaging, coverage.

Two exchanges at most: rows are combined to one for each chain, position and atom
name (before the shuffle too, so that a hot entry sends its cells once), then
brought together by peptide. Every later group key contains the peptide, so
faults, averages and coverage follow in the same partitions. A peptide has no
more cells than its sequence has atoms and its faulty positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coilworks.functions.chi import ATOMS
from coilworks.functions.coil_tables import THREE_TO_ONE
from coilworks.operators.conditions import number

PEPTIDE = ("entry_id", "st_id", "entity_assem_id", "entity_id")
EXTRA = ("HA2", "HA3", "HB1", "HB2", "HB3")
MAX_ERROR = 1.3


def residues(seq: Column) -> Column:
    """Letters of a sequence in upper case."""
    return F.upper(F.regexp_replace(seq, "[^A-Za-z]", ""))


def latest_entities(entities: DataFrame) -> DataFrame:
    """One row an entity: entry_id, entity_id, entity_type, polymer_type, seq, name; the last received wins, then the largest row."""
    last = F.max(F.struct("received_at", "ent_row", "entity_type", "polymer_type", F.nullif(F.coalesce(residues(F.col("seq")), F.lit("")), F.lit("")).alias("seq"), "entity_name", "details")).alias("e")
    return entities.groupBy("entry_id", "entity_id").agg(last).select("entry_id", "entity_id", "e.entity_type", "e.polymer_type", "e.seq", "e.entity_name", "e.details")


def _empty(c: str) -> Column:
    """``.`` and null are empty text."""
    return F.when(F.col(c).isNull() | (F.col(c) == "."), "").otherwise(F.col(c))


def checked_rows(shifts: DataFrame, entities: DataFrame) -> DataFrame:
    """Shift rows of polypeptides with pos (1-based), aa, atom, value, error, and the tests of each step.

    bad_pos: not a whole number or below 1; beyond: past the sequence; mismatch:
    a canonical residue that is not the sequence's; bad_value: a canonical atom,
    side chains included, without a number; kept: canonical, error at most 1.3 or
    not given, ambiguity 1, 2 or empty, a backbone atom; bad_name: kept, but no
    name of its residue (HB1 outside Ala, HA2 outside Gly).
    """
    wanted = entities.filter((F.col("entity_type") == "polymer") & (F.col("polymer_type") == "polypeptide(L)") & F.col("seq").isNotNull()).select("entry_id", "entity_id", "seq")
    rows = shifts.join(wanted, ["entry_id", "entity_id"])
    code = F.try_element_at(F.create_map(*[F.lit(x) for kv in THREE_TO_ONE.items() for x in kv]), F.upper(F.trim(F.col("comp_id"))))
    whole = F.trim(F.col("seq_id")).rlike(r"^[-+]?\d{1,9}$")
    rows = rows.select(*PEPTIDE, "seq", F.when(whole, F.trim(F.col("seq_id")).cast("int")).alias("pos"), code.alias("aa"), F.col("atom_id"), number(_empty("val")).alias("value"), number(_empty("val_err")).alias("error"), _empty("ambiguity").alias("ambiguity"))
    canonical, length = F.col("aa").isNotNull(), F.length("seq")
    own = F.substring(F.col("seq"), F.col("pos"), F.lit(1))
    bad_pos = F.col("pos").isNull() | (F.col("pos") < 1)
    beyond = ~bad_pos & (F.col("pos") > length)
    ala, gly, name = F.col("aa") == "A", F.col("aa") == "G", F.col("atom_id")
    atom = F.when(ala & name.isin("HB1", "HB2", "HB3"), "HB").when(~ala & name.isin("HB2", "HB3"), "HB").when(gly & name.isin("HA2", "HA3"), "HA").when(name.isin(*ATOMS), name)
    kept = canonical & F.coalesce(F.col("error") <= MAX_ERROR, F.lit(True)) & F.col("ambiguity").isin("1", "2", "") & name.isin(*ATOMS, *EXTRA)
    kept = F.coalesce(kept, F.lit(False))
    return rows.select(
        *PEPTIDE, F.length("seq").alias("length"), "pos", "aa", "atom_id", atom.alias("atom"), "value", "error",
        bad_pos.alias("bad_pos"), beyond.alias("beyond"), F.coalesce(canonical & ~bad_pos & ~beyond & (own != F.col("aa")), F.lit(False)).alias("mismatch"),
        (canonical & F.col("value").isNull()).alias("bad_value"), kept.alias("kept"), (kept & atom.isNull()).alias("bad_name"),
    )


TESTS = ("bad_pos", "beyond", "mismatch", "bad_value", "bad_name")


def cells(checked: DataFrame) -> DataFrame:
    """One row for each chain, position and atom name, combined before the shuffle: what its rows say.

    n kept rows, the smallest and greatest (value, error) of them, and each test's
    worst outcome. Identical rows, the error included, are one; null errors are equal.
    """
    pair = F.when(F.col("kept"), F.struct("value", "error"))
    rows = checked.groupBy(*PEPTIDE, "length", "pos", "atom", "atom_id").agg(F.min(pair).alias("a"), F.max(pair).alias("b"), F.count_if("kept").alias("n"), *[F.max(t).alias(t) for t in TESTS])
    return rows.withColumn("conflict", (F.col("n") > 0) & ~F.col("a").eqNullSafe(F.col("b"))).withColumn("value", F.col("a.value")).drop("a", "b")


def cell_values(checked: DataFrame) -> DataFrame:
    """Kept rows of one atom name at a position: value (the only one) and conflict (two different rows)."""
    return cells(checked).filter("n > 0").select(*PEPTIDE, "length", "pos", "atom", "atom_id", "value", "n", "conflict")


def rejected_peptides(checked: DataFrame) -> DataFrame:
    """PEPTIDE with one boolean a test; a peptide with any of them has no shifts."""
    out = cells(checked).groupBy(*PEPTIDE).agg(*[F.max(t).alias(t) for t in (*TESTS, "conflict")])
    return out.withColumn("rejected", _any_fault())


def _any_fault() -> Column:
    return F.greatest(*[F.col(t).cast("int") for t in (*TESTS, "conflict")]) == 1


def _judged(checked: DataFrame) -> DataFrame:
    """Cells with ``rejected``, a fault anywhere in their peptide; partitioned by peptide, whose cells are few."""
    return cells(checked).withColumn("rejected", F.max(_any_fault()).over(Window.partitionBy(*PEPTIDE)))


def averaged(checked: DataFrame) -> DataFrame:
    """PEPTIDE, length, pos, atom, value of the peptides without a fault: the mean over protons of one name."""
    return _judged(checked).filter("n > 0 and not rejected").groupBy(*PEPTIDE, "length", "pos", "atom").agg(F.avg("value").alias("value"))


def coverage(checked: DataFrame) -> DataFrame:
    """PEPTIDE, length, total, types, positions: cells without the ends, atoms seen, residues seen; null for rejected peptides.

    A sequence under two residues has 0, 0, 0.
    """
    places = {a: 1 << j for j, a in enumerate(ATOMS)}
    bit = F.element_at(F.create_map(*[F.lit(x) for kv in places.items() for x in kv]), F.col("atom"))
    seen = F.coalesce(F.bit_or(F.when(F.col("n") > 0, bit)), F.lit(0))
    by_residue = _judged(checked).groupBy(*PEPTIDE, "length", "rejected", "pos").agg(seen.alias("seen"))
    inner = (F.col("pos") > 1) & (F.col("pos") < F.col("length"))
    out = by_residue.groupBy(*PEPTIDE).agg(
        F.max("length").alias("length"), F.max("rejected").alias("rejected"), F.sum(F.when(inner, F.bit_count("seen")).otherwise(0)).alias("total"), F.bit_count(F.bit_or("seen")).alias("types"), F.count_if(F.col("seen") > 0).alias("positions")
    )
    value = lambda c: F.when(~F.col("rejected"), F.when(F.col("length") < 2, F.lit(0)).otherwise(F.col(c))).cast("bigint").alias(c)
    return out.select(*PEPTIDE, "length", value("total"), value("types"), value("positions"))
