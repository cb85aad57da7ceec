"""The dataset build: entries to filtered, scored peptides, their report and files."""

from __future__ import annotations

import logging
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coilworks.functions.chi import ATOMS, WEIGHTS, rounded
from coilworks.functions.coil_tables import CoilTables
from coilworks.operators import coil, filters, peptides, scoring, shifts
from coilworks.params import FORMATS, SCORE_TYPES, Filters
from coilworks.session import stage
from coilworks.sources import star


LOG = logging.getLogger("coilworks.dataset")

# fixed values: column names of the published files
PUBLISHED = {
    "id": "ID", "entry_id": "entryID", "st_id": "stID", "entity_assem_id": "entity_assemID", "entity_id": "entityID", "citation_doi": "citation_DOI", "ph": "pH",
    "positions_post": "bbshift_positions_post", "types_post": "bbshift_types_post", "total": "total_bbshifts",
}
ATOM_ORDER = ("C", "CA", "CB", "H", "HA", "HB", "N")  #: of the offsets in the published files


class Dataset(NamedTuple):
    peptides: DataFrame  #: all peptides with pass_pre and pass_post
    nested: DataFrame  #: the passing ones with their arrays
    failed: DataFrame  #: entry_id, error
    tests: DataFrame  #: shift rows with their tests


def comparisons(passing: DataFrame, tests: DataFrame, tables: CoilTables | None) -> DataFrame:
    """Residue rows pep, pos, leak, x0..x6 of the peptides that pass the pre-filter."""
    key = F.concat_ws("_", *shifts.PEPTIDE).alias("pep")
    seqs = passing.select(key, "seq", "temperature", "ph", F.col("ionic_strength").alias("ionic"))
    predicted = coil.predict(seqs, "pep", tables).select("pep", "pos", "atom", "shift")
    observed = shifts.averaged(tests).select(key, "pos", "atom", "value").join(seqs.select("pep"), "pep", "left_semi")
    both = observed.join(predicted, ["pep", "pos", "atom"], "left")
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    x = F.when(F.col("shift").isNotNull(), (F.col("value") - F.col("shift")) / F.element_at(weight, F.col("atom")))
    wide = both.groupBy("pep", "pos").agg(*[F.max(F.when(F.col("atom") == a, x)).alias(f"x{j}") for j, a in enumerate(ATOMS)], F.count_if(F.col("shift").isNull()).cast("int").alias("leak"))
    grid = seqs.select("pep", F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("pos"))
    return grid.join(wide, ["pep", "pos"], "left").withColumn("leak", F.coalesce("leak", F.lit(0)))


def build(entries: DataFrame, f: Filters, tables: CoilTables | None = None, offset_correction: bool = True, precision: int = 4, folder: str | None = None, key: object = None) -> Dataset:
    """Filtered and scored peptides of parsed entries. Without entries, or if nothing passes, the results are empty.

    Peptides carry ``reason``: why one has no place in the dataset, or null. With
    a ``folder`` the stages are kept there under ``key`` (what the entries are)
    and every option they depend on, and reused by a later run.
    """
    written = lambda name, make, *options: stage(folder, name, (key, name, f, *options), make)
    rows = written("peptides", lambda: peptides.peptides(entries, f))
    tests = written("shifts", lambda: peptides.checked(rows))
    flagged = written("flagged", lambda: peptides.with_coverage(rows, tests, f))
    passing = flagged.filter("pass_pre")
    max_offset = None if f.max_offset == float("inf") else f.max_offset
    scored = written("scores", lambda: scoring.corrected(comparisons(passing, tests, tables), max_offset, f.reject_shift_type_only, offset_correction), tables, offset_correction)
    cells = [F.col(f"x{j}").isNotNull() for j in range(len(ATOMS))]
    seen = F.greatest(*[c.cast("int") for c in cells])
    kinds = [F.max(c.cast("int")) for c in cells]
    at = F.array_sort(F.collect_list(F.struct("pos", F.col("k3").cast("int").alias("k"), rounded(F.col("z3"), precision).alias("z"), rounded(F.col("p3"), precision).alias("p"))))
    by = scored.groupBy("pep").agg(
        F.sum(seen).alias("positions_post"), sum(kinds[1:], kinds[0]).alias("types_post"), F.sum(sum([c.cast("int") for c in cells[1:]], cells[0].cast("int"))).alias("total_post"), (F.count("z3") == 0).alias("failed"),
        at.alias("_r"), *[F.max(f"off{j}").alias(f"off_{a}") for j, a in enumerate(ATOMS)],
    )
    by = by.withColumn("lost_offsets", sum([F.col(f"off_{a}").isNull().cast("int") for a in ATOMS[1:]], F.col(f"off_{ATOMS[0]}").isNull().cast("int")))
    joined = flagged.withColumn("pep", F.concat_ws("_", *shifts.PEPTIDE)).join(by, "pep", "left").withColumn("failed", F.coalesce("failed", F.lit(True)))
    done = filters.postfilter(joined, f)
    reasons = (("shifts rejected", F.col("total").isNull()), ("pre-filter", ~F.col("pass_pre")), ("no scores", F.col("failed")), ("post-filter", ~F.col("pass_post")))
    done = done.withColumn("reason", F.coalesce(*[F.when(test, text) for text, test in reasons]))
    fields = ["exp_method", "exp_method_subtype", "citation_doi", "citation_title", "ionic_strength", "ph", "temperature", *[f"off_{a}" for a in ATOM_ORDER], "positions_post", "types_post", "total", "seq"]
    nested = done.filter("pass_post").select(F.col("pep").alias("id"), *shifts.PEPTIDE, "entity_name", *fields, F.col("_r.k").alias("k"), F.col("_r.z").alias("zscores"), F.col("_r.p").alias("pscores"))
    return Dataset(done.drop("_r"), nested, entries.filter("error is not null").select("entry_id", "error"), tests)


def shift_columns(averaging: bool = True) -> tuple[str, ...]:
    """Names of the shift arrays: seven atoms, and the single protons without averaging."""
    return tuple(f"shift_{a}" for a in (ATOMS if averaging else (*ATOMS, *shifts.EXTRA)))


def with_shifts(nested: DataFrame, tests: DataFrame, averaging: bool = True) -> DataFrame:
    """``nested`` with one array by position for each atom; null where nothing was observed."""
    key = list(shifts.PEPTIDE)
    names = [c.removeprefix("shift_") for c in shift_columns(averaging)]
    cells = shifts.averaged(tests) if averaging else shifts.cell_values(tests).withColumn("atom", F.col("atom_id"))
    cells = cells.join(nested.select(*key), key, "left_semi")
    wide = cells.groupBy(*key, "pos").agg(*[F.max(F.when(F.col("atom") == a, F.col("value"))).alias(a) for a in names])
    grid = nested.select(*key, F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("pos"))
    rows = grid.join(wide, [*key, "pos"], "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("_s"))
    return nested.join(rows.select(*key, *[F.col(f"_s.{a}").alias(f"shift_{a}") for a in names]), key)


def long_rows(nested: DataFrame, score_types: tuple[str, ...] = SCORE_TYPES) -> DataFrame:
    """One row a residue of the passing peptides, scores in the order asked for, then the shifts if there are any."""
    check_scores(score_types)
    more = [*score_types, *[c for c in nested.columns if c.startswith("shift_")]]
    # zipping would pad unequal arrays with nulls
    same = reduce(and_, [F.size(c) == F.length("seq") for c in ("k", *more)])
    nested = nested.withColumn("k", F.when(same, F.col("k")).otherwise(F.raise_error(F.concat(F.lit("arrays of unequal length in "), "id")).cast("array<int>")))
    rows = nested.select("id", *shifts.PEPTIDE, "entity_name", F.posexplode(F.arrays_zip(F.split("seq", "").alias("seq"), "k", *more)).alias("_p", "_e"))
    return rows.select("id", *shifts.PEPTIDE, "entity_name", (F.col("_p") + 1).alias("seq_index"), "_e.seq", "_e.k", *[f"_e.{s}" for s in more])


def published(df: DataFrame) -> DataFrame:
    """Columns under the names of the published files; shift arrays are named by their atom."""
    return df.withColumnsRenamed(PUBLISHED | {c: c.removeprefix("shift_") for c in df.columns if c.startswith("shift_")})


def check_scores(score_types: tuple[str, ...]) -> None:
    if wrong := [s for s in score_types if s not in SCORE_TYPES]:
        raise ValueError(f"unknown score types {wrong}: {', '.join(SCORE_TYPES)}")


def run(spark: SparkSession, folder: str, out: str, f: Filters, kind: str = "csv", pattern: str = star.FILE_PATTERN, tables: CoilTables | None = None, offset_correction: bool = True, precision: int = 4, score_types: tuple[str, ...] = SCORE_TYPES, include_shifts: bool = False, averaging: bool = True, cache: str | None = None) -> DataFrame:
    """Builds the dataset of a folder, writes it to ``out`` and returns the loss report.

    With ``cache`` parsed entries and all stages are kept there, keyed by the
    files (paths, sizes, times) and every option, so that a second run reuses
    what it can and no stale result.
    """
    if kind not in FORMATS:
        raise ValueError(f"unknown output format {kind!r}: {', '.join(FORMATS)}")
    check_scores(score_types)
    key = star.fingerprint(spark, folder, pattern) if cache else None
    entries = stage(cache, "entries", key, lambda: star.read_entries(spark, folder, pattern))
    LOG.info("entries read from %s", folder)
    got = build(entries, f, tables, offset_correction, precision, cache, key)
    for r in got.failed.groupBy("error").count().orderBy(F.desc("count")).limit(20).toLocalIterator():
        LOG.warning("%d entries rejected: %s", r["count"], r["error"])
    nested = with_shifts(got.nested, got.tests, averaging) if include_shifts else got.nested
    if kind == "csv":
        published(long_rows(nested, score_types)).write.mode("overwrite").option("header", True).csv(out)
    else:
        drop = [s for s in SCORE_TYPES if s not in score_types]
        published(nested.drop(*drop)).write.mode("overwrite").option("ignoreNullFields", False).json(out)
    LOG.info("dataset written to %s", out)
    return filters.report(got.peptides, f)
