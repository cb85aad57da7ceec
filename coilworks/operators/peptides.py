"""Entries to peptides: which shifts belong to which chain under which conditions.

All look-ups stay within the entry's row: nested arrays are filtered and matched
by higher-order functions, so nothing is joined or shuffled until shift rows are
brought together by peptide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coilworks.operators import conditions as cond
from coilworks.operators import filters, shifts
from coilworks.params import Filters

_STR = "array<string>"


def _ids(arr: Column, field: str = "id") -> Column:
    return F.array_distinct(F.transform(arr, lambda x: x[field]))


def _filled(arr: Column) -> Column:
    return F.filter(arr, lambda x: x.isNotNull() & (x != ""))


def shift_keys(entries: DataFrame) -> DataFrame:
    """entry_id, entry, table, key (entity_assem_id, entity_id), sample_ids of each usable shift table's chains.

    A table is skipped if its conditions are unknown, if it names an unknown
    experiment or sample. Samples are its own, or else those of its experiments;
    it may have none.
    """
    rows = entries.filter("entry is not null").select("entry_id", "entry", F.explode("entry.shift_tables").alias("table"))
    known = F.exists("entry.conditions", lambda c: c["id"] == F.col("table.condition_id"))
    wanted = _filled(_ids(F.col("table.experiments")))
    experiments = F.size(F.array_except(wanted, _ids(F.col("entry.experiments")))) == 0
    direct = _filled(_ids(F.col("table.experiments"), "sample_id"))
    through = _filled(F.transform(F.filter("entry.experiments", lambda e: F.array_contains(wanted, e["id"])), lambda e: e["sample_id"]))
    rows = rows.withColumn("sample_ids", F.array_distinct(F.when(F.size(direct) > 0, direct).otherwise(through)))
    samples = F.size(F.array_except("sample_ids", _ids(F.col("entry.samples")))) == 0
    keys = F.array_distinct(F.transform("table.shifts", lambda s: F.struct(s["entity_assem_id"].alias("entity_assem_id"), s["entity_id"].alias("entity_id"))))
    return rows.filter(known & experiments & samples).select("entry_id", "entry", "table", "sample_ids", F.explode(keys).alias("key"))


def resolve(components: Column, assem_id: Column, entity_id: Column) -> Column:
    """The one component meant: same id, and no or the same entity; if several, those with the same entity; null unless one is left."""
    loose = F.filter(components, lambda c: (c["id"] == assem_id) & ((c["entity_id"] == "") | (c["entity_id"] == entity_id)))
    strict = F.filter(components, lambda c: (c["id"] == assem_id) & (c["entity_id"] == entity_id))
    return F.when(F.size(loose) == 1, F.try_element_at(loose, F.lit(1))).when((F.size(loose) > 1) & (F.size(strict) == 1), F.try_element_at(strict, F.lit(1)))


def peptides(entries: DataFrame, f: Filters) -> DataFrame:
    """One row a peptide with its entry's fields, sequence, conditions, term hits and raw shifts."""
    rows = shift_keys(entries)
    components = F.flatten(F.transform("entry.assemblies", lambda a: F.transform(a["entities"], lambda c: F.struct(c["id"].alias("id"), c["entity_id"].alias("entity_id"), a["name"].alias("name"), a["details"].alias("details")))))
    rows = rows.withColumn("component", resolve(components, F.col("key.entity_assem_id"), F.col("key.entity_id"))).filter("component is not null")
    own = F.try_element_at(F.filter("entry.entities", lambda e: e["id"] == F.col("key.entity_id")), F.lit(1))
    rows = rows.withColumn("entity", own).filter("entity is not null and entity.type = 'polymer' and entity.polymer_type = 'polypeptide(L)'")
    condition = F.try_element_at(F.filter("entry.conditions", lambda c: c["id"] == F.col("table.condition_id")), F.lit(1))
    rows = rows.withColumn("vars", condition["variables"])

    def last(name: str) -> Column:
        return F.try_element_at(F.filter("vars", lambda v: cond.variable(v["type"]) == name), F.lit(-1))

    rows = rows.withColumns({f"_{n}": last(n) for n in ("temperature", "ionic_strength", "ph")})
    named = F.filter("entry.samples", lambda s: F.array_contains("sample_ids", s["id"]))
    rows = rows.withColumns({"_named": named, "_searched": F.when(F.size("sample_ids") == 0, F.col("entry.samples")).otherwise(named)})
    sample_texts = F.flatten(F.transform("_named", lambda s: F.array(s["name"], s["details"], s["framecode"])))
    # the entry's details are a copy of its title
    texts = F.concat(F.array("entry.title", "entry.citation_title", "component.name", "component.details", "entity.name", "entity.details"), sample_texts)
    chemicals = F.flatten(F.transform("_searched", lambda s: F.transform(F.filter(s["components"], lambda c: (c["name"] != "") & (c["entity_id"] == "")), lambda c: c["name"])))
    rows = rows.withColumns({"_texts": F.array_compact(texts), "_chemicals": F.array_compact(chemicals)})

    def found(column: str, terms: tuple[str, ...]) -> Column:
        def entry(term: str) -> Column:
            return F.struct(F.lit(term).alias("key"), F.exists(column, lambda x: F.lower(x).contains(term.lower())).alias("value"))

        return F.map_from_entries(F.array(*[entry(t) for t in terms])) if terms else F.expr("cast(map() as map<string,boolean>)")

    t, i = F.col("_temperature"), F.col("_ionic_strength")
    mine = F.filter("table.shifts", lambda s: (s["entity_assem_id"] == F.col("key.entity_assem_id")) & (s["entity_id"] == F.col("key.entity_id")))
    return rows.select(
        "entry_id", F.col("table.id").alias("st_id"), "key.entity_assem_id", "key.entity_id", F.col("entity.name").alias("entity_name"), F.col("entity.seq").alias("seq"),
        F.nullif("entry.exp_method", F.lit("")).alias("exp_method"), F.nullif("entry.exp_method_subtype", F.lit("")).alias("exp_method_subtype"), "entry.citation_title", "entry.citation_doi",
        cond.temperature(t["val"], t["unit"], f.unit_assumptions, f.unit_corrections, f.default_conditions).alias("temperature"),
        cond.ionic_strength(i["val"], i["unit"], f.unit_assumptions, f.unit_corrections, f.default_conditions).alias("ionic_strength"),
        cond.ph(F.col("_ph")["val"], f.default_conditions).alias("ph"),
        found("_texts", f.keywords_blacklist).alias("kw_hits"), found("_chemicals", f.chemical_denaturants).alias("denat_hits"), mine.alias("shifts"),
    )


def checked(rows: DataFrame) -> DataFrame:
    """Shift rows of the peptides with the tests of :func:`coilworks.operators.shifts.checked_rows`."""
    long = rows.select("entry_id", "st_id", F.inline("shifts"))
    chains = rows.select("entry_id", "entity_id", "seq").distinct().withColumns({"entity_type": F.lit("polymer"), "polymer_type": F.lit("polypeptide(L)")})
    return shifts.checked_rows(long, chains)


def with_coverage(rows: DataFrame, tests: DataFrame, f: Filters) -> DataFrame:
    """Peptides with total, types, positions (null where the shifts are rejected) and pass_pre."""
    cov = shifts.coverage(tests).drop("length")
    return filters.prefilter(rows.drop("shifts").join(cov, list(shifts.PEPTIDE), "left"), f)
