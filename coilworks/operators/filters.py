"""Pre- and post-filters of peptides and the report of what they lose.

Criteria are boolean columns with SQL's three-valued logic; rows are flagged,
never dropped. The report is one aggregate over the flags.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coilworks.functions.chi import ATOMS
from coilworks.functions.coil_tables import AMINO_ACIDS
from coilworks.params import Filters

CANONICAL = f"{AMINO_ACIDS}X"


def any_term(text: Column, terms: tuple[str, ...]) -> Column:
    """Case-insensitive match of any term; terms are regular expressions, as published."""
    return F.lower(text).rlike("|".join(t.lower() for t in terms)) if terms else F.lit(False)


def method(exp_method: Column, subtype: Column, whitelist: tuple[str, ...], blacklist: tuple[str, ...]) -> Column:
    """An NMR method whose subtype is in the whitelist and not in the blacklist.

    Without a subtype it passes only if the empty term is whitelisted and not
    blacklisted; an empty whitelist passes nothing.
    """
    if not whitelist:
        return F.lit(False)
    nmr = F.lower(exp_method).contains("nmr")
    passing = nmr & any_term(subtype, whitelist)
    if blacklist:
        passing &= ~any_term(subtype, blacklist)
    if "" in whitelist and "" not in blacklist:
        return passing | (nmr & subtype.isNull())
    return passing & subtype.isNotNull()


def between(x: Column, bounds: tuple[float, float]) -> Column:
    """Inclusive; an infinite bound only asks for a value."""
    lo, hi = bounds
    low = x >= lo if math.isfinite(lo) else x.isNotNull()
    return low & (x <= hi) if math.isfinite(hi) else low


def noncanonical_fraction(seq: Column) -> Column:
    kept = F.length(seq) - F.length(F.translate(seq, CANONICAL, ""))
    return 1 - F.try_divide(kept.cast("double"), F.length(seq).cast("double"))


def x_fraction(seq: Column) -> Column:
    return F.try_divide((F.length(seq) - F.length(F.replace(seq, F.lit("X"), F.lit("")))).cast("double"), F.length(seq).cast("double"))


def hits(texts: list[Column], terms: tuple[str, ...]) -> Column:
    """map<term, boolean>: whether a text contains the term, case ignored; nulls hold nothing."""
    if not terms:
        return F.expr("cast(map() as map<string,boolean>)")
    found = F.array_compact(F.array(*[F.lower(t) for t in texts]))

    def entry(term: str) -> Column:
        return F.struct(F.lit(term).alias("key"), F.exists(found, lambda x: x.contains(term.lower())).alias("value"))

    entries = [entry(t) for t in terms]
    return F.map_from_entries(F.array(*entries))


def criteria(f: Filters) -> dict[str, Column]:
    """Name and test of each pre-filter criterion over the peptide columns."""
    c = F.col
    length = F.length("seq")
    tests = {
        "method": method(c("exp_method"), c("exp_method_subtype"), f.exp_method_whitelist, f.exp_method_blacklist),
        "temperature": between(c("temperature"), f.temperature_range),
        "ionic_strength": between(c("ionic_strength"), f.ionic_strength_range),
        "ph": between(c("ph"), f.ph_range),
        "peptide_length": between(length, f.peptide_length_range),
        "shift_types": c("types") >= f.min_backbone_shift_types,
        "shift_positions": c("positions") >= f.min_backbone_shift_positions,
        "shift_fraction": F.try_divide(c("positions").cast("double"), length.cast("double")) >= f.min_backbone_shift_fraction,
        "noncanonical": noncanonical_fraction(c("seq")) <= f.max_noncanonical_fraction,
        "x_residues": x_fraction(c("seq")) <= f.max_x_fraction,
    }
    tests |= {f"keyword {k}": ~F.element_at("kw_hits", k) for k in f.keywords_blacklist}
    return tests | {f"chemical {k}": ~F.element_at("denat_hits", k) for k in f.chemical_denaturants}


def present(f: Filters) -> Column:
    """No value missing that the filters need; the subtype only where it is required."""
    needed = ["exp_method", "temperature", "ionic_strength", "ph", "seq", "total"]
    if not ("" in f.exp_method_whitelist and "" not in f.exp_method_blacklist):
        needed.append("exp_method_subtype")
    return reduce(and_, [F.col(n).isNotNull() for n in needed])


def prefilter(peptides: DataFrame, f: Filters) -> DataFrame:
    """Adds pass_pre."""
    return peptides.withColumn("pass_pre", F.coalesce(present(f) & reduce(and_, criteria(f).values()), F.lit(False)))


def postfilter(peptides: DataFrame, f: Filters) -> DataFrame:
    """Adds pass_post from types_post, positions_post, failed (no scores) and, if offsets may not be lost, lost_offsets."""
    return peptides.withColumn("pass_post", F.col("pass_pre") & F.coalesce(reduce(and_, post_criteria(f).values()), F.lit(False)))


def post_criteria(f: Filters) -> dict[str, Column]:
    """Name and test of each post-filter criterion."""
    c = F.col
    tests = {
        "shift_types": c("types_post") >= f.min_backbone_shift_types,
        "shift_positions": c("positions_post") >= f.min_backbone_shift_positions,
        "shift_fraction": F.try_divide(c("positions_post").cast("double"), F.length("seq").cast("double")) >= f.min_backbone_shift_fraction,
        "computation": ~c("failed"),
    }
    return tests if f.reject_shift_type_only else tests | {"any_offset": c("lost_offsets") == 0}


def losses(peptides: DataFrame, f: Filters) -> DataFrame:
    """criterion, filtered, only_filtered, percent: rows that fail each criterion, and rows that fail no other.

    A row with an unknown test counts for the tests that are known, and not as
    failing "only" one. One pass: the tests are evaluated once for each row.
    """
    return _lost(peptides, criteria(f))


def _lost(peptides: DataFrame, tests: dict[str, Column]) -> DataFrame:
    names = list(tests)
    flagged = peptides.select(F.array(*[tests[n] for n in names]).alias("t"))
    failing = F.size(F.filter("t", lambda x: ~x))
    unknown = F.exists("t", lambda x: x.isNull())
    aggs = [F.count("*").alias("rows")]
    for i in range(len(names)):
        bad = F.coalesce(~F.element_at("t", i + 1), F.lit(False))
        aggs += [F.count_if(bad).alias(f"a{i}"), F.count_if(bad & (failing == 1) & ~unknown).alias(f"b{i}")]
    one = flagged.agg(*aggs)
    rows = [F.struct(F.lit(n).alias("criterion"), F.col(f"a{i}").alias("filtered"), F.col(f"b{i}").alias("only_filtered"), (100 * F.coalesce(F.try_divide(F.col(f"a{i}").cast("double"), F.col("rows").cast("double")), F.lit(0.0))).alias("percent")) for i, n in enumerate(names)]
    return one.select(F.inline(F.array(*rows)))


def report(peptides: DataFrame, f: Filters) -> DataFrame:
    """stage, criterion, filtered, only_filtered, percent: the whole loss report.

    Stages: pre (each criterion over all peptides), offset (atoms rejected, over
    those that pass the pre-filter), post (each criterion over the same), total
    (what the pre-filter and the post-filter take away, and what remains for the
    scores and in the dataset). ``peptides`` has pass_pre, pass_post, off_<atom>
    and the columns of both filters; of no peptide every percentage is 0.
    """
    passing = peptides.filter("pass_pre")
    offsets = {a: F.col(f"off_{a}").isNotNull() for a in ATOMS}
    parts = [_lost(rows, tests).withColumn("stage", F.lit(name)) for name, rows, tests in (("pre", peptides, criteria(f)), ("offset", passing, offsets), ("post", passing, post_criteria(f)))]
    one = peptides.agg(F.count("*").alias("all"), F.count_if("pass_pre").alias("pre"), F.count_if("pass_post").alias("post"))
    rows = []
    for name, n, of in (("filtered_pre", F.col("all") - F.col("pre"), "all"), ("remaining_for_scores", F.col("pre"), "all"), ("filtered_post", F.col("pre") - F.col("post"), "pre"), ("final_dataset", F.col("post"), "all")):
        rows.append(F.struct(F.lit(name).alias("criterion"), n.alias("filtered"), F.lit(None).cast("bigint").alias("only_filtered"), (100 * F.coalesce(F.try_divide(n.cast("double"), F.col(of).cast("double")), F.lit(0.0))).alias("percent")))
    parts.append(one.select(F.inline(F.array(*rows))).withColumn("stage", F.lit("total")))
    return reduce(DataFrame.unionByName, parts).select("stage", "criterion", "filtered", "only_filtered", "percent")
