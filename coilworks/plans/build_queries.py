"""Queries of the dataset build over the deposition tables: conditions, shifts, filters, random coil."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from coilworks.functions import coil_tables as ct
from coilworks.functions.chi import hill, rounded
from coilworks.operators import coil, conditions, filters, peptides, pka, shifts
from coilworks.params import PRESETS
from coilworks.params import filters as filters_of
from coilworks.session import fan_out, table
from coilworks.session import spread as fan_out_rows
from coilworks.sources import star

RULES = ct.rule_tables()


def _conditions(spark, d):
    return conditions.last_values(table(spark, d, "sample_conditions"))


def condition_temperature(spark, d):
    v, u = F.col("temperature_val"), F.col("temperature_unit")
    return _conditions(spark, d).select("entry_id", "cond_list_id", F.round(conditions.temperature(v, u), 6).alias("tolerant_k"), F.round(conditions.temperature(v, u, True, False), 6).alias("moderate_k"), F.round(conditions.temperature(v, u, False, False, False), 6).alias("strict_k"))


def condition_ionic(spark, d):
    v, u = F.col("ionic_strength_val"), F.col("ionic_strength_unit")
    return _conditions(spark, d).select("entry_id", "cond_list_id", F.round(conditions.ionic_strength(v, u), 6).alias("tolerant_m"), F.round(conditions.ionic_strength(v, u, True, False), 6).alias("moderate_m"), F.round(conditions.ionic_strength(v, u, False, False, False), 6).alias("strict_m"))


def condition_ph(spark, d):
    return _conditions(spark, d).select("entry_id", "cond_list_id", conditions.ph(F.col("ph_val")).alias("with_default"), conditions.ph(F.col("ph_val"), False).alias("as_given"))


def _peptides(spark, d):
    return table(spark, d, "entities").filter("polymer_type = 'polypeptide(L)'").select("ent_row", shifts.residues(F.col("seq")).alias("seq"))


def sequence_fractions(spark, d):
    s = F.col("seq")
    return _peptides(spark, d).select("ent_row", F.length(s).cast("bigint").alias("n"), F.round(filters.noncanonical_fraction(s), 6).alias("noncanonical"), F.round(filters.x_fraction(s), 6).alias("x_part"), F.coalesce(filters.between(F.length(s), (15, 200)), F.lit(False)).alias("length_ok"))


def method_filter(spark, d):
    m, s = F.col("exp_method"), F.col("exp_method_subtype")
    out = [F.coalesce(filters.method(m, s, f.exp_method_whitelist, f.exp_method_blacklist), F.lit(False)).alias(n) for n, f in PRESETS.items()]
    return table(spark, d, "star_entries").select("entry_row", *out)


def keyword_hits(spark, d):
    terms = ("disorder", "solution", "α-helix")
    got = table(spark, d, "star_entries").select("entry_row", filters.hits([F.col("title"), F.col("citation_title")], terms).alias("h"))
    return got.select("entry_row", *[F.element_at("h", t).alias(f"hit_{i}") for i, t in enumerate(terms)])


def denaturant_hits(spark, d):
    terms = PRESETS["strict"].chemical_denaturants
    rows = table(spark, d, "filter_defaults").select("preset_row", F.explode_outer("chemical_denaturants").alias("name"))
    hit = F.coalesce(F.size(F.map_filter(filters.hits([F.col("name")], terms), lambda k, v: v)), F.lit(0))
    return rows.groupBy("preset_row").agg(F.sum(hit).cast("bigint").alias("hits"))


def _checked(spark, d):
    return shifts.checked_rows(table(spark, d, "atom_shifts"), shifts.latest_entities(table(spark, d, "entities")))


def latest_entity(spark, d):
    return shifts.latest_entities(table(spark, d, "entities")).select("entry_id", "entity_id", "entity_type", "polymer_type", "seq")


def shift_tests(spark, d):
    names = ("bad_pos", "beyond", "mismatch", "bad_value", "kept", "bad_name")
    return _checked(spark, d).groupBy(*shifts.PEPTIDE).agg(F.count("*").alias("n_rows"), *[F.count_if(n).alias(n) for n in names])


def shift_cells(spark, d):
    return shifts.cell_values(_checked(spark, d)).filter("pos is not null").select(*shifts.PEPTIDE, "pos", "atom_id", "n", "conflict")


def shift_rejects(spark, d):
    return shifts.rejected_peptides(_checked(spark, d))


def shift_averages(spark, d):
    return shifts.averaged(_checked(spark, d)).select(*shifts.PEPTIDE, "pos", "atom", F.round("value", 6).alias("value"))


def shift_coverage(spark, d):
    return shifts.coverage(_checked(spark, d)).filter("total is not null").select(*shifts.PEPTIDE, F.col("length").cast("bigint").alias("length"), "total", "types", "positions")


def _filter_bridge(spark, d):
    """Peptides with their coverage, the entry's method and texts, and conditions of its first list (by its id)."""
    cov = shifts.coverage(_checked(spark, d))
    last = F.max(F.struct("received_at", "entry_row", "exp_method", "exp_method_subtype", "title", "citation_title")).alias("s")
    entry = table(spark, d, "star_entries").groupBy("entry_id").agg(last).select("entry_id", F.nullif("s.exp_method", F.lit("")).alias("exp_method"), F.nullif("s.exp_method_subtype", F.lit("")).alias("exp_method_subtype"), "s.title", "s.citation_title")
    first = F.row_number().over(Window.partitionBy("entry_id").orderBy(F.col("cond_list_id").asc_nulls_last()))
    cond = _conditions(spark, d).withColumn("_first", first).filter("_first = 1").select("entry_id", conditions.temperature(F.col("temperature_val"), F.col("temperature_unit")).alias("temperature"), conditions.ionic_strength(F.col("ionic_strength_val"), F.col("ionic_strength_unit")).alias("ionic_strength"), conditions.ph(F.col("ph_val")).alias("ph"))
    seqs = shifts.latest_entities(table(spark, d, "entities")).select("entry_id", "entity_id", "seq", "details")
    f = PRESETS["moderate"]
    rows = cov.join(entry, "entry_id", "left").join(cond, "entry_id", "left").join(seqs, ["entry_id", "entity_id"])
    return rows.withColumns({"kw_hits": filters.hits([F.col("title"), F.col("citation_title"), F.col("details")], f.keywords_blacklist), "denat_hits": filters.hits([F.col("details")], f.chemical_denaturants)}), f


def prefilter_flags(spark, d):
    rows, f = _filter_bridge(spark, d)
    return filters.prefilter(rows, f).select(*shifts.PEPTIDE, "pass_pre")


def filter_losses(spark, d):
    rows, f = _filter_bridge(spark, d)
    return filters.losses(rows, f).select("criterion", "filtered", "only_filtered", F.round("percent", 6).alias("percent"))


def postfilter_flags(spark, d):
    rows, f = _filter_bridge(spark, d)
    rows = filters.prefilter(rows, f).withColumns({"types_post": F.col("types") - 1, "positions_post": F.col("positions"), "failed": F.coalesce(F.col("total") == 0, F.lit(True)), "lost_offsets": F.col("total") % 4})
    return filters.postfilter(rows, f).select(*shifts.PEPTIDE, "pass_post")


def _sequences(spark, d):
    """Whole sequences with conditions by rule; pH is 7 for one row in nine."""
    return fan_out(_peptides(spark, d)).select("ent_row", "seq", (F.lit(283.0) + F.col("ent_row") % 30).alias("temperature"), (F.lit(5.0) + (F.col("ent_row") % 9) * 0.5).alias("ph"), (F.lit(0.05) + (F.col("ent_row") % 4) * 0.05).alias("ionic"))


def pentamer_context(spark, d):
    return coil.residues(_sequences(spark, d), "ent_row").select("ent_row", "pos", F.concat("m2", "m1", "aa", "p1", "p2").alias("pentamer"))


def residue_classes(spark, d):
    return coil.residues(_sequences(spark, d), "ent_row").groupBy("aa", coil.residue_class(F.col("aa")).alias("class")).agg(F.count("*").alias("n"))


def _per_atom(spark, d, make):
    rows = coil.with_coefficients(coil.residues(_sequences(spark, d), "ent_row", "temperature"), RULES)
    return rows.select("ent_row", "pos", *[F.round(make(F.lit(i)), 7).alias(f"v_{a.lower()}") for i, a in enumerate(ct.ATOMS)])


def neighbour_correction(spark, d):
    return _per_atom(spark, d, coil.neighbour_correction)


def pair_combination(spark, d):
    return _per_atom(spark, d, coil.pair_correction)


def temperature_correction(spark, d):
    return _per_atom(spark, d, coil.temperature_correction)


def predicted_shifts_ph7(spark, d):
    rows = coil.residues(_sequences(spark, d), "ent_row", "temperature")
    return coil.shifts_at_ph7(rows, ("ent_row",), RULES).select("ent_row", "pos", "aa", "atom", rounded(F.col("shift"), 7).alias("shift"))


def hill_fraction(spark, d):
    sites = coil.fixed_sites(_sequences(spark, d), "ent_row", "ph")
    return sites.select("ent_row", "pos", "aa", F.round(hill(F.col("ph"), F.col("pka"), F.col("n_h")), 6).alias("protonated"))


def ph_shift_fixed_pka(spark, d):
    return coil.fixed_ph_terms(_sequences(spark, d), "ent_row").select("ent_row", "pos", "atom", F.round("term", 6).alias("term"))


def predicted_shifts_fixed_pka(spark, d):
    return coil.predict(_sequences(spark, d), "ent_row", RULES, fixed_pka=True).select("ent_row", "pos", "aa", "atom", rounded(F.col("shift"), 7).alias("shift"))


def pka_titration(spark, d):
    return pka.titrations(_sequences(spark, d))


def predicted_shifts(spark, d):
    return coil.predict(_sequences(spark, d), "ent_row", RULES)


def shifty_table(spark, d):
    from coilworks.sources import sinks

    return sinks.shifty_lines(predicted_shifts_ph7(spark, d))


def _star_texts(spark, d):
    """One file text for each chain of a shift table; every seventh table has unknown conditions, every eleventh an unknown experiment."""
    quoted = lambda c: F.concat(F.lit('"'), F.when(F.coalesce(F.col(c), F.lit("")) == "", ".").otherwise(F.regexp_replace(c, '["\\s]', "")), F.lit('"'))
    cells = ("entity_assem_id", "entity_id", "seq_id", "comp_id", "atom_id", "atom_type", "val", "val_err", "ambiguity")
    lines = table(spark, d, "atom_shifts").select(*shifts.PEPTIDE, F.concat_ws(" ", *[quoted(c) for c in cells]).alias("line"))
    chains = lines.groupBy(*shifts.PEPTIDE).agg(F.concat_ws("\n", F.collect_list("line")).alias("lines"))
    n = F.col("st_id").cast("int")
    blank = F.when(F.col("entity_assem_id").cast("int") % 3 == 0, ".").otherwise(F.col("entity_id"))
    second = F.when(F.col("entity_id") == "3", F.concat(F.lit("\n"), F.col("entity_assem_id"), F.lit(" . $y native"))).otherwise("")
    frame = lambda name, category, *parts: [F.lit(f"save_{name}\n_X.Sf_category {category}\n"), *parts, F.lit("\nsave_\n")]
    loop = lambda category, tags: F.lit("loop_\n" + "\n".join(f"_{category}.{x}" for x in tags) + "\n")
    stop = F.lit("\nstop_")
    text = F.concat(
        F.lit("data_x\n"),
        *frame("a", "assembly", F.lit("_Assembly.ID 1\n"), loop("Entity_assembly", ("ID", "Entity_ID", "Entity_label", "Physical_state")), F.concat_ws(" ", "entity_assem_id", blank, F.lit("$x native")), second, stop),
        *frame("e", "entity", F.lit("_Entity.Type polymer\n_Entity.Polymer_type polypeptide(L)\n_Entity.ID "), F.col("entity_id")),
        *frame("c", "sample_conditions", F.lit("_Sample_condition_list.ID 1")),
        *frame("x", "experiment_list", loop("Experiment", ("ID", "Name", "Sample_ID")), F.lit("1 HSQC ."), stop),
        *frame("s", "assigned_chemical_shifts", F.lit("_L.ID "), F.col("st_id"), F.lit("\n_L.Sample_condition_list_ID "), F.when(n % 7 == 0, "9").otherwise("1"), F.lit("\n"), loop("Chem_shift_experiment", ("Experiment_ID", "Sample_ID")), F.when(n % 11 == 0, "9").otherwise("1"), F.lit(" ."), stop,
               F.lit("\n"), loop("Atom_chem_shift", ("Entity_assembly_ID", "Entity_ID", "Seq_ID", "Comp_ID", "Atom_ID", "Atom_type", "Val", "Val_err", "Ambiguity_code")), F.col("lines"), stop),
    )
    return chains.select("entry_id", text.alias("text"))


def star_parse(spark, d):
    """Shift rows of each chain after a round trip through the file format."""
    got = star.parse(_star_texts(spark, d)).select("entry_id", F.explode("entry.shift_tables").alias("t")).select("entry_id", F.col("t.id").alias("st_id"), F.inline("t.shifts"))
    return got.groupBy(*shifts.PEPTIDE).agg(F.count("*").alias("n_rows"), F.count_if(F.col("val") == "").alias("no_value"), F.sum(F.length("seq_id") + F.length("atom_id") + F.length("val")).alias("letters"))


def peptide_key_resolution(spark, d):
    """Chains whose conditions, experiments, assembly component and polymer are found."""
    rows = peptides.peptides(star.parse(_star_texts(spark, d)), PRESETS["unfiltered"])
    return rows.select(*shifts.PEPTIDE, F.size("shifts").cast("bigint").alias("n_rows"))


def _sample_texts(spark, d):
    """One file text for each chain and conditions list of an entry, with quotes, blanks and blocks, samples and experiments.

    By the number of the shift table: every fifth names its sample itself, the
    others through their experiment; of every thirteenth that sample is unknown;
    every fourth sample holds urea, and in every eighth that is an entity.
    """
    chains = table(spark, d, "atom_shifts").groupBy(*shifts.PEPTIDE).agg(F.count("*").cast("int").alias("rows"))
    lists = table(spark, d, "sample_conditions").filter("cond_list_id is not null").groupBy("entry_id").agg(F.min("cond_list_id").alias("list"))
    variables = table(spark, d, "sample_conditions").join(lists, "entry_id").filter("cond_list_id = list and val is not null and not contains(val, '\n')")
    block = lambda c: F.concat(F.lit("\n;\n"), F.coalesce(c, F.lit(".")), F.lit("\n;\n"))
    lines = variables.select("entry_id", "cond_row", F.concat_ws(" ", block(F.col("var_type")), block(F.col("val")), block(F.col("val_units"))).alias("line"))
    conditions_of = lines.groupBy("entry_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("cond_row", "line"))), lambda x: x["line"])).alias("variables"))
    titles = table(spark, d, "star_entries").groupBy("entry_id").agg(F.max_by("title", F.struct("received_at", "entry_row")).alias("title"))
    rows = chains.join(lists, "entry_id").join(conditions_of, "entry_id").join(titles, "entry_id")
    n = F.col("st_id").cast("int")
    frame = lambda name, category, *parts: [F.lit(f"save_{name}\n_X.Sf_category {category}\n"), *parts, F.lit("\nsave_\n")]
    loop = lambda category, tags: F.lit("loop_\n" + "\n".join(f"_{category}.{x}" for x in tags) + "\n")
    stop = F.lit("\nstop_")
    sample = F.when(n % 13 == 0, "7").otherwise("1")
    text = F.concat(
        F.lit("data_x\n"),
        *frame("i", "entry_information", F.lit("_Entry.Title"), block(F.regexp_replace("title", "\n", " "))),
        *frame("a", "assembly", F.lit("_Assembly.ID 1\n"), loop("Entity_assembly", ("ID", "Entity_ID", "Entity_label", "Physical_state")), F.concat_ws(" ", "entity_assem_id", "entity_id", F.lit("$x 'native state'")), stop),
        *frame("e", "entity", F.lit("_Entity.Type polymer\n_Entity.Polymer_type polypeptide(L)\n_Entity.ID "), F.col("entity_id")),
        *frame("p", "sample", F.lit("_Sample.ID 1\n_Sample.Name 'it''s a sample'\n"), loop("Sample_component", ("ID", "Assembly_ID", "Entity_ID", "Mol_common_name", "Concentration_val", "Concentration_val_units")), F.lit("1 . "), F.when(n % 8 == 0, "1").otherwise("."), F.when(n % 4 == 0, " 'deuterated urea'").otherwise(' "glycerol"'), F.lit(" 8 M"), stop),
        *frame("c", "sample_conditions", F.lit("_Sample_condition_list.ID '"), F.col("list"), F.lit("'\n"), loop("Sample_condition_variable", ("Type", "Val", "Val_units")), F.col("variables"), stop),
        *frame("x", "experiment_list", loop("Experiment", ("ID", "Name", "Sample_ID")), F.lit('1 "1H-15N HSQC" '), sample, stop),
        *frame("s", "assigned_chemical_shifts", F.lit("_L.ID "), F.col("st_id"), F.lit("\n_L.Sample_condition_list_ID '"), F.col("list"), F.lit("'\n"), loop("Chem_shift_experiment", ("Experiment_ID", "Sample_ID")), F.lit("1 "), F.when(n % 5 == 0, "1").otherwise("."), stop,
               F.lit("\n"), loop("Atom_chem_shift", ("Entity_assembly_ID", "Entity_ID", "Seq_ID", "Comp_ID", "Atom_ID", "Atom_type", "Val", "Val_err", "Ambiguity_code")), F.concat_ws(" ", "entity_assem_id", "entity_id", F.lit("1 MET CA C 55.0 . 1")), stop),
    )
    return fan_out_rows(rows.select("entry_id", text.alias("text")))


def peptide_samples(spark, d):
    """Samples, chemicals, conditions and title words of each chain after a round trip through the file format."""
    f = PRESETS["strict"]
    rows = peptides.peptides(star.parse(_sample_texts(spark, d)), filters_of("tolerant", chemical_denaturants=("urea", "glycerol"), keywords_blacklist=("structure", "disorder"), default_conditions=f.default_conditions))
    hit = lambda m, t: F.element_at(m, t)
    return rows.select(*shifts.PEPTIDE, hit("denat_hits", "urea").alias("urea"), hit("denat_hits", "glycerol").alias("glycerol"), hit("kw_hits", "structure").alias("structure"), hit("kw_hits", "disorder").alias("disorder"), F.round("temperature", 6).alias("temperature"), F.round("ionic_strength", 6).alias("ionic_strength"), "ph")


QUERIES = {
    f.__name__: f
    for f in (
        condition_temperature, condition_ionic, condition_ph, sequence_fractions, method_filter, keyword_hits, denaturant_hits, latest_entity, shift_tests, shift_cells, shift_rejects, shift_averages, shift_coverage,
        prefilter_flags, filter_losses, postfilter_flags, pentamer_context, residue_classes, neighbour_correction, pair_combination, temperature_correction, predicted_shifts_ph7, hill_fraction, ph_shift_fixed_pka,
        predicted_shifts_fixed_pka, pka_titration, predicted_shifts, shifty_table, star_parse, peptide_key_resolution, peptide_samples,
    )
}


# --- the same in SQL -------------------------------------------------------
_NUM = r"'^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$'"


def _num(x: str) -> str:
    return f"CASE WHEN regexp_matches({x},{_NUM}) THEN CAST(trim({x}) AS DOUBLE) END"


_VARS = ("ionic_strength", "ph", "temperature")
COND = (
    "cv AS (SELECT *, CASE WHEN lower(var_type) LIKE '%ionic strength%' THEN 'ionic_strength' WHEN lower(var_type)='ph' THEN 'ph' WHEN lower(var_type)='pressure' THEN 'pressure' WHEN lower(var_type) LIKE '%temp%' THEN 'temperature' END AS v FROM sample_conditions),"
    "cl AS (SELECT entry_id, cond_list_id, "
    + ", ".join(f"arg_max(coalesce({c},''), cond_row) FILTER (WHERE v='{v}') AS {v}_{n}" for v in _VARS for c, n in (("val", "val"), ("val_units", "unit")))
    + " FROM cv GROUP BY entry_id, cond_list_id),"
    "cn AS (SELECT *, " + ", ".join(f"{_num(f'{v}_val')} AS {v}_n" for v in _VARS) + " FROM cl)"
)


def _sql_temperature(assume: bool, correct: bool, default: bool) -> str:
    v, u = "temperature_n", "coalesce(temperature_unit,'')"
    plain = f"CASE WHEN {v}>=15 AND {v}<50 THEN {v}+273.15e0 WHEN {v}>=50 AND {v}<=100 THEN ({v}-32)*1.8e0+273.15e0 ELSE {v} END" if correct else v
    return f"CASE WHEN {v} IS NULL THEN {'298e0' if default else 'NULL'} WHEN {u} LIKE '%C%' THEN {v}+273.15e0 WHEN {u} LIKE '%F%' THEN ({v}-32)*1.8e0+273.15e0 WHEN {u}='K' OR {str(assume).lower()} THEN {plain} END"


def _sql_ionic(assume: bool, correct: bool, default: bool) -> str:
    v, u = "ionic_strength_n", "coalesce(ionic_strength_unit,'')"
    plain = f"CASE WHEN {v}>5 THEN {v}*0.001e0 ELSE {v} END" if correct else v
    return f"CASE WHEN {v} IS NULL THEN {'0.1e0' if default else 'NULL'} WHEN {u}='mM' THEN {v}*0.001e0 WHEN {u}='mu' THEN {v}*0.000001e0 WHEN {u}='M' OR {str(assume).lower()} THEN {plain} END"


_LEVELS = (("tolerant", True, True, True), ("moderate", True, False, True), ("strict", False, False, False))
_SEQ = "upper(regexp_replace(seq,'[^A-Za-z]','','g'))"
_NONCANON = "1-length(regexp_replace({s},'[^ARNDCQEGHILKMFPSTYWVX]','','g'))/CAST(nullif(length({s}),0) AS DOUBLE)"
_XPART = "length(regexp_replace({s},'[^X]','','g'))/CAST(nullif(length({s}),0) AS DOUBLE)"


def _sql_method(f) -> str:
    term = lambda ts: "regexp_matches(lower(exp_method_subtype),'" + "|".join(t.lower() for t in ts) + "')"
    nmr = "lower(exp_method) LIKE '%nmr%'"
    out = f"({nmr} AND {term(f.exp_method_whitelist)}" + (f" AND NOT {term(f.exp_method_blacklist)}" if f.exp_method_blacklist else "") + ")"
    if "" in f.exp_method_whitelist and "" not in f.exp_method_blacklist:
        return f"({out} OR ({nmr} AND exp_method_subtype IS NULL))"
    return f"({out} AND exp_method_subtype IS NOT NULL)"


def _has(cols: list[str], term: str) -> str:
    return "(" + " OR ".join(f"coalesce(contains(lower({c}),'{term.lower()}'),false)" for c in cols) + ")"


ENT = f"le AS (SELECT entry_id, entity_id, entity_type, polymer_type, nullif(coalesce({_SEQ},''),'') AS seq, details FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, entity_id ORDER BY received_at DESC NULLS LAST, ent_row DESC) AS rn FROM entities) WHERE rn=1)"
_DOT = "(CASE WHEN {c} IS NULL OR {c}='.' THEN '' ELSE {c} END)"
_KEY = ", ".join(shifts.PEPTIDE)
_SINGLE = "CASE upper(trim(comp_id)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ct.THREE_TO_ONE.items()) + " END"
_BB = ", ".join(f"'{a}'" for a in ("C", "CA", "CB", "HA", "H", "N", "HB"))
ROWS = (
    ENT
    + ",r0 AS (SELECT s.entry_id, s.st_id, s.entity_assem_id, s.entity_id, e.seq, CASE WHEN regexp_matches(trim(seq_id),'^[-+]?\\d{1,9}$') THEN CAST(trim(seq_id) AS INT) END AS pos, "
    + f"{_SINGLE} AS aa, atom_id, {_num(_DOT.format(c='val'))} AS value, {_num(_DOT.format(c='val_err'))} AS error, {_DOT.format(c='ambiguity')} AS amb"
    + " FROM atom_shifts s JOIN le e ON s.entry_id=e.entry_id AND s.entity_id=e.entity_id WHERE e.entity_type='polymer' AND e.polymer_type='polypeptide(L)' AND e.seq IS NOT NULL),"
    + "r1 AS (SELECT *, length(seq) AS length, pos IS NULL OR pos<1 AS bad_pos, pos IS NOT NULL AND pos>=1 AND pos>length(seq) AS beyond,"
    + f" coalesce(aa IS NOT NULL AND coalesce(error<=1.3e0,true) AND amb IN ('1','2','') AND atom_id IN ({_BB},'HA2','HA3','HB1','HB2','HB3'),false) AS kept,"
    + f" CASE WHEN aa='A' AND atom_id IN ('HB1','HB2','HB3') THEN 'HB' WHEN aa<>'A' AND atom_id IN ('HB2','HB3') THEN 'HB' WHEN aa='G' AND atom_id IN ('HA2','HA3') THEN 'HA' WHEN atom_id IN ({_BB}) THEN atom_id END AS atom FROM r0),"
    + "r2 AS (SELECT *, coalesce(aa IS NOT NULL AND NOT bad_pos AND NOT beyond AND substr(seq,pos,1)<>aa,false) AS mismatch, aa IS NOT NULL AND value IS NULL AS bad_value, kept AND atom IS NULL AS bad_name FROM r1),"
    + f"d AS (SELECT {_KEY}, length, pos, atom, atom_id, value, error, count(*) AS m FROM r2 WHERE kept GROUP BY ALL),"
    + f"cell AS (SELECT {_KEY}, length, pos, atom, atom_id, min(value) AS value, CAST(sum(m) AS BIGINT) AS n, count(*)>1 AS conflict FROM d GROUP BY {_KEY}, length, pos, atom, atom_id),"
    + f"pr AS (SELECT {_KEY}, max(length) AS length, bool_or(bad_pos) AS bad_pos, bool_or(beyond) AS beyond, bool_or(mismatch) AS mismatch, bool_or(bad_value) AS bad_value, bool_or(bad_name) AS bad_name FROM r2 GROUP BY {_KEY}),"
    + f"pc AS (SELECT {_KEY}, bool_or(conflict) AS conflict FROM cell GROUP BY {_KEY}),"
    + f"rej AS (SELECT pr.*, coalesce(conflict,false) AS conflict, bad_pos OR beyond OR mismatch OR bad_value OR bad_name OR coalesce(conflict,false) AS rejected FROM pr LEFT JOIN pc USING ({_KEY})),"
    + f"av AS (SELECT {_KEY}, length, pos, atom, avg(value) AS value FROM cell JOIN (SELECT {_KEY} FROM rej WHERE NOT rejected) g USING ({_KEY}) GROUP BY {_KEY}, length, pos, atom),"
    + f"ca AS (SELECT {_KEY}, count(*) FILTER (WHERE pos>1 AND pos<length) AS t, count(DISTINCT atom) AS ty, count(DISTINCT pos) AS po FROM av GROUP BY {_KEY}),"
    + f"cov AS (SELECT {_KEY}, length, "
    + ", ".join(f"CASE WHEN NOT rejected THEN CASE WHEN length<2 THEN 0 ELSE coalesce({a},0) END END AS {b}" for a, b in (("t", "total"), ("ty", "types"), ("po", "positions")))
    + f" FROM rej LEFT JOIN ca USING ({_KEY}))"
)
_F = PRESETS["moderate"]


def _rng(c: str, b) -> str:
    return f"({c}>={b[0]!r} AND {c}<={b[1]!r})" if b[1] != float("inf") else f"({c}>={b[0]!r})"


_CRIT = {
    "method": _sql_method(_F), "temperature": _rng("temperature", _F.temperature_range), "ionic_strength": _rng("ionic_strength", _F.ionic_strength_range), "ph": _rng("ph", _F.ph_range),
    "peptide_length": _rng("length(seq)", _F.peptide_length_range), "shift_types": f"types>={_F.min_backbone_shift_types}", "shift_positions": f"positions>={_F.min_backbone_shift_positions}",
    "shift_fraction": f"positions/CAST(nullif(length(seq),0) AS DOUBLE)>={_F.min_backbone_shift_fraction}", "noncanonical": f"{_NONCANON.format(s='seq')}<={_F.max_noncanonical_fraction}", "x_residues": f"{_XPART.format(s='seq')}<={_F.max_x_fraction}",
} | {f"keyword {k}": f"NOT {_has(['title', 'citation_title', 'details'], k)}" for k in _F.keywords_blacklist} | {f"chemical {k}": f"NOT {_has(['details'], k)}" for k in _F.chemical_denaturants}
FILTERED = (
    f"WITH {ROWS},{COND},"
    "en AS (SELECT entry_id, nullif(exp_method,'') AS exp_method, nullif(exp_method_subtype,'') AS exp_method_subtype, title, citation_title FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY received_at DESC NULLS LAST, entry_row DESC) AS rn FROM star_entries) WHERE rn=1),"
    f"co AS (SELECT entry_id, {_sql_temperature(True, True, True)} AS temperature, {_sql_ionic(True, True, True)} AS ionic_strength, coalesce(ph_n,7e0) AS ph FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY cond_list_id NULLS LAST) AS rn FROM cn) WHERE rn=1),"
    f"pep AS (SELECT cov.*, exp_method, exp_method_subtype, title, citation_title, temperature, ionic_strength, ph, le.seq, le.details FROM cov LEFT JOIN en USING (entry_id) LEFT JOIN co USING (entry_id) JOIN le ON cov.entry_id=le.entry_id AND cov.entity_id=le.entity_id),"
    "fl AS (SELECT *, " + ", ".join(f"{c} AS c{i}" for i, c in enumerate(_CRIT.values())) + " FROM pep),"
    "pf AS (SELECT *, coalesce(exp_method IS NOT NULL AND temperature IS NOT NULL AND ionic_strength IS NOT NULL AND ph IS NOT NULL AND seq IS NOT NULL AND total IS NOT NULL AND " + " AND ".join(f"c{i}" for i in range(len(_CRIT))) + ",false) AS pass_pre FROM fl)"
)
_FAILING = "+".join(f"CASE WHEN c{i} IS FALSE THEN 1 ELSE 0 END" for i in range(len(_CRIT)))
_UNKNOWN = " OR ".join(f"c{i} IS NULL" for i in range(len(_CRIT)))

# random coil
_SQ = f"sq AS (SELECT ent_row, {_SEQ} AS seq, 283e0+ent_row%30 AS temperature, 5e0+(ent_row%9)*0.5e0 AS ph FROM entities WHERE polymer_type='polypeptide(L)')"
_RES = _SQ + ",rs AS (SELECT ent_row, temperature, ph, i AS pos, substr('n'||seq||'c', CAST(i AS INT)-1, 5) AS pent FROM (SELECT *, unnest(range(2, length(seq))) AS i FROM sq WHERE length(seq)>=4)), rx AS (SELECT *, substr(pent,3,1) AS aa, substr(pent,1,1) AS m2, substr(pent,2,1) AS m1, substr(pent,4,1) AS p1, substr(pent,5,1) AS p2 FROM rs)"


def _case(x: str, values: dict, other: str = "0e0") -> str:
    text = lambda v: f"{v!r}e0" if isinstance(v, float) and "e" not in repr(v) else (f"'{v}'" if isinstance(v, str) else repr(v))
    return f"(CASE {x} " + " ".join(f"WHEN '{k}' THEN {text(v)}" for k, v in values.items() if v is not None) + f" ELSE {other} END)"


_PLACES = ((2, "p2"), (1, "p1"), (-1, "m1"), (-2, "m2"))


def _sql_neighbour(atom: str) -> str:
    ends, parts = ct.terminus(), []
    for o, c in _PLACES:
        values = {aa: RULES.neighbour[atom, aa, o] for aa in ct.AMINO_ACIDS} | ({"c": ends[atom, "c"]} if o == 2 else {}) | ({"n": ends[atom, "n"]} if o == -2 else {})
        parts.append(_case(c, values))
    return "(" + "+".join(parts) + ")"


def _sql_class(x: str) -> str:
    return _case(x, ct.CLASSES, "'p'")


def _sql_pair(atom: str) -> str:
    parts = []
    for o, c in _PLACES:
        values = {k[2] + k[3]: v for k, v in RULES.combination.items() if k[0] == atom and k[1] == o}
        if values:
            parts.append(f"CASE WHEN k{c}='pp' AND aa NOT IN ('S','T') THEN 0e0 ELSE {_case(f'k{c}', values)} END")
    return "(" + "+".join(parts or ["0e0"]) + ")"


def _sql_warm(atom: str) -> str:
    return "0e0" if atom == "HB" else f"({_case('aa', {aa: r[atom] / 1000 for aa, r in ct.temperature().items()})}*(temperature-298))"


_KIND = _RES + ",ky AS (SELECT *, " + ", ".join(f"{_sql_class('aa')}||{_sql_class(c)} AS k{c}" for _, c in _PLACES) + " FROM rx)"
_CENTRE = {a: _case("aa", {aa: r[a] for aa, r in ct.centre().items()}, "NULL") for a in ct.ATOMS}
_PRED = _KIND + ",pd AS (" + " UNION ALL ".join(f"SELECT ent_row, pos, aa, '{a}' AS atom, {_CENTRE[a]}+{_sql_neighbour(a)}+{_sql_pair(a)}+{_sql_warm(a)} AS shift FROM ky" for a in ct.ATOMS) + "),ps AS (SELECT * FROM pd WHERE shift IS NOT NULL)"
_SITES = "si AS (SELECT ent_row, ph, i AS pos, substr(seq, CAST(i AS INT), 1) AS aa FROM (SELECT *, unnest(range(1, length(seq)+1)) AS i FROM sq)), st AS (SELECT *, " + _case("aa", {k: v for k, v in ct.PK0.items() if k not in "nc"}, "NULL") + " AS pka FROM si WHERE aa IN ('D','E','H','C','K','R','Y'))"


def _sql_hill(ph: str) -> str:
    return f"(1-1/(pow(10e0,0.9e0*(pka-{ph}))+1))"


_SPREAD = " UNION ALL ".join(
    f"SELECT ent_row, pos+({d}) AS pos, '{a}' AS atom, {_case('aa', {aa: v[i] for (aa, at), v in ct.ph_shifts().items() if at == a and v[i] is not None}, 'NULL')}*({_sql_hill('ph')}-{_sql_hill('7')}) AS term FROM st"
    for a in ct.ATOMS for d, i in ((0, 0), (-1, 1), (1, 2)) if any(at == a and v[i] is not None for (aa, at), v in ct.ph_shifts().items())
)
_TERMS = f"{_SITES},sp AS ({_SPREAD}), tm AS (SELECT ent_row, pos, atom, sum(term) AS term FROM sp WHERE term IS NOT NULL GROUP BY ent_row, pos, atom)"


def _six(make) -> str:
    return ", ".join(f"round({make(a)},7) AS v_{a.lower()}" for a in ct.ATOMS)


_DEN = PRESETS["strict"].chemical_denaturants
_CLEAN = "(CASE WHEN {c} IS NULL OR {c}='' OR regexp_replace({c},'[\"\\s]','','g')='.' THEN '' ELSE regexp_replace({c},'[\"\\s]','','g') END)"
SQL = {
    "star_parse": f"SELECT {_KEY}, count(*) AS n_rows, count(*) FILTER (WHERE {_CLEAN.format(c='val')}='') AS no_value, CAST(sum(length({_CLEAN.format(c='seq_id')})+length({_CLEAN.format(c='atom_id')})+length({_CLEAN.format(c='val')})) AS BIGINT) AS letters FROM atom_shifts GROUP BY {_KEY}",
    "peptide_key_resolution": f"SELECT {_KEY}, count(*) AS n_rows FROM atom_shifts WHERE CAST(st_id AS INT)%7<>0 AND CAST(st_id AS INT)%11<>0 AND NOT (entity_id='3' AND CAST(entity_assem_id AS INT)%3=0) GROUP BY {_KEY}",
    "condition_temperature": f"WITH {COND} SELECT entry_id, cond_list_id, " + ", ".join(f"round({_sql_temperature(*x)},6) AS {n}_k" for n, *x in _LEVELS) + " FROM cn",
    "condition_ionic": f"WITH {COND} SELECT entry_id, cond_list_id, " + ", ".join(f"round({_sql_ionic(*x)},6) AS {n}_m" for n, *x in _LEVELS) + " FROM cn",
    "condition_ph": f"WITH {COND} SELECT entry_id, cond_list_id, coalesce(ph_n,7e0) AS with_default, ph_n AS as_given FROM cn",
    "sequence_fractions": f"WITH q AS (SELECT ent_row, {_SEQ} AS s FROM entities WHERE polymer_type='polypeptide(L)') SELECT ent_row, length(s) AS n, round({_NONCANON.format(s='s')},6) AS noncanonical, round({_XPART.format(s='s')},6) AS x_part, coalesce(length(s) BETWEEN 15 AND 200,false) AS length_ok FROM q",
    "method_filter": "SELECT entry_row, " + ", ".join(f"coalesce({_sql_method(f)},false) AS {n}" for n, f in PRESETS.items()) + " FROM star_entries",
    "keyword_hits": "SELECT entry_row, " + ", ".join(f"{_has(['title', 'citation_title'], t)} AS hit_{i}" for i, t in enumerate(("disorder", "solution", "α-helix"))) + " FROM star_entries",
    "denaturant_hits": "WITH q AS (SELECT preset_row, unnest(CASE WHEN len(chemical_denaturants)>0 THEN chemical_denaturants ELSE [NULL] END) AS name FROM filter_defaults) SELECT preset_row, CAST(sum(" + "+".join(f"CAST({_has(['name'], t)} AS INT)" for t in _DEN) + ") AS BIGINT) AS hits FROM q GROUP BY preset_row",
    "latest_entity": f"WITH {ENT} SELECT entry_id, entity_id, entity_type, polymer_type, seq FROM le",
    "shift_tests": f"WITH {ROWS} SELECT {_KEY}, count(*) AS n_rows, " + ", ".join(f"count(*) FILTER (WHERE {n}) AS {n}" for n in ("bad_pos", "beyond", "mismatch", "bad_value", "kept", "bad_name")) + f" FROM r2 GROUP BY {_KEY}",
    "shift_cells": f"WITH {ROWS} SELECT {_KEY}, pos, atom_id, n, conflict FROM cell WHERE pos IS NOT NULL",
    "shift_rejects": f"WITH {ROWS} SELECT {_KEY}, bad_pos, beyond, mismatch, bad_value, bad_name, conflict, rejected FROM rej",
    "shift_averages": f"WITH {ROWS} SELECT {_KEY}, pos, atom, round(value,6) AS value FROM av",
    "shift_coverage": f"WITH {ROWS} SELECT {_KEY}, CAST(length AS BIGINT) AS length, CAST(total AS BIGINT) AS total, CAST(types AS BIGINT) AS types, CAST(positions AS BIGINT) AS positions FROM cov WHERE total IS NOT NULL",
    "prefilter_flags": f"{FILTERED} SELECT {_KEY}, pass_pre FROM pf",
    "postfilter_flags": f"{FILTERED} SELECT {_KEY}, pass_pre AND coalesce(types-1>={_F.min_backbone_shift_types} AND positions>={_F.min_backbone_shift_positions} AND positions/CAST(nullif(length(seq),0) AS DOUBLE)>={_F.min_backbone_shift_fraction} AND NOT coalesce(total=0,true) AND total%4=0,false) AS pass_post FROM pf",
    "filter_losses": f"{FILTERED} " + " UNION ALL ".join(f"SELECT '{n}' AS criterion, count(*) FILTER (WHERE c{i} IS FALSE) AS filtered, count(*) FILTER (WHERE c{i} IS FALSE AND ({_FAILING})=1 AND NOT ({_UNKNOWN})) AS only_filtered, round(coalesce(100e0*count(*) FILTER (WHERE c{i} IS FALSE)/nullif(count(*),0),0e0),6) AS percent FROM pf" for i, n in enumerate(_CRIT)),
    "pentamer_context": f"WITH {_RES} SELECT ent_row, pos, pent AS pentamer FROM rx",
    "residue_classes": f"WITH {_RES} SELECT aa, {_sql_class('aa')} AS class, count(*) AS n FROM rx GROUP BY aa, {_sql_class('aa')}",
    "neighbour_correction": f"WITH {_RES} SELECT ent_row, pos, {_six(_sql_neighbour)} FROM rx",
    "pair_combination": f"WITH {_KIND} SELECT ent_row, pos, {_six(_sql_pair)} FROM ky",
    "temperature_correction": f"WITH {_RES} SELECT ent_row, pos, {_six(_sql_warm)} FROM rx",
    "predicted_shifts_ph7": f"WITH {_PRED} SELECT ent_row, pos, aa, atom, round(shift,7) AS shift FROM ps",
    "hill_fraction": f"WITH {_SQ},{_SITES} SELECT ent_row, pos, aa, round({_sql_hill('ph')},6) AS protonated FROM st",
    "ph_shift_fixed_pka": f"WITH {_SQ},{_TERMS} SELECT ent_row, pos, atom, round(term,6) AS term FROM tm",
    "predicted_shifts_fixed_pka": f"WITH {_PRED},{_TERMS} SELECT ps.ent_row, ps.pos, aa, ps.atom, round(shift-CASE WHEN ph<>7 AND abs(term)<9.9e0 THEN term ELSE 0e0 END,7) AS shift FROM ps JOIN (SELECT ent_row, ph FROM sq) q ON ps.ent_row=q.ent_row LEFT JOIN tm ON ps.ent_row=tm.ent_row AND ps.pos=tm.pos AND ps.atom=tm.atom",
    "peptide_samples": f"WITH li AS (SELECT entry_id, min(cond_list_id) AS list FROM sample_conditions WHERE cond_list_id IS NOT NULL GROUP BY entry_id),"
    "va AS (SELECT c.*, lower(trim(var_type)) AS lt FROM sample_conditions c JOIN li USING (entry_id) WHERE cond_list_id=list AND val IS NOT NULL AND NOT contains(val, chr(10))),"
    "cv AS (SELECT *, CASE WHEN lower(var_type) LIKE '%ionic strength%' THEN 'ionic_strength' WHEN lower(var_type)='ph' THEN 'ph' WHEN lower(var_type)='pressure' THEN 'pressure' WHEN lower(var_type) LIKE '%temp%' THEN 'temperature' END AS v FROM va),"
    "cl AS (SELECT entry_id, " + ", ".join(f"arg_max(CASE WHEN {c}='.' THEN '' ELSE coalesce({c},'') END, cond_row) FILTER (WHERE v='{v}') AS {v}_{n}" for v in _VARS for c, n in (("val", "val"), ("val_units", "unit"))) + " FROM cv GROUP BY entry_id),"
    "cn AS (SELECT *, " + ", ".join(f"{_num(f'{v}_val')} AS {v}_n" for v in _VARS) + " FROM cl),"
    "ti AS (SELECT entry_id, arg_max(title, (received_at, entry_row)) AS title FROM star_entries GROUP BY entry_id),"
    f"ch AS (SELECT DISTINCT {_KEY} FROM atom_shifts)"
    f" SELECT {_KEY}, CAST(st_id AS INT)%4=0 AND CAST(st_id AS INT)%8<>0 AS urea, CAST(st_id AS INT)%4<>0 AS glycerol, {_has(['title'], 'structure')} AS structure, {_has(['title'], 'disorder')} AS disorder,"
    f" round({_sql_temperature(True, True, False)},6) AS temperature, round({_sql_ionic(True, True, False)},6) AS ionic_strength, ph_n AS ph FROM ch JOIN cn USING (entry_id) JOIN ti USING (entry_id) WHERE CAST(st_id AS INT)%13<>0 OR CAST(st_id AS INT)%5=0",
}
