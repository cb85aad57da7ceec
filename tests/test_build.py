import json

import pytest

from coilworks import cli
from coilworks.functions import coil_tables as ct
from coilworks.functions.chi import ATOMS
from coilworks.operators import conditions, filters
from coilworks.params import PRESETS
from coilworks.params import filters as preset
from coilworks.plans import dataset
from coilworks.sources import sinks, star
from pyspark.sql import functions as F

SEQ = "MADEKHCTSLGIVNQPFRYWAAKLMNST"
THREE = {v: k for k, v in ct.THREE_TO_ONE.items()}


def star_text(entry="1", seq=SEQ, condition="1", experiments="1", lists=1, component="1", shifts=None, entity_ref="1", chemical="sodium chloride", subtype="solution"):
    centre = ct.centre()
    rows = shifts
    if rows is None:
        rows = [(i + 1, THREE[a], at, centre[a][at] + 0.01 * ((i * 7) % 5)) for i, a in enumerate(seq) for at in ("C", "CA", "N", "H", "HA") if centre[a][at] is not None]
        rows = [(p, r, "HA2" if r == "GLY" and at == "HA" else at, v) for p, r, at, v in rows]
    body = "\n".join(f"1 1 {p} {r} {at} {at[0]} {v} 0.1 1" for p, r, at, v in rows)
    lists = "".join(f"save_exp{i}\n_Experiment_list.Sf_category experiment_list\n_Experiment_list.ID {i + 1}\nloop_\n_Experiment.ID\n_Experiment.Name\n_Experiment.Sample_ID\n1 HSQC 1\nstop_\nsave_\n" for i in range(lists))
    return f"""data_{entry}
# a comment
save_entry
_Entry.Sf_category entry_information
_Entry.Title
;
A title over
two lines
;
_Entry.Experimental_method NMR
_Entry.Experimental_method_subtype {subtype}
save_
save_assembly
_Assembly.Sf_category assembly
_Assembly.ID 1
_Assembly.Name 'the system''s name'
_Assembly.Details .
loop_
_Entity_assembly.ID
_Entity_assembly.Entity_ID
_Entity_assembly.Entity_label
_Entity_assembly.Physical_state
{component} {entity_ref} $x native
stop_
save_
save_entity
_Entity.Sf_category entity
_Entity.ID 1
_Entity.Name "a name"
_Entity.Type polymer
_Entity.Polymer_type polypeptide(L)
_Entity.Polymer_seq_one_letter_code
;
{seq}
;
save_
save_sample
_Sample.Sf_category sample
_Sample.ID 1
_Sample.Name s
loop_
_Sample_component.ID
_Sample_component.Entity_ID
_Sample_component.Mol_common_name
_Sample_component.Concentration_val
_Sample_component.Concentration_val_units
1 . '{chemical}' 1 mM
stop_
save_
save_cond
_Sample_condition_list.Sf_category sample_conditions
_Sample_condition_list.ID 1
loop_
_Sample_condition_variable.Type
_Sample_condition_variable.Val
_Sample_condition_variable.Val_units
temperature 298 K
pH 6.5 pH
'ionic strength' 100 mM
stop_
save_
{lists}save_shifts
_Assigned_chem_shift_list.Sf_category assigned_chemical_shifts
_Assigned_chem_shift_list.ID 1
_Assigned_chem_shift_list.Sample_condition_list_ID {condition}
loop_
_Chem_shift_experiment.Experiment_ID
_Chem_shift_experiment.Sample_ID
{experiments} 1
stop_
loop_
_Atom_chem_shift.Entity_assembly_ID
_Atom_chem_shift.Entity_ID
_Atom_chem_shift.Seq_ID
_Atom_chem_shift.Comp_ID
_Atom_chem_shift.Atom_ID
_Atom_chem_shift.Atom_type
_Atom_chem_shift.Val
_Atom_chem_shift.Val_err
_Atom_chem_shift.Ambiguity_code
{body}
stop_
save_
"""


def test_parser_values():
    e = star.entry(star_text())
    assert e["title"] == "A title over\ntwo lines" and e["assemblies"][0]["name"] == "the system''s name" and e["assemblies"][0]["details"] == ""
    assert e["entities"][0]["seq"] == SEQ and e["conditions"][0]["variables"][2] == {"type": "ionic strength", "val": "100", "unit": "mM"}
    for bad in (star_text(lists=2), star_text(lists=0), star_text().replace("assigned_chemical_shifts", "other"), star_text().replace("_Entity.Sf_category entity", "_Entity.Sf_category other"), "save_x\n_A.b", "loop_\n_a.b\n_a.c\n1\nstop_"):
        with pytest.raises(ValueError):
            star.entry(bad)


def test_missing_loop_tag_empties_the_loop():
    assert star.entry(star_text().replace("_Entity_assembly.Physical_state\n", "_Entity_assembly.Other\n"))["assemblies"][0]["entities"] == []


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("stars")
    texts = {
        "1": star_text("1"), "2": star_text("2", condition="9"), "3": star_text("3", experiments="9"), "4": star_text("4", lists=2), "5": star_text("5", component="7"), "6": star_text("6", entity_ref="."),
        "7": star_text("7", chemical="8 M Urea"), "8": star_text("8", subtype="solid-state"), "9": star_text("9", shifts=[(0, "MET", "CA", 55.0)]), "10": star_text("10", shifts=[(1, "MET", "CA", 55.0), (1, "MET", "CA", 56.0)]),
    }
    for k, t in texts.items():
        sub = d / f"bmr{k}"
        sub.mkdir()
        (sub / f"bmr{k}_3.str").write_text(t)
        (sub / "notes.txt").write_text("x")
    return str(d)


def test_build_end_to_end(spark, folder, tmp_path):
    assert star.find_files(spark, folder).count() == 10
    entries = star.read_entries(spark, folder).cache()
    got = dataset.build(entries, preset("tolerant"), ct.rule_tables())
    assert [r.entry_id for r in got.failed.collect()] == ["4"]
    flags = {r.entry_id: (r.pass_pre, r.pass_post) for r in got.peptides.collect()}
    # 2, 3 and 5 have no usable shift table; 9 and 10 have rejected shifts
    assert flags == {"1": (True, True), "6": (True, True), "7": (False, False), "8": (False, False), "9": (False, False), "10": (False, False)}
    whole = dataset.build(entries, preset("unfiltered"), ct.rule_tables())
    nested = whole.nested
    one = nested.filter("entry_id = '1'").collect()[0]
    assert len(one.k) == len(SEQ) and one.temperature == 298.0 and one.ionic_strength == pytest.approx(0.1) and one.ph == 6.5
    rows = dataset.long_rows(nested.filter("entry_id = '1'"))
    assert rows.count() == len(SEQ) and "".join(r.seq for r in rows.orderBy("seq_index").collect()) == SEQ
    for averaging in (True, False):
        row = dataset.with_shifts(nested.filter("entry_id = '1'"), whole.tests, averaging).collect()[0]
        assert len(row.shift_CA) == len(SEQ) and row.shift_CA[0] == pytest.approx(ct.centre()["M"]["CA"]) and row.shift_CB == [None] * len(SEQ)
        g = SEQ.index("G")
        assert (row.shift_HA[g] is not None) == averaging and (averaging or row.shift_HA2[g] is not None)
    reasons = {r.entry_id: r.reason for r in got.peptides.collect()}
    assert reasons["1"] is None and reasons["7"] == "pre-filter" and reasons["9"] == "shifts rejected"
    run = lambda kind, out, **more: dataset.run(spark, folder, str(tmp_path / out), preset("tolerant"), kind, tables=ct.rule_tables(), cache=str(tmp_path / "cache"), **more)
    report = {(r.stage, r.criterion): r for r in run("json", "out").collect()}
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(r["entryID"] for r in lines) == ["1", "6"]
    assert list(lines[0])[:19] == ["ID", "entryID", "stID", "entity_assemID", "entityID", "entity_name", "exp_method", "exp_method_subtype", "citation_DOI", "citation_title", "ionic_strength", "pH", "temperature", "off_C", "off_CA", "off_CB", "off_H", "off_HA", "off_HB"]
    assert report["pre", "chemical urea"].filtered == 1 and report["total", "remaining_for_scores"].filtered == 2 and report["total", "final_dataset"].filtered == 2 and report["total", "filtered_post"].percent == 0.0
    assert {c for s, c in report if s == "offset"} == set(ATOMS) and {c for s, c in report if s == "post"} == {"shift_types", "shift_positions", "shift_fraction", "computation"}
    stages = sorted(p.name for p in (tmp_path / "cache").iterdir())
    run("csv", "rows", include_shifts=True)
    assert sorted(p.name for p in (tmp_path / "cache").iterdir()) == stages and len(stages) == 5  # reused
    table = spark.read.csv(str(tmp_path / "rows"), header=True)
    assert table.columns == ["ID", "entryID", "stID", "entity_assemID", "entityID", "entity_name", "seq_index", "seq", "k", "zscores", "pscores", *ATOMS] and table.count() == 2 * len(SEQ)
    uneven = nested.withColumn("k", F.array(F.lit(1)))
    with pytest.raises(Exception, match="unequal"):
        dataset.long_rows(uneven).collect()
    with pytest.raises(ValueError):
        dataset.run(spark, folder, str(tmp_path / "o"), preset(), "xml")
    with pytest.raises(ValueError):
        dataset.check_scores(("corrected",))
    assert dataset.build(entries.limit(0), preset(), ct.rule_tables()).nested.count() == 0


def test_broken_files_and_ids_given_twice(spark, tmp_path):
    (tmp_path / "bmr1_3.str").write_text(star_text("1"))
    (tmp_path / "bmr2_3.str").write_text("save_a\n_X.Sf_category assembly\n_X.ID")
    (tmp_path / "xbmr1_3.str").write_text("nothing")
    (tmp_path / "bmr3_3.str").write_bytes(b"\xff\xfe\x00")
    got = {r.entry_id: r.error for r in star.read_entries(spark, str(tmp_path)).collect()}
    assert got["1"] is None and got["2"] and got["3"] and len(got) == 3
    twice = {r.entry_id: r.error for r in star.read_entries(spark, str(tmp_path), r"x?bmr(\d+)_3\.str").collect()}
    assert len(twice) == 3 and twice["1"] == "no assembly"  # the last path counts
    before = star.fingerprint(spark, str(tmp_path))
    (tmp_path / "bmr2_3.str").write_text("changed")
    assert star.fingerprint(spark, str(tmp_path)) != before


def test_predictor(spark):
    from coilworks import predict

    lines = predict.table(spark, "madeghk", 6.0, 298, 0.1, ct.rule_tables()).collect()
    assert [r.pos for r in lines] == [2, 3, 4, 5, 6] and lines[0].line.startswith("2    A")
    with pytest.raises(ValueError):
        predict.table(spark, "mad", 6.0, 298, 0.1, ct.rule_tables())


def test_options():
    args, f = cli.options(["--input-dir", "a", "--output", "b", "--filter-defaults", "strict", "--max-offset", "5", "--peptide-length-range", "7", "--keywords-blacklist", "x", "y"])
    assert f.max_offset == 5 and f.peptide_length_range == (7, float("inf")) and f.keywords_blacklist == ("x", "y") and f.ph_range == PRESETS["strict"].ph_range
    with pytest.raises(ValueError):
        preset("none")
    with pytest.raises(ValueError):
        preset("strict", colour=1)


def test_conditions(spark):
    df = spark.createDataFrame([("25", "C"), ("25", ""), ("77", "F"), ("60", ""), ("298", "K"), ("abc", "K"), (None, None), ("1e2", "K")], "v string, u string")
    t = [r[0] for r in df.select(conditions.temperature(F.col("v"), F.col("u"))).collect()]
    assert t == pytest.approx([298.15, 298.15, 354.15, 323.55, 298.0, 298.0, 298.0, 395.55])
    fixed = [r[0] for r in df.select(conditions.temperature(F.col("v"), F.col("u"), fix_fahrenheit=True)).collect()]
    assert fixed[2] == pytest.approx(298.15)
    strict = [r[0] for r in df.select(conditions.temperature(F.col("v"), F.col("u"), False, False, False)).collect()]
    assert strict[1] is None and strict[5] is None
    ion = spark.createDataFrame([("50", "mM"), ("50", "M"), ("50", "mu"), ("50", "")], "v string, u string")
    assert [r[0] for r in ion.select(conditions.ionic_strength(F.col("v"), F.col("u"))).collect()] == pytest.approx([0.05, 0.05, 5e-5, 0.05])


def test_method_rules(spark):
    df = spark.createDataFrame([("NMR", "solution"), ("nmr", None), ("NMR", "solid-state"), ("X-ray", "solution"), (None, None)], "m string, s string")
    get = lambda w, b: [r[0] for r in df.select(F.coalesce(filters.method(F.col("m"), F.col("s"), w, b), F.lit(False))).collect()]
    assert get(("", "solution"), ("solid",)) == [True, True, False, False, False]
    assert get(("solution",), ("solid",)) == [True, False, False, False, False]
    assert get((), ()) == [False] * 5


def test_coefficient_tables(tmp_path):
    assert sum(v is not None for r in ct.centre().values() for v in r.values()) == 137 and len(ct.terminus()) == 14 and sum(map(len, ct.temperature().values())) == 120
    with pytest.raises((ValueError, OSError)):
        ct.load_tables(str(tmp_path))
    few = "atom,aa,p2,p1,m1,m2\nC,A,0.1,0.2,0.3,0.4\n"
    (tmp_path / "neighbour.csv").write_text(few)
    pairs = [f"{a},{o},{x},{y},0.5" for a in ct.ATOMS for o in (-2, -1, 1, 2) for x in "GPra+-p" for y in "GPra+-p"][: ct.PAIR_ROWS]
    (tmp_path / "combination.csv").write_text("\n".join(["atom,neipos,centre,neighbour,value", *pairs]))
    with pytest.raises(ValueError, match="neighbour.csv"):
        ct.load_tables(str(tmp_path))
    (tmp_path / "neighbour.csv").write_text("\n".join(["atom,aa,p2,p1,m1,m2", *[f"{a},{aa},0.1,0.2,0.3,0.4" for a in ct.ATOMS for aa in ct.AMINO_ACIDS]]))
    t = ct.load_tables(str(tmp_path))
    assert t.neighbour["C", "A", -1] == 0.3 and t.combination["C", -2, "G", "r"] == 0.5 and len(t.neighbour) == 560
    (tmp_path / "combination.csv").write_text("\n".join(["atom,neipos,centre,neighbour,value", *pairs[1:]]))
    with pytest.raises(ValueError, match="247"):
        ct.load_tables(str(tmp_path))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", [1, 2], [0.5, None], [0.1, 0.2])], "id string, k array<bigint>, zscores array<double>, pscores array<double>")
    sinks.write_dataset(df, str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    sinks.write_dataset(df, str(tmp_path / "j"), "json")
    with pytest.raises(ValueError):
        sinks.write_dataset(df, str(tmp_path / "x"), "npz")
    uneven = df.withColumn("k", F.array(F.lit(1).cast("bigint")))
    with pytest.raises(Exception, match="unequal"):
        sinks.long_scores(uneven).collect()
    pred = spark.createDataFrame([(1, 2, "A", "CA", 52.5)], "ent_row bigint, pos int, aa string, atom string, shift double")
    assert "52.500" in sinks.shifty_lines(pred).collect()[0].line
