"""Deposition files in the STAR text format: tokenizer, frames, nested entry rows.

Files are read whole, one row a file, and parsed in Arrow batches: the grammar
(quoted values, ``;`` blocks, loops, saveframes) is the one thing here that
column expressions cannot hold. A file is the unit of work; many files make many
tasks. A file that cannot be read or is rejected becomes a row with ``error``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_PATTERN = r"bmr(\d+)_3\.str"
MAX_DOUBLES = 100_000  #: paths of ids given twice that may be broadcast

ENTRY = """struct<exp_method:string,exp_method_subtype:string,title:string,submission_date:string,citation_title:string,citation_doi:string,
assemblies:array<struct<id:string,name:string,details:string,entities:array<struct<id:string,entity_id:string,label:string,state:string>>>>,
entities:array<struct<id:string,name:string,details:string,type:string,polymer_type:string,seq:string,links:array<struct<database_code:string,accession_code:string,entry_mol_code:string,percent:string,identity:string>>>>,
samples:array<struct<id:string,name:string,framecode:string,details:string,components:array<struct<id:string,entity_id:string,name:string,val:string,unit:string>>>>,
conditions:array<struct<id:string,variables:array<struct<type:string,val:string,unit:string>>>>,
experiments:array<struct<id:string,name:string,sample_id:string>>,
shift_tables:array<struct<id:string,condition_id:string,experiments:array<struct<id:string,sample_id:string>>,
shifts:array<struct<entity_assem_id:string,entity_id:string,seq_id:string,comp_id:string,atom_id:string,atom_type:string,val:string,val_err:string,ambiguity:string>>>>>""".replace("\n", "")

_TOKEN = re.compile(r"(?:^;(?P<block>.*?)^;(?=\s|\Z))|#[^\n]*|'(?P<single>(?:[^'\n]|'(?=\S))*)'(?=\s|\Z)|\"(?P<double>(?:[^\"\n]|\"(?=\S))*)\"(?=\s|\Z)|(?P<word>\S+)", re.M | re.S)


def tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(token, is a value by its quotes); comments are skipped."""
    for m in _TOKEN.finditer(text.replace("\r\n", "\n")):
        kind = m.lastgroup
        if kind == "word":
            yield m["word"], False
        elif kind:
            value = m[kind]
            yield (value[1:] if kind == "block" and value.startswith("\n") else value).rstrip("\n") if kind == "block" else value, True


def frames(text: str) -> list[dict]:
    """Saveframes in order: name, tags (without the category), loops as (category, tags, rows)."""
    out: list[dict] = []
    frame: dict | None = None
    stream = tokens(text)
    pending: tuple[str, bool] | None = None
    while True:
        token, quoted = pending or next(stream, (None, False))
        pending = None
        if token is None:
            if frame is not None:
                raise ValueError("a saveframe is not closed")
            return out
        low = token.lower()
        if not quoted and low == "save_":
            frame = None
        elif not quoted and low.startswith("save_"):
            if frame is not None:
                raise ValueError("a saveframe within a saveframe")
            frame = {"name": token[5:], "tags": {}, "loops": []}
            out.append(frame)
        elif not quoted and low == "loop_":
            names, values = [], []
            for token, quoted in stream:
                if not quoted and token.lower() == "stop_":
                    break
                if not quoted and token.startswith("_") and not values:
                    names.append(token)
                elif not quoted and token.lower() in ("loop_", "save_"):
                    pending = (token, quoted)
                    break
                else:
                    values.append(token)
            if not names or len(values) % len(names):
                raise ValueError("a loop's values do not fill its rows")
            if frame is not None:
                category = names[0].split(".")[0]
                rows = [values[i : i + len(names)] for i in range(0, len(values), len(names))]
                frame["loops"].append((category, [n.split(".", 1)[-1] for n in names], rows))
        elif not quoted and token.startswith("_"):
            value, _ = next(stream, (None, False))
            if value is None:
                raise ValueError(f"{token} has no value")
            if frame is not None:
                frame["tags"][token.split(".", 1)[-1]] = value


def _tag(frame: dict | None, name: str, default: str | None = "") -> str | None:
    """A tag's value; ``.`` is empty, a missing tag the default."""
    value = (frame or {"tags": {}})["tags"].get(name, default)
    return "" if value == "." else value


def _loop(frame: dict, category: str, *names: str) -> list[tuple[str, ...]]:
    """Rows of a loop by tag names; one missing tag empties the loop."""
    for found, tags, rows in frame["loops"]:
        if found == category:
            if any(n not in tags for n in names):
                return []
            at = [tags.index(n) for n in names]
            return [tuple("" if r[i] == "." else r[i] for i in at) for r in rows]
    return []


def _unique(kind: str, ids: list[str | None]) -> None:
    if len(set(ids)) != len(ids):
        raise ValueError(f"repeated {kind} id")


def entry(text: str) -> dict:
    """The nested entry of a file's text; ValueError if it must be rejected.

    Rejected: no assembly, no entity, not exactly one experiment list, no shift
    table, repeated ids. Missing samples or conditions are empty lists.
    """
    by: dict[str, list[dict]] = {}
    for f in frames(text):
        by.setdefault(_tag(f, "Sf_category") or "", []).append(f)
    info, cite = by.get("entry_information", [None])[0], by.get("citations", [None])[0]
    for name in ("assembly", "entity", "assigned_chemical_shifts"):
        if not by.get(name):
            raise ValueError(f"no {name}")
    if len(by.get("experiment_list", [])) != 1:
        raise ValueError("not exactly one experiment list")
    struct = lambda names, rows: [dict(zip(names, r)) for r in rows]
    assemblies = [{"id": _tag(f, "ID"), "name": _tag(f, "Name"), "details": _tag(f, "Details"), "entities": struct(("id", "entity_id", "label", "state"), _loop(f, "_Entity_assembly", "ID", "Entity_ID", "Entity_label", "Physical_state"))} for f in by["assembly"]]
    entities = []
    for f in by["entity"]:
        seq = (_tag(f, "Polymer_seq_one_letter_code") or "").replace("\n", "").upper() or None
        links = struct(("database_code", "accession_code", "entry_mol_code", "percent", "identity"), _loop(f, "_Entity_db_link", "Database_code", "Accession_code", "Entry_mol_code", "Seq_query_to_submitted_percent", "Seq_identity"))
        entities.append({"id": _tag(f, "ID"), "name": _tag(f, "Name"), "details": _tag(f, "Details"), "type": _tag(f, "Type"), "polymer_type": _tag(f, "Polymer_type"), "seq": seq, "links": links})
    samples = [{"id": _tag(f, "ID"), "name": _tag(f, "Name"), "framecode": _tag(f, "Sf_framecode"), "details": _tag(f, "Details"), "components": struct(("id", "entity_id", "name", "val", "unit"), _loop(f, "_Sample_component", "ID", "Entity_ID", "Mol_common_name", "Concentration_val", "Concentration_val_units"))} for f in by.get("sample", [])]
    conditions = [{"id": _tag(f, "ID"), "variables": struct(("type", "val", "unit"), _loop(f, "_Sample_condition_variable", "Type", "Val", "Val_units"))} for f in by.get("sample_conditions", [])]
    experiments = struct(("id", "name", "sample_id"), _loop(by["experiment_list"][0], "_Experiment", "ID", "Name", "Sample_ID"))
    cells = ("Entity_assembly_ID", "Entity_ID", "Seq_ID", "Comp_ID", "Atom_ID", "Atom_type", "Val", "Val_err", "Ambiguity_code")
    names = ("entity_assem_id", "entity_id", "seq_id", "comp_id", "atom_id", "atom_type", "val", "val_err", "ambiguity")
    tables = [{"id": _tag(f, "ID"), "condition_id": _tag(f, "Sample_condition_list_ID"), "experiments": struct(("id", "sample_id"), _loop(f, "_Chem_shift_experiment", "Experiment_ID", "Sample_ID")), "shifts": struct(names, _loop(f, "_Atom_chem_shift", *cells))} for f in by["assigned_chemical_shifts"]]
    for kind, rows in (("assembly", assemblies), ("entity", entities), ("sample", samples), ("condition", conditions), ("shift table", tables)):
        _unique(kind, [r["id"] for r in rows])
    return {
        "exp_method": _tag(info, "Experimental_method"), "exp_method_subtype": _tag(info, "Experimental_method_subtype"), "title": _tag(info, "Title"), "submission_date": _tag(info, "Submission_date"),
        "citation_title": _tag(cite, "Title"), "citation_doi": _tag(cite, "DOI"), "assemblies": assemblies, "entities": entities, "samples": samples, "conditions": conditions, "experiments": experiments, "shift_tables": tables,
    }


def parse(texts: DataFrame) -> DataFrame:
    """entry_id, error, entry of each row of entry_id, text; null text is an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors, entries = [], []
            for t in pdf.text:
                try:
                    if t is None:
                        raise ValueError("no text")
                    entries.append(entry(t))
                    errors.append(None)
                except Exception as e:  # whatever is wrong with one file must not end the build
                    entries.append(None)
                    errors.append(str(e) if isinstance(e, ValueError) else f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"entry_id": pdf.entry_id, "error": pd.Series(errors, dtype=object), "entry": pd.Series(entries, dtype=object)})

    return texts.select(F.col("entry_id").cast("string").alias("entry_id"), "text").mapInPandas(run, f"entry_id string, error string, entry {ENTRY}")


def _named_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """entry_id, path, length, modificationTime, content of the files whose whole name matches.

    One level down only if none is in the folder itself; the id is the pattern's first group.
    """

    def listed(where: str) -> DataFrame:
        files = spark.read.format("binaryFile").load(where)
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        return files.filter(name.rlike(f"^(?:{pattern})$")).withColumn("entry_id", F.regexp_extract(name, f"^(?:{pattern})$", 1))

    from pyspark.errors import AnalysisException

    try:
        here = listed(folder)
        found = None if here.select("path").isEmpty() else here
    except AnalysisException:
        found = None
    if found is None:
        found = listed(f"{folder.rstrip('/')}/*/")
    return found


def find_files(spark: SparkSession, folder: str, pattern: str = FILE_PATTERN) -> DataFrame:
    """entry_id, path of the matching files; of files with one id the last path counts."""
    return _named_files(spark, folder, pattern).groupBy("entry_id").agg(F.max("path").alias("path"))


def read_entries(spark: SparkSession, folder: str, pattern: str = FILE_PATTERN) -> DataFrame:
    """Parsed entries of a folder: entry_id, error, entry."""
    named = _named_files(spark, folder, pattern)
    # the content is read once, where it is parsed; only the paths of ids given twice meet it
    texts = named.select("entry_id", "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    paths = named.select("entry_id", "path")
    last = paths.groupBy("entry_id").agg(F.max("path").alias("last"), F.count("*").alias("n")).filter("n > 1").select("entry_id", "last")
    doubles = paths.join(last, "entry_id").filter("path <> last").select("path")
    few = doubles.count()
    if few:
        texts = texts.join(F.broadcast(doubles) if few <= MAX_DOUBLES else doubles, "path", "left_anti")
    return parse(texts.select("entry_id", "text"))


def fingerprint(spark: SparkSession, folder: str, pattern: str = FILE_PATTERN) -> tuple:
    """What the files of a folder are: changes when a path, size or time does. One pass over the listing."""
    one = _named_files(spark, folder, pattern).select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"), "length")
    return (pattern, *one.agg(F.count("*"), F.sum("length"), F.sum("h"), F.bit_xor(F.col("h").cast("bigint"))).first())
