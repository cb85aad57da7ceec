"""Readers of entity tables shared by the split operators (problems 3 and 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLYPEPTIDE = "polypeptide(L)"

#: Texts that stand in for an accession code that is not there.
PLACEHOLDERS = ["", ".", "-", "?", "na", "n/a", "none", "null", "nil", "pending", "tobeassigned", "unknown", "tba", "tbd", "notavailable", "notassigned", "unassigned"]

#: Database names that may stand before an accession code.
DATABASES = "UNIPROTKB|UNIPROT|UNP|SWISSPROT|SP|TREMBL|TR|GENBANK|GB|WWPDB|PDB|RCSB|EMBL|ENA|DDBJ|REFSEQ|REF|PIR"


def residues(seq: Column) -> Column:
    """The letters of a sequence in upper case; null stays null."""
    return F.upper(F.regexp_replace(seq, "[^A-Za-z]", ""))


def split_name(split: Column) -> Column:
    return F.lower(F.trim(split))


def accession(code: Column) -> Column:
    """Accession code without case, spaces, leading database name and version; null for placeholders."""
    solid = F.upper(F.regexp_replace(code, r"[\s\u00a0]", ""))
    bare = F.regexp_replace(F.regexp_replace(solid, rf"^(?:{DATABASES})[:|]", ""), r"\.\d+$", "")
    return F.when(~F.lower(bare).isin(PLACEHOLDERS), bare)


def polypeptides(entities: DataFrame, *extra: str) -> DataFrame:
    """Rows of polypeptides: ent_row, res (letters, maybe empty) and the columns named."""
    return entities.filter(F.col("polymer_type") == POLYPEPTIDE).select("ent_row", F.coalesce(residues(F.col("seq")), F.lit("")).alias("res"), *extra)
