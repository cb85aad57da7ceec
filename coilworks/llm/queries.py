"""Registered queries of the training-data operators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coilworks.llm import canonical, grouping, leaks, lookalikes, mixing, overlap, residues, terms
from coilworks.session import checkpoint, table


def _typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "filter_defaults"), table(spark, sf_dir, "entities"), table(spark, sf_dir, "ref_terms")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.canonical_terms(*_typed(spark, sf_dir)).select("field_name", "row_id", "item_no", "term_id")


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.unmatched(*_typed(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.row_pairs(table(spark, sf_dir, "entities"))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.representative_pairs(table(spark, sf_dir, "entities"))


def p3_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.members(table(spark, sf_dir, "entities"))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_counts(table(spark, sf_dir, "entities"))


def _related(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "entities"), table(spark, sf_dir, "entity_db_links"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.assign_splits(table(spark, sf_dir, "entities"), table(spark, sf_dir, "entity_db_links"), table(spark, sf_dir, "split_targets"))


def p4_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.split_report(_assigned(spark, sf_dir), table(spark, sf_dir, "split_targets"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(p6_found(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source: whether its share is met (within 0.01 and a document's size) and its cap kept."""
    near = F.abs(F.col("share") - F.col("target_share")) < 0.01
    return p7_report(spark, sf_dir).select("source", near.alias("share_met"), (F.col("most_copies") <= F.col("max_repeats")).alias("cap_kept"))


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of a related group with the number of splits its group fell into (1), and whether every share is met."""
    assigned = checkpoint(_assigned(spark, sf_dir))
    splits = assigned.groupBy("group_row").agg(F.count_distinct("new_split").alias("splits"))
    report = grouping.split_report(assigned, table(spark, sf_dir, "split_targets")).agg(F.max(F.abs(F.col("share") - F.col("target_share"))).alias("off"))
    within = report.first()["off"] < 0.02
    return assigned.filter("group_size > 1").join(splits, "group_row").select("ent_row", "group_row", "splits", F.lit(within).alias("shares_met"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.alike_pairs(table(spark, sf_dir, "documents"))


def p8_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.normalize(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "canon")


QUERIES = {
    "p2_found": p2_found,
    "p2_unmatched": p2_unmatched,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p3_pairs": p3_pairs,
    "p3_members": p3_members,
    "p4_found": _related(grouping.related_rows),
    "p4_forest": _related(grouping.forest_edges),
    "p4_splits": _assigned,
    "p4_split_report": p4_split_report,
    "p4_checks": p4_checks,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p7_mix": p7_mix,
    "p7_report": p7_report,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
    "p8_texts": p8_texts,
}
# residues, split and accession as the operators read them
_ROWS = "r AS (SELECT ent_row, entry_id, entity_id, feed, lower(trim(data_split)) AS split, upper(regexp_replace(coalesce(seq,''),'[^A-Za-z]','','g')) AS res FROM entities WHERE polymer_type='polypeptide(L)')"
_PAIRS = _ROWS + (
    ",h AS (SELECT * FROM r WHERE split IN ('val','test') AND res<>''), t AS (SELECT * FROM r WHERE split='train' AND res<>''),"
    "p AS (SELECT h.ent_row AS e, t.ent_row AS t, levenshtein(h.res,t.res) AS d FROM h JOIN t ON 100*abs(length(h.res)-length(t.res))<=15*greatest(length(h.res),length(t.res)) WHERE 100*levenshtein(h.res,t.res)<=15*greatest(length(h.res),length(t.res)))"
)
_STRINGS = _ROWS + ",g AS (SELECT *, min(ent_row) OVER (PARTITION BY res) AS sid FROM r WHERE split IN ('train','val','test') AND res<>''), h AS (SELECT DISTINCT sid, res FROM g WHERE split<>'train'), t AS (SELECT DISTINCT sid, res FROM g WHERE split='train')"
_CODE = "regexp_replace(regexp_replace(upper(regexp_replace(accession_code,'[\\s\u00a0]','','g')),'^(" + residues.DATABASES + ")[:|]',''),'\\.\\d+$','')"
_PLACEHOLDERS = ",".join(f"'{p}'" for p in residues.PLACEHOLDERS)


def _sql_look(text: str) -> str:
    """The look of a text: every character of the basic plane that the table changes, then composed."""
    changed = {c: lookalikes.of_char(c) for c in map(chr, range(0x80, 0x10000)) if not 0xAC00 <= ord(c) <= 0xDFFF and unicodedata.category(c) != "Co"}
    changed = {c: unicodedata.normalize("NFC", s) for c, s in changed.items()}
    one = {c: s for c, s in changed.items() if len(s) == 1 and s != c}
    to = "".join(one.values()).replace("'", "''")
    out = f"translate({text}, '{''.join(one)}', '{to}')"
    out = f"regexp_replace({out}, '[{''.join(c for c, s in changed.items() if not s)}\\x{{E0100}}-\\x{{E01EF}}\\x{{E0001}}-\\x{{E007F}}]', '', 'g')"
    for c, s in changed.items():
        if len(s) > 1 and s.isascii():
            out = f"replace({out}, '{c}', '{s}')"
    return f"nfc_normalize({out})"


_LOOK = _sql_look("text")
# words as letters and digits between white space, then every run of 15
_RUNS = r"{n} AS (SELECT DISTINCT {k}, array_to_string(w[i:i+14], ' ') AS run FROM (SELECT {k}, w, unnest(range(1, len(w)-13)) AS i FROM (SELECT {k}, string_split(trim(regexp_replace(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g')), ' ') AS w FROM {f}) WHERE len(w)>=15))"
# the whole tables: brute force over all pairs of splits, and reachability within groups
SQL: dict[str, str] = {
    "p3_found": f"WITH {_PAIRS} SELECT least(e,t) AS ent_row_a, greatest(e,t) AS ent_row_b FROM p",
    "p3_counts": f"WITH {_PAIRS}, c AS (SELECT e, count(*) AS n, min(d) AS least FROM p GROUP BY e) SELECT split, feed, count(*) AS eval_rows, count(n) AS overlapping_rows, count(*) FILTER (WHERE least=0) AS exact_rows, CAST(coalesce(sum(n),0) AS BIGINT) AS pairs FROM (SELECT ent_row, split, feed FROM r WHERE split IN ('val','test') AND res<>'') x LEFT JOIN c ON ent_row=e GROUP BY split, feed",
    "p3_pairs": f"WITH {_STRINGS} SELECT h.sid AS sid_e, t.sid AS sid_t, CAST(levenshtein(h.res,t.res) AS INTEGER) AS distance FROM h JOIN t ON 100*abs(length(h.res)-length(t.res))<=15*greatest(length(h.res),length(t.res)) WHERE 100*levenshtein(h.res,t.res)<=15*greatest(length(h.res),length(t.res))",
    "p3_members": f"WITH {_STRINGS} SELECT ent_row, sid, split FROM g",
    "p6_found": "WITH " + _RUNS.format(n="d", k="doc_id", t=_LOOK, f="documents") + "," + _RUNS.format(n="e", k="item_id", t=_sql_look("item_text"), f="eval_items") + " SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (run)",
    "p7_checks": "SELECT regexp_replace(lower(trim(source)),'[-\\s]+','_','g') AS source, true AS share_met, true AS cap_kept FROM mix_targets",
    "p8_found": f"WITH s AS (SELECT doc_id, text, {_LOOK} AS look FROM documents WHERE text IS NOT NULL) SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.look=b.look AND a.text<>b.text AND a.doc_id<b.doc_id",
    "p4_found": f"WITH RECURSIVE {_ROWS}, c AS (SELECT DISTINCT entry_id, entity_id, {_CODE} AS code FROM entity_db_links WHERE accession_code IS NOT NULL),"
    f" k AS (SELECT ent_row, 'a '||code AS key FROM r JOIN c USING (entry_id, entity_id) WHERE lower(code) NOT IN ({_PLACEHOLDERS}) UNION SELECT ent_row, 's '||res FROM r WHERE res<>''),"
    " hub AS (SELECT key, min(ent_row) AS b FROM k GROUP BY key), e AS (SELECT DISTINCT ent_row AS a, b FROM k JOIN hub USING (key) WHERE ent_row<>b), bi AS (SELECT a, b FROM e UNION SELECT b, a FROM e),"
    " reach AS (SELECT a, b FROM bi UNION SELECT reach.a, bi.b FROM reach JOIN bi ON reach.b=bi.a) SELECT a AS ent_row, least(a,min(b)) AS group_row FROM reach GROUP BY a",
}
SQL["p4_checks"] = SQL["p4_found"].replace("SELECT a AS ent_row, least(a,min(b)) AS group_row FROM reach GROUP BY a", "SELECT a AS ent_row, least(a,min(b)) AS group_row, CAST(1 AS BIGINT) AS splits, true AS shares_met FROM reach GROUP BY a")
