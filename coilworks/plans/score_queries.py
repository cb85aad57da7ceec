"""Score queries on a deterministic bridge from ``embeddings`` to peptides.

A peptide is a label, a residue one of its vectors in order of ``vec_id``, an atom
one of the first seven dimensions; scaled to unit deviation, with offsets put
into atoms 2 and 5, holes, and cells that were observed but not predicted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coilworks.functions.chi import ATOMS, rounded
from coilworks.operators import scoring
from coilworks.session import table

N = scoring.N_ATOMS
SHIFTED = {1: 2.5, 4: 3.5}


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    pos = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))

    def cell(j: int):
        seen = ((F.col("vec_id") * 7 + j + 1) % 11 != 0) & (F.col("vec_id") % 9 != 0)
        if j == 2:
            seen &= F.col("vec_id") % 10 != 0
        return F.when(seen, F.element_at("embedding", j + 1).cast("double") * 8 + SHIFTED.get(j, 0.0)).alias(f"x{j}")

    leak = ((F.col("vec_id") % 10 == 0) & ((F.col("vec_id") * 7 + 3) % 11 != 0) & (F.col("vec_id") % 9 != 0)).cast("int")
    return e.select(F.col("label").alias("pep"), pos.alias("pos"), leak.alias("leak"), *[cell(j) for j in range(N)])


_SEEN = ["(vec_id*7+{n})%11<>0 AND vec_id%9<>0" + (" AND vec_id%10<>0" if j == 2 else "") for j in range(N)]
BRIDGE = (
    "res AS (SELECT label AS pep, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INT) AS pos,"
    " CASE WHEN vec_id%10=0 AND (vec_id*7+3)%11<>0 AND vec_id%9<>0 THEN 1 ELSE 0 END AS leak, "
    + ", ".join(f"CASE WHEN {_SEEN[j].format(n=j + 1)} THEN CAST(embedding[{j + 1}] AS DOUBLE)*8+{SHIFTED.get(j, 0.0)} END AS x{j}" for j in range(N))
    + " FROM embeddings)"
)


def sql_z(tot: str, k: str) -> str:
    q = f"({tot}/{k})"
    return f"CASE WHEN {k}>0 THEN (pow({q},1e0/6)-pow({q},1e0/3)/2+sqrt({q})/3-(5e0/6-1e0/(9*{k})-7e0/(648*{k}*{k})+25e0/(2187*{k}*{k}*{k})))/sqrt(1e0/(18*{k})+1e0/(162*{k}*{k})-37e0/(11664*{k}*{k}*{k})) END"


def sql_p(tot: str, k: str) -> str:
    return f"CASE WHEN {k}>0 THEN (exp(-{tot}/(8e0*{k}))-exp(-2e0))/(1-exp(-2e0)) END"


def sql_scores(name: str, source: str, tag: str = "", offsets: list[str] | None = None) -> str:
    """CTEs that add tot, k, tot3, k3, z1, z3, p3 with a tag to ``source``."""
    off = offsets or ["0e0"] * N
    tot = "+".join(f"coalesce(pow(least(abs(x{j}-{off[j]}),4e0),2),0e0)" for j in range(N))
    k = "+".join(f"CASE WHEN x{j} IS NULL THEN 0 ELSE 1 END" for j in range(N))
    return (
        f"{name}_1 AS (SELECT *, {tot} AS tot{tag}, {k} AS k{tag} FROM {source}),"
        f"{name}_2 AS (SELECT *, sum(tot{tag}) OVER t AS tot3{tag}, sum(k{tag}) OVER t AS k3{tag}, min(CASE WHEN k{tag}>0 THEN pos END) OVER p AS lo{tag}, max(CASE WHEN k{tag}>0 THEN pos END) OVER p AS hi{tag}"
        f" FROM {name}_1 WINDOW p AS (PARTITION BY pep), t AS (PARTITION BY pep ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),"
        f"{name} AS (SELECT *, CASE WHEN pos BETWEEN lo{tag} AND hi{tag} THEN {sql_z(f'(tot{tag}+16e0*leak)', f'k{tag}')} END AS z1{tag},"
        f" CASE WHEN pos BETWEEN lo{tag} AND hi{tag} THEN {sql_z(f'tot3{tag}', f'k3{tag}')} END AS z3{tag},"
        f" CASE WHEN pos BETWEEN lo{tag} AND hi{tag} THEN {sql_p(f'tot3{tag}', f'k3{tag}')} END AS p3{tag} FROM {name}_2)"
    )


def sql_outlier(j: int, tag: str, off: str) -> str:
    return f"(x{j} IS NOT NULL AND (coalesce(z1{tag}>6,false) OR (coalesce(z3{tag}>6,false) AND coalesce(z1{tag}>0,false) AND k{tag}>0) OR coalesce(abs(x{j}-{off})>6,false)))"


def sql_global(c: str) -> str:
    n, m, r, s = f"count({c}) OVER p", f"avg({c}) OVER p", f"sqrt(avg({c}*{c}) OVER p)", f"stddev_pop({c}) OVER p"
    return f"CASE WHEN {n}<4 THEN 0e0 WHEN {s}=0 THEN {m} WHEN ln(({r})/nullif({s},0))*({n})-1<6 THEN 0e0 ELSE {m} END"


def sql_rolling(name: str, source: str) -> str:
    cols, wins = [], []
    for j in range(N):
        wins.append(f"w{j} AS (PARTITION BY pep, (x{j} IS NULL) ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)")
        full = f"x{j} IS NOT NULL AND count(x{j}) OVER w{j}=9"
        cols += [f"CASE WHEN {full} THEN stddev_pop(x{j}) OVER w{j} END AS s{j}", f"CASE WHEN {full} THEN avg(x{j}) OVER w{j} END AS m{j}", f"CASE WHEN {full} THEN sqrt(avg(x{j}*x{j}) OVER w{j}) END AS r{j}"]
    return f"{name} AS (SELECT *, {', '.join(cols)} FROM {source} WINDOW {', '.join(wins)})"


def sql_best(name: str, source: str) -> str:
    seen = ", ".join(f"bool_or(x{j} IS NOT NULL) OVER p AS any{j}" for j in range(N))
    complete = " AND ".join(f"(NOT any{j} OR s{j} IS NOT NULL)" for j in range(N))
    n = "+".join(f"CAST(any{j} AS INT)" for j in range(N))
    return (
        sql_rolling(f"{name}_r", source)
        + f",{name}_s AS (SELECT *, {seen} FROM {name}_r WINDOW p AS (PARTITION BY pep)),"
        + f"{name}_m AS (SELECT *, CASE WHEN {complete} AND ({n})>0 THEN ({'+'.join(f'coalesce(s{j},0e0)' for j in range(N))})/({n}) END AS mean_sd FROM {name}_s),"
        + f"{name}_b AS (SELECT pep, pos AS best_pos FROM (SELECT pep, pos, row_number() OVER (PARTITION BY pep ORDER BY mean_sd, pos) AS rn FROM {name}_m WHERE mean_sd IS NOT NULL) WHERE rn=1),"
        + f"{name} AS (SELECT m.*, b.best_pos FROM {name}_m m LEFT JOIN {name}_b b USING (pep))"
    )


def sql_running(name: str, source: str) -> str:
    o = ", ".join(f"max(CASE WHEN pos=best_pos AND (CASE WHEN s{j}=0 THEN r{j}>0 ELSE ln(r{j}/nullif(s{j},0))*9-1>6 END) THEN m{j} END) OVER p AS o{j}" for j in range(N))
    return sql_best(f"{name}_w", source) + f",{name} AS (SELECT *, {o} FROM {name}_w WINDOW p AS (PARTITION BY pep))"


def sql_corrected(max_offset: float = 3.0, reject: bool = True) -> str:
    run = [f"coalesce(o{j},0e0)" for j in range(N)]
    final = [f"CASE WHEN used_running THEN gm{j} ELSE gn{j} END" for j in range(N)]
    parts = [
        sql_scores("a", "res", "a"),
        "an AS (SELECT *, " + ", ".join(f"{sql_global(f'(CASE WHEN NOT {sql_outlier(j, "a", "0e0")} THEN x{j} END)')} AS gn{j}" for j in range(N)) + " FROM a WINDOW p AS (PARTITION BY pep))",
        sql_running("ru", "an"),
        sql_scores("b", "ru", "b", run),
        "bm AS (SELECT *, " + ", ".join(f"{sql_global(f'(CASE WHEN NOT {sql_outlier(j, "b", run[j])} THEN x{j} END)')} AS gm{j}" for j in range(N)) + ", avg(z3a) OVER p AS ava, avg(z3b) OVER p AS avb FROM b WINDOW p AS (PARTITION BY pep))",
        "bu AS (SELECT *, (" + " OR ".join(f"{r}<>0" for r in run) + ") AND coalesce(ava>=avb,false) AS used_running FROM bm)",
        "bf AS (SELECT pep, pos, leak, used_running, " + ", ".join(f"x{j}, CASE WHEN abs({final[j]})<={max_offset} THEN {final[j]} END AS off{j}" for j in range(N)) + " FROM bu)",
        "bx AS (SELECT pep, pos, leak, used_running, " + ", ".join(f"off{j}, " + (f"CASE WHEN off{j} IS NOT NULL THEN x{j} END AS x{j}" if reject else f"x{j}") for j in range(N)) + " FROM bf)",
        sql_scores("fin", "bx", "", [f"coalesce(off{j},0e0)" for j in range(N)]),
    ]
    return ",".join(parts)


def _r(c: str) -> str:
    return f"round({c},6) AS {c}"


def _round(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def residue_scores(spark, d):
    return scoring.with_scores(bridge(spark, d)).select("pep", "pos", F.col("k3").cast("bigint").alias("k3"), F.round("z3", 6).alias("zscore"), F.round("p3", 6).alias("pscore"))


def single_residue_scores(spark, d):
    return scoring.with_scores(bridge(spark, d)).select("pep", "pos", F.col("k").cast("bigint").alias("k"), *_round("tot", "z1"))


def rolling_offset_window(spark, d):
    return scoring.rolling(bridge(spark, d)).select("pep", "pos", *_round(*[f"{a}{j}" for a in "smr" for j in range(N)]))


def best_window(spark, d):
    return scoring.best_window(bridge(spark, d)).filter("pos = best_pos").select("pep", "best_pos", *_round("mean_sd"))


def running_offsets(spark, d):
    return scoring.running_offsets(bridge(spark, d)).filter("pos = 1").select("pep", *_round(*[f"o{j}" for j in range(N)]))


def global_offsets(spark, d):
    df = scoring.with_scores(bridge(spark, d), "a")
    df = df.withColumns({f"_a{j}": o for j, o in enumerate(scoring.outliers("a"))})
    return df.withColumns({f"g{j}": g for j, g in enumerate(scoring.global_offsets([F.when(~F.col(f"_a{j}"), F.col(f"x{j}")) for j in range(N)]))}).filter("pos = 1").select("pep", *_round(*[f"g{j}" for j in range(N)]))


def outlier_mask(spark, d):
    df = scoring.with_scores(bridge(spark, d), "a")
    return df.select("pep", "pos", *[o.alias(f"ol{j}") for j, o in enumerate(scoring.outliers("a"))])


def offset_corrected_scores(spark, d):
    return scoring.corrected(bridge(spark, d)).select("pep", "pos", "used_running", F.col("k3").cast("bigint").alias("k3"), *_round("z3", "p3", *[f"off{j}" for j in range(N)]))


def offset_corrected_kept(spark, d):
    return scoring.corrected(bridge(spark, d), max_offset=2.0, reject_shift_type_only=False).select("pep", "pos", F.col("k3").cast("bigint").alias("k3"), *_round("z3", "p3"))


def uncorrected_scores(spark, d):
    return scoring.corrected(bridge(spark, d), correct=False).select("pep", "pos", *_round("z3", "p3"))


def max_offset_reject(spark, d):
    return scoring.offset_losses(bridge(spark, d)).select(F.col("atom").cast("bigint").alias("atom"), "rejected", "only_rejected")


def pivot_matrix(spark, d):
    """Long cells back to one row a residue, one column an atom."""
    return _long(spark, d).groupBy("pep", "pos").pivot("atom", list(ATOMS)).agg(F.first("x")).select("pep", "pos", *[F.round(a, 6).alias(f"v_{a.lower()}") for a in ATOMS])


def _long(spark, d):
    return bridge(spark, d).select("pep", "pos", F.inline(F.array(*[F.struct(F.lit(a).alias("atom"), F.col(f"x{j}").alias("x")) for j, a in enumerate(ATOMS)]))).filter("x is not null")


def long_cells(spark, d):
    return _long(spark, d).select("pep", "pos", "atom", *_round("x"))


def residue_grid(spark, d):
    """Every position of each peptide with the number of its observed cells, 0 included."""
    seen = _long(spark, d).groupBy("pep", "pos").agg(F.count("*").alias("k"))
    grid = bridge(spark, d).groupBy("pep").agg(F.max("pos").alias("n")).select("pep", F.explode(F.sequence(F.lit(1), "n")).alias("pos"))
    return grid.join(seen, ["pep", "pos"], "left").select("pep", "pos", F.coalesce("k", F.lit(0)).alias("k"))


def dataset_nested(spark, d):
    from coilworks.sources import sinks

    return sinks.nested_scores(scoring.corrected(bridge(spark, d)))


def dataset_long(spark, d):
    from coilworks.sources import sinks

    return sinks.long_scores(sinks.nested_scores(scoring.corrected(bridge(spark, d)))).select("id", "seq_index", "k", rounded(F.col("zscores"), 4).alias("zscores"), rounded(F.col("pscores"), 4).alias("pscores"))


def result_compare(spark, d):
    from coilworks.operators import compare

    a = scoring.corrected(bridge(spark, d)).select("pep", "pos", F.col("z3").alias("score")).filter("pos % 7 <> 0")
    b = scoring.with_scores(bridge(spark, d)).select("pep", "pos", F.col("z3").alias("score")).filter("pos % 5 <> 0")
    return compare.compare(a, b, ["pep", "pos"], "score")


def set_ops(spark, d):
    from coilworks.operators import compare

    a, b = bridge(spark, d).filter("x0 is not null").select("pep", "pos"), bridge(spark, d).filter("x3 is not null").select("pep", "pos")
    return compare.set_report(a, b)


QUERIES = {
    f.__name__: f
    for f in (
        residue_scores, single_residue_scores, rolling_offset_window, best_window, running_offsets, global_offsets, outlier_mask, offset_corrected_scores, offset_corrected_kept,
        uncorrected_scores, max_offset_reject, pivot_matrix, long_cells, residue_grid, dataset_nested, dataset_long, result_compare, set_ops,
    )
}

_W = "WITH " + BRIDGE
_ANY = ", ".join
_LONG = "lng AS (" + " UNION ALL ".join(f"SELECT pep, pos, '{a}' AS atom, x{j} AS x FROM res WHERE x{j} IS NOT NULL" for j, a in enumerate(ATOMS)) + ")"
_COR = f"{_W},{sql_corrected()}"
_GONE = _ANY(f"bool_or(off{j} IS NULL) AS g{j}" for j in range(N))
_MANY = "+".join(f"CAST(g{j} AS INT)" for j in range(N))
SQL = {
    "residue_scores": f"{_W},{sql_scores('s', 'res')} SELECT pep, pos, CAST(k3 AS BIGINT) AS k3, round(z3,6) AS zscore, round(p3,6) AS pscore FROM s",
    "single_residue_scores": f"{_W},{sql_scores('s', 'res')} SELECT pep, pos, CAST(k AS BIGINT) AS k, {_r('tot')}, {_r('z1')} FROM s",
    "rolling_offset_window": f"{_W},{sql_rolling('w', 'res')} SELECT pep, pos, {_ANY(_r(f'{a}{j}') for a in 'smr' for j in range(N))} FROM w",
    "best_window": f"{_W},{sql_best('w', 'res')} SELECT pep, best_pos, {_r('mean_sd')} FROM w WHERE pos=best_pos",
    "running_offsets": f"{_W},{sql_running('w', 'res')} SELECT pep, {_ANY(_r(f'o{j}') for j in range(N))} FROM w WHERE pos=1",
    "global_offsets": f"{_W},{sql_scores('s', 'res', 'a')}, g AS (SELECT *, "
    + _ANY(f"{sql_global(f'(CASE WHEN NOT {sql_outlier(j, "a", "0e0")} THEN x{j} END)')} AS g{j}" for j in range(N))
    + f" FROM s WINDOW p AS (PARTITION BY pep)) SELECT pep, {_ANY(_r(f'g{j}') for j in range(N))} FROM g WHERE pos=1",
    "outlier_mask": f"{_W},{sql_scores('s', 'res', 'a')} SELECT pep, pos, {_ANY(f'{sql_outlier(j, "a", "0e0")} AS ol{j}' for j in range(N))} FROM s",
    "offset_corrected_scores": f"{_COR} SELECT pep, pos, used_running, CAST(k3 AS BIGINT) AS k3, {_r('z3')}, {_r('p3')}, {_ANY(_r(f'off{j}') for j in range(N))} FROM fin",
    "offset_corrected_kept": f"{_W},{sql_corrected(2.0, False)} SELECT pep, pos, CAST(k3 AS BIGINT) AS k3, {_r('z3')}, {_r('p3')} FROM fin",
    "uncorrected_scores": f"{_W},{sql_scores('s', 'res')} SELECT pep, pos, {_r('z3')}, {_r('p3')} FROM s",
    "max_offset_reject": f"{_COR}, g AS (SELECT pep, {_GONE} FROM bf GROUP BY pep) "
    + " UNION ALL ".join(f"SELECT CAST({j + 1} AS BIGINT) AS atom, count(*) FILTER (WHERE g{j}) AS rejected, count(*) FILTER (WHERE g{j} AND ({_MANY})=1) AS only_rejected FROM g" for j in range(N)),
    "pivot_matrix": f"{_W} SELECT pep, pos, {_ANY(f'round(x{j},6) AS v_{a.lower()}' for j, a in enumerate(ATOMS))} FROM res WHERE {' OR '.join(f'x{j} IS NOT NULL' for j in range(N))}",
    "long_cells": f"{_W},{_LONG} SELECT pep, pos, atom, {_r('x')} FROM lng",
    "residue_grid": f"{_W} SELECT pep, pos, CAST({'+'.join(f'CAST(x{j} IS NOT NULL AS INT)' for j in range(N))} AS BIGINT) AS k FROM res",
    "dataset_long": f"{_COR} SELECT CAST(pep AS VARCHAR) AS id, pos AS seq_index, CAST(k3 AS BIGINT) AS k, round_even(z3,4) AS zscores, round_even(p3,4) AS pscores FROM fin",
    "result_compare": f"{_COR},{sql_scores('u', 'res')}, l AS (SELECT pep, pos, z3 AS score FROM fin WHERE pos%7<>0), r AS (SELECT pep, pos, z3 AS score FROM u WHERE pos%5<>0)"
    " SELECT 'left_only' AS part, count(*) AS n FROM l ANTI JOIN r USING (pep,pos) UNION ALL SELECT 'right_only', count(*) FROM r ANTI JOIN l USING (pep,pos)"
    " UNION ALL SELECT CASE WHEN (l.score IS NULL AND r.score IS NULL) OR coalesce(abs(l.score-r.score)<=1e-8+1e-5*abs(r.score),false) THEN 'equal' ELSE 'differs' END, count(*) FROM l JOIN r USING (pep,pos) GROUP BY 1",
    "set_ops": f"{_W}, l AS (SELECT pep,pos FROM res WHERE x0 IS NOT NULL), r AS (SELECT pep,pos FROM res WHERE x3 IS NOT NULL)"
    " SELECT 'both' AS part, pep, pos FROM (SELECT * FROM l INTERSECT SELECT * FROM r) UNION ALL SELECT 'left', pep, pos FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT 'right', pep, pos FROM (SELECT * FROM r EXCEPT SELECT * FROM l)",
}
