"""Offsets, outliers and residue scores of peptides.

Layout: one row a residue with ``pep``, ``pos``, the seven normalised differences
``x0``..``x6`` (null where there is no comparison) and ``leak`` (observed cells
without a prediction). Every step is a column expression or a window over ``pep``,
so the whole chain needs one exchange; windows over observed values only (by
``pep`` and "is there a value") keep that partitioning and are sorted anew. A
peptide has at most as many rows as residues, so no partition outgrows a task.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coilworks.functions.chi import CAP, p_score, z_score

N_ATOMS = 7
MIN_AIC = 6.0
OUTLIER = 6.0
WINDOW = 9
X = [f"x{j}" for j in range(N_ATOMS)]


def _pep():
    return Window.partitionBy("pep")


def _sum(cols: list[Column]) -> Column:
    return reduce(add, cols)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def with_scores(df: DataFrame, tag: str = "", offsets: list[Column] | None = None) -> DataFrame:
    """Adds k, tot, z1 (residue), k3, tot3, z3, p3 (triplet), each with ``tag``, given offsets per atom.

    Cells count min(|x - offset|, 4) squared; a leaked cell adds the cap to the
    residue score only. Scores outside the first and last residue with a cell
    are null. Triplets are padded with nothing at both ends, so every residue of
    the sequence must have its row.
    """
    off = offsets or [F.lit(0.0)] * N_ATOMS
    cells = [F.pow(F.least(F.abs(F.col(x) - o), F.lit(CAP)), 2.0) for x, o in zip(X, off)]
    df = df.withColumns({f"tot{tag}": _sum([_zero(c) for c in cells]), f"k{tag}": _sum([F.col(x).isNotNull().cast("int") for x in X])})
    tot, k = F.col(f"tot{tag}"), F.col(f"k{tag}")
    three = _pep().orderBy("pos").rowsBetween(-1, 1)
    df = df.withColumns({f"tot3{tag}": F.sum(tot).over(three), f"k3{tag}": F.sum(k).over(three), "_lo": F.min(F.when(k > 0, F.col("pos"))).over(_pep()), "_hi": F.max(F.when(k > 0, F.col("pos"))).over(_pep())})
    inside = F.col("pos").between(F.col("_lo"), F.col("_hi"))
    t3, k3 = F.col(f"tot3{tag}"), F.col(f"k3{tag}")
    return df.withColumns(
        {f"z1{tag}": F.when(inside, z_score(tot + CAP * CAP * F.col("leak"), k)), f"z3{tag}": F.when(inside, z_score(t3, k3)), f"p3{tag}": F.when(inside, p_score(t3, k3))}
    ).drop("_lo", "_hi")


def outliers(tag: str = "", offsets: list[Column] | None = None) -> list[Column]:
    """For each atom whether its cell is an outlier (false where there is no cell)."""
    off = offsets or [F.lit(0.0)] * N_ATOMS
    z1, z3 = F.col(f"z1{tag}"), F.col(f"z3{tag}")
    residue = _yes(z1 > OUTLIER) | (_yes(z3 > OUTLIER) & _yes(z1 > 0) & (F.col(f"k{tag}") > 0))
    return [F.col(x).isNotNull() & (residue | _yes(F.abs(F.col(x) - o) > OUTLIER)) for x, o in zip(X, off)]


def global_offsets(cells: list[Column]) -> list[Column]:
    """Mean of each atom's accepted cells, 0 if fewer than 4 or if dAIC = n ln(rms / sd) - 1 is below 6."""
    out = []
    for c in cells:
        n, mean, rms, sd = F.count(c).over(_pep()), F.avg(c).over(_pep()), F.sqrt(F.avg(c * c).over(_pep())), F.stddev_pop(c).over(_pep())
        out.append(F.when(n < 4, 0.0).when(sd == 0, mean).when(F.ln(rms / sd) * n - 1 < MIN_AIC, 0.0).otherwise(mean))
    return out


def rolling(df: DataFrame) -> DataFrame:
    """Adds sd, mean and rms (``s0``, ``m0``, ``r0``, ...) of nine observed values around each residue, null unless all are there."""
    half = WINDOW // 2
    new = {}
    for j, x in enumerate(X):
        seen = Window.partitionBy("pep", F.col(x).isNull()).orderBy("pos").rowsBetween(-half, half)
        full = F.col(x).isNotNull() & (F.count(x).over(seen) == WINDOW)
        new |= {f"s{j}": F.when(full, F.stddev_pop(x).over(seen)), f"m{j}": F.when(full, F.avg(x).over(seen)), f"r{j}": F.when(full, F.sqrt(F.avg(F.col(x) * F.col(x)).over(seen)))}
    return df.withColumns(new)


def best_window(df: DataFrame) -> DataFrame:
    """Adds best_pos: where the mean rolling sd over all atoms seen in the peptide is least (ties: first); null if nowhere complete."""
    df = rolling(df)
    seen = [F.max(F.col(x).isNotNull()).over(_pep()) for x in X]
    df = df.withColumns({f"_any{j}": c for j, c in enumerate(seen)})
    there = [F.col(f"_any{j}") for j in range(N_ATOMS)]
    complete = reduce(and_, [~t | F.col(f"s{j}").isNotNull() for j, t in enumerate(there)])
    n = _sum([t.cast("int") for t in there])
    df = df.withColumn("mean_sd", F.when(complete & (n > 0), _sum([_zero(F.col(f"s{j}")) for j in range(N_ATOMS)]) / n))
    best = F.min(F.when(F.col("mean_sd").isNotNull(), F.struct("mean_sd", "pos"))).over(_pep())
    return df.withColumn("best_pos", best["pos"]).drop(*[f"_any{j}" for j in range(N_ATOMS)])


def running_offsets(df: DataFrame) -> DataFrame:
    """Adds o0..o6: at the best window the mean of each atom if dAIC = 9 ln(rms / sd) - 1 exceeds 6, else null."""
    df = best_window(df)
    here = F.col("pos") == F.col("best_pos")
    new = {}
    for j in range(N_ATOMS):
        s, m, r = F.col(f"s{j}"), F.col(f"m{j}"), F.col(f"r{j}")
        accept = F.when(s == 0, r > 0).otherwise(F.ln(r / s) * WINDOW - 1 > MIN_AIC)
        new[f"o{j}"] = F.max(F.when(here & accept, m)).over(_pep())
    return df.withColumns(new)


def corrected(df: DataFrame, max_offset: float | None = 3.0, reject_shift_type_only: bool = True, correct: bool = True) -> DataFrame:
    """The whole flow: adds off0..off6 (null where rejected), k3, z3, p3 of the final scores and used_running.

    Uncorrected scores mark outliers and give global offsets; running offsets, if
    any is not zero, rescore the peptide and replace them when the mean triplet
    score does not grow. Offsets beyond ``max_offset`` are rejected and, with
    ``reject_shift_type_only``, their cells leave the scores.
    """
    if not correct:
        return with_scores(df.withColumns({f"off{j}": F.lit(0.0) for j in range(N_ATOMS)} | {"used_running": F.lit(False)}), "")
    df = with_scores(df, "a")
    df = df.withColumns({f"_a{j}": o for j, o in enumerate(outliers("a"))})
    df = df.withColumns({f"_n{j}": g for j, g in enumerate(global_offsets([F.when(~F.col(f"_a{j}"), F.col(x)) for j, x in enumerate(X)]))})
    df = running_offsets(df)
    run = [_zero(F.col(f"o{j}")) for j in range(N_ATOMS)]
    df = with_scores(df, "b", run)
    df = df.withColumns({f"_b{j}": o for j, o in enumerate(outliers("b", run))})
    df = df.withColumns({f"_m{j}": g for j, g in enumerate(global_offsets([F.when(~F.col(f"_b{j}"), F.col(x)) for j, x in enumerate(X)]))})
    df = df.withColumns({"_ava": F.avg("z3a").over(_pep()), "_avb": F.avg("z3b").over(_pep())})
    nonzero = F.greatest(*[(r != 0).cast("int") for r in run]) == 1
    df = df.withColumn("used_running", nonzero & _yes(F.col("_ava") >= F.col("_avb")))
    final = [F.when(F.col("used_running"), F.col(f"_m{j}")).otherwise(F.col(f"_n{j}")) for j in range(N_ATOMS)]
    if max_offset is not None:
        final = [F.when(F.abs(f) <= max_offset, f) for f in final]
    df = df.withColumns({f"off{j}": f for j, f in enumerate(final)})
    df = df.select("pep", "pos", "leak", *X, *[f"off{j}" for j in range(N_ATOMS)], "used_running")
    if reject_shift_type_only:
        df = df.withColumns({x: F.when(F.col(f"off{j}").isNotNull(), F.col(x)) for j, x in enumerate(X)})
    return with_scores(df, "", [_zero(F.col(f"off{j}")) for j in range(N_ATOMS)])


def offset_losses(df: DataFrame, max_offset: float = 3.0) -> DataFrame:
    """atom, rejected, only_rejected: peptides that lose each atom to ``max_offset``, and lose only that one."""
    gone = [F.col(f"off{j}").isNull() for j in range(N_ATOMS)]
    one = corrected(df, max_offset).groupBy("pep").agg(*[F.max(g).alias(f"g{j}") for j, g in enumerate(gone)])
    many = _sum([F.col(f"g{j}").cast("int") for j in range(N_ATOMS)])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(j + 1).alias("atom"), F.col(f"g{j}").alias("gone"), (F.col(f"g{j}") & (many == 1)).alias("only")) for j in range(N_ATOMS)])))
    return long.groupBy("atom").agg(F.count_if("gone").alias("rejected"), F.count_if("only").alias("only_rejected"))
