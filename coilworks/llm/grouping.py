"""Splits that keep related records together (problem 4).

Rows are vertices through their sequence class (equal residues are one vertex);
each accession code ties its vertices to the smallest of them. A Borůvka-style
contraction picks for every component its smallest outgoing edge, hooks
components along it, follows the hooks to their roots by pointer jumping and
relabels the edges, until none is left. The chosen edges are a spanning forest,
written to the shared checkpoint folder round by round, so that a lost executor
costs no more than the current round.

Only aggregated minima (with map-side combine) and equi-joins are used; a code
or component with a third of all rows is never gathered in one task. Nothing is
collected but one count for each round and one row for each size band.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coilworks.llm import residues
from coilworks.session import checkpoint

BANDS = 8  #: size bands to a doubling
BUCKET_GROUPS = 50_000  #: groups in a hash bucket, numbered one after another, on average


def vertices(entities: DataFrame) -> DataFrame:
    """ent_row, entry_id, entity_id, node: the smallest ent_row with the same residues; rows without residues stand alone."""
    rows = residues.polypeptides(entities, "entry_id", "entity_id")
    same = rows.filter("res <> ''").groupBy("res").agg(F.min("ent_row").alias("node"))
    return rows.join(same, "res", "left").select("ent_row", "entry_id", "entity_id", F.coalesce("node", "ent_row").alias("node"))


def accession_edges(rows: DataFrame, links: DataFrame) -> DataFrame:
    """u, v: vertices of one accession tied to its smallest vertex."""
    codes = links.select("entry_id", "entity_id", residues.accession(F.col("accession_code")).alias("code")).filter(F.col("code").isNotNull()).distinct()
    tied = rows.join(codes, ["entry_id", "entity_id"]).select("code", "node").distinct()
    hubs = tied.groupBy("code").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    return tied.join(hubs, "code").filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()


def _roots(hooks: DataFrame) -> DataFrame:
    """comp, root from comp, parent by pointer jumping; a root's parent is itself."""
    while True:
        step = hooks.alias("a").join(hooks.alias("b"), F.col("a.parent") == F.col("b.comp"), "left").select(F.col("a.comp").alias("comp"), F.col("a.parent").alias("old"), F.coalesce("b.parent", "a.parent").alias("parent"))
        step = checkpoint(step)
        moved = not step.filter("old <> parent").isEmpty()
        hooks = step.select("comp", "parent")
        if not moved:
            return hooks.withColumnRenamed("parent", "root")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels: node, comp; forest: u, v) of an undirected graph given by u, v.

    Each round at least halves the components that still have an edge, so the
    rounds grow with the logarithm of the largest group. Loops are ignored,
    repeated edges count once.
    """
    live = edges.filter("u <> v").select("u", "v", F.col("u").alias("cu"), F.col("v").alias("cv"))
    live = checkpoint(live)
    labels = checkpoint(live.select(F.col("u").alias("node")).union(live.select("v")).distinct().withColumn("comp", F.col("node")))
    forest = []
    while not live.isEmpty():
        both = live.select(F.col("cu").alias("comp"), F.col("cv").alias("other"), "u", "v").union(live.select("cv", "cu", "u", "v"))
        # the order of the edges is fixed by (hash, u, v), the same from both ends
        key = F.struct(F.xxhash64("u", "v").alias("w"), "u", "v", "other")
        best = checkpoint(both.groupBy("comp").agg(F.min(key).alias("e")).select("comp", F.col("e.other").alias("other"), F.col("e.u").alias("u"), F.col("e.v").alias("v")))
        forest.append(best.select("u", "v").distinct())
        # two components that picked each other: the smaller one is the root
        back = best.select(F.col("comp").alias("other"), F.col("other").alias("comp2"))
        hooks = best.join(back, "other", "left").select("comp", F.when((F.col("comp2") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("parent"))
        roots = _roots(hooks)
        labels = checkpoint(labels.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))
        live = live.join(roots.toDF("cu", "ru"), "cu").join(roots.toDF("cv", "rv"), "cv").filter("ru <> rv").select("u", "v", F.col("ru").alias("cu"), F.col("rv").alias("cv"))
        live = checkpoint(live)
    empty = edges.select("u", "v").limit(0)
    return labels, functools.reduce(DataFrame.union, forest, empty)


def groups(entities: DataFrame, links: DataFrame) -> DataFrame:
    """ent_row, group_row (smallest ent_row of its group), group_size for every polypeptide row."""
    rows = vertices(entities)
    labels, _ = spanning_forest(accession_edges(rows, links))
    least = labels.groupBy("comp").agg(F.min("node").alias("group_row"))
    named = labels.join(least, "comp").select("node", "group_row")
    sizes = rows.groupBy("node").agg(F.count("*").alias("n")).join(named, "node", "left").select("node", "n", F.coalesce("group_row", "node").alias("group_row"))
    totals = sizes.groupBy("group_row").agg(F.sum("n").alias("group_size"))
    return rows.select("ent_row", "node").join(sizes.join(totals, "group_row").select("node", "group_row", "group_size"), "node").select("ent_row", "group_row", "group_size")


def related_rows(entities: DataFrame, links: DataFrame) -> DataFrame:
    """ent_row, group_row of the rows that are related to at least one other row.

    Null or empty sequences and placeholder accessions relate nothing; an entity
    without links is related by its sequence alone; empty tables give no rows.
    """
    return groups(entities, links).filter("group_size > 1").select("ent_row", "group_row")


def forest_edges(entities: DataFrame, links: DataFrame) -> DataFrame:
    """u, v: the spanning forest over sequence classes (each named by its smallest ent_row)."""
    return spanning_forest(accession_edges(vertices(entities), links))[1]


def assign_splits(entities: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """ent_row, group_row, group_size, new_split: whole groups in one split, shares close to ``targets``.

    Groups are stratified by size band (BANDS to a doubling) and dealt
    systematically, the largest band first: the r-th of a band's n groups takes
    the point (r - 1/2) / n on the line of what the splits still miss, which the
    band's own groups then fill. Bands of one group, however large, are dealt the
    same way. What reaches the driver is one row for each band. Ranks come from
    counts per (band, hash bucket) and a number within the bucket, so no band is
    sorted as a whole.
    """
    rows = checkpoint(groups(entities, links))
    units = rows.groupBy("group_row").agg(F.first("group_size").alias("size"))
    shares = [(r[0], float(r[1])) for r in targets.select("data_split", "target_share").filter("target_share > 0").orderBy("data_split").collect()]
    if not shares:
        raise ValueError("no split has a positive share")
    banded = units.select("group_row", "size", F.floor(F.log2("size") * BANDS).cast("int").alias("band"), F.xxhash64("group_row").alias("h"))
    # one row a band: sizes are bigint, so there are at most 64 * BANDS
    totals = {r.band: (r.n, r["rows"]) for r in banded.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("rows")).collect()}
    cuts = _deal(totals, shares)
    buckets = -(-sum(n for n, _ in totals.values()) // BUCKET_GROUPS) or 1
    banded = banded.drop("size").withColumn("bucket", F.pmod("h", F.lit(buckets)))
    start = banded.groupBy("band", "bucket").agg(F.count("*").alias("n")).selectExpr("band", "bucket", "sum(n) over (partition by band order by bucket) - n as before")
    placed = banded.selectExpr("*", "row_number() over (partition by band, bucket order by h, group_row) as r").join(start, ["band", "bucket"])
    line = rows.sparkSession.createDataFrame(cuts, "band int, lo bigint, hi bigint, new_split string")
    rank = F.col("before") + F.col("r")
    dealt = placed.join(F.broadcast(line), "band").filter((rank > F.col("lo")) & (rank <= F.col("hi"))).select("group_row", "new_split")
    return rows.join(dealt, "group_row").select("ent_row", "group_row", "group_size", "new_split")


def _deal(totals: dict[int, tuple[int, int]], shares: list[tuple[str, float]]) -> list[tuple[int, int, int, str]]:
    """(band, lo, hi, split): ranks lo < r <= hi of a band go to the split; ``totals`` has each band's groups and rows."""
    whole = sum(s for _, s in shares)
    missing = {name: share / whole * sum(r for _, r in totals.values()) for name, share in shares}
    out = []
    for band in sorted(totals, reverse=True):
        n, size = totals[band]
        order = sorted(missing, key=lambda k: (-missing[k], k))
        wanted = {k: max(missing[k], 0.0) for k in order}
        line, upto, lo = sum(wanted.values()) or 1.0, 0.0, 0
        for i, k in enumerate(order):
            upto += wanted[k]
            # the points (r - 1/2) / n up to this split's end
            hi = n if i == len(order) - 1 else min(n, max(lo, math.floor(upto / line * n + 0.5)))
            if hi > lo:
                out.append((band, lo, hi, k))
                missing[k] -= (hi - lo) * size / n
            lo = hi
    return out


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """data_split, target_share, rows, share: what was reached."""
    got = assigned.groupBy("new_split").agg(F.count("*").alias("rows"))
    wanted = targets.select("data_split", "target_share")
    rows = wanted.join(got, F.col("data_split") == F.col("new_split"), "left").select("data_split", "target_share", F.coalesce("rows", F.lit(0)).alias("rows"))
    # one row for each split
    return rows.withColumn("share", F.coalesce(F.try_divide(F.col("rows"), F.sum("rows").over(Window.partitionBy())), F.lit(0.0)))
