"""Same or near-same sequences across splits (problem 3).

Edit-distance segment join. Every distinct evaluation string of length L is cut
into k+1 segments, k being the largest edit distance any training string of an
admissible length may have; at most k edits leave one segment whole. A pair is a
candidate if a segment stands in the training string at a position that the edits
before and after it allow (multi-match-aware windows) and if its letter counts
allow the distance. Candidates are verified by Spark's ``levenshtein`` with a
threshold, a banded dynamic program in the JVM.

What is shuffled are the strings, never their segments or substrings, which are
many times as large: a training string goes to the band of its length, an
evaluation string to the two or three bands of the lengths it may match, and
``nearby`` looks for common segments within a band. A band with many letters is
dealt into pieces on either side, and each piece meets each of the other side, so
that a group fits a Python worker whatever the data. Only the letters in each
band, a row for each side, reach the driver; no broadcast is asked for.

Equal strings are joined once and expanded to rows at the end, so copies, even a
third of all rows, cost one string. Rows and strings meet by a digest of 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coilworks.llm import nearby, residues

PERCENT = 15  #: edit distance allowed, in per cent of the longer length
PIECE = 16_000_000  #: letters that either side of a group has at most, about


def _band(length: str, percent: int) -> str:
    """Band of a length; the lengths admissible for one string lie in three bands at most."""
    return f"cast(floor(ln({length}) / {-math.log(1 - percent / 100)!r}D) as int)"


def _bands(percent: int) -> str:
    """Bands of the training strings that an evaluation string may match."""
    shortest, most = f"cast(ceil(len * {100 - percent} / 100) as int)", f"cast(floor(100 * len / {100 - percent}) as int)"
    return f"sequence({_band(f'greatest(1, {shortest})', percent)}, {_band(f'greatest(len, {most})', percent)})"


def digest(res: Column) -> Column:
    """128 bits that stand for a string."""
    return F.substring(F.unhex(F.sha2(res, 256)), 1, 16)


def distinct_strings(rows: DataFrame) -> DataFrame:
    """One row for each string: res, sid (smallest ent_row), in_train, in_eval."""
    return rows.groupBy("res").agg(F.min("ent_row").alias("sid"), F.max(F.col("split") == "train").alias("in_train"), F.max(F.col("split") != "train").alias("in_eval"))


def pieces(rows: DataFrame, percent: int = PERCENT, most: int = PIECE) -> dict[int, tuple[int, int]]:
    """Each band that has both sides: the pieces of its training strings and of the evaluation strings that may match them.

    From the letters of the distinct strings, about: a wrong estimate changes only the size of a piece.
    """
    sides = rows.select("res", F.length("res").alias("len"), (F.col("split") == "train").alias("train"))
    sides = sides.selectExpr("res", "len", "train", f"explode(if(train, array({_band('len', percent)}), {_bands(percent)})) as band")
    sizes = sides.groupBy("band", "train").agg((F.approx_count_distinct("res") * F.avg("len")).alias("letters")).collect()
    needed = {(r.band, r.train): max(1, math.ceil(r.letters / most)) for r in sizes}
    return {band: (n, needed[band, False]) for (band, train), n in needed.items() if train and (band, False) in needed}


def dealt(strings: DataFrame, percent: int, dealing: dict[int, tuple[int, int]]) -> DataFrame:
    """band, part_t, part_e (the group), held, sid, res: each string in every group in which it may have a partner."""
    of = ", ".join(f"{band}, struct({t} as t, {e} as e)" for band, (t, e) in sorted(dealing.items()))
    if not of:
        return strings.selectExpr("0 as band", "0 as part_t", "0 as part_e", "in_eval as held", "sid", "res").limit(0)
    train, held = f"array({_band('len', percent)})", _bands(percent)
    to_train = "transform(sequence(0, b.n.e - 1), j -> struct(b.band as band, cast(pmod(xxhash64(sid), b.n.t) as int) as part_t, j as part_e, false as held))"
    to_held = "transform(sequence(0, b.n.t - 1), j -> struct(b.band as band, j as part_t, cast(pmod(xxhash64(sid), b.n.e) as int) as part_e, true as held))"
    met = "filter(transform({bands}, band -> struct(band, of[band] as n)), b -> b.n is not null)"
    groups = [f"if({side}, flatten(transform({met.format(bands=bands)}, b -> {to})), array())" for side, bands, to in (("in_train", train, to_train), ("in_eval", held, to_held))]
    sized = strings.selectExpr("*", "length(res) as len", f"map({of}) as of")
    return sized.selectExpr(f"inline(concat({', '.join(groups)}))", "sid", "res")


def candidates(strings: DataFrame, percent: int, dealing: dict[int, tuple[int, int]]) -> DataFrame:
    """sid_e, res_e, sid_t, res_t: pairs with a common segment at an allowed position and letter counts near enough."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return nearby.of_group(batches, percent)

    spark, group = strings.sparkSession, ["band", "part_t", "part_e"]
    # by number, as groups are few bytes but costly, and adaptive execution would join them
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt(strings, percent, dealing).repartition(parts, *group).groupBy(*group).applyInArrow(found, "sid_e bigint, res_e string, sid_t bigint, res_t string")


def string_pairs(rows: DataFrame, percent: int = PERCENT, most: int = PIECE) -> DataFrame:
    """Verified pairs of distinct strings: sid_e, sid_t, distance, key_e, key_t (their digests)."""
    found = candidates(distinct_strings(rows), percent, pieces(rows, percent, most))
    found = found.withColumn("distance", F.expr(f"levenshtein(res_e, res_t, cast({percent} * greatest(length(res_e), length(res_t)) div 100 as int))"))
    # a pair may come twice from a group with very many
    return found.filter("distance >= 0").select("sid_e", "sid_t", "distance", digest(F.col("res_e")).alias("key_e"), digest(F.col("res_t")).alias("key_t")).distinct()


def split_rows(entities: DataFrame) -> DataFrame:
    """Polypeptides with a split: ent_row, res, feed, split (train, val or test).

    Rows without a split, with another word for it, or without letters belong to
    no pair and are left out.
    """
    rows = residues.polypeptides(entities, "feed", residues.split_name(F.col("data_split")).alias("split"))
    return rows.filter(F.col("split").isin("train", "val", "test") & (F.col("res") != ""))


def overlaps(entities: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All pairs of an evaluation row and a training row within the edit distance.

    Columns: ent_row_e, split, feed, ent_row_t, feed_t, distance. Every pair of
    rows comes out, copies included; nulls and empty sequences give none; an
    empty table gives an empty result; a row delivered twice gives its pairs
    once for each delivery.
    """
    rows = split_rows(entities)
    keyed = rows.withColumn("key", digest(F.col("res")))
    held, train = keyed.filter("split <> 'train'"), keyed.filter("split = 'train'")
    return (
        string_pairs(rows, percent)
        .join(held.select(F.col("key").alias("key_e"), F.col("ent_row").alias("ent_row_e"), "split", "feed"), "key_e")
        .join(train.select(F.col("key").alias("key_t"), F.col("ent_row").alias("ent_row_t"), F.col("feed").alias("feed_t")), "key_t")
        .select("ent_row_e", "split", "feed", "ent_row_t", "feed_t", "distance")
    )


def members(entities: DataFrame) -> DataFrame:
    """ent_row, sid, split: every row with the representative (smallest ent_row) of its string."""
    rows = split_rows(entities)
    return rows.join(distinct_strings(rows).select("res", "sid"), "res").select("ent_row", "sid", "split")


def representative_pairs(entities: DataFrame) -> DataFrame:
    """sid_e, sid_t, distance: overlapping pairs of distinct strings, each named by its smallest ent_row.

    With :func:`members` this is the whole result without expanding copies: a
    string that stands in a third of train and of val is one pair. A string that
    stands in both splits is paired with itself at distance 0.
    """
    return string_pairs(split_rows(entities)).select("sid_e", "sid_t", "distance")


def row_pairs(entities: DataFrame) -> DataFrame:
    """ent_row_a, ent_row_b: each overlapping pair of rows, the smaller first."""
    return overlaps(entities).select(F.least("ent_row_e", "ent_row_t").alias("ent_row_a"), F.greatest("ent_row_e", "ent_row_t").alias("ent_row_b"))


def overlap_counts(entities: DataFrame) -> DataFrame:
    """Per split and feed of the evaluation side: its rows, rows that overlap, exact ones, and pairs.

    The pairs are summed before they meet the rows, so no group of pairs is
    gathered by split.
    """
    found = overlaps(entities).groupBy("ent_row_e").agg(F.count("*").alias("n"), F.min("distance").alias("least"))
    rows = split_rows(entities).filter("split <> 'train'").select("ent_row", "split", "feed")
    out = rows.join(found, rows.ent_row == found.ent_row_e, "left").groupBy("split", "feed")
    return out.agg(
        F.count("*").alias("eval_rows"), F.count("n").alias("overlapping_rows"), F.count_if(F.col("least") == 0).alias("exact_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")
    )
