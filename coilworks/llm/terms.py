"""Free-entered values to the entries of a reference list (problem 2).

Prefix-filter set-similarity join. A value or name is brought to words (look of
the characters, case, separators, bracketed remarks and amounts set aside). Words
that stand beside many different names, exact otherwise, are additions and are
left out: they are learned from the values, not listed. The tokens of a word are
the unordered pairs of letters one or two places apart, its ends marked, so that
two swapped letters cost little. Tokens are ordered by global rarity; two sets
of Jaccard similarity above t share one of their |x| - floor(t|x|) rarest
tokens, so only those are joined. Length and positional filters follow, a pair is
kept at its first common prefix token alone, Jaccard is computed exactly and
decides: more than half of all tokens must be common, the most similar name
wins. An exact check then rejects names with other numbers or another stem.

Everything runs on distinct values and, but for reading the words, in the JVM.
The prefixes of the names are broadcast if their counted bytes allow and meet
the values in a shuffled equi-join otherwise, with the same result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coilworks.llm.lookalikes import skeleton
from coilworks.session import checkpoint, spread

SIMILARITY = 0.5  #: Jaccard similarity a match must exceed
ADDED_TO = 3  #: different names beside which a word must stand to be an addition
BROADCAST_BYTES = 32 << 20  #: counted bytes of name prefixes that may be broadcast
NO_VALUE = frozenset(("", ".", "-", "n/a", "none"))

# fixed values: symbols of elements that no letter joins to the name
SYMBOLS = {"na": "sodium", "k": "potassium", "fe": "iron", "cu": "copper", "ag": "silver", "au": "gold", "hg": "mercury", "pb": "lead", "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta"}
# fixed values: small letters whose capitals look Latin; read so only beside Latin letters
SMALL_OF_LOOKALIKES = dict(zip("αβεζηικμνρτυχвкмнту", "abezhikmnptyxbkmhty"))

_UNIT = r"(?:mm|µm|μm|um|nm|m|mol|mmol|molar|%|percent|mg\s*/\s*ml|g\s*/\s*l|eq)"
_AMOUNT = re.compile(rf"(?<![\w.,])\d+(?:[.,]\d+)?[\s-]*(?:%\s*[vw]\s*/\s*[vw]|{_UNIT})(?!\w)")
_JOINED_AMOUNT = re.compile(r"(?<=\w)-(?=\d+[-\s]*(?:mm|m|um)\b)")
_LOT = re.compile(r"\b(?:batch|lot|no\.?)[\s-]*\d+\b")
_BRACKETED = re.compile(r"[\s-]\([^()]*\)(?!\w)")
_WORD, _BETWEEN, _TWICE = re.compile(r"\w+"), re.compile(r"[^\w%]+"), re.compile(r"([a-z])\1+")


def _latin(match: re.Match) -> str:
    """Small look-alikes of capitals within a word that has Latin letters; a measure keeps its micro sign."""
    word = match[0]
    if word.isascii() or not re.search("[a-z]", word) or re.fullmatch("[µμ](?:m|mol|l|g)", word):
        return word
    return "".join(SMALL_OF_LOOKALIKES.get(c, c) for c in word)


@lru_cache(maxsize=65536)
def words_of(text: str) -> tuple[str, ...]:
    """The words of a text without bracketed remarks, amounts and lot numbers, in one English spelling.

    Letters typed twice are one; ph is f and z is s (sulphate, oxidized). A text
    of nothing else keeps what it has.
    """
    t = skeleton(text).lower()
    if not t.isascii():
        t = _WORD.sub(_latin, skeleton(t))  # lower case may bring out further look-alikes
    whole = t = f" {t.replace('_', ' ')} "
    while "(" in t and (shorter := _BRACKETED.sub(" ", t)) != t:
        t = shorter
    t = _LOT.sub(" ", t)
    if re.search(r"\d", t):
        t = _AMOUNT.sub(" ", _JOINED_AMOUNT.sub(" ", t))
    words = [w for w in _BETWEEN.split(t) if w] or [w for w in _BETWEEN.split(whole) if w]
    return tuple(_TWICE.sub(r"\1", SYMBOLS.get(w, w).replace("ph", "f").replace("z", "s")) for w in words) or (whole.strip(),)


@F.arrow_udf(T.StringType())
def _norm(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None or skeleton(t).strip().lower() in NO_VALUE else " ".join(words_of(t)) for t in text.to_pylist()], pa.string())


def tokens(words: str) -> F.Column:
    """Distinct tokens of an array of words: unordered letter pairs one or two places apart, numbered where repeated.

    A token is one bigint: 21 bits for each letter's code point and for the number.
    """
    pair = "shiftleft(cast(least(c[i], c[i + {d}]) as bigint), 42) + shiftleft(cast(greatest(c[i], c[i + {d}]) as bigint), 21)"
    near = [f"transform(sequence(0, size(c) - {d + 1}), i -> {pair.format(d=d)})" for d in (1, 2)]
    letters = f"transform({words}, w -> transform(sequence(1, length(w) + 2), i -> ascii(substr(concat('^', w, '$'), i, 1))))"
    each = f"flatten(transform({letters}, c -> concat({near[0]}, {near[1]})))"
    # in sorted order a token's place less that of its first equal is its number
    return F.expr(f"transform(array(sort_array({each})), a -> transform(a, (x, i) -> x + i + 1 - array_position(a, x)))[0]")


def _bags(words: DataFrame) -> DataFrame:
    """``words`` (kind, bag) once for each bag, with id and tokens."""
    return words.select("kind", "bag").distinct().select("kind", "bag", tokens("bag").alias("tokens"))


def similarity_join(left: DataFrame, right: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """kind, left_bag, right_bag, similarity of all pairs within one kind with Jaccard above ``t``.

    ``left`` and ``right`` have kind, bag (unique within the kind) and tokens
    (distinct, not null, not empty).
    """
    both = left.select("kind", F.explode("tokens").alias("token")).union(right.select("kind", F.explode("tokens").alias("token")))
    rarity = both.groupBy("kind", "token").agg(F.count("*").alias("df"))

    def prefixes(side: DataFrame) -> DataFrame:
        ranked = side.select("kind", "bag", F.explode("tokens").alias("token")).join(rarity, ["kind", "token"])
        ranked = ranked.groupBy("kind", "bag").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o")).select("kind", "bag", F.col("o.token").alias("set"))
        # few bytes, many comparisons
        return spread(ranked).select("*", F.posexplode(F.expr(f"slice(set, 1, size(set) - cast(floor({t} * size(set) + 1e-9) as int))")).alias("pos", "token"))

    x = prefixes(left).alias("x")
    y = checkpoint(prefixes(right))
    small = (y.agg(F.sum(8 * F.size("set") + 64 + F.length(F.concat_ws(" ", "bag")))).first()[0] or 0) <= BROADCAST_BYTES
    y = (F.broadcast(y) if small else y).alias("y")
    met = x.join(y, (F.col("x.kind") == F.col("y.kind")) & (F.col("x.token") == F.col("y.token")))
    nx, ny = F.size("x.set"), F.size("y.set")
    need = F.floor(t / (1 + t) * (nx + ny) + 1e-9) + 1
    near = (ny > t * nx) & (nx > t * ny) & (F.least(nx - F.col("x.pos"), ny - F.col("y.pos")) >= need)
    met = met.filter(near).select(F.col("x.kind").alias("kind"), F.col("x.bag").alias("left_bag"), F.col("y.bag").alias("right_bag"), (nx + ny).alias("both"), F.col("x.token").alias("token"), F.array_intersect("x.set", "y.set").alias("common"))
    # a pair counts at its first common token, where the positional bound holds
    pairs = met.filter("common[0] = token").withColumn("similarity", F.size("common") / (F.col("both") - F.size("common"))).drop("both", "token", "common")
    return pairs.filter(F.col("similarity") > t)


def additions(distinct: DataFrame, names: DataFrame) -> DataFrame:
    """kind, word: words of no name that stand in values beside at least ADDED_TO different names, exact otherwise.

    ``distinct`` has kind, known and extra (words in and not in the names of the
    kind, sorted), ``names`` kind, term_id and bag.
    """
    beside = distinct.filter("size(extra) > 0").join(names.select("kind", "term_id", F.col("bag").alias("known")), ["kind", "known"])
    return beside.select("kind", "term_id", F.explode("extra").alias("word")).distinct().groupBy("kind", "word").agg(F.count("*").alias("n")).filter(F.col("n") >= ADDED_TO).select("kind", "word")


_OTHER_STEM = "exists(left_bag, w -> exists(right_bag, m -> length(m) >= 4 and endswith(w, m) and length(w) >= length(m) + 3))"
_NUMBERS = r"filter({}, w -> w rlike '^[0-9]+$')"


def same_substance() -> F.Column:
    """The exact check behind the join.

    A word that ends in a word of the name after three or more other letters is
    another stem (polyethylene, thiourea); a value with numbers must have those
    of the name, if it has any (polysorbate 80).
    """
    mine, its = F.expr(_NUMBERS.format("left_bag")), F.expr(_NUMBERS.format("right_bag"))
    return ~F.expr(_OTHER_STEM) & ((F.size(mine) == 0) | (F.size(F.array_except(its, mine)) == 0))


def match(values: DataFrame, reference: DataFrame) -> DataFrame:
    """kind, norm, term_id for every distinct (kind, norm) of ``values``; term_id 0 where nothing is meant.

    The most similar name wins; ties go to the fewest edits, then the smallest
    term_id. A name of two terms is the smaller one's.
    """
    spelled = reference.select("kind", "term_id", F.explode(F.array_compact(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))
    spelled = spelled.withColumn("norm", _norm("name")).filter("norm is not null")
    names = checkpoint(spelled.select("kind", "term_id", F.array_sort(F.split("norm", " ")).alias("bag")).groupBy("kind", "bag").agg(F.min("term_id").alias("term_id")))
    vocabulary = names.select("kind", F.explode("bag").alias("word")).distinct().withColumn("in_name", F.lit(True))
    words = values.filter("norm is not null").select("kind", "norm").distinct().select("kind", "norm", F.explode(F.split("norm", " ")).alias("word"))
    split = words.join(vocabulary, ["kind", "word"], "left").groupBy("kind", "norm").agg(*[F.array_sort(F.collect_list(F.when(c, F.col("word")))).alias(n) for n, c in (("known", F.col("in_name")), ("extra", F.col("in_name").isNull()))])
    distinct = checkpoint(split)
    added = additions(distinct, names)
    more = distinct.select("kind", "norm", F.explode("extra").alias("word")).join(added, ["kind", "word"], "left_anti").groupBy("kind", "norm").agg(F.collect_list("word").alias("more"))
    left = F.array_sort(F.concat("known", F.coalesce("more", F.array().cast("array<string>"))))
    bags = checkpoint(distinct.join(more, ["kind", "norm"], "left").select("kind", "norm", F.when(F.size(left) > 0, left).otherwise(F.col("extra")).alias("bag")))
    found = similarity_join(checkpoint(_bags(bags)), checkpoint(_bags(names))).filter(same_substance())
    scored = found.join(names.toDF("kind", "right_bag", "term_id"), ["kind", "right_bag"])
    edits = F.levenshtein(F.concat_ws(" ", "left_bag"), F.concat_ws(" ", "right_bag"))
    best = scored.groupBy("kind", F.col("left_bag").alias("bag")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), edits.alias("e"), "term_id")).alias("b"))
    return bags.join(best, ["kind", "bag"], "left").select("kind", "norm", F.coalesce("b.term_id", F.lit(0).cast("bigint")).alias("term_id"))


def typed_values(presets: DataFrame, entities: DataFrame) -> DataFrame:
    """field_name, kind, row_id, item_no, value: every value typed into the three fields."""

    def of_array(column: str, kind: str) -> DataFrame:
        return presets.select(F.lit(column).alias("field_name"), F.lit(kind).alias("kind"), F.col("preset_row").alias("row_id"), F.posexplode(column).alias("pos", "value")).select("field_name", "kind", "row_id", (F.col("pos") + 1).cast("bigint").alias("item_no"), "value")

    details = entities.select(F.lit("details").alias("field_name"), F.lit("detail").alias("kind"), F.col("ent_row").alias("row_id"), F.lit(1).cast("bigint").alias("item_no"), F.col("details").alias("value"))
    return of_array("chemical_denaturants", "chemical").union(of_array("keywords_blacklist", "keyword")).union(details).filter("value is not null")


def canonical_terms(presets: DataFrame, entities: DataFrame, reference: DataFrame) -> DataFrame:
    """field_name, row_id, item_no, value, term_id for each value that is not null, blank or a mark for no value.

    Null or empty arrays give no rows and null items keep their place; empty
    tables give no rows, an empty reference term_id 0 throughout. Words are read
    once and written. The join back is on the distinct value, one row each, so a
    value typed by a third of all rows is one row on the other side.
    """
    typed = checkpoint(typed_values(presets, entities).withColumn("norm", _norm("value")).filter("norm is not null"))
    return typed.join(match(typed, reference), ["kind", "norm"]).select("field_name", "row_id", "item_no", "value", "term_id")


def unmatched(presets: DataFrame, entities: DataFrame, reference: DataFrame) -> DataFrame:
    """field_name, value, rows: values that name nothing in the reference, with how often they were typed."""
    return canonical_terms(presets, entities, reference).filter("term_id = 0").groupBy("field_name", "value").agg(F.count("*").alias("rows"))
