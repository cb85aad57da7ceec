"""Mixing sources to target weights (problem 7).

Every document gets a 60-bit hash. Tokens are summed by source and by the leading
12 bits of the hash; the running sums of that histogram show in which bucket a
source's budget runs out. Only that boundary bucket is split again by the next
12 bits, and so on, until the threshold is fine enough. A document is used once
more if its hash lies below its source's threshold: a filter, no sort. Thresholds
for growing budgets are nested, so a larger mix contains a smaller one.

Tokens are counted once, with a public tokenizer whose file is a parameter, and
written to the shared checkpoint folder. What reaches the driver are the targets
and one histogram of 4096 buckets a source for each level, whatever the data.
"""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coilworks.session import checkpoint

BITS, LEVELS = 12, 5
BUCKETS = 1 << BITS
HASH_BITS = BITS * LEVELS
TOLERANCE = 1e-4  #: part of a source's budget by which its threshold may miss it
_RANKS: dict[str, object] = {}


def default_tokenizer() -> str:
    """The public byte-level BPE, from COILWORKS_TOKENIZER or the installed files."""
    named = os.environ.get("COILWORKS_TOKENIZER")
    if named:
        return named
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _encoding(path: str):
    if path not in _RANKS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _RANKS[path] = tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _RANKS[path]


def token_count(text: Column, tokenizer: str | None = None) -> Column:
    """Tokens of a whole text; null stays null, empty is 0."""
    path = tokenizer or default_tokenizer()

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(path).encode_ordinary
        return pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return count(text)


def source_name(source: Column) -> Column:
    """Sources without case, outer blanks and dashes for underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[-\s]+", "_")


def counted(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, seed: int = 17) -> DataFrame:
    """doc_id, source, tokens, h of the documents of the target sources (others and null texts are left out)."""
    wanted = documents.filter("text is not null").select("doc_id", source_name(F.col("source")).alias("source"), "text")
    named = targets.select(source_name(F.col("source")).alias("source")).distinct()
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 64 - HASH_BITS)
    return wanted.join(named, "source", "left_semi").select("doc_id", "source", token_count(F.col("text"), tokenizer).alias("tokens"), h.alias("h"))


def thresholds(docs: DataFrame, budgets: dict[str, float]) -> dict[str, int]:
    """For each source the hash below which its tokens sum up to at most the budget, as near as TOLERANCE."""
    done: dict[str, int] = {}
    open_: dict[str, tuple[int, float, float]] = {s: (0, 0.0, b) for s, b in budgets.items()}  # prefix, tokens below it, budget
    for level in range(LEVELS):
        if not open_:
            break
        shift = HASH_BITS - BITS * (level + 1)
        within = None
        for s, (prefix, _, _) in open_.items():
            one = (F.col("source") == s) & (F.shiftright("h", shift + BITS) == F.lit(prefix).cast("bigint"))
            within = one if within is None else within | one
        sums: dict[str, dict[int, int]] = {}
        for r in docs.filter(within).groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("tokens").alias("t")).collect():
            sums.setdefault(r.source, {})[r.b] = r.t
        still = {}
        for s, (prefix, below, budget) in open_.items():
            edge = prefix << BITS
            for b, t in sorted(sums.get(s, {}).items()):
                edge = b
                if below + t > budget:
                    break
                below += t
            else:
                edge = (prefix + 1) << BITS
                done[s] = edge << shift
                continue
            if level == LEVELS - 1 or budget - below <= TOLERANCE * budget:
                done[s] = edge << shift
            else:
                still[s] = (edge, below, budget)
        open_ = still
    return done


def _plan(docs: DataFrame, targets: DataFrame, total_tokens: float | None) -> tuple[dict[str, tuple[int, int]], float]:
    """source: (whole copies, threshold of one more), and the tokens aimed at."""
    rows = targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").filter("target_share > 0").collect()
    share = {r.s: float(r.target_share) for r in rows}
    most = {r.s: max(int(r.max_repeats or 0), 0) for r in rows}
    whole = sum(share.values()) or 1.0
    have = dict.fromkeys(share, 0) | {r.source: int(r.t or 0) for r in docs.groupBy("source").agg(F.sum("tokens").alias("t")).collect() if r.source in share}
    # the largest mix in which every source reaches its share
    reachable = min((have[s] * most[s] / (share[s] / whole) for s in share), default=0.0)
    total = reachable if total_tokens is None else float(total_tokens)
    copies, part = {}, {}
    for s in share:
        budget = min(total * share[s] / whole, have[s] * most[s])
        copies[s] = int(budget // have[s]) if have[s] else 0
        rest = budget - copies[s] * have[s]
        if copies[s] < most[s] and rest > 0:
            part[s] = rest
    edge = thresholds(docs, part)
    return {s: (copies[s], edge.get(s, 0)) for s in share}, total


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, tokens, copies: how often each document is used (only those used).

    Without ``total_tokens`` the mix is the largest in which every source holds
    its share; with more than that, sources stop at ``max_repeats`` times all
    their documents and the report shows what they reach. A source without
    documents makes the default mix empty. Rows with one doc_id are used alike.
    """
    docs = checkpoint(counted(documents, targets, tokenizer))
    plan, _ = _plan(docs, targets, total_tokens)
    copies = F.lit(0)
    for s, (whole, edge) in plan.items():
        copies = F.when(F.col("source") == s, F.lit(whole) + (F.col("h") < F.lit(edge).cast("bigint")).cast("int")).otherwise(copies)
    return docs.withColumn("copies", copies).filter("copies > 0").select("doc_id", "source", "tokens", "copies")


def expand(mixed: DataFrame) -> DataFrame:
    """One row for each use of a document: doc_id, source, tokens, copy_no."""
    return mixed.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"))


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, documents, most_copies, tokens, share: what the mix reached."""
    got = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    named = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    rows = named.join(got, "source", "left").select("source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "most_copies", "tokens")])
    # one row for each source
    return rows.withColumn("share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())), F.lit(0.0)))

