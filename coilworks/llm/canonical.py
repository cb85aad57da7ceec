"""Visually identical text in one form (problem 8).

Words (runs of letters, marks and invisible characters) of the whole corpus are
counted. Words of one coarse look, of which at least one is not plain ASCII, go to
one bucket. In each bucket the clean spellings (composed, nothing invisible, one
script) form a trie, which a weighted edit automaton walks for every other word:
look-alikes, also one character for two letters, and invisible characters cost
nothing, any other edit costs one, and the budget is nought, since what looks
different must stay different. A letter that only may look Latin costs nothing
where the word mixes alphabets and no spelling fits without. The canonical
spelling is chosen among those found (ASCII first, then the most frequent, then
the smallest); a word that finds none is normalized by the table, and so is every
other character. Documents whose canonical texts are equal look the same.

Only distinct words meet in a bucket, never their occurrences; the number of
buckets follows the number of words. Words whose spelling is the table's need no
entry, so the dictionary holds the exceptions; it is broadcast if its counted
bytes allow and joined by document otherwise.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coilworks.llm.lookalikes import WEAK, WEAK_AS, coarse, of_char, skeleton
from coilworks.session import checkpoint

WORD = r"[\p{L}\p{M}\p{Cf}]+"
_WORD = regex.compile(WORD)
BUCKET_WORDS = 20_000  #: words a bucket holds on average
BROADCAST_BYTES = 32 << 20  #: counted bytes of the dictionary that may be broadcast

_ASCII = r"^[\x00-\x7f]*$"
_MAY_BE = dict(zip(WEAK, WEAK_AS, strict=True))


def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split()[0]


def is_clean(word: str) -> bool:
    """A spelling that may be canonical: composed, nothing the table drops or widens, letters of one alphabet.

    Greek signs are used within Latin words (Hα), so Greek beside Latin is clean
    unless a Greek letter looks Latin.
    """
    if word.isascii():
        return True
    if unicodedata.normalize("NFC", word) != word or any(of_char(c) == "" or len(unicodedata.normalize("NFKD", c)) != len(unicodedata.normalize("NFD", c)) or unicodedata.decomposition(c).startswith("<") for c in word):
        return False
    scripts = {_script(c) for c in word if c.isalpha()}
    if len(scripts) <= 1:
        return True
    return scripts <= {"LATIN", "GREEK"} and all(of_char(c) == unicodedata.normalize("NFD", c) for c in word)


class Trie:
    """Spellings by their decomposed characters; edges are grouped by what they look like."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", word):
            node = node.setdefault(of_char(c), {}).setdefault(c, {})
        node.setdefault(None, []).append((word, count))

    def look_up(self, word: str, budget: int = 0, weak: bool = False) -> list[tuple[str, int, int]]:
        """(spelling, count, cost) of all spellings within the budget.

        Automaton over the look of the word: a look-alike edge and an invisible
        character cost 0, with ``weak`` also a letter for the Latin one it may
        be; any other substitution, insertion or deletion costs 1.
        """
        units = unicodedata.normalize("NFD", "".join(of_char(c) for c in word))
        states: dict[int, tuple[dict, int]] = {id(self.root): (self.root, 0)}

        def spread(found: dict[int, tuple[dict, int]]) -> dict[int, tuple[dict, int]]:
            todo = list(found.values())
            while todo:  # insertions
                node, cost = todo.pop()
                if cost < budget:
                    for look, edges in node.items():
                        for child in edges.values() if look is not None else ():
                            if cost + 1 < found.get(id(child), (None, budget + 1))[1]:
                                found[id(child)] = (child, cost + 1)
                                todo.append((child, cost + 1))
            return found

        states = spread(states)
        for u in units:
            new: dict[int, tuple[dict, int]] = {}
            looks = (u, _MAY_BE[u]) if weak and u in _MAY_BE else (u,)
            for node, cost in states.values():
                steps = [(child, cost) for look in looks for child in node.get(look, {}).values()]
                if cost < budget:
                    steps += [(child, cost + 1) for look, edges in node.items() if look is not None and look not in looks for child in edges.values()] + [(node, cost + 1)]
                for child, c in steps:
                    if c < new.get(id(child), (None, budget + 1))[1]:
                        new[id(child)] = (child, c)
            states = spread(new)
        return [(w, n, cost) for node, cost in states.values() for w, n in node.get(None, ())]

    def spelling(self, word: str) -> str:
        """The canonical spelling of a word: one that fits exactly, else one that may, else the table's form."""
        found = self.look_up(word)
        if not found and not is_clean(word):
            # all words of this look are unclean, so all of them come here
            found = self.look_up(word, weak=True)
        return choose(found, word)


def choose(found: list[tuple[str, int, int]], word: str) -> str:
    """The canonical spelling: ASCII, then most frequent, then smallest; the table's form if none is found."""
    if not found:
        return skeleton(word)
    return min(found, key=lambda x: (not x[0].isascii(), -x[1], x[0]))[0]


def word_counts(documents: DataFrame) -> DataFrame:
    """word, n over all texts, combined within each partition before the shuffle."""
    return documents.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@F.arrow_udf(T.StringType())
def _coarse(words: pa.Array) -> pa.Array:
    return pa.array([coarse(w) for w in words.to_pylist()], pa.string())


_ENTRIES = pa.schema([("word", pa.string()), ("canon", pa.string())])


def _of_bucket(rows: pa.Table) -> pa.Table:
    trie = Trie()
    words = rows.column("word").to_pylist()
    for w, n in zip(words, rows.column("n").to_pylist()):
        if is_clean(w):
            trie.add(w, n)
    out = [(w, trie.spelling(w)) for w in words if not w.isascii()]
    return pa.Table.from_pylist([{"word": w, "canon": c} for w, c in out if c != skeleton(w)], _ENTRIES)


def dictionary(documents: DataFrame) -> DataFrame:
    """word, canon: words whose canonical spelling is not the table's form."""
    counts = checkpoint(word_counts(documents))
    plain = F.col("word").rlike(_ASCII)
    other = counts.filter(~plain).select("word", "n", _coarse("word").alias("look"))
    # a plain word matters where another spelling may look like it
    wanted = counts.filter(plain).select("word", "n", F.col("word").alias("look")).join(other.select("look").distinct(), "look", "left_semi")
    words = checkpoint(other.unionByName(wanted))
    buckets = -(-words.count() // BUCKET_WORDS) or 1
    return words.select("word", "n", F.pmod(F.xxhash64("look"), F.lit(buckets)).alias("bucket")).groupBy("bucket").applyInArrow(_of_bucket, "word string, canon string")


def canonical(text: str, words: dict[str, str]) -> str:
    """``text`` with each word in its canonical spelling and every other character by the table."""
    if text.isascii():
        return text
    out, end = [], 0
    for m in _WORD.finditer(text):
        w = m[0]
        out += [skeleton(text[end : m.start()]), words.get(w) or skeleton(w)]
        end = m.end()
    return unicodedata.normalize("NFC", "".join([*out, skeleton(text[end:])]))


def normalize(documents: DataFrame, id_column: str = "doc_id", name: str = "canon") -> DataFrame:
    """``documents`` with a column ``name``: the text in canonical form.

    Texts that look the same become equal, texts that look different stay
    different. Null stays null, empty stays empty; all columns and rows are kept,
    repeated ones too; a column already called ``name`` is replaced.
    """
    texts = documents.select("text").filter("text is not null")
    found = checkpoint(dictionary(texts))
    # a plain text is its own form and needs no Python
    other = F.when(~F.col("text").rlike(_ASCII), F.col("text"))
    if (found.agg(F.sum(F.octet_length("word") + F.octet_length("canon") + 100)).first()[0] or 0) <= BROADCAST_BYTES:
        shipped = documents.sparkSession.sparkContext.broadcast(dict(found.toLocalIterator()))

        @F.arrow_udf(T.StringType())
        def in_place(text: pa.Array) -> pa.Array:
            words = shipped.value
            return pa.array([t if t is None else canonical(t, words) for t in text.to_pylist()], pa.string())

        return documents.withColumn(name, F.coalesce(in_place(other), F.col("text")))

    @F.arrow_udf(T.StringType())
    def with_words(text: pa.Array, entries: pa.Array) -> pa.Array:
        pairs = ({e["word"]: e["canon"] for e in row or ()} for row in entries.to_pylist())
        return pa.array([t if t is None else canonical(t, words) for t, words in zip(text.to_pylist(), pairs)], pa.string())

    used = documents.filter(~F.col("text").rlike(_ASCII)).select(F.col(id_column).alias("_id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word"))
    used = used.filter(~F.col("word").rlike(_ASCII)).join(found, "word").groupBy("_id").agg(F.collect_list(F.struct("word", "canon")).alias("_words"))
    joined = documents.drop("_words").join(used, documents[id_column] == used["_id"], "left")
    return joined.withColumn(name, F.coalesce(with_words(other, F.col("_words")), F.col("text"))).drop("_id", "_words")


def alike_pairs(documents: DataFrame) -> DataFrame:
    """doc_id_a, doc_id_b (smaller first): documents with different stored texts of one canonical form.

    Distinct texts are paired first and then expanded to documents, so exact
    copies never meet one another; a class with one stored text gives nothing.
    """
    docs = documents.select("doc_id", "text").filter("text is not null")
    keyed = normalize(docs).select("doc_id", F.sha2("text", 256).alias("t"), F.sha2("canon", 256).alias("c"))
    keyed = checkpoint(keyed)
    texts = keyed.select("c", "t").distinct()
    several = texts.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1").select("c")
    texts = texts.join(several, "c")
    pairs = texts.toDF("c", "ta").join(texts.toDF("c", "tb"), "c").filter("ta < tb").select("ta", "tb")
    ids = keyed.join(several, "c", "left_semi").select("t", "doc_id")
    found = pairs.join(ids.toDF("ta", "a"), "ta").join(ids.toDF("tb", "b"), "tb")
    return found.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
