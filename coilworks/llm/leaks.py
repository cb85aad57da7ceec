"""Evaluation texts leaking into training text (problem 6).

An inverted BM25 index of the test items is queried with every passage of every
document. Passages are windows of 30 words every 15 words, so that each run of
15 words lies whole in one of them. The threshold of an item is the least score
that any 15 consecutive words of it give; a passage that holds such a run scores
no less, so nothing is lost. Retrieved pairs are verified by comparing runs of
words.

The index holds postings by term, items in the order of their thresholds, with
the greatest impact of each term and of each block of postings. Scoring is
block-max WAND for a batch of passages at once: with a passage's terms ordered by
greatest impact, those before the pivot, where the sums reach the least
threshold, cannot carry an item alone; of the others' lists only blocks are
opened whose maximum, with all that the other terms may add, reaches the block's
least threshold; opened items take their impacts from the strongest term down
and are dropped as soon as what is left cannot lift them to their threshold.

Statistics are those of all items. The index is built in tasks, in pieces of
bounded size (measured: about 1.1 KB for an item of 60 words, vocabulary included),
and broadcast up to a bound in bytes: 100,000 such items would be some 110 MB, one
pass over the documents. More items make more passes, one after the other. Documents are
never shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coilworks.llm.lookalikes import words
from coilworks.session import checkpoint

RUN = 15  #: consecutive words that make a leak
BLOCK = 64  #: postings in a block of the index
K1, B = 1.2, 0.75
PIECE_WORDS = 1 << 21  #: words of items in one piece of the index, on average
PASS_BYTES = 256 << 20  #: bytes of pieces broadcast and queried in one pass over the documents
BATCH = 256  #: documents, and passages, scored together


class Index:
    """BM25 postings of items with block maxima and thresholds."""

    def __init__(self, ids: list[int], texts: list[list[str]], idf: dict[str, float], mean_len: float, run: int = RUN):
        self.run = run
        self.vocab = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        weight = np.array([idf[w] for w in self.vocab])
        found, least = [], np.empty(len(ids))
        for j, text in enumerate(texts):
            seq = np.fromiter((self.vocab[w] for w in text), np.int32, len(text))
            terms, place, tf = np.unique(seq, return_inverse=True, return_counts=True)
            impact = weight[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(text) / mean_len))
            # each window's terms once: a word counts where it is not repeated within the window
            windows = np.sort(np.lib.stride_tricks.sliding_window_view(place, run), axis=1)
            new = np.ones(windows.shape, bool)
            new[:, 1:] = windows[:, 1:] != windows[:, :-1]
            least[j] = (impact[windows] * new).sum(axis=1).min()
            found.append((seq, terms, impact))
        order = np.argsort(least, kind="stable")
        self.ids = [ids[j] for j in order]
        self.least = least[order] * (1 - 1e-5)  # impacts are kept in single precision
        self.seq = [found[j][0] for j in order]
        item = np.repeat(np.arange(len(ids)), [len(found[j][1]) for j in order])
        term = np.concatenate([found[j][1] for j in order])
        by_term = np.lexsort((item, term))
        self.key = term[by_term].astype(np.int64) * len(ids) + item[by_term]  # term and item of each posting, ascending
        self.impact = np.concatenate([found[j][2] for j in order])[by_term].astype(np.float32)
        sizes = np.bincount(term, minlength=len(self.vocab))
        first = np.concatenate([[0], np.cumsum(sizes)])
        # blocks of each term's list; the last term stands for words of no item and has none
        blocks = -(-sizes // BLOCK)
        self.block_of = np.concatenate([[0], np.cumsum(blocks), [blocks.sum()]]).astype(np.int64)
        within = np.arange(blocks.sum()) - np.repeat(self.block_of[:-2], blocks)
        self.block_at = np.append(np.repeat(first[:-1], blocks) + within * BLOCK, first[-1])
        self.block_max = np.maximum.reduceat(self.impact, self.block_at[:-1])
        self.block_least = self.least[self.key[self.block_at[:-1]] % len(ids)]
        self.term_max = np.append(np.maximum.reduceat(self.impact, first[:-1]), 0).astype(np.float64)
        self._runs: dict[int, set[bytes]] = {}

    def read(self, doc: list[str]) -> np.ndarray:
        none = len(self.vocab)
        return np.fromiter((self.vocab.get(w, none) for w in doc), np.int32, len(doc))

    def retrieve(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(document, start of passage, item place) of every passage scoring at least the item's threshold."""
        width, none = 2 * self.run, len(self.vocab)
        flat, doc_of, start_of, begins, base = [], [], [], [], 0
        for d, ids in enumerate(docs):
            starts = np.arange(0, len(ids) - self.run + 1, self.run)
            if len(starts):
                doc_of.append(np.full(len(starts), d))
                start_of.append(starts)
                begins.append(base + starts)
                flat += [ids, np.full(width, none, np.int32)]
                base += len(ids) + width
        if not begins:
            return
        terms, at, doc_of, start_of = np.concatenate(flat), np.concatenate(begins), np.concatenate(doc_of), np.concatenate(start_of)
        sums = np.concatenate([[0.0], np.cumsum(self.term_max[terms])])
        alive = np.nonzero(sums[at + width] - sums[at] >= self.least[0] - 1e-6)[0]
        for k in range(0, len(alive), BATCH):
            mine = alive[k : k + BATCH]
            for row, item in zip(*self._wand(terms[at[mine][:, None] + np.arange(width)])):
                yield int(doc_of[mine[row]]), int(start_of[mine[row]]), int(item)

    def _wand(self, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) of all scores that reach the item's threshold."""
        items, none = len(self.ids), len(self.vocab)
        passages = np.sort(passages, axis=1)
        passages[:, 1:][passages[:, 1:] == passages[:, :-1]] = none  # a term counts once
        most = self.term_max[passages]
        order = np.argsort(most, axis=1, kind="stable")
        passages, most = np.take_along_axis(passages, order, 1), np.take_along_axis(most, order, 1)
        sums = np.cumsum(most, axis=1)
        total = sums[:, -1]
        # from the pivot on
        row, col = np.nonzero((sums >= self.least[0] - 1e-6) & (most > 0))
        term = passages[row, col]
        size = self.block_of[term + 1] - self.block_of[term]
        pair = np.repeat(np.arange(len(row)), size)
        block = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + self.block_of[term][pair]
        opened = self.block_max[block] + (total[row] - most[row, col])[pair] >= self.block_least[block] - 1e-6
        pair, block = pair[opened], block[opened]
        size = self.block_at[block + 1] - self.block_at[block]
        posting = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.block_at[block], size)
        met = np.unique(np.repeat(row[pair], size) * items + self.key[posting] % items)
        row, item = met // items, met % items
        score, left = np.zeros(len(met)), total[row]
        for c in range(passages.shape[1] - 1, -1, -1):
            if not len(row):
                break
            wanted = passages[row, c].astype(np.int64) * items + item
            place = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            score += np.where(self.key[place] == wanted, self.impact[place], 0.0)
            left = left - most[row, c]
            kept = score + left >= self.least[item] - 1e-6
            row, item, score, left = row[kept], item[kept], score[kept], left[kept]
        return row, item

    def verify(self, doc: np.ndarray, start: int, item: int) -> bool:
        """Whether a run of the passage stands in the item, word for word."""
        if item not in self._runs:
            seq = self.seq[item]
            self._runs[item] = {seq[p : p + self.run].tobytes() for p in range(len(seq) - self.run + 1)}
        known, last = self._runs[item], len(doc) - self.run
        return any(doc[p : p + self.run].tobytes() in known for p in range(start, min(start + self.run - 1, last) + 1))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _words(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else words(t) for t in text.to_pylist()], pa.list_(pa.string()))


def index_pieces(items: DataFrame, run: int = RUN) -> DataFrame:
    """piece, size: pickled :class:`Index` objects over the items of at least ``run`` words, and their bytes.

    Items of one id are in one piece. Shorter items cannot hold a run.
    """
    read = checkpoint(items.select("item_id", _words("item_text").alias("w")).filter(F.size("w") >= run).withColumn("row", F.monotonically_increasing_id()))
    whole = read.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("words")).first()
    n, mean_len, pieces = whole.n, whole.words / max(whole.n, 1), -(-whole.words // PIECE_WORDS) or 1
    counts = read.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    df = read.select("row", F.explode(F.array_distinct("w")).alias("word")).join(counts, "word").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "df"))).alias("df"))

    def build(rows: pa.Table) -> pa.Table:
        idf: dict[str, float] = {}
        for found in rows.column("df").to_pylist():
            for w, k in found:
                idf[w] = float(np.log1p((n - k + 0.5) / (k + 0.5)))
        made = Index(rows.column("item_id").to_pylist(), rows.column("w").to_pylist(), idf, mean_len, run)
        data = pickle.dumps(made, protocol=5)
        return pa.table({"piece": pa.array([data], pa.binary()), "size": pa.array([len(data)], pa.int64())})

    cut = read.join(df, "row").select("item_id", "w", "df", F.pmod(F.xxhash64("item_id"), F.lit(pieces)).alias("c"))
    return checkpoint(cut.groupBy("c").applyInArrow(build, "piece binary, size bigint"))


def _passes(pieces: DataFrame) -> Iterator[list[bytes]]:
    """The pieces in lists of at most PASS_BYTES, or of one piece."""
    now, size = [], 0
    for r in pieces.toLocalIterator():
        if now and size + r["size"] > PASS_BYTES:
            yield now
            now, size = [], 0
        now.append(bytes(r["piece"]))
        size += r["size"]
    yield now


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, item_id: documents that hold at least ``run`` consecutive words of an item.

    Whole texts are read. Null or short texts and items leak nothing; a document
    given twice with one id counts once for each of its rows, an item once.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").filter(F.col("text").isNotNull())

    def query(shipped) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                for k in range(0, batch.num_rows, BATCH):
                    ids, texts = batch.column("doc_id")[k : k + BATCH].to_pylist(), [words(t) for t in batch.column("text")[k : k + BATCH].to_pylist()]
                    found: dict[tuple[int, int], None] = {}
                    for part in index:
                        read = [part.read(t) for t in texts]
                        for d, start, item in part.retrieve(read):
                            if (d, part.ids[item]) not in found and part.verify(read[d], start, item):
                                found[d, part.ids[item]] = None
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[d] for d, _ in found], pa.int64()), "item_id": pa.array([i for _, i in found], pa.int64())})

        return docs.mapInArrow(scan, "doc_id bigint, item_id bigint")

    out, before = None, None
    for now in _passes(index_pieces(items, run)):
        if before is not None:
            # one pass at a time: its result is written and its index released
            one = checkpoint(query(before))
            before.unpersist()
            out = one if out is None else out.union(one)
        before = spark.sparkContext.broadcast([pickle.loads(piece) for piece in now])
    last = query(before)
    return last if out is None else out.union(last)


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, benchmark, held, documents: in how many documents each item leaks, none included."""
    counts = found.groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "benchmark", "held").join(counts, "item_id", "left").select("item_id", "benchmark", "held", F.coalesce("documents", F.lit(0)).alias("documents"))
