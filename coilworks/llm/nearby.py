"""Pairs of one group that may be within the edit distance (kernel of problem 3).

One call has strings held out and training strings, and finds all pairs with a
common segment at an allowed position whose letter counts allow the distance
too. Memory: the strings, some 30 bytes a segment of the held ones, and blocks
of a fixed size for the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = 16  #: positions of training strings that share an index of segments
STRINGS = 1 << 14  #: training strings looked up at once
HITS = 1 << 19  #: common segments looked at once
BAGS = 1 << 16  #: pairs whose letter counts are compared at once
PAIRS = 1 << 22  #: pairs kept to drop repeats among them
ROWS = 10_000  #: pairs in a batch that goes back


class Strings:
    """Strings of the letters A to Z as one array of bytes, with the count of each letter."""

    def __init__(self, column: pa.Array):
        _, at, data = column.cast(pa.large_string()).buffers()
        self.n = len(column)
        self.start = np.frombuffer(at, np.int64)[: self.n + 1]
        self.data = np.frombuffer(data, np.uint8)
        self.len = np.diff(self.start)
        self.bag = np.empty((self.n, 26), np.int16)
        for i in range(0, self.n, STRINGS):
            own = self.len[i : i + STRINGS]
            letters = self.data[self.start[i] : self.start[i] + own.sum()]
            self.bag[i : i + STRINGS] = np.bincount(np.repeat(np.arange(len(own)) * 26, own) + letters - 65, minlength=len(own) * 26).reshape(-1, 26)


class Segments:
    """The segments of those held strings that are cut into pieces of q letters, k edits being allowed."""

    def __init__(self, held: Strings, of: np.ndarray, k: np.ndarray, q: int, percent: int):
        many = k[of] + 1
        self.e = np.repeat(of, many).astype(np.int32)
        self.i = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)
        length, edits = held.len[self.e], k[self.e]
        p = self.i * length // (edits + 1)
        least, most = -(-length * (100 - percent) // 100), 100 * length // (100 - percent)
        # shifts that some admissible length allows
        self.low = np.maximum(0, p + np.maximum(-self.i, least - length - (edits - self.i))).astype(np.int32)
        self.high = (p + np.minimum(self.i, most - length + (edits - self.i))).astype(np.int32)
        self.p = p.astype(np.int32)
        at = held.start[self.e] + p
        self.code = _code(lambda r: held.data[at + r], q)
        self.bits = min(22, max(8, int(len(self.e)).bit_length() + 1))
        self.slot = _slot(self.code, self.bits)


def _code(letter, q: int) -> np.ndarray:
    """q letters as a number; a remainder for many letters, which only adds candidates."""
    code = letter(0).astype(np.uint32)
    for r in range(1, q):
        code = code * np.uint32(31) + letter(r)
    return code


def _slot(code: np.ndarray, bits: int) -> np.ndarray:
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def _common(held: Strings, train: Strings, k: np.ndarray, cut: Segments, q: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the held and of the training string for each common segment at an allowed position."""
    for a in range(0, int(cut.high.max()) + 1, STEP):
        near = np.flatnonzero((cut.low < a + STEP) & (cut.high >= a))
        long = np.flatnonzero(train.len >= a + q)
        if not len(near) or not len(long):
            continue
        slots = cut.slot[near]
        ordered = near[np.argsort(slots, kind="stable")]
        ends = np.cumsum(np.bincount(slots, minlength=1 << cut.bits))
        for b in range(0, len(long), STRINGS):
            some = long[b : b + STRINGS]
            window = train.data[np.minimum(train.start[some, None] + a + np.arange(STEP + q - 1), len(train.data) - 1)]
            code = _code(lambda r: window[:, r : r + STEP], q)  # noqa: B023
            last = ends[slot := _slot(code, cut.bits)]
            first = np.where(slot > 0, ends[slot.astype(np.int64) - 1], 0)
            n = np.where(a + np.arange(STEP) + q <= train.len[some, None], last - first, 0).ravel()
            found = np.flatnonzero(n)
            first, code, total = first.ravel(), code.ravel(), np.cumsum(n[found])
            done = 0
            while done < len(found):
                upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + HITS, "right")))
                own, done = found[done:upto], upto
                counts = n[own]
                x = ordered[np.repeat(first[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
                row = np.repeat(own, counts)
                at = a + row % STEP
                ok = (at >= cut.low[x]) & (at <= cut.high[x]) & (cut.code[x] == code[row])
                x, row, at = x[ok], row[ok], at[ok]
                e, t, i = cut.e[x], some[row // STEP], cut.i[x]
                delta, shift = train.len[t] - held.len[e], at - cut.p[x]
                ok = (100 * np.abs(delta) <= percent * np.maximum(train.len[t], held.len[e])) & (np.abs(shift) <= i) & (np.abs(shift - delta) <= k[e] - i)
                yield e[ok].astype(np.int64), t[ok]


def _bags_allow(held: Strings, train: Strings, e: np.ndarray, t: np.ndarray, percent: int) -> np.ndarray:
    """Whether the letters one string has more than the other, either way, are no more than the edits allowed."""
    out = np.empty(len(e), bool)
    for j in range(0, len(e), BAGS):
        x, y = e[j : j + BAGS], t[j : j + BAGS]
        more = np.maximum(held.bag[x] - train.bag[y], 0).sum(1)
        delta = held.len[x] - train.len[y]
        out[j : j + BAGS] = np.maximum(more, more - delta) <= percent * np.maximum(held.len[x], train.len[y]) // 100
    return out


def near_pairs(held: Strings, train: Strings, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the distance and some that are not; a pair comes again only beyond PAIRS pairs."""
    k = percent * (100 * held.len // (100 - percent)) // 100
    size = held.len // (k + 1)
    kept: list[np.ndarray] = []

    def flush() -> tuple[np.ndarray, np.ndarray]:
        pair = np.unique(np.concatenate(kept))
        kept.clear()
        return pair // train.n, pair % train.n

    for q in np.unique(size[size > 0]).tolist():
        for e, t in _common(held, train, k, Segments(held, np.flatnonzero(size == q), k, q, percent), q, percent):
            ok = _bags_allow(held, train, e, t, percent)
            kept.append(np.unique(e[ok] * train.n + t[ok]))
            if sum(map(len, kept)) > PAIRS:
                yield flush()
    if kept:
        yield flush()


def of_group(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows held, sid, res of a group to sid_e, res_e, sid_t, res_t of its pairs."""
    rows = pa.Table.from_batches(batches)
    held, train = (rows.filter(side).combine_chunks() for side in (rows.column("held"), pc.invert(rows.column("held"))))
    if not held.num_rows or not train.num_rows:
        return
    side = {"e": held.select(["sid", "res"]), "t": train.select(["sid", "res"])}
    del rows, held, train
    strings = {s: Strings(x.column("res").combine_chunks()) for s, x in side.items()}
    for e, t in near_pairs(strings["e"], strings["t"], percent):
        for j in range(0, len(e), ROWS):
            own = {s: side[s].take(at[j : j + ROWS]) for s, at in (("e", e), ("t", t))}
            yield from pa.table({f"{c}_{s}": own[s].column(c) for s in own for c in ("sid", "res")}).combine_chunks().to_batches()
