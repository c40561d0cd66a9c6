"""Periodic runs of words: stretches that repeat with a small period at least `times` over, found by longest common extensions.

A text is a list of words. A run is a stretch of consecutive words with smallest period q, of length max(least, times * q) or
more, that no neighbouring word extends with that period. For the pieces of a document in which one can lie:

1. Ukkonen's algorithm builds the suffix tree of the piece and that of its reversal.
2. An Euler tour of a tree lists its leaves and, between two of them, the depth of their lowest common ancestor; the least depth
   over a stretch, from a table of powers of two, is the common extension of any two places in constant time.
3. The longest Lyndon word from each place, in the order of the words and in the reverse one, is the root of every run (each
   run has one in one of the orders): with the root's length as the period, it is extended to the right in the first tree and to the
   left in the second. Both ends are then as far as the period holds.

Which pieces: in a run every three words in a row occur at least times - 1 times, so a document is cut where they don't, again
and again until nothing changes. That loses no run (a run's starts are neighbours and all stay) and leaves most prose without a tree.

Rows are judged by themselves, without a shuffle; the memory of a task follows the longest piece (about 300 bytes a word). A null
text is an empty one and has no runs; a null id stays null; repeated rows and ids give equal rows; further columns are not
read; an empty table gives an empty one. Runs are in order of start, then period, so no ties are left.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mdloom.llm.common import mix, pieces, texts

LEAST, TIMES = 6, 4
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class SuffixTree:
    """Ukkonen's tree of a list of positive numbers, an end mark 0 added; words of the list stand for symbols."""

    def __init__(self, symbols: list[int]) -> None:
        self.text = text = [*symbols, 0]
        self.width = width = max(text) + 1
        n = len(text)
        begin, end, link = array("q", [0]), array("q", [0]), array("q", [0])
        child: dict[int, int] = {}
        node = edge = length = remaining = 0
        for i, c in enumerate(text):
            remaining += 1
            waiting = 0
            while remaining:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    span = end[below] - begin[below]
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    at = begin[below] + length
                    if text[at] == c:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    middle = len(begin)
                    child[key] = middle
                    begin.append(begin[below])
                    end.append(at)
                    link.append(0)
                    child[middle * width + c] = middle + 1
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    begin[below] = at
                    child[middle * width + text[at]] = below
                    if waiting:
                        link[waiting] = middle
                    waiting = middle
                remaining -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - remaining + 1
        keys = np.fromiter(child.keys(), np.int64, len(child))
        below = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)
        self.parent, self.symbol, self.below = keys[order] // width, keys[order] % width, below[order]
        self.labels = np.frombuffer(end, np.int64) - np.frombuffer(begin, np.int64)

    def tour(self, end_first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(the suffixes in the order of an Euler tour, the depth of the lowest common ancestor of each and the next);
        the end mark comes before all other symbols, or after them."""
        n = len(self.text)
        sort = np.arange(len(self.below)) if end_first else np.lexsort((np.where(self.symbol == 0, self.width, self.symbol), self.parent))
        below = self.below[sort].tolist()
        first = np.searchsorted(self.parent, np.arange(len(self.labels) + 1)).tolist()
        labels = self.labels.tolist()
        places, between = array("q"), array("q")
        stack, low = [(0, 0, 0)], 0  # a node, the depth of its parent, and whether it isn't the first child
        while stack:
            node, depth, later = stack.pop()
            if later:
                low = depth
            depth += labels[node]
            a, b = first[node], first[node + 1]
            if a == b:
                between.append(low)
                places.append(n - depth)
            else:
                for k in range(b - 1, a, -1):
                    stack.append((below[k], depth, 1))
                stack.append((below[a], depth, 0))
        return np.array(places, np.int64), np.array(between, np.int64)[1:]


class Extensions:
    """Constant-time longest common extensions of pairs of places of a tree's text."""

    def __init__(self, places: np.ndarray, between: np.ndarray) -> None:
        self.rank = np.empty(len(places), np.int64)
        self.rank[places] = np.arange(len(places))
        self.least = [between.astype(np.int32)]
        while 2 << len(self.least) - 1 <= len(between):
            last, half = self.least[-1], 1 << len(self.least) - 1
            self.least.append(np.minimum(last[: len(last) - half], last[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of places a and b, which differ."""
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << int(k))])
        return out


def next_below(rank: np.ndarray) -> np.ndarray:
    """For each place the first later one with a smaller rank, else their number."""
    values = rank.tolist()
    out, open_ = [len(values)] * len(values), []
    for i, r in enumerate(values):
        while open_ and values[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def runs_of(symbols: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of the runs of a list of symbols, by start and period."""
    n = len(symbols)
    _, dense = np.unique(symbols, return_inverse=True)
    text = (dense + 1).tolist()
    tree = SuffixTree(text)
    places, between = tree.tour(True)
    other, _ = tree.tour(False)
    del tree
    ahead = Extensions(places, between)
    reverse_rank = np.empty(n + 1, np.int64)
    reverse_rank[other] = -np.arange(n + 1)
    start = np.concatenate([np.arange(n)] * 2)
    after = np.concatenate([next_below(ahead.rank)[:n], next_below(reverse_rank)[:n]])
    period = after - start
    keep = period * times <= n
    start, after, period = start[keep], after[keep], period[keep]
    right = ahead.of(start, after)
    back = Extensions(*SuffixTree(text[::-1]).tour(True))
    left = back.of(n - start, n - after)  # what ends just before both
    length = left + period + right
    keep = (length >= least) & (length >= times * period)
    found = np.stack([(start - left)[keep], length[keep], period[keep]], axis=1)
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def candidates(symbols: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """The pieces (start, end) of the documents' concatenated symbols outside which no run can lie."""
    n = len(symbols)
    at = np.arange(max(0, n - 2))
    at = at[doc[at] == doc[at + 2]]  # starts of three words of one document
    piece = doc[at].astype(np.int64)
    three = mix(symbols[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(symbols[at + 1].astype(np.uint64)))
    three = mix(three * np.uint64(0xC2B2AE3D27D4EB4F) + symbols[at + 2].astype(np.uint64))
    while len(at):
        key = mix(three + piece.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], np.diff(key[order]) != 0])
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        often = np.empty(len(key), bool)
        often[order] = np.repeat(size >= times - 1, size)
        kept, old = at[often], piece[often]
        piece = np.cumsum(np.concatenate([[0], (np.diff(kept) != 1) | (np.diff(old) != 0)])) if len(kept) else old
        long = (np.bincount(piece) >= least - 2)[piece] if len(kept) else np.zeros(0, bool)
        done = len(kept) == len(at) and long.all()
        at, piece, three = kept[long], piece[long], three[often][long]
        if done:
            break
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate([[True], np.diff(piece) != 0]))
    last = np.append(first[1:], len(at)) - 1
    return list(zip(at[first].tolist(), (at[last] + 3).tolist(), strict=True))


def find_runs(words: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """Runs of each of several lists of words."""
    numbers: dict[bytes, int] = {}
    sizes = [len(w) for w in words]
    symbols = np.fromiter((numbers.setdefault(x, len(numbers)) for w in words for x in w), np.int64, sum(sizes))
    numbers.clear()
    base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    found: list[list[np.ndarray]] = [[] for _ in words]
    for a, b in candidates(symbols, np.repeat(np.arange(len(words)), sizes), least, times):
        d = int(np.searchsorted(base, a, side="right")) - 1
        found[d].append(runs_of(symbols[a:b], least, times) + np.array([a - base[d], 0, 0]))
    none = np.empty((0, 3), np.int64)
    return [np.concatenate(f) if f else none for f in found]  # pieces are in order, and no two of them hold a start of the same run


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run is cut down to its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: the words joined by one space, without
    those that some run holds after its first period. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = [t.encode().split() for t in batch.column("text").to_pylist()]
            found = find_runs(words, least, times)
            collapsed = [b" ".join(w if not len(r) else [x for x, k in zip(w, kept_words(len(w), r).tolist(), strict=True) if k]).decode() for w, r in zip(words, found, strict=True)]
            flat = np.concatenate(found) if found else np.empty((0, 3), np.int64)
            items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32()), items)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), runs, pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return texts(docs).mapInArrow(run, SCHEMA)
