"""LM scoring (1): a log-frequency Bloom filter of n-gram counts.

A count c is quantised to level 1 + floor(log_b c), and (n-gram, 1), (n-gram, 2) ... up to its level go into the filter; the
level of an n-gram is how many of these are found, one after the other. The filter is cut into pages by ranges of the
n-gram's hash; the worker that counts a page's bigrams also writes it, as a file of the shared folder.

The model is P(w | h) = (q(hw) + N(h) P(w)) / (T(h) + N(h)): q is a bigram's count from the filter, P(w) the add-half unigram,
and T(h) and N(h) are the sum of q and the number of the bigrams that begin with h, kept with the exact count of h in a table of
words beside each page. So the sum over all w, unknown ones included, is 1 but for false finds. The first level has PROBES
probes, which lets one of 2**30 absent bigrams through: with V words a context gains at most V / 2**30 / (T + N), under a
thousandth up to V = 1,000,000. Further levels have MORE_PROBES, and overstate T by at most half a hundredth.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.llm.common import mix, packed_by, partitions, pieces, resident, shared_dir, small_batches, unpack_all, written
from mdloom.llm.decontaminate import WordHashes
from mdloom.llm.token_files import _place

BASE, PROBES, MORE_PROBES = 1.5, 30, 8
LEVELS = 64
END = b""  # no word is empty
BLOCK = 1 << 15


def level_values() -> np.ndarray:
    """The mean count of each level; level 0 is a count of 0."""
    out = [0.0]
    for j in range(1, LEVELS):
        low, high = int(np.ceil(BASE ** (j - 1) - 1e-9)), int(np.ceil(BASE**j - 1e-9)) - 1
        out.append((low + max(low, high)) / 2)
    return np.array(out)


VALUES = level_values()


def level_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


def bucket_of(g: np.ndarray, buckets: int) -> np.ndarray:
    """By ranges, so that sorted hashes visit the buckets in order."""
    return ((g >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def spots(g: np.ndarray, level: int, first: int, last: int, size: int) -> np.ndarray:
    """[n-gram, probe]: the bits of probes first to last - 1."""
    seed = g + np.uint64(0x9E3779B97F4A7C15 * level % 2**64)
    a, b, c = (mix(seed ^ np.uint64(s)) for s in (0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
    i = np.arange(first, last, dtype=np.uint64)
    x = a[:, None] + i * b[:, None] + i * i * c[:, None]
    return ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def page_of(g: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bit set of a bucket's n-grams, half of it set, as bytes."""
    levels = level_of(count)
    more = int(levels.sum()) - len(g)
    flags = np.zeros(64 + int((PROBES * len(g) + MORE_PROBES * more) / np.log(2)) // 8 * 8, bool)
    for j in range(1, int(levels.max(initial=0)) + 1):
        own = g[levels >= j]
        for at in range(0, len(own), BLOCK):
            flags[spots(own[at : at + BLOCK], j, 0, PROBES if j == 1 else MORE_PROBES, len(flags))] = True
    return np.packbits(flags, bitorder="little")


def probe(g: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The level of each n-gram in one page."""
    size = len(bits) * 8

    def found(own: np.ndarray, level: int, first: int, last: int) -> np.ndarray:
        at = spots(own, level, first, last, size)
        return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)

    level = np.zeros(len(g), np.int64)
    for lo in range(0, len(g), BLOCK):
        alive = np.arange(lo, min(lo + BLOCK, len(g)))
        alive = alive[found(g[alive], 1, 0, 4)]  # most absent ones go here
        alive = alive[found(g[alive], 1, 4, PROBES)]
        j = 1
        while len(alive):
            level[alive] = j
            j += 1
            alive = alive[found(g[alive], j, 0, MORE_PROBES)] if j < LEVELS else alive[:0]
    return level


def save(folder: str, name: str, *columns: np.ndarray) -> None:
    """A flat file, under a name of its own attempt first, so a task that runs twice leaves whole files."""
    import uuid

    fs, root = _place(folder)
    mine = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(mine) as f:
        for c in columns:
            f.write(np.ascontiguousarray(c).tobytes())
    fs.move(mine, f"{root}/{name}")


class Model:
    """The files of a folder: memory-mapped where the folder is a local path, else read one by one when needed."""

    def __init__(self, folder: str, buckets: int) -> None:
        self.fs, self.root = _place(folder)
        self.buckets, self.maps = buckets, {}

    def file(self, name: str) -> np.ndarray:
        if name in self.maps:
            return self.maps[name]
        path = f"{self.root}/{name}"
        if not self.fs.get_file_info(path).size:
            data = np.empty(0, np.uint8)
        elif self.fs.type_name == "local":
            data = self.maps[name] = np.memmap(path, np.uint8, "r")
        else:
            with self.fs.open_input_file(path) as f:
                data = np.frombuffer(f.readall(), np.uint8)
        return data

    def by_bucket(self, g: np.ndarray):
        """(bucket, slice of g) for sorted g."""
        cuts = np.searchsorted(bucket_of(g, self.buckets), np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            yield b, slice(cuts[b], cuts[b + 1])

    def words(self, g: np.ndarray) -> np.ndarray:
        """[count, T, N] of each of the sorted distinct words."""
        out = np.zeros((3, len(g)))
        for b, own in self.by_bucket(g):
            table = self.file(f"{b}.words").view("<u8").reshape(4, -1)
            if table.shape[1]:
                at = np.minimum(np.searchsorted(table[0], g[own]), table.shape[1] - 1)
                hit = table[0][at] == g[own]
                for k in (0, 1, 2):
                    out[k, own] = np.where(hit, table[k + 1][at], 0)
        out[1] /= 2
        return out

    def levels(self, g: np.ndarray) -> np.ndarray:
        """The level of each of the sorted distinct bigrams."""
        out = np.zeros(len(g), np.int64)
        for b, own in self.by_bucket(g):
            bits = self.file(f"{b}.page")
            if len(bits):
                out[own] = probe(g[own], bits)
        return out


@functools.lru_cache(maxsize=1)
def opened(folder: str, buckets: int) -> Model:
    """One model in each process, for all its tasks."""
    return Model(folder, buckets)


def token_hashes(texts_: list[str], book: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, an end after each text; tokens of each text)."""
    lists = [[*t.encode().lower().split(), END] for t in texts_]
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((book[w] for x in lists for w in x), np.uint64, int(sizes.sum())), sizes


def pair_hash(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + tokens)


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sum of each column."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[new], *(np.add.reduceat(c[order], new) if len(new) else c for c in columns)


def train(texts_: DataFrame, folder: str) -> tuple[int, int, int]:
    """Count the tokens of column text, write the model's files; (buckets, distinct tokens, tokens).

    Each task sends its own counts, packed by bucket; a bucket holds one range of word and bigram hashes, so no word, however
    frequent, takes more than a row per task there. A context's bigrams lie in all buckets; each sends one partial T and N.
    """
    spark = texts_.sparkSession
    buckets = 2 * partitions(spark)

    def count(batches):
        import pyarrow as pa

        book = resident(WordHashes)
        for batch in pieces(batches, 8_000_000):
            tokens, _ = token_hashes(batch.column("text").to_pylist(), book)
            before = np.concatenate([[np.uint64(book[END])], tokens[:-1]]).astype(np.uint64)
            g, n = np.unique(tokens, return_counts=True)
            rows = [(b, 0, raw) for b, raw in packed_by(bucket_of(g, buckets), g, n.astype("<u4"))]
            g, at, n = np.unique(pair_hash(before, tokens), return_index=True, return_counts=True)
            rows += [(b, 1, raw) for b, raw in packed_by(bucket_of(g, buckets), g, before[at], n.astype("<u4"))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "grams"])

    def build(key, frame):
        import pandas as pd

        g, h, n = unpack_all(frame["grams"][frame["kind"] == 1], "<u8", "<u8", "<u4")
        order = np.argsort(g, kind="stable")
        g, h, n = g[order], h[order], n[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, int)
        h, n, g = h[new], np.add.reduceat(n, new) if len(new) else n, g[new]
        if len(g):
            save(folder, f"{int(key[0])}.page", page_of(g, n))
        h, t, n = summed(h, (2 * VALUES[level_of(n)]).astype(np.int64), np.ones(len(h), np.int64))
        parts = [(b, 1, raw) for b, raw in packed_by(bucket_of(h, buckets), h, t, n)]
        w, c = unpack_all(frame["grams"][frame["kind"] == 0], "<u8", "<u4")
        w, c = summed(w, c.astype(np.int64))
        return pd.DataFrame([*parts, *([(int(key[0]), 0, next(packed_by(np.zeros(len(w), np.int64), w, c))[1])] if len(w) else [])], columns=["bucket", "kind", "grams"]).astype({"bucket": "int32", "kind": "int32"})

    def finish(key, frame):
        import pandas as pd

        w, c = unpack_all(frame["grams"][frame["kind"] == 0], "<u8", "<i8")
        h, t, n = summed(*unpack_all(frame["grams"][frame["kind"] == 1], "<u8", "<i8", "<i8"))
        at = np.searchsorted(w, h)  # a context is a token, so it is there
        sums = np.zeros((2, len(w)), np.int64)
        sums[:, at] = t, n
        save(folder, f"{int(key[0])}.words", w.astype("<u8"), c.astype("<u8"), *sums.astype("<u8"))
        return pd.DataFrame({"v": [len(w)], "n": [int(c.sum())]})

    fs, root = _place(folder)
    fs.create_dir(root, recursive=True)
    grams = "bucket int, kind int, grams binary"
    built = texts_.select("text").mapInArrow(count, grams).groupBy("bucket").applyInPandas(build, grams)
    total = written(built.groupBy("bucket").applyInPandas(finish, "v long, n long"), "model").agg(F.sum("v"), F.sum("n")).first()
    return buckets, total[0] or 0, total[1] or 0


SCORES = "doc_id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, training, n_tokens, n_known, train_tokens, base_score, score.

    training: a boolean column over docs; rows where it is null don't train. Tokens are runs other than ASCII blanks, A-Z as
    a-z, then one end; null and empty texts are an end alone. Repeated rows are counted and scored one by one, null ids too;
    with nothing to learn from, scores are those of the add-half unigram over no tokens; an empty table gives an empty one.
    Only the id, the text and what training names are read, so further columns may have any name. A very long text is
    tokenised whole; a task holds about 4 MB of text, or one document.

    Every worker takes the model from the shared folder, not from the driver: a batch's distinct words and bigrams are
    sorted and held against the pages in order. One way for every size, with memory for a batch and what is mapped of the pages.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    folder = shared_dir(spark, "language-model")
    buckets, v, n_train = train(base.where("training"), folder)

    def score(batches):
        import pyarrow as pa

        book, model = resident(WordHashes), opened(folder, buckets)
        for batch in pieces(batches, 4_000_000):
            tokens, sizes = token_hashes(batch.column("text").to_pylist(), book)
            distinct, at = np.unique(tokens, return_inverse=True)
            count, total, kinds = model.words(distinct)
            unigram = (count + 0.5) / (n_train + 0.5 * (v + 1))
            before = np.concatenate([[np.searchsorted(distinct, np.uint64(book[END]))], at[:-1]])
            seen = np.flatnonzero((count[at] > 0) & (kinds[before] > 0))
            pairs, of = np.unique(pair_hash(distinct[before[seen]], tokens[seen]), return_inverse=True)
            q = np.zeros(len(tokens))
            q[seen] = VALUES[model.levels(pairs)][of]
            p = probability(q, total[before], kinds[before], unigram[at])
            ends = np.cumsum(sizes)
            each = [np.add.reduceat(x, ends - sizes) for x in (np.log10(unigram)[at], np.log10(p), (count > 0)[at].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("training"), pa.array(sizes), pa.array(each[2]), pa.array(np.full(len(sizes), n_train)), pa.array(each[0]), pa.array(each[1])], ["doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return base.mapInArrow(score, SCORES)


def probability(q, total, kinds, unigram):
    """A context that was never seen has the unigram's."""
    return np.where(kinds > 0, (q + kinds * unigram) / np.maximum(total + kinds, 1), unigram)
