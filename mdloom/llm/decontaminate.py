"""Benchmark decontamination (4): winnowing.

Every shared span of a window's length holds a k-gram whose hash is the least of its sliding window on both sides, so
joining the least hashes finds each such span; the join's hits are then extended over the words around them, carried along,
and count only where a whole window agrees word for word.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.llm.common import mix, pieces, resident, small_batches, written

WINDOW = 13
#: Bits of the filter for each fingerprint of an item, the powers of two it lies between, and the bits that one task packs.
FILTER_SHARE, FILTER_LEAST, FILTER_MOST, FILTER_PART = 64, 16, 27, 1 << 16
#: Bytes that end a word become spaces; A-Z become a-z; all bytes from 0x80 stay.
FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k successive words."""
    out = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(out)]
    return mix(out)


def shape(n: int) -> tuple[int, int]:
    """(k, w) for windows of n words: k-grams, of which w fill a window."""
    k = (n + 2) // 2
    return k, n - k + 1


def sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each w successive values, by doubling."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = f(x[:-step], x[step:])
        done += step
    return x


def winnowed(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the k-grams that are the least of some window of n words; owner: the text of each word."""
    if len(hashes) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    k, w = shape(n)
    g = grams(hashes, k)
    least = sliding(g, w, np.minimum)
    whole = owner[: len(least)] == owner[n - 1 :]
    least = np.where(whole, least, np.uint64(0))
    edge = np.zeros(w - 1, np.uint64)
    # a k-gram is taken if it equals the least of a window that it lies in: the largest such least is compared
    most = sliding(np.concatenate([edge, least, edge]), w, np.maximum)
    at = np.flatnonzero((g == most[: len(g)]) & (most[: len(g)] > 0))
    return at, g[at]


def fingerprints(lengths: list[int], keep: np.ndarray | None, whole_items: bool):
    """A mapInArrow function: a row per text, fingerprint (n, hash) and words around it, with all its places, or one row
    without; keep: a bit set that holds the hashes of interest."""

    def run(batches):
        import pyarrow as pa

        book = resident(WordHashes)
        for batch in pieces(batches):
            lists = [words_of(t) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            begin = np.cumsum(sizes) - sizes
            hashes = np.fromiter((book[w] for x in lists for w in x), np.uint64, int(sizes.sum()))
            owner = np.repeat(np.arange(len(lists)), sizes)
            rows: dict[tuple, list[int]] = {}
            for n in lengths:
                at, g = winnowed(hashes, owner, n)
                g = g ^ np.uint64(n)
                if whole_items:
                    fit = (sizes[owner[at]] == n) if n < WINDOW else (sizes[owner[at]] >= n)
                    at, g = at[fit], g[fit]
                if keep is not None:
                    bit = (g % np.uint64(8 * len(keep))).astype(np.int64)
                    fit = (keep[bit >> 3] >> (bit & 7)) & 1 > 0
                    at, g = at[fit], g[fit]
                k, _ = shape(n)
                place = at - begin[owner[at]]
                lead = np.minimum(place, n - k)
                for i, h, p, before in zip(owner[at].tolist(), g.astype(np.int64).tolist(), place.tolist(), lead.tolist(), strict=True):
                    rows.setdefault((i, n, h, before, b" ".join(lists[i][p - before : p + n]).decode()), []).append(p)
            seen = {r[0] for r in rows}
            rows.update(((i, None, None, None, None), None) for i in range(len(lists)) if i not in seen)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(cols[0], pa.int64())) for c in ("row", "id")), pa.array(sizes[np.array(cols[0], np.int64)]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(rows.values(), pa.list_(pa.int32())), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())],
                ["row", "id", "n_words", "n", "hash", "places", "lead", "around"],
            )

    return run


SCHEMA = "row long, id long, n_words long, n int, hash long, places array<int>, lead int, around string"


def bit_set(marks: DataFrame) -> np.ndarray:
    """The fingerprints of all items modulo the number of bits, as a bit set. It has FILTER_SHARE bits or more for each of them,
    up to 2 ** FILTER_MOST bits (16 MB); tasks pack a part each, so the driver takes no more than the set's own bytes."""
    bits = 1 << min(FILTER_MOST, max(FILTER_LEAST, (FILTER_SHARE * marks.count()).bit_length()))
    bit = marks.select(F.pmod("b_hash", F.lit(bits)).alias("bit")).distinct()
    parts = bit.groupBy(F.floor(F.col("bit") / FILTER_PART).alias("part")).agg(F.collect_list((F.col("bit") % FILTER_PART).cast("int")).alias("set"))

    def packed(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for found in batch.column("set"):
                flags = np.zeros(FILTER_PART, bool)
                flags[found.values.to_numpy()] = True
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(out, pa.binary())], ["part", "packed"])

    keep = np.zeros(bits // 8, np.uint8)
    size = FILTER_PART // 8
    for r in parts.mapInArrow(packed, "part long, packed binary").toLocalIterator():
        keep[r.part * size : (r.part + 1) * size] = np.frombuffer(r.packed, np.uint8)
    return keep


def runs_of(n: np.ndarray, a, a_lead: np.ndarray, b, b_lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of texts a and b, whose k-grams for windows of n words begin at the words a_lead and b_lead: how many equal
    words stand before and from there on, and whether they fill a window."""
    import pyarrow as pa

    lists = [pa.compute.split_pattern(x, " ") for x in (a, b)]
    codes = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode().indices.to_numpy()  # words as numbers
    back = WINDOW - shape(WINDOW)[0]
    step = np.arange(-back, WINDOW)
    sides, begin = [], 0
    for x, lead, none in zip(lists, (a_lead, b_lead), (-1, -2), strict=True):
        size = pa.compute.list_value_length(x).to_numpy()
        at = lead[:, None] + step
        inside = (at >= 0) & (at < size[:, None])
        first = begin + np.cumsum(size) - size
        sides.append(np.where(inside, codes[np.where(inside, first[:, None] + at, 0)], none))
        begin += int(size.sum())
    same = sides[0] == sides[1]
    before = np.logical_and.accumulate(same[:, :back][:, ::-1], axis=1).sum(axis=1)
    after = np.logical_and.accumulate(same[:, back:], axis=1).sum(axis=1)
    return before, after, (after >= (n + 2) // 2) & (before + after >= n)


def extended(batches):
    """Joined fingerprints to rows with the equal words before and from the k-gram on, or null if they don't fill a window."""
    import pyarrow as pa

    for batch in batches:
        hit = np.flatnonzero(batch.column("b_around").is_valid().to_numpy(zero_copy_only=False))
        found = batch.take(pa.array(hit))
        n, lead, b_lead = (found.column(c).to_numpy() for c in ("n", "lead", "b_lead"))
        before, after, whole = runs_of(n, found.column("around"), lead, found.column("b_around"), b_lead)
        hit = hit[whole]
        sizes, miss = np.zeros((2, batch.num_rows), np.int32), np.ones(batch.num_rows, bool)
        sizes[:, hit], miss[hit] = (before[whole], after[whole]), False
        kept = [pa.compute.if_else(pa.array(~miss), batch.column(c), pa.scalar(None, batch.column(c).type)) for c in ("item", "places")]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("n_words"), *kept, pa.array(sizes[0], mask=miss), pa.array(sizes[1], mask=miss)], ["row", "id", "n_words", "item", "places", "before", "after"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, item_ids (those found, sorted as strings), contaminated.

    Words are runs of ASCII letters (lower-cased), digits and all characters from U+0080; a window is 13 successive words
    of an item, or the whole of a shorter one. Null and empty texts have no words and are clean; items without words match
    nothing, and a null item id counts as no item though its words are hit; items with equal texts are found together, rows
    that repeat an item count once; rows of docs that repeat an id, or have none, are judged one by one; empty tables give no
    rows, or no hits. Ids and texts alone are read, so further columns may have any name. A very long text is taken whole.

    A bit set over the items' fingerprints (`bit_set`, at most 16 MB) thins the documents' fingerprints before the join; a fuller
    set would thin less and lose nothing. A fingerprint that a text repeats with the same words around it is one row of the
    join, so a one-word item makes one row a document; the join's hot hashes are split by adaptive execution.
    """
    small_batches(docs.sparkSession)
    doc = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    item = items.select(F.col(item_col).cast("long").alias("id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"), F.lit(0).cast("long").alias("row"))
    marks = item.mapInArrow(fingerprints(list(range(1, WINDOW + 1)), None, True), SCHEMA).where("hash is not null")
    marks = written(marks.select(F.col("id").alias("item"), F.col("n").alias("b_n"), F.col("hash").alias("b_hash"), F.col("lead").alias("b_lead"), F.col("around").alias("b_around")).distinct(), "fingerprints")
    lengths = sorted(r.b_n for r in marks.select("b_n").distinct().collect())  # at most 13
    hits = doc.mapInArrow(fingerprints(lengths, bit_set(marks), False), SCHEMA)
    hits = hits.withColumn("key", F.coalesce("hash", F.xxhash64("row")))  # rows without a hash spread out
    joined = hits.join(marks, (hits.key == marks.b_hash) & (hits.n == marks.b_n), "left")
    runs = joined.select("row", "id", "n_words", "n", "places", "lead", "around", "item", "b_lead", "b_around").mapInArrow(extended, "row long, id long, n_words long, item long, places array<int>, before int, after int")
    runs = runs.groupBy("row").agg(
        F.first("id").alias("id"),
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("before").isNotNull(), F.struct("places", "before", "after"))).alias("runs"),
        F.array_sort(F.transform(F.collect_set("item"), lambda x: x.cast("string"))).alias("item_ids"),
    )
    hit = F.transform("runs", lambda r: F.flatten(F.transform(r["places"], lambda p: F.sequence(p - r["before"], p + r["after"] - 1))))
    n_hit = F.size(F.array_distinct(F.flatten(hit)))
    out = runs.select(F.col("id").alias("doc_id"), "n_words", n_hit.cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
