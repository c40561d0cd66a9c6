"""Packing (7): shortest-pack-first over the length histogram."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mdloom.llm.common import pieces, resident, texts, written

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, chunk long, nth long"


def pack_histogram(histogram: dict[int, int], limit: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(slots, sequences) for a histogram {length: pieces}.

    A slot (length, first, count, sequence, offset) says that the pieces of that length with ranks first to
    first + count - 1 lie at offset of the sequences sequence, sequence + 1 ... Lengths go longest first, each into the
    least filled packs that have room; a group of equal packs splits when only some of them get a piece. There are at most
    two groups more for each length and turn, whatever the number of pieces.
    """
    groups: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = {}  # filled -> [(packs, [(length, first rank, offset)])]
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            filled = min((f for f in groups if f + length <= limit), default=None)
            if filled is None:
                groups.setdefault(length, []).append((left, [(length, rank, 0)]))
                break
            packs, slots = groups[filled].pop()
            if not groups[filled]:
                del groups[filled]
            n = min(left, packs)
            if n < packs:
                groups.setdefault(filled, []).append((packs - n, [(x, first + n, at) for x, first, at in slots]))
            groups.setdefault(filled + length, []).append((n, [*slots, (length, rank, filled)]))
            left, rank = left - n, rank + n
    out, sequence = [], 0
    for filled in sorted(groups, reverse=True):
        for packs, slots in groups[filled]:
            out.extend((length, first, packs, sequence, at) for length, first, at in slots)
            sequence += packs
    return out, sequence


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids, with end_id after them, are cut every limit ids; null and empty texts are one id; a very long text is
    many pieces. Repeated rows and null ids are packed like others; pieces of one length are placed in the order of the
    table; an empty table gives an empty one; only the id and the text are read, so further columns may have any name.
    Texts are encoded once, into a small table of pieces in the shared folder; a piece's rank among those of its length is
    prefix sums of counts, over the partitions, over the chunks of its partition and within its chunk. What the first of
    these takes to one task is a row per partition, never the pieces. The driver sees the histogram: one row per length, at
    most limit.
    """
    spark = docs.sparkSession

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from mdloom.llm.words import id_book

        part = TaskContext.get().partitionId()
        for n, batch in enumerate(pieces(batches)):
            ids, sizes = resident(id_book, tokenizer_path, end_id).encode(batch.column("text").to_pylist())
            raw, ends = ids.astype("<u4"), np.cumsum(sizes)
            count = -(-sizes // limit)
            doc = np.repeat(np.arange(len(sizes)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * limit
            length = np.minimum(limit, sizes[doc] - start)
            first = (ends - sizes)[doc] + start
            crc = [zlib.crc32(raw[a : a + k].tobytes()) for a, k in zip(first, length, strict=True)]
            order = np.argsort(length, kind="stable")
            kept = length[order]
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - np.searchsorted(kept, kept)
            chunk = np.full(len(doc), (part << 32) + n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(chunk), pa.array(nth)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "chunk", "nth"])

    cuts = written(texts(docs, id_col, text_col).mapInArrow(cut, PIECES), "pieces")
    part = F.shiftright("chunk", 32)
    counts = written(cuts.groupBy("length", "chunk").agg(F.count("*").alias("n")).withColumn("part", part), "counts")
    parts = counts.groupBy("length", "part").agg(F.sum("n").alias("n"))
    parts = parts.withColumn("earlier", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    before = counts.withColumn("base", F.sum("n").over(W.partitionBy("length", "part").orderBy("chunk")) - F.col("n")).join(parts, ["length", "part"])
    before = before.select("length", "chunk", (F.col("base") + F.col("earlier")).alias("base"))
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = pack_histogram(histogram, limit)
    slots.sort()
    where = {}
    for length in histogram:
        own = [s for s in slots if s[0] == length]
        where[length] = tuple(np.array([s[i] for s in own], np.int64) for i in (1, 3, 4))
    shared = spark.sparkContext.broadcast(where)  # at most a few slots for each group of packs: bounded by limit alone

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            rank = batch.column("base").to_numpy() + batch.column("nth").to_numpy()
            length = batch.column("length").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                at = length == x
                first, seq, off = shared.value[int(x)]
                slot = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = seq[slot] + rank[at] - first[slot], off[slot]
            columns = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            columns[2] = columns[2].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = cuts.join(before, ["length", "chunk"])
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
