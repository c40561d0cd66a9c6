"""Suffix-array dedup (6): a depth-limited most-significant-digit sort of suffixes.

Only the first L bytes of a suffix count, so equal groups are exactly the repeated windows of L bytes. A row for each suffix
would move many times the input; suffixes are taken up where a q-gram's hash is the least of some window of L bytes,
which depends on the window alone, so every repeated window holds the same such anchor in all its places, at one offset.
Passes, each within the groups that the last one left undecided:

1. the anchor's q-gram, dealt over buckets of its hash;
2. the hash of all bytes around the anchor that its windows can hold: where that is equal, all windows are, so all but those of
   the least document are repeated throughout. A task settles what it can of this before the shuffle;
3. for the least document of each such group, if its q-gram has other groups: the bytes themselves. For each offset of the
   anchor the suffixes from the window's start are sorted digit by digit, eight bytes at a time, and only groups that
   still hold two documents go on to the next digit.

The first two passes compare hashes of about 90 bits together (32 of the q-gram, its bucket, 48 of the surroundings): n anchors hold a
false match with odds of about n * n / 2**90, one in 10,000 at n = 3 * 10**11, some 4 TB of text. The third compares bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdloom.llm.common import Ranges, mix, packed_by, partitions, pieces, resident, small_batches, unpack_all, written
from mdloom.llm.decontaminate import sliding

SALT = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
#: gram, around, document, tag, group, place, further places of one run (the last less the first), bytes before and from it
MARKS = ("<u4", "<u8", "<i8", "<i8", "<i4", "<u4", "<u4", "u1", "u1")
PLACES = ("<i8", "<i8", "<i4", "<u4", "<u4", "u1", "u1")
SPANS = ("<i8", "<i8", "<i4", "<u4", "<u4")
#: Kind 0: a repeated span from a to b; kind 1: an anchor at a, and at places up to a + b that look the same, to look at further, with
#: c bytes before it and d from it.
FOUND = "g int, kind int, doc long, tag long, a int, b int, c int, d int"


def tags(texts_: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(t) for t in texts_], np.uint64).astype(np.int64)


def anchors(data: np.ndarray, sizes: np.ndarray, length: int, gram: int, block: int = 1 << 17) -> tuple[np.ndarray, ...]:
    """(document, place in it, bytes of its windows before and from the place, hash of the q-gram, of all those bytes).

    Taken block by block, each with the bytes that windows over its edges need, so memory doesn't follow the longest text.
    """
    ends = np.cumsum(sizes)
    begin = ends - sizes
    w = length - gram + 1
    edge = np.zeros(w - 1, np.uint64)
    out = [(*(np.empty(0, np.int64) for _ in range(4)), *(np.empty(0, np.uint64) for _ in range(2)))]
    for start in range(0, len(data), block):
        low, high = max(0, start - w + 1), min(len(data), start + block + length)
        if high - low < length:
            continue
        owner = np.repeat(np.arange(len(sizes)), np.maximum(np.minimum(ends, high) - np.maximum(begin, low), 0))
        ranges = Ranges(SALT[data[low:high]])
        g = ranges.every(gram)
        least = np.where(owner[: high - low - length + 1] == owner[length - 1 :], sliding(g, w, np.minimum), np.uint64(0))
        most = sliding(np.concatenate([edge, least, edge]), w, np.maximum)[: len(g)]
        at = np.flatnonzero((g == most) & (most > 0))
        at = at[(at >= start - low) & (at < start - low + block)]
        doc = owner[at]
        place = at + low - begin[doc]
        left = np.minimum(length - gram, place)
        right = np.minimum(length, sizes[doc] - place)
        around = mix(ranges.of(at - left, at + right) ^ (left * 256 + right).astype(np.uint64))
        out.append((doc, place, left, right, g[at], around))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """For sorted rows: the index of the first row with the same keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def runs_of(length: int, doc, place, around, gram) -> tuple[np.ndarray, np.ndarray]:
    """(order, further) of anchors by q-gram, surroundings, document and place. Places of one document that look the same and lie
    no further than length apart are one run: the order holds its first, further how far its last is."""
    order = np.lexsort((place, doc, around, gram))
    doc, place, around, gram = doc[order], place[order], around[order], gram[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (around[1:] != around[:-1]) | (gram[1:] != gram[:-1]) | (place[1:] - place[:-1] > length)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(order)]])[: len(first)] - 1
    return order[first], place[last] - place[first]


def refined(group: np.ndarray, digit: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their new groups, from 0) of those whose group still holds two documents when this digit splits it."""
    order = np.lexsort((digit, group))
    g, d = group[order], digit[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    if not len(order):
        return order, order
    at = np.flatnonzero(new)
    several = np.minimum.reduceat(doc[order], at) < np.maximum.reduceat(doc[order], at)
    g = np.cumsum(new) - 1
    keep = several[g]
    return order[keep], g[keep]


def digits(part: np.ndarray) -> np.ndarray:
    """[digit, row]: the rows' bytes, eight at a time, most significant first."""
    wide = np.zeros((len(part), -(-part.shape[1] // 8) * 8), np.uint8)
    wide[:, : part.shape[1]] = part
    return wide.view(">u8").T.astype(np.uint64)


def sorted_groups(rows: np.ndarray, group: np.ndarray, part: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows (and their groups) that share all bytes of part with another document's, by most-significant-digit passes."""
    for digit in digits(part):
        at, group = refined(group, digit[rows], doc[rows])
        rows = rows[at]
    return rows, group


def repeated_windows(table: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) offset before the anchor at which each row's window also is one of a smaller document, or -1; table: the
    bytes around each anchor, length - gram before it and length from it. An anchor's windows all overlap, so its first and last
    repeated ones bound what is removed."""
    reach = length - gram
    first, last = np.full(len(table), -1, np.int64), np.full(len(table), -1, np.int64)
    rows, group = sorted_groups(np.arange(len(table)), np.zeros(len(table), np.int64), table[:, reach : reach + gram], doc)
    for o in range(reach + 1):  # windows that start reach - o bytes before the anchor
        fit = (reach - o <= left[rows]) & (o + gram <= right[rows])
        rest = np.concatenate([table[:, o:reach], table[:, reach + gram : o + length]], 1)
        own, g = sorted_groups(rows[fit], group[fit], rest, doc)
        if len(own):
            order = np.lexsort((doc[own], g))
            own, g = own[order], g[order]
            over = own[doc[own] > doc[own][first_of_runs(g)]]
            first[over] = np.where(first[over] < 0, o, first[over])
            last[over] = o
    return first, last


def repeated_spans(docs: DataFrame, length: int = 50, gram: int = 22, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """One row per document: doc_id, kept (binary: what is left), n_bytes, n_removed, n_spans, and the columns carry.

    as_text: kept is a string; a character that lost some of its bytes goes whole. A byte goes if some window of length bytes over
    it also starts in a document with a smaller id; windows are judged on the input. Null and empty texts have no bytes; texts
    shorter than length stay whole; repeats within one document stay; rows that share an id count as one document, each
    judged by its own text; rows with a null id stay whole and take nothing from others; an empty table gives an empty one.
    length is at most 255. Columns of docs other than id, text and carry aren't read, so they may have any name; carry a
    struct where a name is one of the result's. Anchors are found block by block, but a very long text is cut in one task.

    What moves: about 16 bytes for every 15 bytes of text that has no equal in its task, and the texts twice, beside the anchors whose
    groups are still open and beside the spans that are cut; groups are dealt by hashes of content, so copies of one passage spread over as many buckets as it has anchors, each task sends one of equal
    anchors, and a run of one byte or of a short pattern is one anchor.
    """
    spark = docs.sparkSession
    buckets, groups = 4 * partitions(spark), 4 * partitions(spark)
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)))
    base = base.withColumn("g", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(groups)).cast("int"))
    named = base.where("doc_id is not null").select("g", "doc_id", "text")

    def mark(batches):
        import pyarrow as pa

        resident(tuple)
        for batch in pieces(batches, 1_000_000):
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            sizes = np.array([len(t) for t in raw], np.int64)
            doc, place, left, right, gram_, around = anchors(np.frombuffer(b"".join(raw), np.uint8), sizes, length, gram)
            i, further = runs_of(length, doc, place, around, gram_)
            doc, place, left, right, gram_, around = doc[i], place[i], left[i], right[i], gram_[i], around[i] >> np.uint64(16)
            ids, g, tag = batch.column("doc_id").to_numpy()[doc], batch.column("g").to_numpy()[doc], tags(raw)[doc]
            over = np.zeros(len(ids), bool)  # settled here: an equal anchor of this task has a smaller id
            if len(ids):
                head = first_of_runs(gram_, around)
                at = np.flatnonzero(head == np.arange(len(head)))
                over = ids > np.repeat(np.minimum.reduceat(ids, at), np.diff([*at, len(ids)]))
            spans = merged_spans(ids[over], tag[over], g[over], (place - left)[over], (place + further + right)[over])
            rows = [(-1 - k, blob) for k, blob in packed_by(spans[2].astype(np.int64), *(x.astype(k) for x, k in zip(spans, SPANS, strict=True)))]
            own = np.flatnonzero(~over)
            own = own[np.lexsort((place[own], doc[own]))]  # rows of one document together take less room
            columns = (gram_ >> np.uint64(32), around, ids, tag, g, place, further, left, right)
            rows += packed_by((gram_[own] % np.uint64(buckets)).astype(np.int64), *(x[own].astype(k) for x, k in zip(columns, MARKS, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "marks"])

    def group(key, frame):
        import pandas as pd

        if int(key[0]) < 0:  # settled before the shuffle
            return span_rows(0, *unpack_all(frame["marks"], *SPANS))
        gram_, around, doc, tag, g, place, further, left, right = unpack_all(frame["marks"], *MARKS)
        del frame
        order = np.lexsort((doc, around, gram_))
        gram_, around, doc = gram_[order], around[order], doc[order]
        least = doc[first_of_runs(gram_, around)]
        head = first_of_runs(gram_)
        many = np.zeros(len(doc), bool)  # by the head of each q-gram: two documents and two groups
        np.logical_or.at(many, head, (around != around[head]))
        docs_differ = np.zeros(len(doc), bool)
        np.logical_or.at(docs_differ, head, doc != doc[head])
        over = doc > least
        i = order[over]
        merged = merged_spans(doc[over], tag[i], g[i], place[i].astype(np.int64) - left[i], place[i].astype(np.int64) + further[i] + right[i])
        open_ = ~over & (many & docs_differ)[head]
        i = order[open_]
        return pd.concat([span_rows(0, *merged), span_rows(1, doc[open_], tag[i], g[i], place[i], further[i], left[i], right[i])])

    marks = named.mapInArrow(mark, "bucket int, marks binary")
    found = written(marks.groupBy("bucket").applyInPandas(group, FOUND), "repeats")
    reach = length - gram

    def around(key, text, open_):
        import pandas as pd

        if not len(open_) or not len(text):
            return pd.DataFrame({"bucket": pd.array([], "int32"), "marks": []})
        doc, tag, g, place, further, left, right = (open_[c].to_numpy(k) for c, k in zip(("doc", "tag", "g", "a", "b", "c", "d"), PLACES, strict=True))
        data, begin = joined(text, doc, tag)
        at, span = begin + place, np.arange(-reach, length)
        table = np.zeros((len(at), length + reach), np.uint8)
        for a in range(0, len(at), 4096):  # a block at a time: positions take eight times their bytes
            b = a + 4096
            inside = (span >= -left[a:b].astype(int)[:, None]) & (span < right[a:b].astype(int)[:, None])
            table[a:b] = np.where(inside, data[np.clip(at[a:b, None] + span, 0, len(data) - 1)], 0)
        bucket = mix(Ranges2(SALT[table[:, reach : reach + gram]])) % np.uint64(buckets)
        table = table.view(f"V{length + reach}")[:, 0]
        rows = list(packed_by(bucket.astype(np.int64), doc, tag, g, place, further, left, right, table))
        return pd.DataFrame(rows, columns=["bucket", "marks"]).astype({"bucket": "int32"})

    def windows(key, frame):
        doc, tag, g, place, further, left, right, table = unpack_all(frame["marks"], *PLACES, f"V{length + reach}")
        del frame
        table = np.ascontiguousarray(table).view(np.uint8).reshape(-1, length + reach)
        first, last = repeated_windows(table, doc, left, right, length, gram)
        i = np.flatnonzero(last >= 0)
        start = place[i].astype(np.int64) - reach
        return span_rows(0, *merged_spans(doc[i], tag[i], g[i], start + first[i], start + further[i] + last[i] + length))

    near = named.groupBy("g").cogroup(found.where("kind = 1").groupBy("g")).applyInPandas(around, "bucket int, marks binary")
    single = near.groupBy("bucket").applyInPandas(windows, FOUND)
    spans = found.where("kind = 0").unionByName(single)

    def cut(key, text, spans_):
        import pyarrow as pa

        raw = [t.encode() for t in text.column("text").to_pylist()]
        doc, tag, start, end = (spans_.column(c).to_numpy().astype(np.int64) for c in ("doc", "tag", "a", "b"))
        order = np.lexsort((tag, doc))
        doc, tag, start, end = doc[order], tag[order], start[order], end[order]
        lo = {}
        head = np.flatnonzero(first_of_runs(doc, tag) == np.arange(len(doc))) if len(doc) else np.empty(0, int)
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(doc)][: len(head)], strict=True):
            lo[int(doc[a]), int(tag[a])] = (a, b)
        kept, removed, runs = [], [], []
        for key_, t, mine in zip(text.column("doc_id").to_pylist(), raw, tags(raw).tolist(), strict=True):
            a, b = lo.get((key_, mine), (0, 0))
            if a == b:
                kept.append(t)
                removed.append(0)
                runs.append(0)
                continue
            step = np.zeros(len(t) + 1, np.int32)
            np.add.at(step, start[a:b], 1)
            np.add.at(step, end[a:b], -1)
            gone = np.cumsum(step[:-1]) > 0
            kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
            removed.append(int(gone.sum()))
            runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
        left = pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        columns = [text.column("doc_id"), left, *(pa.array(x, pa.int64()) for x in ([len(t) for t in raw], removed, runs)), *(text.column(f"carried_{i}") for i in range(len(carry)))]
        return pa.Table.from_arrays(columns, ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", *(f"carried_{i}" for i in range(len(carry)))])

    fields = {"doc_id": T.LongType(), "kept": T.StringType() if as_text else T.BinaryType(), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType()}
    fields |= {f"carried_{i}": docs.schema[c].dataType for i, c in enumerate(carry)}
    out = base.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(cut, T.StructType([T.StructField(k, v) for k, v in fields.items()]))
    return out.withColumnsRenamed({f"carried_{i}": c for i, c in enumerate(carry)})


def Ranges2(values: np.ndarray) -> np.ndarray:
    """A hash of each row."""
    return (values * Ranges.power(Ranges.base, values.shape[1])[: values.shape[1]]).sum(1, dtype=np.uint64)


def span_rows(kind: int, doc, tag, g, a, b, c=0, d=0):
    """Rows, not arrays by group: their number follows the text, not the buckets times the groups."""
    import pandas as pd

    return pd.DataFrame({"g": g, "kind": kind, "doc": doc, "tag": tag, "a": a, "b": b, "c": c, "d": d}).astype({k: "int32" for k in ("g", "kind", "a", "b", "c", "d")})


def merged_spans(doc, tag, g, start, end):
    """Spans of one document that touch or overlap, joined: (doc, tag, g, start, end)."""
    order = np.lexsort((start, tag, doc))
    doc, tag, g, start, end = doc[order], tag[order], g[order], start[order], end[order]
    if not len(doc):
        return doc, tag, g, start, end
    first = first_of_runs(doc, tag)
    shift = np.cumsum(first == np.arange(len(doc))) * (1 << 33)  # documents apart, so one running maximum serves all
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + shift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(doc)]]) - 1
    return doc[at], tag[at], g[at], start[at], (reach - shift)[last]


def joined(text, doc: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group's texts end to end, and where the text of each (doc, tag) begins."""
    raw = [t.encode() for t in text["text"]]
    sizes = np.array([len(t) for t in raw], np.int64)
    begin = np.cumsum(sizes) - sizes
    known = {(int(k), int(m)): i for i, (k, m) in enumerate(zip(text["doc_id"], tags(raw), strict=True))}
    at = np.array([known[d, m] for d, m in zip(doc.tolist(), tag.tolist(), strict=True)], np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), begin[at]
