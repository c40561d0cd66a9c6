"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SCHEMA = "doc_id long, text string"
HEAVIEST = 1000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BROADCAST_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB between Spark and its Python workers, in place of Spark's own 64 MB; another value that the
    session has is left alone. Texts are long, and a task holds several batches on both sides."""
    if spark.conf.get(BATCH_BYTES, None) in ("67108864", "67108864b", "64m", "64MB"):
        spark.conf.set(BATCH_BYTES, "4m")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text is an empty one."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


MADE: list[list[str]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; where that is unset, a local one is set in
    local mode (tests), and elsewhere it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[[^,\]]*(,[^,\]]*)?\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/mdloom/{name}-{uuid.uuid4().hex}"
    for made in MADE:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, the shared folders made meanwhile; what was read from them must be written by then."""
    MADE.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in MADE.pop():
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back: cuts the lineage and outlives lost executors. The shuffle files of the write go
    at its end, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path, before = shared_dir(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def sent_if_few(rows: DataFrame) -> DataFrame:
    """Rows, broadcast if there are at most BROADCAST_IDS, which is counted; they should be written."""
    return F.broadcast(rows) if rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else rows


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id (null counts as one) isn't in ids, a column of longs named gone. The ids are broadcast if there are at
    most BROADCAST_IDS, which is counted; else both sides are shuffled."""
    ids = written(ids.distinct(), "ids")
    return docs.join(sent_if_few(ids), F.col(id_col).cast("long").eqNullSafe(ids.gone), "left_anti")


RESIDENT: list = [None, None]


def resident(make, *args):
    """make(*args), kept in this process for its further tasks until another one is asked for: a worker holds one at a time."""
    key = (make, args)
    if RESIDENT[0] != key:
        RESIDENT[:] = None, None
        give_back()
        RESIDENT[:] = key, make(*args)
    return RESIDENT[1]


def trim() -> None:
    """Memory freed by arrays goes back to the system, where the C library can do that; takes some milliseconds."""
    import contextlib
    import ctypes

    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def give_back() -> None:
    """All freed memory goes to the system, as far as the C library can do that."""
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_counted(df: DataFrame, by_key: DataFrame, on: list[str], count: str) -> DataFrame:
    """df joined with one row for each of its keys, which holds in column count how many rows of df have that key (or a bound).

    The keys with most rows are broadcast; any other has at most a HEAVIEST-th of df, so that no task of the join that
    shuffles follows one key's rows.
    """
    top = written(by_key.orderBy(F.desc(count), *on).limit(HEAVIEST), "heaviest")
    out = df.join(F.broadcast(top), on)
    rest = by_key.join(F.broadcast(top.select(on)), on, "left_anti")
    if rest.isEmpty():
        return out
    return out.unionByName(df.join(F.broadcast(top.select(on)), on, "left_anti").join(rest, on))


def pieces(batches: Iterable[pa.RecordBatch], max_bytes: int = 700_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches with a column text, cut so that each holds about max_bytes of it (or one document). After each batch the
    memory that its pieces freed goes back, so that workers that wait for tasks don't hold it."""
    for batch in batches:
        size = np.cumsum(pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + max_bytes, side="right")))
            yield batch.slice(at, end - at)
            at = end
        trim()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads what a sum or product has put together."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1 ... start+length-1 of all ranges, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every end of the undirected edges (a, b) of longs; component is the smallest node it reaches.

    Each round sends the smallest known neighbour both ways and then jumps to that neighbour's own label, so that long
    chains halve; a node's messages are reduced before the shuffle. Labels are written to the shared folder each round.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(both.a.alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        step = written(step, f"{name}-step")
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "old")
        moved = written(moved, f"{name}-labels")
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length as compressed bytes, byte planes apart (high bytes are alike)."""
    out = []
    for c in columns:
        c = np.ascontiguousarray(c)
        planes = c.view(np.uint8).reshape(len(c), -1).T.tobytes() if len(c) else b""
        out.append(planes)
    raw = b"".join(out)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else (0).to_bytes(8, "little")


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    widths = [np.dtype(k).itemsize for k in kinds]
    if not n:
        return [np.empty(0, k) for k in kinds]
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * sum(widths), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind, width in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind)[:, 0])
        at += n * width
    return out


def unpack_all(blobs: Iterable[bytes], *kinds: str) -> list[np.ndarray]:
    resident(tuple)  # a group's arrays are large, so nothing else stays beside them
    parts = [unpack(b, *kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, k) for i, k in enumerate(kinds)]


def packed_by(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, packed columns of its rows), rows in their order."""
    order = np.argsort(key, kind="stable")
    kept = key[order]
    cuts = np.flatnonzero(np.diff(kept)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(kept)], strict=True):
        if b > a:
            yield int(kept[a]), pack(*(c[order[a:b]] for c in columns))


class Ranges:
    """Hashes of any range of a sequence of 64-bit values, by prefix sums modulo 2**64."""

    base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
    powers = {base: np.ones(1, np.uint64), inverse: np.ones(1, np.uint64)}

    @classmethod
    def power(cls, base: np.uint64, n: int) -> np.ndarray:
        if len(cls.powers[base]) < n:
            cls.powers[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
        return cls.powers[base]

    def __init__(self, values: np.ndarray) -> None:
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power(self.base, len(values))[: len(values)], out=self.total[1:])
        self.back = self.power(self.inverse, len(values) + 1)

    def every(self, length: int) -> np.ndarray:
        """Of each range of this length."""
        n = len(self.total) - length
        return mix((self.total[length:] - self.total[:n]) * self.back[:n]) if n > 0 else np.empty(0, np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.back[start])
