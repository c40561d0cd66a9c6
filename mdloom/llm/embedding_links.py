"""Embedding near-duplicates (10): a subspace pigeonhole join.

Unit vectors with cosine >= c have a squared distance of at most b = 2 - 2c. Vectors are turned by one random rotation and
cut into blocks; of two such vectors, some block's squared distance is at most its share of b, in proportion to its
width. Each block is range-joined under that budget. A tree of medians, taken over the block's coordinates in turn from a
bounded sample, makes its cells; the sample settles only how even they are. A vector is at home in one cell and visits those
after it whose box lies within the radius, so two vectors meet in one cell alone. Within a cell, strips of like vectors
meet only those within the radius along each coordinate. The union of what the blocks propose is checked in double precision;
a pair counts in the first block that proposes it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.llm.common import components, join_counted, partitions, written

CHUNK, SEATS, LEAF, STRIP = 8000, 1 << 20, 6000, 32
LEAST_SEATS, SAMPLE = 500, 16_384
SLACK = 1e-7


def blocks_of(dim: int, width: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dim), max(1, dim // width))


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Grid:
    """The blocks of vectors of one length, and the cells of each."""

    def __init__(self, dim: int, width: int, budget: float, depth: int = 0, sample: np.ndarray | None = None) -> None:
        """sample: unit vectors, turned by the rotation."""
        self.blocks = blocks_of(dim, width)
        self.radius = [np.sqrt(budget * len(b) / dim) + SLACK for b in self.blocks]
        self.depth = depth if sample is not None and len(sample) else 0
        self.medians = [self.tree(sample[:, b]) if self.depth else np.empty(0) for b in self.blocks]

    def tree(self, x: np.ndarray) -> np.ndarray:
        """The splitting value of each inner node, children of k at 2 k + 1 and 2 k + 2."""
        out, node = np.zeros(2**self.depth - 1), np.zeros(len(x), np.int64)
        for level in range(self.depth):
            v = x[:, level % x.shape[1]]
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = v[node == k]
                out[k] = np.median(own) if len(own) else 0.0
            node = 2 * node + 1 + (v >= out[node])
        return out

    def cells(self, turned: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, cell, whether it is at home there) of each home and of each visit to a later cell."""
        x, medians, limit = turned[:, self.blocks[block]], self.medians[block], self.radius[block] ** 2
        who, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        home, gap = np.ones(len(x), bool), np.zeros(x.shape)  # gap: from the vector to the box, along each coordinate
        for level in range(self.depth):
            axis = level % x.shape[1]
            d = x[who, axis] - medians[node]
            across = gap.copy()
            across[:, axis] = np.abs(d)
            go = (across * across).sum(1) <= limit
            own, other = 2 * node + 1 + (d >= 0), 2 * node + 1 + (d < 0)
            who, node = np.concatenate([who, who[go]]), np.concatenate([own, other[go]])
            home, gap = np.concatenate([home, np.zeros(int(go.sum()), bool)]), np.concatenate([gap, across[go]])
        at_home = np.empty(len(x), np.int64)
        at_home[who[home]] = node[home]
        keep = home | (node > at_home[who])
        return who[keep], node[keep] - (2**self.depth - 1), home[keep]


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def strips(x: np.ndarray, y: np.ndarray, radius: float):
    """(rows of x, rows of y) that hold all pairs within radius: x is halved at medians of its coordinates in turn, and each
    part takes the rows of y within radius of its own range."""
    stack = [(np.arange(len(x)), np.arange(len(y)), 0)]
    while stack:
        i, j, level = stack.pop()
        if len(i) <= STRIP or level >= 4 * x.shape[1]:
            yield i, j
            continue
        axis = level % x.shape[1]
        v, other = x[i, axis], y[j, axis]
        low = v < np.median(v)
        for part in (i[low], i[~low]):
            if len(part):
                own = x[part, axis]
                stack.append((part, j[(other >= own.min() - radius) & (other <= own.max() + radius)], level + 1))


def linked(home: np.ndarray, others: np.ndarray, grid: Grid, turn: np.ndarray, block: int, threshold: float, same: np.ndarray | None = None):
    """(i, j) of the pairs that this block proposes first and whose cosine reaches the threshold. same: where each of home lies in
    others, if all do; each pair of these then comes once."""
    a, b = home @ turn, others @ turn
    at, radius = grid.blocks[block], grid.radius[block]
    a32, b32 = a[:, at].astype(np.float32), b[:, at].astype(np.float32)
    one = np.ones((1, 1), np.float32)
    left = np.concatenate([-2 * a32, (a32 * a32).sum(1)[:, None], np.repeat(one, len(a), 0)], 1)
    right = np.concatenate([b32, np.repeat(one, len(b), 0), (b32 * b32).sum(1)[:, None]], 1)
    limit = np.float32(radius**2 + 1e-5)
    done = np.zeros(len(b), bool)
    for rows, columns in strips(a[:, at], b[:, at], radius):
        if same is not None:
            columns = columns[~done[columns]]
            done[same[rows]] = True
        near = left[rows] @ right[columns].T <= limit
        i, j = np.divmod(np.flatnonzero(near), len(columns)) if len(columns) else (rows[:0], rows[:0])
        for s in range(0, len(i), 20_000):
            p, q = rows[i[s : s + 20_000]], columns[j[s : s + 20_000]]
            fit = np.einsum("ij,ij->i", home[p], others[q]) >= threshold
            p, q = p[fit], q[fit]
            if same is not None:  # within a strip, from the smaller place
                own = np.full(len(b), -1)
                own[same[rows]] = rows
                once = (own[q] < 0) | (own[q] > p)
                p, q = p[once], q[once]
            square = (a[p] - b[q]) ** 2
            first = np.full(len(p), -1)
            for k in range(len(grid.blocks) - 1, -1, -1):
                first[square[:, grid.blocks[k]].sum(1) <= grid.radius[k] ** 2] = k
            yield p[first == block], q[first == block]


def join_roots(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Join the trees of the pairs (p, q) in place; each points at its smallest member."""
    while len(p):
        a, b = root[p], root[q]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root[:] = up
        apart = root[p] != root[q]
        p, q = p[apart], q[apart]


def embedding_links(vectors: DataFrame, threshold: float = 0.95, width: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null id, link with nothing
    and are their own component; so do vectors of different lengths with each other. Equal vectors are joined once and
    counted as often as they occur, rows that repeat an id included; a cosine of just the threshold links; an empty table gives an
    empty one. Only the id and the vector are read, so further columns may have any name.

    The cells' medians come from about SAMPLE distinct vectors; which pairs meet doesn't hang on them. Homes in a cell are dealt in
    chunks of about CHUNK and all its vectors in chunks of about SEATS numbers; a task holds one of each, whatever the
    cell's size, and only sums and one edge for each vector leave it.
    """
    spark = vectors.sparkSession
    narrow = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    kind = "<f4" if narrow else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if narrow else "array<double>").alias("v"))

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            raw = []
            for v, key in zip(batch.column("v"), batch.column("vec_id"), strict=True):
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) if v.is_valid and key.is_valid else np.empty(0, kind)
                raw.append((x + np.zeros(1, kind)).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    packed = written(rows.mapInArrow(pack, "vec_id long, raw binary").withColumn("key", F.sha2("raw", 256)), "vectors")
    classes = written(packed.where("raw is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("raw").alias("raw")), "classes")
    budget = 2 - 2 * threshold
    size = np.dtype(kind).itemsize
    dims = (F.length("raw") / size).cast("int")
    counts = {r.dim: r["count"] for r in classes.groupBy(dims.alias("dim")).count().collect()}  # a row per length of vectors
    share = min(1.0, SAMPLE / max(1, sum(counts.values())))
    picked: dict[int, list[bytes]] = {}
    for r in classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("raw").collect():  # about SAMPLE rows
        picked.setdefault(len(r.raw) // size, []).append(bytes(r.raw))
    grids = {}
    for dim, n in counts.items():
        own = picked.get(dim, [])
        depth = max(0, min(int(np.ceil(np.log2(n / LEAF))), int(np.log2(max(8, len(own)) / 8))))
        grids[dim] = Grid(dim, width, budget, depth, unit(own, kind) @ rotation(dim) if own else None)

    def cells(batches):
        import pyarrow as pa

        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            long = np.array([len(r) // size for r in raw])
            for dim in np.unique(long).tolist():
                if dim not in turns:
                    turns[dim] = rotation(dim)
                which = np.flatnonzero(long == dim)
                turned = unit([raw[i] for i in which], kind) @ turns[dim]
                for block in range(len(grids[dim].blocks)):
                    who, cell, home = grids[dim].cells(turned, block)
                    at = pa.array(which[who])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), dim, np.int32)), pa.array(np.full(len(who), block, np.int32)), pa.array(cell), pa.array(home), *(batch.column(c).take(at) for c in ("id", "n", "raw"))], ["dim", "block", "cell", "home", "id", "n", "raw"])

    dealt = written(classes.repartition(partitions(spark)).mapInArrow(cells, "dim int, block int, cell long, home boolean, id long, n long, raw binary"), "cells")
    sizes = dealt.groupBy("dim", "block", "cell").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes"))
    seats = F.greatest(F.lit(LEAST_SEATS), F.floor(F.lit(SEATS) / F.col("dim")))
    sizes = sizes.withColumn("homes", F.ceil(F.col("homes") / CHUNK)).withColumn("others", F.ceil(F.col("rows") / seats))
    tasks = join_counted(dealt, written(sizes, "sizes"), ["dim", "block", "cell"], "rows").where("homes > 0")
    own, seat = F.pmod(F.xxhash64("id"), "homes"), F.pmod(F.xxhash64("id", F.lit(3)), "others")

    def upto(c: str):
        return F.sequence(F.lit(0).cast("long"), F.col(c) - 1)

    as_home = F.when(F.col("home"), F.transform(upto("others"), lambda o: F.struct(own.alias("chunk"), o.alias("other"))))
    as_other = F.transform(upto("homes"), lambda h: F.struct(h.alias("chunk"), seat.alias("other")))
    tasks = tasks.withColumn("own", own).withColumn("seat", seat).withColumn("at", F.explode(F.array_distinct(F.concat(F.coalesce(as_home, F.array().cast("array<struct<chunk:long,other:long>>")), as_other))))
    tasks = tasks.select("dim", "block", "cell", "at.chunk", "at.other", "home", (F.col("home") & (F.col("own") == F.col("at.chunk"))).alias("chosen"), (F.col("seat") == F.col("at.other")).alias("seated"), "id", "n", "raw")

    def join(key, frame):
        """Rows (a, a, links of a found here) and (a, b, 0): a and b are joined by links found here."""
        import pandas as pd

        dim, block = int(key[0]), int(key[1])
        ids, weight, at_home = frame["id"].to_numpy(), frame["n"].to_numpy(), frame["home"].to_numpy()
        x = unit(frame["raw"].tolist(), kind)
        home, seated = np.flatnonzero(frame["chosen"].to_numpy()), np.flatnonzero(frame["seated"].to_numpy())
        del frame
        same = home if len(seated) == len(ids) and len(home) == at_home.sum() else None  # all of the cell is here
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for p, q in linked(x[home], x[seated], grids[dim], rotation(dim), block, threshold, same):
            p, q = home[p], seated[q]
            if same is None:  # two at home meet from both sides, here or in another task
                once = ~at_home[q] | (ids[p] < ids[q])
                p, q = p[once], q[once]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            join_roots(root, p, q)
        found, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": np.concatenate([ids[found], ids[moved]]), "b": np.concatenate([ids[found], ids[root[moved]]]), "n": np.concatenate([links[found], np.zeros(len(moved), np.int64)])})

    found = written(tasks.groupBy("dim", "block", "cell", "chunk", "other").applyInPandas(join, "a long, b long, n long"), "links")
    links = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    labels = components(found.where("a <> b").select("a", "b"), "vectors").withColumnRenamed("node", "id")
    per_class = classes.select("key", "id", "n").join(links, "id", "left").join(labels, "id", "left")
    per_class = per_class.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = packed.select("vec_id", "key").join(per_class, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
