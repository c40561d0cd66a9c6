"""Token-ID output (2): flat unsigned integers with 64-bit document offsets.

A folder holds, for each shard k in ascending doc_id order: ``k.ids`` (all ids, little-endian uint16 or uint32),
``k.off`` (uint64: where each document starts within the shard, and the end) and ``k.doc`` (int64 doc ids; the least
value stands for null). A shard ends with the document that fills it, so its size doesn't follow the partitions'. And ``manifest.json`` with the number type and, per shard, documents, ids and base: the ids of all
shards before it, a prefix sum over one figure per shard.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from mdloom.llm.common import partitions, pieces, resident, texts

NULL_ID = -(2**63)


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, wide: bool = False, shard_ids: int = 1 << 26, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode every document, end it with end_id and write the files; returns the manifest.

    Documents are dealt out by ranges of doc_id and sorted within a range; equal ids (and null ids, which come first) stay
    together, ordered by text, each row a document of its own. Null and empty texts are documents of one id, end_id; an empty
    table gives no shards. Only the id and the text are read, so further columns may have any name. Very long texts make a long
    document, encoded whole. A new shard begins when one has shard_ids ids. A shard is written under a name of its own attempt and
    then moved, so a task that runs twice leaves whole files. The folder must be one that all executors share. An id
    that the number type can't hold ends the job.
    """
    spark = docs.sparkSession
    dtype = "<u4" if wide else "<u2"

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        from mdloom.llm.words import id_book

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, root = _place(folder)
        fs.create_dir(root, recursive=True)
        top = np.iinfo(dtype).max

        def close(shard: str, out, ends: list, names: list, total: int):
            out.close()
            for name, data in (("off", np.concatenate([[0], *ends]).astype("<u8")), ("doc", np.concatenate(names).astype("<i8"))):
                with fs.open_output_stream(f"{root}/.{shard}-{attempt}.{name}") as f:
                    f.write(data.tobytes())
            for name in ("ids", "off", "doc"):
                fs.move(f"{root}/.{shard}-{attempt}.{name}", f"{root}/{shard}.{name}")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard]), pa.array([sum(map(len, names))], pa.int64()), pa.array([total], pa.int64())], ["part", "shard", "docs", "ids"])

        n, out, ends, names, total = 0, None, [], [], 0
        for batch in pieces(batches):
            ids, sizes = resident(id_book, tokenizer_path, end_id).encode(batch.column("text").to_pylist())
            if int(ids.max(initial=0)) > top:
                raise ValueError(f"id {ids.max()} doesn't fit {dtype}; write wide files")
            if out is None:
                shard = f"{part:07}-{n:05}"
                out = fs.open_output_stream(f"{root}/.{shard}-{attempt}.ids")
            out.write(ids.astype(dtype).tobytes())
            ends.append(total + np.cumsum(sizes))
            names.append(batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))
            total += len(ids)
            if total >= shard_ids:
                yield close(shard, out, ends, names, total)
                n, out, ends, names, total = n + 1, None, [], [], 0
        if out is not None:
            yield close(shard, out, ends, names, total)

    dealt = texts(docs, id_col, text_col).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = sorted(dealt.mapInArrow(write, "part int, shard string, docs long, ids long").collect())  # one row per shard
    base, listed = 0, []
    for s in shards:
        listed.append({"shard": s.shard, "docs": s.docs, "ids": s.ids, "base": base})
        base += s.ids
    manifest = {"dtype": dtype, "end_id": end_id, "ids": base, "shards": listed}
    fs, root = _place(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def open_shard(folder: str, shard: str, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, doc ids), memory-mapped where the folder is a local path."""
    fs, root = _place(folder)
    out = []
    for name, kind in (("ids", dtype), ("off", "<u8"), ("doc", "<i8")):
        path = f"{root}/{shard}.{name}"
        if not fs.get_file_info(path).size:
            out.append(np.empty(0, kind))
        elif fs.type_name == "local":
            out.append(np.memmap(path, kind, "r"))
        else:
            with fs.open_input_file(path) as f:
                out.append(np.frombuffer(f.readall(), kind))
    return tuple(out)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as
    little-endian uint32). An empty corpus gives an empty table."""
    fs, root = _place(folder)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.readall())
    dtype = manifest["dtype"]

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                ids, off, doc = open_shard(folder, shard, dtype)
                off = off.astype(np.int64)
                for lo in range(0, len(doc), 10_000):
                    at = off[lo : lo + 10_001]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                    key = np.array(doc[lo : lo + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(key, mask=key == NULL_ID), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [(s["shard"], s["base"]) for s in manifest["shards"]]
    shards = spark.createDataFrame(rows, "shard string, base long")
    return shards.repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
