"""Token ids as flat binary files.

Documents are range-partitioned by doc_id; each task encodes its range in order and writes one shard:
``.bin`` the ids as flat unsigned little-endian integers (16 bits where the vocabulary allows), ``.idx`` 64-bit
offsets of the documents (one more than documents), ``.doc`` their ids and ``.nul`` a byte that is 1 where the
id is null. The base of a shard is the sum of the sizes of all before it. Files get their final name only when
they are whole, so a task that is lost and run again replaces what it left.

Defined results: a null or empty text is the end id alone; null ids come first; equal ids are ordered by a
hash of their texts, repeated rows are documents of their own; an empty table gives empty shards. Only
doc_id and text are read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacloom.llm.common import durable, shared_folder
from vacloom.llm.tokens import default_path, encoder

END_ID = 2
MANIFEST = "shard long, path string, width int, n_docs long, n_ids long"


def _opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def _flat(uri: str, kind: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where the folder is mounted, read where it is a remote store."""
    store, path = _opened(uri)
    if store.get_file_info(path).size == 0:
        return np.zeros(0, kind)
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, kind, mode="r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), kind)


def write_shards(docs: DataFrame, folder: str | None = None, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write the files and return the manifest, a row for each shard with its base."""
    spark, path = docs.sparkSession, path or default_path()
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = encoder(path), TaskContext.get()
        end = np.array([end_id], own.dtype).tobytes()
        store, root = _opened(folder)
        store.create_dir(root, recursive=True)
        base = f"{root}/shard-{task.partitionId():06d}"
        draft, n_docs, n_ids = f"{base}.{task.taskAttemptId()}", 0, 0
        files = {k: store.open_output_stream(f"{draft}.{k}") for k in ("bin", "idx", "doc", "nul")}
        files["idx"].write(np.zeros(1, "<u8").tobytes())
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [x + end for x in own.encode(part.column("text").to_pylist())]
                sizes = np.array([len(x) // own.dtype.itemsize for x in ids], np.int64)
                files["bin"].write(b"".join(ids))
                files["idx"].write((n_ids + np.cumsum(sizes)).astype("<u8").tobytes())
                files["doc"].write(part.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                files["nul"].write(part.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
                n_docs, n_ids = n_docs + len(ids), n_ids + int(sizes.sum())
        for k, file in files.items():
            file.close()
            store.move(f"{draft}.{k}", f"{base}.{k}")
        yield pa.record_batch([pa.array([v], t) for v, t in (
            (task.partitionId(), pa.int64()), (f"{folder}/shard-{task.partitionId():06d}", pa.string()), (own.dtype.itemsize, pa.int32()),
            (n_docs, pa.int64()), (n_ids, pa.int64()))], ["shard", "path", "width", "n_docs", "n_ids"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    shards = durable(ranged.select("doc_id", "text").mapInArrow(write, MANIFEST))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Documents read back from the files: doc_id, start, n_tokens, ids (packed 32-bit)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                idx, flat = _flat(f"{shard['path']}.idx", "<u8").astype(np.int64), _flat(f"{shard['path']}.bin", f"<u{shard['width']}")
                doc, nul = _flat(f"{shard['path']}.doc", "<i8"), _flat(f"{shard['path']}.nul", "u1")
                for at in range(0, shard["n_docs"], 256):
                    to = min(at + 256, shard["n_docs"])
                    yield pa.record_batch([
                        pa.array(doc[at:to], pa.int64(), mask=nul[at:to].astype(bool)), pa.array(idx[at:to] + shard["base"], pa.int64()),
                        pa.array(np.diff(idx[at : to + 1]), pa.int64()),
                        pa.array([flat[idx[i] : idx[i + 1]].astype("<u4").tobytes() for i in range(at, to)], pa.binary()),
                    ], ["doc_id", "start", "n_tokens", "ids"])

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
