"""Token ids in Arrow files: equal-length sequences and masks, read without copying.

Documents are put in ascending id order (range partitions, sorted inside), encoded and ended by an end id. Each
partition writes two Arrow IPC files:

* `tokens`: record batches of `ROWS` sequences; `ids` is a fixed-size list of `LENGTH` unsigned integers, `mask` one of
  `LENGTH` booleans (false: filling at the file's end). All batches but the last have the same shape, so sequence k is
  row k % ROWS of batch k // ROWS, a slice of the mapped file.
* `docs`: doc_id, first position in the file's sequences and number of ids of each document.

A task writes under a name of its own attempt and returns it as a row; only files named in the manifest count, so a
task that is run again or lost leaves nothing behind that is read. Memory: one record batch and one slice of texts.

Null and empty texts hold the end id only. Documents of equal id stand side by side. An empty table gives an empty
manifest. Extra columns of the input are not returned.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactus.llm.common import as_bytes, slices, stored, text_bytes, vocabulary_bytes, work_path
from tactus.llm.pieces import Pieces

LENGTH = 2048
ROWS = 64
#: Bytes of text encoded at a time; pieces met again in a slice cost nothing.
SLICE = 12 << 20
MANIFEST = "part int, tokens string, docs string, n_docs long, n_tokens long"


def _sequences(ids: np.ndarray, real: int, length: int) -> pa.RecordBatch:
    mask = np.zeros(len(ids), bool)
    mask[:real] = True
    return pa.RecordBatch.from_arrays(
        [pa.FixedSizeListArray.from_arrays(pa.array(ids), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)],
        ["ids", "mask"])


class _Writer:
    """Packs ids of documents into sequences; batches of equal shape go to the file as they fill."""

    def __init__(self, store, path: str, dtype: np.dtype, id_type: pa.DataType, length: int):
        self.length, self.dtype, self.step = length, dtype, length * ROWS
        self.docs_schema = pa.schema([("doc_id", id_type), ("position", pa.int64()), ("n_tokens", pa.int64())])
        empty = _sequences(np.zeros(0, dtype), 0, length)
        self.files = [store.open_output_stream(f"{path}.{kind}.arrow") for kind in ("tokens", "docs")]
        self.tokens = pa.ipc.new_file(self.files[0], empty.schema)
        self.docs = pa.ipc.new_file(self.files[1], self.docs_schema)
        self.waiting: list[bytes] = []
        self.held = self.total = self.n_docs = 0

    def add(self, ids_of_docs: pa.Array, packed: list[bytes]) -> None:
        counts = np.array([len(p) // self.dtype.itemsize for p in packed], np.int64)
        starts = self.total + np.cumsum(counts) - counts
        self.docs.write_batch(pa.RecordBatch.from_arrays([ids_of_docs, pa.array(starts), pa.array(counts)], schema=self.docs_schema))
        self.waiting += packed
        self.held += int(counts.sum())
        self.total += int(counts.sum())
        self.n_docs += len(packed)
        if self.held >= self.step:
            flat = np.frombuffer(b"".join(self.waiting), self.dtype)
            full = len(flat) // self.step * self.step
            for i in range(0, full, self.step):
                self.tokens.write_batch(_sequences(flat[i:i + self.step], self.step, self.length))
            self.waiting, self.held = [flat[full:].tobytes()], len(flat) - full

    def close(self) -> None:
        if self.held:
            flat = np.frombuffer(b"".join(self.waiting), self.dtype)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[:len(flat)] = flat
            self.tokens.write_batch(_sequences(padded, len(flat), self.length))
        for x in (self.tokens, self.docs, *self.files):
            x.close()


def write(docs: DataFrame, path: str, end_id: int, folder: str | None = None, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Writes all documents; returns the manifest, one row per file pair, in doc_id order by `part`."""
    spark = docs.sparkSession
    folder = folder or work_path(spark, "tokens")
    shared = spark.sparkContext.broadcast(Pieces(vocabulary_bytes(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = shared.value
        worker.prepare()
        end = np.array([end_id], worker.dtype).tobytes()
        part = TaskContext.get().partitionId()
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, writer = f"{base}/part-{part:06d}-{uuid.uuid4().hex}", None
        for batch in batches:
            for some in slices(batch, 1, SLICE):
                writer = writer or _Writer(store, name, worker.dtype, some.column(0).type, length)
                writer.add(some.column(0), [ids + end for ids in worker.encode(as_bytes(some.column(1)))])
        if writer:
            writer.close()
            at = f"{folder}/{name.rpartition('/')[2]}"
            yield pa.RecordBatch.from_pylist([{
                "part": part, "tokens": f"{at}.tokens.arrow", "docs": f"{at}.docs.arrow", "n_docs": writer.n_docs, "n_tokens": writer.total}],
                schema=pa.schema([("part", pa.int32()), ("tokens", pa.string()), ("docs", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select("doc_id", text_bytes(text_col).alias("raw"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return stored(ordered.mapInArrow(run, MANIFEST), "manifest")


class TokenFile:
    """Random access to a tokens file: sequences and masks are views of the mapped bytes where the store is a disk."""

    def __init__(self, uri: str):
        store, path = pafs.FileSystem.from_uri(uri)
        local = isinstance(store, pafs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else store.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.last: tuple[int, np.ndarray] | None = None

    def batch(self, k: int) -> np.ndarray:
        """All ids of record batch k, in a row; the last one read is kept, as documents lie side by side."""
        if self.last is None or self.last[0] != k:
            self.last = k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.last[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence k."""
        row = self.file.get_batch(k // ROWS)
        return (row.column(0)[k % ROWS].values.to_numpy(zero_copy_only=True),
                row.column(1)[k % ROWS].values.to_numpy(zero_copy_only=False))

    def span(self, start: int, n: int) -> np.ndarray:
        """`n` ids from position `start`."""
        step, parts = self.length * ROWS, []
        while n > 0:
            ids = self.batch(start // step)[start % step:][:n]
            parts.append(ids)
            start, n = start + len(ids), n - len(ids)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def read(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), from the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenFile(row["tokens"])
                store, path = pafs.FileSystem.from_uri(row["docs"])
                with store.open_input_file(path) as source, pa.ipc.open_file(source) as docs:
                    for k in range(docs.num_record_batches):
                        some = docs.get_batch(k)
                        starts, counts = some.column(1).to_pylist(), some.column(2).to_pylist()
                        ids = [tokens.span(s, n).astype("<u4").tobytes() for s, n in zip(starts, counts)]
                        yield pa.RecordBatch.from_arrays(
                            [some.column(0), pa.array([row["base"] + s for s in starts], pa.int64()), some.column(2), pa.array(ids, pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"])

    parts = based.repartitionByRange(max(1, manifest.count()), "part")  # a task for each file pair
    return parts.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids binary")


def read_back(spark: SparkSession, manifest: DataFrame, docs: DataFrame) -> DataFrame:
    """`read` with the id type of the documents that were written."""
    return read(manifest, docs.schema["doc_id"].dataType.simpleString())
