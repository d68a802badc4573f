"""Helpers shared by the operators: texts as bytes, bounded slices of Arrow batches, tables written once."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.session import reliable_folder

#: Bytes of text handled at a time inside a task; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Largest vocabulary file that is sent to all executors.
VOCABULARY_BYTES = 64 << 20
#: UTF-8 bytes with A-Z lowered and every ASCII byte that is no letter or digit made a space.
WORD_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit("").cast("binary"))


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about `limit` bytes together."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def _trim() -> None:
    """Hands back what freed numpy arrays leave in the C library, where it can."""
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None) -> Callable:
    """A task's function that leaves nothing behind in its worker: `forget` empties caches, unused memory goes back.

    Workers are kept for later stages, and their memory adds up beside the JVM's.
    """
    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            pa.default_memory_pool().release_unused()
            _trim()
    return wrapped


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts or bytes of an Arrow column; null becomes empty."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    return [b or b"" for b in column.to_pylist()]


def words(raw: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lowered."""
    return raw.translate(WORD_BYTES).split()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return os.path.join(reliable_folder(spark), "llm", f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written once as Parquet to the shared folder and read again; cuts the lineage."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes a table written by `stored` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def vocabulary_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver; its size is bounded."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    with open(path, "rb") as file:
        return file.read()
