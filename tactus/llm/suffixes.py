"""Benchmark decontamination by suffix arrays over the documents.

The documents' words are shards (slices of a partition). For each shard a suffix array is built over the positions at
which a benchmark window can begin, and every benchmark suffix that begins a window is searched in it by bisection, word
after word: the interval after the window's length holds all its occurrences, the last interval that isn't empty the
longest verbatim matches. Documents are read once and never shuffled.

The benchmark is divided into blocks of `BLOCK_BYTES` of text; a block is collected, indexed and written to the shared
folder, and tasks hold one block at a time. So neither driver nor tasks grow with the benchmark.

Words: runs of ASCII letters and digits and non-ASCII characters, A-Z lowered. A window is `WINDOW` consecutive words of
an item; a shorter item is one window; items without words have none. Null texts have no words. A null item id stands as
an empty string; rows of equal item id are one item. Repeated documents are reported each. With an empty benchmark
nothing is hit. Extra columns are kept by `remove` and not returned by `scan`.
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import as_bytes, lean, slices, text_bytes, words, work_path

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Bytes of document text in a shard.
SHARD_BYTES = 4 << 20


class Block:
    """Suffixes of some benchmark items that begin a window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        flat, owner, start, size, self.items = [0], [], [], [], []
        for name, raw in items:
            found = list(map(number, words(raw)))
            if not found:
                continue
            width = min(window, len(found))
            for i in range(len(found) - width + 1):
                start.append(len(flat) + i)
                size.append(width)
                owner.append(len(self.items))
            flat += [*found, 0]
            self.items.append(name)
        self.flat = np.array(flat, np.int64)
        self.start, self.size, self.owner = (np.array(x, np.int64) for x in (start, size, owner))
        self.least = np.full(len(self.vocabulary) + 1, np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.flat[self.start], self.size)
        self.longest = max(map(len, "".join("x" if x else " " for x in flat).split()), default=0)


def _runs(ids: np.ndarray) -> np.ndarray:
    """Number of non-zero words from each position on."""
    n = len(ids)
    ends = np.where(ids == 0, np.arange(n), n)
    return np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n)


def suffix_array(ids: np.ndarray, wanted: np.ndarray, longest: int) -> np.ndarray:
    """The wanted positions in the order of their suffixes' first `longest` words; zero ends a suffix.

    Prefix doubling over all positions of the runs that hold a wanted position.
    """
    if not len(wanted):
        return wanted
    live = np.flatnonzero(ids)
    rank = ids.copy()
    step = 1
    while step < longest:
        after = np.where(live + step < len(ids), rank[np.minimum(live + step, len(ids) - 1)], 0)
        after[_crosses(ids, live, step)] = 0
        order = np.lexsort((after, rank[live]))
        a, b = rank[live][order], after[order]
        new = np.concatenate(([1], 1 + np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank[live[order]] = new
        if new[-1] == len(live):
            break
        step *= 2
    return wanted[np.argsort(rank[wanted], kind="stable")]


def _crosses(ids: np.ndarray, live: np.ndarray, step: int) -> np.ndarray:
    return _runs(ids)[live] <= step


def _bisect(column, low: np.ndarray, high: np.ndarray, target: np.ndarray, right: bool) -> np.ndarray:
    """First place in [low, high) at which the sorted column is not below (right: is above) the target."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        value = column(np.where(open_, middle, 0))
        up = open_ & ((value <= target) if right else (value < target))
        low = np.where(up, middle + 1, low)
        high = np.where(open_ & ~up, middle, high)
    return low


def search(ids: np.ndarray, block: Block) -> tuple[np.ndarray, ...]:
    """Suffix array, and for each benchmark suffix the interval at its window's length, the longest match and its interval."""
    runs = _runs(ids)
    wanted = np.flatnonzero((ids > 0) & (runs >= block.least[ids]))
    live = np.zeros(len(ids), bool)
    if len(wanted):  # words of runs without any wanted position can't be part of a match
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, wanted, 1)
        np.add.at(edge, wanted + runs[wanted], -1)
        live = np.cumsum(edge)[:-1] > 0
    order = suffix_array(np.where(live, ids, 0), wanted, block.longest)
    n = len(block.start)
    low, high = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    at_low, at_high, depth = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    active = np.arange(n) if len(order) else np.arange(0)
    d = 0
    padded = np.concatenate((ids, np.zeros(1, ids.dtype)))
    while len(active):
        target = block.flat[block.start[active] + d]
        active, target = active[target > 0], target[target > 0]
        column = lambda k: padded[np.minimum(order[k] + d, len(ids))]
        lo = _bisect(column, low[active], high[active], target, False)
        hi = _bisect(column, lo, high[active], target, True)
        found = lo < hi
        active, lo, hi = active[found], lo[found], hi[found]
        low[active], high[active] = lo, hi
        d += 1
        depth[active] = d
        full = block.size[active] == d
        at_low[active[full]], at_high[active[full]] = lo[full], hi[full]
    return order, at_low, at_high, depth, low, high


def _places(order: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the interval, position) of all entries of the intervals."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return which, order[low[which] + inside]


class Shard:
    """Words of some documents, one after the other with a border between."""

    def __init__(self, texts: list[bytes]):
        self.words = [words(t) for t in texts]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(self.n + 1) - self.n - 1
        self.total = int((self.n + 1).sum())

    def ids(self, vocabulary: dict[bytes, int]) -> np.ndarray:
        out = np.zeros(self.total, np.int64)
        for w, at in zip(self.words, self.first):
            out[at:at + len(w)] = np.fromiter(map(vocabulary.get, w, repeat(0)), np.int64, len(w))
        return out

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1


def hits(shard: Shard, blocks: Iterator[Block]) -> tuple[np.ndarray, list[set[str]], list[list[tuple]]]:
    """Words hit per document, items per document, longest matches (item, word in item, word in document, words)."""
    edge = np.zeros(shard.total + 1, np.int64)
    items: list[set[str]] = [set() for _ in shard.n]
    matches: list[list[tuple]] = [[] for _ in shard.n]
    for block in blocks:
        order, low, high, depth, deep_low, deep_high = search(shard.ids(block.vocabulary), block)
        some = np.flatnonzero(low < high)
        if not len(some):
            continue
        # windows of equal words have the same interval: its places are listed once
        spans, which = np.unique(np.stack((low[some], high[some], block.size[some]), 1), axis=0, return_inverse=True)
        number, place = _places(order, spans[:, 0], spans[:, 1])
        np.add.at(edge, place, 1)
        np.add.at(edge, place + spans[number, 2], -1)
        docs_of = np.unique(np.stack((number, shard.doc(place)), 1), axis=0)
        owners = np.unique(np.stack((which.reshape(-1), block.owner[some]), 1), axis=0)
        begin, end = (np.searchsorted(owners[:, 0], docs_of[:, 0], side) for side in ("left", "right"))
        for d, a, b in zip(docs_of[:, 1].tolist(), begin.tolist(), end.tolist()):
            items[d].update(block.items[o] for o in owners[a:b, 1].tolist())
        _, first = np.unique(np.stack((deep_low[some], deep_high[some], depth[some]), 1), axis=0, return_index=True)
        chosen = some[first]
        number, place = _places(order, deep_low[chosen], deep_high[chosen])
        opening = np.searchsorted(block.start, block.start)  # suffixes of an item are side by side
        starts = np.concatenate(([0], np.flatnonzero(np.diff(block.owner)) + 1))
        first_of = block.start[starts[np.searchsorted(starts, opening, "right") - 1]]
        for k, p, d in zip(chosen[number].tolist(), place.tolist(), shard.doc(place).tolist()):
            matches[d].append((block.items[block.owner[k]], int(block.start[k] - first_of[k]), int(p - shard.first[d]), int(depth[k])))
    hit = np.cumsum(edge[:-1]) > 0
    total = np.concatenate(([0], np.cumsum(hit)))
    return total[shard.first + shard.n] - total[shard.first], items, matches


def write_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Indexes the benchmark block by block into the shared folder."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_bytes().alias("raw"))
    total = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n, folder, out = max(1, -(-total // block_bytes)), work_path(benchmark.sparkSession, "benchmark"), []
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    for k in range(n):
        some = rows.filter(F.pmod(F.xxhash64("item", "raw"), F.lit(n)) == k).collect()
        with store.open_output_stream(f"{base}/{k}") as file:
            file.write(pickle.dumps(Block([(r[0], bytes(r[1])) for r in some], window)))
        out.append(os.path.join(folder, str(k)))
    return out


#: The block that this worker has read last.
_LAST: dict[str, Block] = {}


def blocks(paths: list[str]) -> Iterator[Block]:
    for path in paths:
        if path not in _LAST:
            _LAST.clear()
            store, name = pafs.FileSystem.from_uri(path)
            with store.open_input_stream(name) as file:
                _LAST[path] = pickle.loads(file.read())
        yield _LAST[path]


SCANNED = pa.schema([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("matches", pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])))])
SCANNED_DDL = "n_words long, n_hit long, items array<string>, matches array<struct<item string, item_word long, doc_word long, n_words long>>"


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items and longest matches of every document."""
    paths = write_blocks(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SHARD_BYTES):
                shard = Shard(as_bytes(part.column(1)))
                n_hit, items, matches = hits(shard, blocks(paths))
                as_rows = [[dict(zip(("item", "item_word", "doc_word", "n_words"), m)) for m in sorted(of)] for of in matches]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(shard.n), pa.array(n_hit), pa.array([sorted(x) for x in items], SCANNED.field(2).type), pa.array(as_rows, SCANNED.field(3).type)],
                    schema=pa.schema([pa.field("doc_id", part.column(0).type), *SCANNED]))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes(text_col).alias("raw")).mapInArrow(lean(run), f"doc_id {id_type}, {SCANNED_DDL}")


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without any hit word, with all their columns."""
    paths = write_blocks(benchmark, window)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, SHARD_BYTES):
                n_hit, _, _ = hits(Shard(as_bytes(part.column(at))), blocks(paths))
                yield part.filter(pa.array(n_hit == 0))

    return docs.mapInArrow(lean(run), docs.schema)
