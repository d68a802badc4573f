"""Byte-level BPE encoding and decoding by a rank file, without the tokenizer's own library.

A text is split by the pre-token pattern. A pre-token that is in the vocabulary as a whole is found by a minimal
perfect hash (one probe, one comparison). Others are merged: a heap holds the candidate pairs by (rank, position) over
a doubly linked list of parts. Words recur, so each worker keeps the ids of pieces it has met, up to a fixed number.

A single space between two characters that are no white space always begins a pre-token, so texts are cut there first
and the pattern sees each distinct piece once.

Null and empty texts have no ids. Texts that are not valid UTF-8 have U+FFFD in place of bad bytes. Extra columns
of the input are not returned by `encode`, `decode` and `round_trip`.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import as_bytes, lean, slices, text_bytes, vocabulary_bytes

#: Pieces and pre-tokens whose ids a worker keeps, half of them of the last generation.
KEPT_PIECES = 800_000
KEPT_PAIRS = 400_000
#: Longer pieces are not kept.
LONGEST_KEPT = 64
#: Pre-tokens of a long text handled at a time.
STEP = 100_000
MASK = (1 << 64) - 1
LOW = (1 << 32) - 1
#: Stands for a pair that is no token.
NONE = LOW


def _mixed(h: int, d: int) -> int:
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & MASK
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & MASK
    return x ^ (x >> 29)


class PerfectHash:
    """Hash and displace: keys go to buckets, each bucket has a number that spreads its keys over free slots."""

    def __init__(self, keys: list[bytes], values: list[int]):
        self.n = n = len(keys)
        self.buckets = n * 2 // 3 + 1
        buckets: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[h % self.buckets].append(i)
        slots: list[int | None] = [None] * n
        self.shift = [0] * self.buckets
        order = sorted(range(self.buckets), key=lambda b: -len(buckets[b]))
        at = 0
        while at < len(order) and len(buckets[order[at]]) > 1:
            members = buckets[order[at]]
            d = 0
            while True:
                d += 1
                to = [_mixed(hashes[i], d) % n for i in members]
                if len(set(to)) == len(to) and all(slots[s] is None for s in to):
                    break
            for s, i in zip(to, members):
                slots[s] = i
            self.shift[order[at]] = d
            at += 1
        free = (s for s in range(n) if slots[s] is None)
        for b in order[at:]:
            if buckets[b]:
                s = next(free)
                slots[s], self.shift[b] = buckets[b][0], -s - 1
        self.keys = [keys[i] for i in slots]
        self.values = [values[i] for i in slots]

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else _mixed(h, d) % self.n
        return self.values[s] if self.keys[s] == key else None


class Bounded(dict):
    """A dictionary that fills missing entries by a function.

    When half of the entries are used it becomes the last generation, whose entries come back when they are met again.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.last = make, most // 2, {}

    def __missing__(self, key):
        value = self.last.get(key)
        if value is None:
            value = self.make(key)
        if key.__class__ is int or len(key) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.last = self.copy()
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes one text at a time; built on the driver from the rank file, sent to the workers."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        tokens, ids = [base64.b64decode(a) for a, _ in pairs], [int(b) for _, b in pairs]
        self.pattern = pattern
        self.whole = PerfectHash(tokens, ids)
        self.tokens = dict(zip(ids, tokens))
        self.ready = False

    def __getstate__(self):
        return {"pattern": self.pattern, "whole": self.whole, "tokens": self.tokens, "ready": False}

    def _prepare(self) -> None:
        self.find = regex.compile(self.pattern)
        self.doubled = regex.compile(r"\s\s|^ | $")
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.bytes_of = [self.whole.get(bytes([b])) for b in range(256)]
        self.pairs = Bounded(self._pair, KEPT_PAIRS)
        found = [self.whole.get(bytes((a, b))) for a in range(256) for b in range(256)]
        #: The rank of two neighbouring bytes joined, by (first byte, second byte).
        self.of_bytes = [[NONE if r is None else r for r in found[a:a + 256]] for a in range(0, 1 << 16, 256)]
        self.pretokens = Bounded(self._pretoken, KEPT_PIECES)
        self.first = Bounded(self._piece, KEPT_PIECES // 10)
        self.later = Bounded(lambda p: self._piece(" " + p), KEPT_PIECES)
        self.decoded = [self.tokens.get(i, b"") for i in range(max(self.tokens, default=0) + 1)]
        self.ready = True

    def _pair(self, key: int) -> int:
        """The rank of two neighbouring tokens joined, or NONE."""
        found = self.whole.get(self.decoded[key >> 32] + self.decoded[key & LOW])
        return NONE if found is None else found

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token itself.

        Heap entries hold the rank in the upper and the position in the lower 32 bits; an entry whose rank is no
        longer that of its position is stale.
        """
        n, of = len(piece), self.pairs
        part = [self.bytes_of[b] for b in piece]
        if None in part:
            raise ValueError("the rank file lacks single bytes")
        after, before, table = list(range(1, n + 1)), list(range(-1, n - 1)), self.of_bytes
        rank = [table[a][b] for a, b in zip(piece, piece[1:])]
        rank.append(NONE)
        heap = [r << 32 | i for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            r, i = top >> 32, top & LOW
            if rank[i] != r:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            part[i], part[gone], rank[gone] = r, -1, NONE
            if end < n:
                before[end] = i
                rank[i] = new = of[r << 32 | part[end]]
                if new != NONE:
                    push(heap, new << 32 | i)
            else:
                rank[i] = NONE
            back = before[i]
            if back >= 0:
                rank[back] = new = of[part[back] << 32 | r]
                if new != NONE:
                    push(heap, new << 32 | back)
        return [p for p in part if p >= 0]

    def _pretoken(self, token: str) -> bytes:
        raw = token.encode()
        rank = self.whole.get(raw)
        return b"".join([i.to_bytes(4, "little") for i in ([rank] if rank is not None else self.merge(raw))])

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, self.find.findall(piece)))

    def encode(self, raw: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.ready:
            self._prepare()
        text = raw.decode("utf-8", "replace")
        if not text:
            return b""
        pieces = text.split(" ") if not self.doubled.search(text) else self.cut.split(text)
        if len(pieces) == 1 and len(text) > STEP:
            found, out = (m.group() for m in self.find.finditer(text)), []
            while some := list(islice(found, STEP)):
                out.append(b"".join(map(self.pretokens.__getitem__, some)))
            return b"".join(out)
        return self.first[pieces[0]] + b"".join(map(self.later.__getitem__, pieces[1:]))

    def decode(self, ids: bytes) -> bytes:
        if not self.ready:
            self._prepare()
        return b"".join(map(self.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _mapped(docs: DataFrame, column: str, kind: str, schema: str, path: str | None, pattern: str, encoder: Encoder | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(encoder or Encoder(vocabulary_bytes(path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                raw = as_bytes(part.column(1))
                if kind == "decode":
                    out = [pa.array(map(worker.decode, raw), pa.binary())]
                else:
                    ids = [worker.encode(x) for x in raw]
                    out = [pa.array(ids, pa.binary())]
                    if kind == "both":
                        out.append(pa.array(map(worker.decode, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(0), *out], schema=names(part.column(0).type, len(out)))

    def names(kind_of_id: pa.DataType, n: int) -> pa.Schema:
        return pa.schema([("doc_id", kind_of_id), *((x, pa.binary()) for x in (["decoded"] if kind == "decode" else ["ids", "decoded"])[:n])])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    value = text_bytes(column) if kind != "decode" else F.coalesce(F.col(column), F.lit("").cast("binary"))
    return docs.select("doc_id", value.alias("raw")).mapInArrow(lean(run), f"doc_id {id_type}, {schema}")


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", encoder: Encoder | None = None) -> DataFrame:
    """doc_id, ids: the whole text's ids as little-endian unsigned 32-bit integers."""
    return _mapped(docs, text_col, "encode", "ids binary", path, pattern, encoder)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", encoder: Encoder | None = None) -> DataFrame:
    """doc_id, decoded: the bytes that the ids stand for."""
    return _mapped(encoded, ids_col, "decode", "decoded binary", path, pattern, encoder)


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", encoder: Encoder | None = None) -> DataFrame:
    """doc_id, ids, decoded in one pass over the texts."""
    return _mapped(docs, text_col, "both", "ids binary, decoded binary", path, pattern, encoder)
