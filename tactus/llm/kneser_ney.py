"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and memory-mapped by the workers that score.

* Words are 64-bit hashes. Map tasks count them in sorted arrays and send one packed array per range of hash values;
  reducers merge the arrays into sorted files. A word's number is its rank over these files.
* Bigrams are two word numbers in one 64-bit key, counted in the same way. Keys go to buckets by their first word, so a
  context's followers are counted in one place; contexts with more than a share of a bucket are spread by the whole key.
* Reducers also send, per word number, how many followers were seen once, twice and more often, and how many different
  words precede it; these become dense arrays.
* Order 3 numbers bigrams by their place over all bigram files. A trigram's key is the number of its first two words and
  the number of its last; keys go to buckets by the bigram, hot ones spread as above. Reducers send followers per bigram
  and how many words precede each bigram; the latter, summed by first word, give the middle order its totals. A text
  begins after two begin marks.
* Scoring tasks map the files and look up each distinct word and bigram of a slice by bisection in sorted order, so
  reading is sequential and memory is that of a slice. A store other than a disk is read file by file instead.

Files are written under a name of the task's attempt and count only if their manifest row arrives, so lost executors
cost nothing but time. The driver gets manifests: one row per file.

Tokens: runs of bytes other than space and \\t to \\r, A-Z lowered, then one end. p(w | h) = max(c(hw) - D, 0) / c(h) +
g(h) p(w); p(w) is made from preceding-word counts in the same way and interpolated with 1 / (words + 1). A word that
training lacks has only that last share; after an unknown word p(w) holds. Null and empty texts are one end. An empty
training set gives every token 1 / 1. Extra columns are not returned.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import as_bytes, discard, lean, slices, stored, text_bytes, work_path

#: A to Z lowered, blanks of all kinds made spaces.
LOWER = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Tokens counted together in a map task, and tokens for which one bucket of bigrams is made.
CHUNK_TOKENS = 3_000_000
BUCKET_TOKENS = 4_000_000
#: Bytes of text handled at a time; some 30 arrays of a number per token are in memory for each.
SLICE = 2 << 20
#: Word numbers in a file of dense arrays.
SPAN = 1 << 20
#: A context with more than this share of a bucket is spread over all buckets.
HOT_SHARE = 0.25
MOST_WORDS = (1 << 32) - 2
PRIME = np.uint64(0x9E3779B97F4A7C15)
END = 0
PACKED = "bucket int, n long, keys binary, counts binary"


def tokens(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending hashes of the different tokens, the place there of each token of the texts in a row, and the number of tokens of each text."""
    flat = np.frombuffer(b" ".join([*raw, b""]).translate(LOWER), np.uint8)  # a blank after each text
    inside = np.concatenate(([False], flat != 32))
    starts = np.flatnonzero(inside[1:] > inside[:-1])
    lengths = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in raw)]))) + 1
    # a word reaches to the next one, so one that is followed by several blanks differs from the same followed by one
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(flat))), pa.py_buffer(flat)]).dictionary_encode()
    different = words.dictionary.buffers()[2].to_pybytes().split() if len(starts) else []
    word = words.indices.to_numpy()
    if len(starts) and np.count_nonzero(inside) + len(starts) < len(flat) - starts[0]:
        place: dict[bytes, int] = {}
        word = np.fromiter((place.setdefault(w, len(place)) for w in different), np.int64, len(different))[word]
        different = list(place)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, different), np.uint64, len(different))
    hashes, back = np.unique(np.append(hashes, np.uint64(END)), return_inverse=True)
    at, inner = np.full(int(lengths.sum()), back[-1]), np.ones(int(lengths.sum()), bool)
    inner[np.cumsum(lengths) - 1] = False
    at[inner] = back[word]
    return hashes, at, lengths


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, so that small numbers compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def _packed(bucket: int, keys: np.ndarray, counts: np.ndarray) -> dict:
    return {"bucket": bucket, "n": len(keys), "keys": _planes(np.diff(keys, prepend=np.uint64(0))), "counts": _planes(counts.astype(np.uint32))}


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and their counts; each large array is let go as soon as the next one is made."""
    ends = np.cumsum(table["n"].to_numpy())
    keys, counts = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.uint32)
    for key, count, n, z in zip(table["keys"], table["counts"], table["n"].to_numpy(), ends):
        np.cumsum(_unplaned(key.as_buffer(), np.uint64), out=keys[z - n:z])
        counts[z - n:z] = _unplaned(count.as_buffer(), np.uint32)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    del order
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)


def _spread(keys: np.ndarray, counts: np.ndarray, buckets: np.ndarray) -> Iterator[dict]:
    """Sorted keys, packed by bucket."""
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(buckets[order]) != 0, [True]))) if len(keys) else []
    for a, b in zip(edges[:-1], edges[1:]):
        at = order[a:b]
        yield _packed(int(buckets[at[0]]), keys[at], counts[at])


def _counted(docs: DataFrame, keys_of: Callable, bucket_of: Callable) -> DataFrame:
    """Packed counts of the keys that `keys_of` gives, ascending and with counts, for the training texts of a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            return pa.RecordBatch.from_pylist(list(_spread(keys, counts, bucket_of(keys))), schema=schema)

        for batch in batches:
            for part in slices(batch, 0, SLICE):
                held.append(keys_of(as_bytes(part.column(0))))
                n += int(held[-1][1].sum())
                if n >= CHUNK_TOKENS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(lean(run, _forget), PACKED)


def _save(folder: str, name: str, columns: dict[str, np.ndarray]) -> str:
    """An Arrow file of one batch, under a name of its own."""
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    file_name = f"{name}-{uuid.uuid4().hex}.arrow"
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))
    with store.open_output_stream(f"{base}/{file_name}") as out, pa.ipc.new_file(out, batch.schema) as writer:
        writer.write_batch(batch)
    return f"{folder}/{file_name}"


def _forget() -> None:
    _OPEN.clear()


#: Mapped bytes above which a worker lets its files go.
MAPPED_BYTES = 32 << 20
#: Mapped files of this worker.
_OPEN: dict[str, tuple[np.ndarray, ...]] = {}


def columns_of(uri: str) -> tuple[np.ndarray, ...]:
    """The columns of a file: views of mapped memory on a disk, read whole from other stores (one at a time)."""
    if uri in _OPEN:
        return _OPEN[uri]
    if sum(c.nbytes for held in _OPEN.values() for c in held) > MAPPED_BYTES:
        _OPEN.clear()
    store, path = pafs.FileSystem.from_uri(uri)
    local = isinstance(store, pafs.LocalFileSystem)
    with pa.memory_map(path) if local else store.open_input_file(path) as source:
        batch = pa.ipc.open_file(source).get_batch(0)
        found = tuple(c.to_numpy(zero_copy_only=True) for c in batch.columns)
    if not local:
        _OPEN.clear()
    _OPEN[uri] = found
    return found


MERGED = "bucket int, path string, n long, total long, n1 long, n2 long, n3 long, n4 long"


def _times(counts: np.ndarray) -> dict:
    return {f"n{k}": int((counts == k).sum()) for k in (1, 2, 3, 4)}


def _narrow(values: np.ndarray) -> np.ndarray:
    """The values in the fewest bytes that hold them all."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _counts_file(folder: str, name: str, keys: np.ndarray, counts: np.ndarray) -> tuple[str, str]:
    """Keys with counts up to 255 in a byte; larger counts in a small file beside."""
    large = np.flatnonzero(counts > 255)
    return (_save(folder, name, {"key": keys, "count": np.minimum(counts, 255).astype(np.uint8)}),
            _save(folder, name + "-large", {"key": keys[large], "count": counts[large]}))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted wanted keys, and which are there."""
    at = np.searchsorted(keys, wanted)
    safe = np.minimum(at, max(0, len(keys) - 1))
    return safe, (keys[safe] == wanted) if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class Vocabulary:
    """Files of sorted word hashes, by the upper bits of the hash."""

    bits: int
    files: dict[int, tuple[str, int]]  # bucket: path, number of its first word
    words: int
    tokens: int

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of sorted hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        buckets = self.bucket(hashes)
        edges = np.searchsorted(buckets, np.arange((1 << self.bits) + 1))
        for b, (path, base) in self.files.items():
            a, z = edges[b], edges[b + 1]
            if a < z:
                keys, counts = columns_of(path)
                at, there = _find(keys, hashes[a:z])
                number[a:z] = np.where(there, base + at, -1)
                count[a:z] = np.where(there, counts[at], 0) if len(counts) else 0
        return number, count


def _distinct(raw: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers (ascending, -1 between them) and counts of the different tokens, the tokens' places there, and the number of tokens of each text."""
    hashes, at, lengths = tokens(raw)
    return *vocabulary.look_up(hashes), at, lengths


def _numbered(raw: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and counts of the tokens of some texts in a row, and the number of tokens of each."""
    number, count, inverse, lengths = _distinct(raw, vocabulary)
    return number[inverse], count[inverse], lengths


def _slots(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that are not -1 in ascending order, and the place of each number there (-1 if it is none)."""
    some = np.flatnonzero(number >= 0)
    some = some[np.argsort(number[some], kind="stable")]
    slot = np.full(len(number), -1, np.int64)
    slot[some] = np.arange(len(some))
    return number[some], slot


def _bigrams(number: np.ndarray, lengths: np.ndarray, begin: int) -> np.ndarray:
    """First words of all tokens' bigrams: the token before, or `begin`."""
    before = np.empty(len(number), np.int64)
    if len(number):
        before[1:] = number[:-1]
        before[np.cumsum(lengths) - lengths] = begin
    return before


def _power_bits(n: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, n)))))


def _by_bucket(found: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, and the places where it does; numbers of 16 bits are sorted digit by digit."""
    order = np.argsort(found.astype(np.uint16) if buckets <= 1 << 16 else found, kind="stable")
    edges = np.concatenate(([0], np.cumsum(np.bincount(found, minlength=1))))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b]:edges[b + 1]]


def _counts(files: dict[int, tuple[str, str]], found: np.ndarray, buckets: int, keys: np.ndarray, places: np.ndarray | None = None,
            bases: dict[int, int] | None = None) -> np.ndarray:
    """Counts of sorted keys in the files of their buckets; with `places` the keys' numbers go there as well, -1 if there is none."""
    out = np.zeros(len(keys), np.int64)
    for b, at in _by_bucket(found, buckets):
        if b not in files:
            continue
        path, large = files[b]
        stored_keys, counts = columns_of(path)
        place, there = _find(stored_keys, keys[at])
        if places is not None:
            places[at] = np.where(there, bases[b] + place, -1)
        if len(counts):
            out[at] = np.where(there, counts[place], 0)
        if (full := at[out[at] == 255]).size:
            large_keys, large_counts = columns_of(large)
            place, there = _find(large_keys, keys[full])
            if len(large_counts):
                out[full] = np.where(there, large_counts[place], 255)
    return out


def _dense(files: dict[int, str], span: int, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """The four columns of dense arrays at sorted numbers."""
    out = tuple(np.zeros(len(number), np.int64) for _ in range(4))
    spans = number // span
    for s in np.unique(spans):
        if s in files:
            a, z = np.searchsorted(spans, (s, s + 1))
            place = number[a:z] - s * span
            for o, column in zip(out, columns_of(files[s])):
                if len(column):  # what lies beyond a file's end is zero
                    o[a:z] = np.where(place < len(column), column[np.minimum(place, len(column) - 1)], 0)
    return out


def _joined(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    return head.astype(np.uint64) << np.uint64(32) | tail.astype(np.uint64)


@dataclass
class Upper:
    """Third order: trigram files, dense arrays per bigram, and per first word of the middle order."""

    files: dict[int, tuple[str, str]]
    hot: np.ndarray
    dense: dict[int, str]  # followers of a bigram seen once, twice, more often, and words before it
    heads: dict[int, str]  # bigrams of a first word with one, two, more words before them, and the sum of these words
    bigrams: int
    discounts: tuple[float, float, float]
    middle: tuple[float, float, float]


@dataclass
class Model:
    vocabulary: Vocabulary
    buckets: int
    hot: np.ndarray
    files: dict[int, tuple[str, str]]
    dense: dict[int, str]
    documents: int
    types: int
    discounts: tuple[float, float, float]
    low_discounts: tuple[float, float, float]
    low_share: float
    span: int = SPAN
    bases: dict[int, int] | None = None
    sizes: dict[int, int] | None = None
    upper: Upper | None = None

    def dense_of(self, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """Followers seen once, twice, more often, and preceding words, of sorted word numbers."""
        return _dense(self.dense, self.span, number)

    def counts_of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted bigram keys."""
        return _counts(self.files, _bucket_of(keys, self.buckets, self.hot), self.buckets, keys)

    def places_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (or -1) and counts of sorted bigram keys, by one look-up."""
        places = np.full(len(keys), -1, np.int64)
        return places, _counts(self.files, _bucket_of(keys, self.buckets, self.hot), self.buckets, keys, places, self.bases)

    def keys_of(self, ranks: np.ndarray) -> np.ndarray:
        """Bigram keys of sorted numbers below the number of bigrams."""
        out = np.zeros(len(ranks), np.uint64)
        for b, (path, _) in self.files.items():
            a, z = np.searchsorted(ranks, (self.bases[b], self.bases[b] + self.sizes[b]))
            if a < z:
                out[a:z] = columns_of(path)[0][ranks[a:z] - self.bases[b]]
        return out

    def pairs(self, number: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers (or -1) and counts of the different bigrams, the tokens that end one, and the bigram of each of these."""
        before = _bigrams(number, lengths, self.vocabulary.words)
        both = np.flatnonzero((before >= 0) & (number >= 0))
        keys, back = np.unique(_joined(before[both], number[both]), return_inverse=True)
        return *self.places_of(keys), both, back

    def ranked(self, number: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number (or -1) of the bigram that each token ends."""
        places, _, both, back = self.pairs(number, lengths)
        rank = np.full(len(number), -1, np.int64)
        rank[both] = places[back]
        return rank

    def low(self, preceding: np.ndarray) -> np.ndarray:
        """p(w) from the number of different words before w."""
        share = self.low_share / (self.vocabulary.words + 1)
        if not self.types:
            return np.full(len(preceding), 1.0 / (self.vocabulary.words + 1))
        return np.maximum(preceding - _discount(preceding, self.low_discounts), 0) / self.types + share

    def score(self, raw: list[bytes]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score and score of some texts."""
        numbers, counts, inverse, lengths = _distinct(raw, self.vocabulary)
        first = np.cumsum(lengths) - lengths
        total = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        n, v = self.vocabulary.tokens, self.vocabulary.words
        base = (np.log10(counts + 1.0) - np.log10(float(n + v + 1)))[inverse]
        known, slot = _slots(numbers)
        preceding = np.zeros(len(numbers), np.int64)
        preceding[slot >= 0] = self.dense_of(known)[3][slot[slot >= 0]]
        p = self.low(preceding)[inverse]
        number, count = numbers[inverse], counts[inverse]
        if self.upper:
            self.raise_order(p, number, known, slot[inverse], lengths)
            return lengths, total((count > 0).astype(np.int64)), total(base), total(np.log10(p))
        begin = v
        before = _bigrams(number, lengths, begin)
        context = np.where(before == begin, self.documents, np.concatenate(([0], count[:-1])) if len(count) else count)
        some = np.flatnonzero((before >= 0) & (context > 0))
        heads, at = np.unique(before[some], return_inverse=True)
        once, twice, more, _ = self.dense_of(heads)
        d = self.discounts
        held = (d[0] * once + d[1] * twice + d[2] * more)[at] / context[some]
        follows = np.zeros(len(some), np.int64)
        both = np.flatnonzero(number[some] >= 0)
        keys, back = np.unique(before[some][both].astype(np.uint64) << np.uint64(32) | number[some][both].astype(np.uint64), return_inverse=True)
        follows[both] = self.counts_of(keys)[back]
        p[some] = np.maximum(follows - _discount(follows, d), 0) / context[some] + held * p[some]
        return lengths, total((count > 0).astype(np.int64)), total(base), total(np.log10(p))


    def raise_order(self, p: np.ndarray, number: np.ndarray, known: np.ndarray, slot: np.ndarray, lengths: np.ndarray) -> None:
        """Makes p(w) the trigram model's p, in place; `known` holds the different numbers, `slot` each token's place there or -1."""
        up = self.upper
        # begin marks have the largest numbers, so they are last in every list of heads
        heads = _dense(up.heads, self.span, np.append(known, self.vocabulary.words))
        places, counts, both, back = self.pairs(number, lengths)
        ranks, at = _slots(places)
        pairs = _dense(up.dense, self.span, np.append(ranks, up.bigrams))
        rank, ends, count, preceding = (np.full(len(number), k, np.int64) for k in (-1, -1, 0, 0))
        rank[both], ends[both], count[both] = places[back], at[back], counts[back]
        preceding[ends >= 0] = pairs[3][ends[ends >= 0]]
        _mix(p, _bigrams(slot, lengths, len(known)), heads, None, preceding, up.middle)
        pair, context = _bigrams(rank, lengths, up.bigrams), _bigrams(count, lengths, self.documents)
        follows = np.zeros(len(number), np.int64)
        both = np.flatnonzero((pair >= 0) & (number >= 0))
        keys, back = np.unique(_joined(pair[both], number[both]), return_inverse=True)
        follows[both] = _counts(up.files, _bucket_of(keys, self.buckets, up.hot), self.buckets, keys)[back]
        _mix(p, _bigrams(ends, lengths, len(ranks)), pairs, context, follows, up.discounts)


def _mix(p: np.ndarray, head: np.ndarray, columns: tuple[np.ndarray, ...], context: np.ndarray | None, follows: np.ndarray, d: tuple[float, float, float]) -> None:
    """One more order, in place, where the head is known: its place in the columns, else -1; without `context` the last column is the total."""
    some = np.flatnonzero(head >= 0)
    total = columns[3][head[some]] if context is None else context[some]
    some, total = some[total > 0], total[total > 0]
    held = (d[0] * columns[0] + d[1] * columns[1] + d[2] * columns[2])[head[some]]
    p[some] = np.maximum(follows[some] - _discount(follows[some], d), 0) / total + held / total * p[some]


def _discount(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the numbers of keys seen 1 to 4 times; 0.5, 1 and 1.5 where they fail."""
    n1, n2, n3, n4 = n
    if n1 and n2 and n3:
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 < x <= k for k, x in enumerate(d, 1)):
            return d
    return (0.5, 1.0, 1.5)


def _mixed(keys: np.ndarray) -> np.ndarray:
    h = keys * PRIME
    return (h ^ (h >> np.uint64(32))) * PRIME >> np.uint64(33)


def _bucket_of(keys: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    head = keys >> np.uint64(32)
    spread = np.isin(head, hot) if len(hot) else np.zeros(len(keys), bool)
    return (_mixed(np.where(spread, keys, head)) % np.uint64(buckets)).astype(np.int64)


def _trimmed(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A group's function after which unused memory goes back, as `lean` does for tasks."""
    def wrapped(table: pa.Table) -> pa.Table:
        once = lean(lambda tables: map(run, tables))
        return list(once(iter([table])))[0]
    return wrapped


def _rows(batch: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(batch, schema=schema)


def count_words(train: DataFrame, folder: str) -> tuple[Vocabulary, np.ndarray, int]:
    """The vocabulary, hashes and counts of its most frequent words, and the number of documents."""
    bits = _power_bits(train.rdd.getNumPartitions())
    bucket = Vocabulary(bits, {}, 0, 0).bucket
    def hashes_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        hashes, at, _ = tokens(raw)
        return hashes, np.bincount(at, minlength=len(hashes))

    packed = _counted(train, hashes_of, bucket)

    @_trimmed
    def merge(table: pa.Table) -> pa.Table:
        keys, counts = _unpacked(table)
        b = table["bucket"][0].as_py()
        top = np.argsort(-counts, kind="stable")[:64]
        return pa.table({"bucket": pa.array([b], pa.int32()), "path": [_save(folder, f"words-{b}", {"key": keys, "count": counts})], "n": [len(keys)],
                         "total": [int(counts.sum())], "place": [top.tolist()], "count": [counts[top].tolist()],
                         "ends": [int(counts[0]) if len(keys) and keys[0] == END else 0]})

    rows = stored(packed.groupBy("bucket").applyInArrow(merge, "bucket int, path string, n long, total long, place array<long>, count array<long>, ends long"), "words").orderBy("bucket").collect()
    files, base, often = {}, 0, []
    for r in rows:
        files[r["bucket"]] = (r["path"], base)
        often += [(base + p, c) for p, c in zip(r["place"], r["count"])]
        base += r["n"]
    if base > MOST_WORDS:
        raise ValueError("more different words than 32-bit numbers")
    return Vocabulary(bits, files, base, sum(r["total"] for r in rows)), np.array(often, np.int64).reshape(-1, 2), sum(r["ends"] for r in rows)


def train_model(docs: DataFrame, chosen: Column, text_col: str = "text", folder: str | None = None, span: int = SPAN, order: int = 2) -> Model:
    """Counts the documents for which `chosen` holds; `order` is 2 or 3."""
    if order not in (2, 3):
        raise ValueError(f"order {order} is neither 2 nor 3")
    folder = folder or work_path(docs.sparkSession, "bigrams")
    train = docs.filter(chosen).select(text_bytes(text_col).alias("raw"))
    vocabulary, often, documents = count_words(train, folder)
    buckets = max(1, -(-vocabulary.tokens // BUCKET_TOKENS))
    begin = vocabulary.words
    # the words of each file with the largest counts are known; a hot word is among them as long as a file has fewer than 64 such
    most = HOT_SHARE * vocabulary.tokens / buckets
    hot = np.array(sorted([*often[often[:, 1] > most, 0].tolist(), *([begin] if documents > most else [])]), np.uint64)

    def keys_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        number, _, lengths = _numbered(raw, vocabulary)
        return np.unique(_joined(_bigrams(number, lengths, begin), number), return_counts=True)

    packed = _counted(train, keys_of, lambda keys: _bucket_of(keys, buckets, hot))
    sums = pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("large", pa.string()), ("n", pa.list_(pa.int64())), ("span", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("values", pa.binary()), ("place", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
    sums_type = "bucket int, path string, large string, n array<long>, span int, kind int, ids binary, values binary, place array<long>, times array<long>"

    def span_rows(kind: int, ids: np.ndarray, n: np.ndarray) -> Iterator[dict]:
        for s in np.unique(ids // span):
            a, z = np.searchsorted(ids, (s * span, (s + 1) * span))
            yield {"span": int(s), "kind": kind, "ids": _planes(np.diff(ids[a:z] - s * span, prepend=0).astype(np.uint32)), "values": _planes(n[a:z].astype(np.uint32))}

    @_trimmed
    def merge(table: pa.Table) -> pa.Table:
        keys, counts = _unpacked(table)
        b = table["bucket"][0].as_py()
        path, large = _counts_file(folder, f"bigrams-{b}", keys, counts)
        top = np.argsort(-counts, kind="stable")[:64]
        out = [{"bucket": b, "path": path, "large": large, "n": [*_times(counts).values(), len(keys)], "place": top.tolist(), "times": counts[top].tolist()}]
        head, tail = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        kinds = [*[(k, head[counts == k + 1 if k < 2 else counts > 2]) for k in range(3)], (3, tail)]
        for kind, ids in kinds:
            out += span_rows(kind, *np.unique(ids, return_counts=True))
        return _rows(out, sums)

    found = stored(packed.groupBy("bucket").applyInArrow(
        merge, sums_type), "bigrams")

    @_trimmed
    def gather(table: pa.Table) -> pa.Table:
        dense = np.zeros((4, span), np.int64)
        for kind, ids, values in zip(table["kind"].to_pylist(), table["ids"].to_pylist(), table["values"].to_pylist()):
            dense[kind][np.cumsum(_unplaned(ids, np.uint32).astype(np.int64))] += _unplaned(values, np.uint32)
        s = table["span"][0].as_py()
        used = int(np.flatnonzero(dense.any(0))[-1]) + 1 if dense.any() else 0
        path = _save(folder, f"dense-{s}", {k: _narrow(v) for k, v in zip(("once", "twice", "more", "preceding"), dense[:, :used])})
        return pa.table({"span": pa.array([s], pa.int32()), "path": [path], "n": [list(_times(dense[3][:used]).values())], "above": [int((dense[3] > 2).sum())]})

    files = found.filter(F.col("bucket").isNotNull()).select("bucket", "path", "large", "n", "place", "times").orderBy("bucket").collect()
    gathered = lambda rows, name: stored(rows.filter(F.col("span").isNotNull()).select("span", "kind", "ids", "values").groupBy("span").applyInArrow(
        gather, "span int, path string, n array<long>, above long"), name)
    spans = gathered(found, "dense").collect()
    discard(found)
    sums_of = lambda rows, k: [sum(r["n"][i] for r in rows) for i in range(k)]
    n, low = sums_of(files, 5), sums_of(spans, 4)
    low_discounts = _discounts(low)
    above = sum(r["above"] for r in spans)
    share = (low_discounts[0] * low[0] + low_discounts[1] * low[1] + low_discounts[2] * above) / n[4] if n[4] else 1.0
    bases, base = {}, 0
    for r in files:
        bases[r["bucket"]] = base
        base += r["n"][4]
    model = Model(vocabulary, buckets, hot, {r["bucket"]: (r["path"], r["large"]) for r in files}, {r["span"]: r["path"] for r in spans},
                  documents, n[4], _discounts(n[:4]), low_discounts, share, span, bases, {r["bucket"]: r["n"][4] for r in files})
    if order == 2:
        return model
    if base > MOST_WORDS:
        raise ValueError("more different bigrams than 32-bit numbers")
    often = [(bases[r["bucket"]] + p, c) for r in files for p, c in zip(r["place"], r["times"])] + [(base, documents)]
    hot_pairs = np.array(sorted(p for p, c in often if c > most), np.uint64)

    def trigrams_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        number, _, lengths = _numbered(raw, vocabulary)
        return np.unique(_joined(_bigrams(model.ranked(number, lengths), lengths, base), number), return_counts=True)

    @_trimmed
    def merge_trigrams(table: pa.Table) -> pa.Table:
        keys, counts = _unpacked(table)
        b = table["bucket"][0].as_py()
        path, large = _counts_file(folder, f"trigrams-{b}", keys, counts)
        out = [{"bucket": b, "path": path, "large": large, "n": [*_times(counts).values(), len(keys)]}]
        pair = (keys >> np.uint64(32)).astype(np.int64)
        for kind in range(3):
            out += span_rows(kind, *np.unique(pair[counts == kind + 1 if kind < 2 else counts > 2], return_counts=True))
        del counts
        # keys ascend, so those of the begin mark, which has the largest number, are last
        known = int(np.searchsorted(pair, base))
        middle = np.full(len(keys), begin, np.uint64)
        middle[:known] = model.keys_of(pair[:known])
        del pair
        middle <<= np.uint64(32)
        middle |= keys & np.uint64(0xFFFFFFFF)
        del keys
        ends, n = np.unique(middle, return_counts=True)
        del middle
        ranks, _ = model.places_of(ends)
        by = np.argsort(ranks)
        return _rows([*out, *span_rows(3, ranks[by], n[by])], sums)

    def by_first_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([f for f in sums if f.name in ("span", "kind", "ids", "values")])
        for batch in batches:
            for s, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ranks = np.arange(s * span, min((s + 1) * span, base))
                before, held = np.zeros(len(ranks), np.int64), columns_of(path)[3][:len(ranks)]
                before[:len(held)] = held
                head = (model.keys_of(ranks) >> np.uint64(32)).astype(np.int64)
                out = []
                for kind, some in enumerate((before == 1, before == 2, before > 2)):
                    out += span_rows(kind, *np.unique(head[some], return_counts=True))
                ids, at = np.unique(head, return_inverse=True)
                out += span_rows(3, ids, np.bincount(at, before, len(ids)).astype(np.int64))
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    counted = stored(_counted(train, trigrams_of, lambda keys: _bucket_of(keys, buckets, hot_pairs)).groupBy("bucket").applyInArrow(
        merge_trigrams, sums_type), "trigrams")
    top = counted.filter(F.col("bucket").isNotNull()).select("bucket", "path", "large", "n").collect()
    pairs = gathered(counted, "pairs")
    held = pairs.collect()
    discard(counted)
    heads = gathered(pairs.select("span", "path").mapInArrow(by_first_word, "span int, kind int, ids binary, values binary"), "heads").collect()
    model.upper = Upper({r["bucket"]: (r["path"], r["large"]) for r in top}, hot_pairs, {r["span"]: r["path"] for r in held},
                        {r["span"]: r["path"] for r in heads}, base, _discounts(sums_of(top, 4)), _discounts(sums_of(held, 4)))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, shared.value.score(as_bytes(part.column(1))))],
                                                 ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes(text_col).alias("raw")).mapInArrow(
        lean(run, _forget), f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double")
