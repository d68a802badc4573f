"""Phrase collocations by partitioned mining: texts are dealt into shards, each shard is mined alone, word by word longer.

1. Texts are dealt into shards of bounded size, each of one language, evenly whatever the texts are; a shard is the whole
   of a task (tasks of small languages hold several). Its words become numbers, which it writes to a file once.
2. A shard counts its different words, and then its different phrases one word longer, of which the beginning and the rest
   are frequent in the language. Keys and counts leave it packed, a row for each of the language's buckets of keys.
3. A bucket adds up the shards' counts, numbers the keys that have the support, and answers each shard with a bit per key
   and the numbers of the frequent ones. A longer phrase's key is the number of its beginning and that of its last word, so
   keys stand for phrases exactly; only the words themselves travel as text.
4. Frequent phrases get their words by joins with the shorter ones. Scores and containment are joins of them with each other.

A shard sends each of its different phrases at most once, whatever the number of shards: what leaves the shards is at most
in proportion to the text. A bucket holds about as many keys as a shard sends, divided by `BUCKETS`.

Pieces end at . , ; : ! ? and line ends (LF, VT, FF, CR); words are runs without blanks and tabs, A-Z lowered. Null,
empty and blank texts have no words. A null language counts as `und`. Repeated rows count each time. Ties in score and
count are settled by the phrase's bytes. An empty table gives an empty result. Extra columns are not read. Numbers of words
have 28 bits and those of phrases 36: above that many frequent ones of a length in a language it stops with an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.llm.common import lean, stored, text_bytes, work_path

SUPPORT = 30
LONGEST = 4
TOP = 2_000
#: Bytes of text in a shard.
SHARD_BYTES = 32 << 20
#: Buckets of keys for each shard of a language.
BUCKETS = 2
#: A phrase goes if a longer one around it has this share of its count.
CONTAINED_PERCENT = 80
SCALE = 2_000_000
#: A to Z lowered, tabs to blanks, marks and line ends that end a piece to line feeds.
PIECE_BYTES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a key for its last word; the others hold the number of its beginning.
LAST_BITS = 28
#: Keys sent at a time, and positions sorted at a time.
SENT, PART = 500_000, 1 << 19
#: What leaves a shard: its file and number of words (bucket -1), or its keys of a bucket with their counts.
LEAVES = "lang string, shard int, part int, shards int, bucket int, n long, keys binary, counts binary, path string"
#: What a bucket settles: frequent keys, and for each shard which of its keys are frequent and their places.
SETTLED = "lang string, shard int, part int, bucket int, flags binary, places binary, number long, head long, last long, word string, f long"
SETTLED_SCHEMA = pa.schema([
    ("lang", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("bucket", pa.int32()), ("flags", pa.binary()), ("places", pa.binary()),
    ("number", pa.int64()), ("head", pa.int64()), ("last", pa.int64()), ("word", pa.string()), ("f", pa.int64())])
LEAVES_SCHEMA = pa.schema([
    ("lang", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("shards", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()),
    ("keys", pa.binary()), ("counts", pa.binary()), ("path", pa.string())])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, so that small numbers compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    h = keys * PRIME
    return ((h ^ (h >> np.uint64(32))) * PRIME >> np.uint64(33)) % np.uint64(buckets)


def _segments(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, ascending, and the places where it does, in their order."""
    order = np.argsort(buckets.astype(np.uint16) if buckets.size and buckets.max() < 1 << 16 else buckets, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(buckets[order]) != 0, [True]))) if len(order) else []
    for a, z in zip(edges[:-1], edges[1:]):
        yield int(buckets[order[a]]), order[a:z]


class Words:
    """The texts of a shard while they come in: words are numbered from 2 in order of their first occurrence."""

    def __init__(self):
        self.numbers, self.texts = _Numbers({b"\n": 0, b"": 1}), []

    def add(self, raw: bytes) -> None:
        found = raw.translate(PIECE_BYTES).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found))
        self.texts += [ids[ids != 1], np.zeros(1, np.int32)]

    def closed(self, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, list[bytes], np.ndarray]]]:
        """Word numbers of the texts (0 where a piece ends), the bucket of each word, and words and counts by bucket."""
        ids, words = np.concatenate(self.texts), list(self.numbers)
        self.__init__()
        bucket = _bucket_of(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), buckets).astype(np.int32)
        counts = np.bincount(ids, minlength=len(words))
        return ids, bucket, [(b, [words[i + 2] for i in at.tolist()], counts[at + 2]) for b, at in _segments(bucket[2:])]


def _save(folder: str, columns: list[np.ndarray]) -> str:
    """An Arrow file with a batch for each array, under a name of its own."""
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    name, schema = f"shard-{uuid.uuid4().hex}.arrow", pa.schema([("number", pa.int32())])
    with store.open_output_stream(f"{base}/{name}") as out, pa.ipc.new_file(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for column in columns:
            writer.write_batch(pa.RecordBatch.from_arrays([pa.array(column, pa.int32())], schema=schema))
    return f"{folder}/{name}"


def _load(path: str) -> list[np.ndarray]:
    store, name = pafs.FileSystem.from_uri(path)
    with store.open_input_file(name) as source:
        file = pa.ipc.open_file(source)
        return [file.get_batch(k).column(0).to_numpy() for k in range(file.num_record_batches)]


Replies = dict[int, tuple[bytes, bytes]]


def _numbers(reply: tuple[bytes, bytes] | None, bucket: int, buckets: int, size: int) -> np.ndarray:
    """The language's numbers of a shard's keys of a bucket, -1 for those that are not frequent."""
    out = np.full(size, -1, np.int64)
    if reply:
        some = np.unpackbits(np.frombuffer(reply[0], np.uint8), count=size).view(bool)
        out[some] = np.cumsum(_unplaned(reply[1], np.uint32), dtype=np.uint32).astype(np.int64) * buckets + bucket
    return out


class Shard:
    """A shard whose phrases are mined word by word longer.

    `words` holds the language's number of the word at each position, `found` that of the phrase of `length` words which
    starts there; -1 stands for ends of pieces and for what is not frequent.
    """

    def __init__(self, path: str, buckets: int, replies: Replies):
        ids, bucket = _load(path)
        numbers = np.full(len(bucket), -1, np.int32)
        for b, at in _segments(bucket[2:]):
            numbers[at + 2] = _numbers(replies.get(b), b, buckets, len(at))
        self.words, self.buckets = numbers[ids], buckets
        self.found, self.length = self.words, 1

    def keys(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, counts, positions in order of the keys) of the different phrases one word longer whose beginning and
        rest are frequent, some buckets at a time."""
        n = self.length
        at = np.flatnonzero((self.found[:-1] >= 0) & (self.found[1:] >= 0)) if len(self.found) else np.zeros(0, int)
        at = at.astype(np.int32)
        made = lambda at: self.found[at].astype(np.uint64) << np.uint64(LAST_BITS) | self.words[at + n].astype(np.uint64)
        parts = min(self.buckets, -(-len(at) // PART))
        side = np.empty(len(at), np.int32)
        for a in range(0, len(at) if parts > 1 else 0, PART):
            side[a:a + PART] = _bucket_of(made(at[a:a + PART]), self.buckets) % np.uint64(parts)
        for part in range(parts):
            mine = at[side == part] if parts > 1 else at
            key = made(mine)
            order = np.argsort(key)
            key = key[order]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            yield key[start], np.diff(np.append(start, len(key))), mine[order]

    def grow(self, replies: Replies) -> None:
        """Makes phrases one word longer, by what their buckets settled."""
        found = np.full(len(self.found), -1, np.int64)
        for keys, counts, at in self.keys():
            numbers = np.empty(len(keys), np.int64)
            for b, mine in _segments(_bucket_of(keys, self.buckets)):
                numbers[mine] = _numbers(replies.get(b), b, self.buckets, len(mine))
            found[at] = np.repeat(numbers, counts)
        self.found, self.length = found, self.length + 1


def _shards(docs: DataFrame, text_col: str, lang_col: str, shard_bytes: int) -> tuple[DataFrame, int]:
    """(lang, shard, shards, part, raw) of all texts that are not empty, and the number of parts (tasks)."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_bytes(text_col).alias("raw")).filter(F.length("raw") > 0)
    sizes = rows.groupBy("lang").agg(F.sum(F.length("raw")).alias("bytes"))
    sizes = sizes.withColumn("shards", F.ceil(F.col("bytes") / shard_bytes).cast("int"))
    # a language of several shards takes a part for each; languages of one shard share parts of about its size
    several = F.when(F.col("shards") > 1, F.col("shards")).otherwise(0)
    along = Window.partitionBy(F.lit(0)).orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)  # a row per language
    small = F.floor(F.coalesce(F.sum(F.when(F.col("shards") == 1, F.col("bytes")).otherwise(0)).over(along), F.lit(0)) / shard_bytes)
    sizes = sizes.withColumns({"_own": F.coalesce(F.sum(several).over(along), F.lit(0)), "_small": small})
    own = sizes.agg(F.sum(several).alias("n")).select(F.coalesce("n", F.lit(0)).alias("_all"))
    sizes = stored(sizes.join(F.broadcast(own)).select("lang", "shards", F.when(F.col("shards") > 1, F.col("_own")).otherwise(F.col("_all") + F.col("_small")).alias("first")), "shards")
    parts = sizes.agg(F.max(F.col("first") + F.col("shards"))).first()[0] or 1
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("shards"))
    rows = rows.join(sizes, "lang").withColumn("shard", shard.cast("int"))
    return rows.select("lang", "shard", "shards", (F.col("first") + F.col("shard")).cast("int").alias("part"), "raw"), parts


def _in_batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += row["n"]
        if n >= SENT:
            yield pa.RecordBatch.from_pylist(held, schema=LEAVES_SCHEMA)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=LEAVES_SCHEMA)


def _numbered(rows: DataFrame, parts: int, folder: str) -> DataFrame:
    """Writes each shard as numbers; its file, its words and their counts leave it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple[str, int], tuple[dict, Words]] = {}
        for batch in batches:
            lang, shard, shards, part, raw = batch.columns
            for i in range(batch.num_rows):
                key = lang[i].as_py(), shard[i].as_py()
                if key not in open_:
                    open_[key] = {"lang": key[0], "shard": key[1], "part": part[i].as_py(), "shards": shards[i].as_py()}, Words()
                open_[key][1].add(raw[i].as_py())
        while open_:
            _, (row, words) = open_.popitem()
            ids, bucket, by_bucket = words.closed(row["shards"] * BUCKETS)
            yield from _in_batches(iter([row | {"bucket": -1, "n": int((ids > 0).sum()), "path": _save(folder, [ids, bucket])}]))
            yield from _in_batches(row | {"bucket": b, "n": len(some), "keys": b" ".join(some), "counts": _planes(counts.astype(np.uint32))} for b, some, counts in by_bucket)

    return rows.repartitionById(parts, "part").mapInArrow(lean(run), LEAVES)


def _longer(shards: DataFrame, settled: list[DataFrame], parts: int) -> DataFrame:
    """Keys and counts of the phrases one word longer than those settled last, as they leave the shards."""
    lengths = len(settled)
    nothing = lambda *names: [F.lit(None).cast("binary").alias(x) for x in names]
    rows = shards.filter("bucket = -1").select("lang", "shard", "part", F.lit(0).alias("length"), F.col("shards").alias("bucket"), "path", *nothing("flags", "places"))
    for k, of in enumerate(settled, 1):
        rows = rows.union(of.filter("flags is not null").select("lang", "shard", "part", F.lit(k), "bucket", F.lit(None).cast("string"), "flags", "places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[dict, list[Replies]]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                row, replies = held.setdefault((r["lang"], r["shard"]), ({"lang": r["lang"], "shard": r["shard"], "part": r["part"]}, [{} for _ in range(lengths)]))
                if r["length"]:
                    replies[r["length"] - 1][r["bucket"]] = r["flags"], r["places"]
                else:
                    row |= {"shards": r["bucket"], "from": r["path"]}
        while held:
            _, (row, replies) = held.popitem()
            shard = Shard(row.pop("from"), row["shards"] * BUCKETS, replies[0])
            for reply in replies[1:]:
                shard.grow(reply)
            yield from _in_batches(
                row | {"bucket": b, "n": len(mine), "keys": _planes(np.diff(keys[mine], prepend=np.uint64(0))), "counts": _planes(counts[mine].astype(np.uint32))}
                for keys, counts, _ in shard.keys() for b, mine in _segments(_bucket_of(keys, shard.buckets)))

    return rows.repartitionById(parts, "part").mapInArrow(lean(run), LEAVES)


def _settle(table: pa.Table, support: int, words: bool) -> pa.Table:
    """Adds up a bucket of a language: numbers its frequent keys and tells each shard which of its keys they are."""
    sizes, (row, *_) = table["n"].to_numpy(), table.select(["lang", "bucket", "shards"]).slice(0, 1).to_pylist()
    bucket, buckets = row["bucket"], row["shards"] * BUCKETS
    counts = np.concatenate([_unplaned(x, np.uint32) for x in table["counts"].to_pylist()]).astype(np.int64)
    if words:
        keys = pa.array([w for x in table["keys"].to_pylist() for w in x.split(b" ")], pa.binary()).dictionary_encode()
        back, different = keys.indices.to_numpy(), keys.dictionary
        total = np.zeros(len(different), np.int64)
        np.add.at(total, back, counts)
    else:
        keys = np.concatenate([np.cumsum(_unplaned(x, np.uint64), dtype=np.uint64) for x in table["keys"].to_pylist()])
        order = np.argsort(keys)
        first = np.concatenate(([True], np.diff(keys[order]) != 0))
        back = np.empty(len(keys), np.int64)
        back[order] = np.cumsum(first) - 1
        different, total = keys[order][first], np.add.reduceat(counts[order], np.flatnonzero(first))
    some = total >= support
    place, n = np.cumsum(some) - 1, int(some.sum())
    if n * buckets >= 1 << (LAST_BITS if words else 64 - LAST_BITS):
        raise ValueError("more frequent phrases of a length than a key has room for")
    no = lambda k, type_: pa.nulls(k, type_)
    if words:
        key = {"word": pa.array(different.filter(pa.array(some))).cast(pa.string())}
    else:
        key = {"head": pa.array((different[some] >> np.uint64(LAST_BITS)).astype(np.int64)), "last": pa.array((different[some] & np.uint64((1 << LAST_BITS) - 1)).astype(np.int64))}
    key |= {"lang": pa.array([row["lang"]] * n, pa.string()), "number": pa.array(np.arange(n) * buckets + bucket, pa.int64()), "f": pa.array(total[some])}
    out = [pa.table([key[f.name] if f.name in key else no(n, f.type) for f in SETTLED_SCHEMA], schema=SETTLED_SCHEMA)]
    ends, replies = np.cumsum(sizes), []
    for shard, part, a, z in zip(table["shard"].to_pylist(), table["part"].to_pylist(), ends - sizes, ends):
        mine = back[a:z][some[back[a:z]]]
        if len(mine):
            # words come in the shard's order, so their places may step back: 32 bits wrap around both ways
            replies.append({"lang": row["lang"], "shard": shard, "part": part, "bucket": bucket, "flags": np.packbits(some[back[a:z]]).tobytes(),
                            "places": _planes(np.diff(place[mine].astype(np.uint32), prepend=np.uint32(0)))})
    return pa.concat_tables([*out, pa.Table.from_pylist(replies, schema=SETTLED_SCHEMA)])


def _settled(leaves: DataFrame, support: int, words: bool) -> DataFrame:
    return leaves.groupBy("lang", "bucket").applyInArrow(lambda table: _settle(table, support, words), SETTLED)


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, n, phrase, f): exact counts of all phrases of one to `LONGEST` words that occur at least `support` times in their language.

    A row of n = 0 per language holds the number of its words.
    """
    rows, parts = _shards(docs, text_col, lang_col, shard_bytes)
    shards = stored(_numbered(rows, parts, work_path(docs.sparkSession, "numbers")), "words")
    settled: list[DataFrame] = []
    for n in range(1, LONGEST + 1):
        leaves = _longer(shards, settled, parts) if settled else shards.filter("bucket >= 0")
        settled.append(stored(_settled(leaves, support, n == 1), f"settled-{n}"))
    counts = shards.filter("bucket = -1").groupBy("lang").agg(F.lit(0).alias("n"), F.lit("").alias("phrase"), F.sum("n").alias("f"))
    single = settled[0].filter("number is not null").select("lang", "number", F.col("word").alias("phrase"), "f")
    counts, shorter = counts.union(single.select("lang", F.lit(1), "phrase", "f")), single
    for n, of in enumerate(settled[1:], 2):
        heads = shorter.select("lang", F.col("number").alias("head"), F.col("phrase").alias("beginning"))
        lasts = single.select("lang", F.col("number").alias("last"), F.col("phrase").alias("end"))
        found = of.filter("number is not null").select("lang", "number", "head", "last", "f").join(heads, ["lang", "head"]).join(lasts, ["lang", "last"])
        shorter = found.select("lang", "number", F.concat_ws(" ", "beginning", "end").alias("phrase"), "f")
        counts = counts.union(shorter.select("lang", F.lit(n), "phrase", "f"))
    return stored(counts, "frequent")


def _words(start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("words", F.lit(start) if isinstance(start, int) else start, length), " ")


def scored(found: DataFrame) -> DataFrame:
    """(lang, n, phrase, a, k, l, r, score) of all phrases of two words or more, by their lowest-scoring cut."""
    f = found.filter("n > 0")
    part = lambda name, count: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = f.filter("n > 1").select("lang", "n", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"), F.explode(F.expr("sequence(1, n - 1)")).alias("k"))
    cuts = cuts.withColumns({"head": _words(1, F.col("k")), "rest": _words(F.col("k") + 1, F.col("n") - F.col("k"))})
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"])
    wide = lambda x: f"cast({x} as decimal(19, 0))"
    score = F.expr(f"(cast({SCALE} as decimal(7, 0)) * {wide('a')}) div ({wide('l')} + {wide('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "n", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "n", "phrase", "a", "cut.*")


def contained(found: DataFrame) -> DataFrame:
    """(lang, phrase, around): the largest count of a longer phrase around each phrase."""
    longer = found.filter("n > 2").select("lang", "f", "n", F.split("phrase", " ").alias("words"), F.explode(F.expr("sequence(2, n - 1)")).alias("size"))
    inner = longer.withColumn("start", F.explode(F.expr("sequence(1, n - size + 1)")))
    return inner.groupBy("lang", _words(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("f").alias("around"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found = frequent(docs, text_col, lang_col, support, shard_bytes)
    alone = scored(found).join(contained(found), ["lang", "phrase"], "left")
    wide = lambda x: F.col(x).cast("decimal(19, 0)")
    alone = alone.filter(F.col("around").isNull() | (wide("around") * 100 < wide("a") * CONTAINED_PERCENT))
    first = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(first).cast("long")).filter(F.col("rank") <= top)
    totals = found.filter("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.drop("n").join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
