"""Join of near-duplicate documents: MinHash banding, verified on full sets of word n-grams.

1. One pass makes each text's set of hashed n-grams (five words), a 128-bit key of the set, a MinHash signature and its
   band hashes. Texts with equal sets are one class from here on, so thousands of copies cost one row.
2. Band and row counts follow from the recall wanted at the similarity: a linked pair shares a band with at least
   `RECALL`. Classes are shuffled on band hashes.
3. A bucket is never turned into pairs. Members of small buckets are compared by signature inside a task. A large bucket
   begins with one pivot. Jaccard distance is a metric: if most members are near the pivot (a link's distance or less),
   all that may be linked to a near one (twice that) are hung on the pivot, near ones are done, and far ones, if there
   are any, go on with those in between. Other large buckets, as those of a passage that many texts share, are cut into
   blocks, and pairs of blocks are compared by signature.
4. Components of these comparisons are candidates. Every class sends its full set once to its component (large components
   are cut into blocks, and each pair of blocks is a task). There all pairs are verified on the full sets, as matrix
   products; what leaves is a count of links per class and a spanning forest, not pairs.
5. Components of verified links are the groups.

Words: runs of ASCII letters and digits and non-ASCII characters, A-Z lowered. A text of fewer than five words is one
n-gram. Texts without words (null, empty, marks only) have no links and no group. Null ids are kept as they are; repeated
rows are copies of each other. Extra columns are not returned by `links` and kept by `one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactus.llm.common import as_bytes, lean, slices, stored, text_bytes, words
from tactus.llm.components import components

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
MOST_HASHES = 128
#: Classes in a block of a component; a task verifies one block or a pair of blocks.
BLOCK = 1_000
#: Members of a bucket that are compared whole at once; larger buckets begin with a pivot.
SMALL = 200
#: Similarities by signature: near is surely within a link's distance, far surely beyond twice that; a link is surely above.
NEAR, FAR, LINK = 0.9, 0.5, 0.6
KEPT_WORDS = 150_000
#: Size of the bitmap of wanted texts, a power of two.
BITS = 1 << 24
#: Columns of the matrices that count shared n-grams.
COLUMNS = 4_096
_RNG = np.random.default_rng(20240229)
MULTIPLY = _RNG.integers(0, 1 << 63, MOST_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 1 << 63, MOST_HASHES, dtype=np.uint64)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def bands_and_rows(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows per band (fewest false candidates) whose bands reach the recall within `most` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))) if similarity < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("the recall can't be reached with so few hashes")
    return best


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h
        return h


#: Hashes of words that this worker has met.
_WORDS = _Words()


def forget() -> None:
    _WORDS.clear()


def shingles(raw: bytes, n: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    found = words(raw)
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    n = min(n, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ w[k:len(w) - n + 1 + k]) * PRIME
        h ^= h >> np.uint64(29)
    return np.unique(h)


def set_key(x: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None


def minhash(x: np.ndarray, hashes: int) -> np.ndarray:
    """Least 32-bit values under `hashes` hash functions."""
    out = np.full(hashes, np.iinfo(np.uint32).max, np.uint64)
    for i in range(0, len(x), 2048):
        v = x[i:i + 2048, None] * MULTIPLY[None, :hashes]
        v += ADD[None, :hashes]
        v >>= np.uint64(32)
        np.minimum(out, v.min(0), out)
    return out


def band_hashes(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64) * PRIME
    for k in range(rows):
        h = (h ^ mins.reshape(bands, rows)[:, k]) * PRIME
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def signed(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, key, sig and bands of every text."""
    bands, rows = bands_and_rows(similarity, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingles(x) for x in as_bytes(part.column(1))]
                mins = [minhash(x, bands * rows) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array(map(set_key, sets), pa.binary()),
                    pa.array([None if m is None else m.astype(np.uint8).tobytes() for m in mins], pa.binary()),
                    pa.array([None if m is None else band_hashes(m, bands, rows).tolist() for m in mins], pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "key", "sig", "bands"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes(text_col).alias("raw"), F.xxhash64(text_col).alias("text_hash")).mapInArrow(
        lean(run, forget), f"doc_id {id_type}, text_hash long, key binary, sig binary, bands array<long>")


def _alike(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Share of equal signature bytes, row by row."""
    if not a:
        return np.zeros(0)
    matrix = lambda x: np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
    return (matrix(a) == matrix(b)).mean(1)


def _compared(pairs: DataFrame) -> DataFrame:
    """Adds the signature similarity `s` to (key, pivot) with their signatures; signatures go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _alike(batch.column(1).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s)], ["key", "pivot", "s"])

    return pairs.select("key", "sig", "pivot", "pivot_sig").mapInArrow(run, "key binary, pivot binary, s double")


def _roots(near: np.ndarray) -> np.ndarray:
    """Least index of each node's component, from a symmetric boolean matrix."""
    root = np.full(len(near), -1)
    for i in range(len(near)):
        if root[i] < 0:
            todo, seen = near[i].copy(), np.zeros(len(near), bool)
            seen[i] = True
            while (new := todo & ~seen).any():
                seen |= new
                todo = near[new].any(0)
            root[seen] = i
    return root


def _whole(table: pa.Table) -> pa.Table:
    """Links by signature inside each (bucket, i, j) of a bundle: each member to the least one of its component."""
    out: tuple[list, list] = ([], [])
    table = table.sort_by([("bucket", "ascending"), ("i", "ascending"), ("j", "ascending"), ("key", "ascending")])
    spot = np.stack([table[c].to_numpy().astype(np.int64) for c in ("bucket", "i", "j")], 1)
    keys, sigs = table["key"].to_pylist(), table["sig"].to_pylist()
    cut = np.flatnonzero(np.concatenate(([True], (spot[1:] != spot[:-1]).any(1), [True]))) if len(spot) else []
    for a, b in zip(cut[:-1], cut[1:]):
        sig = np.frombuffer(b"".join(sigs[a:b]), np.uint8).reshape(b - a, -1)
        least = LINK * sig.shape[1]
        near = np.stack([(row == sig).sum(1) >= least for row in sig])
        for i, r in enumerate(_roots(near)):
            if i != r:
                out[0].append(keys[a + i])
                out[1].append(keys[a + r])
    return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["u", "v"])


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (u, v) of classes whose signatures are alike, linear in the members of buckets."""
    rows = classes.select("key", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("pivot")).filter("n > 1")
    members = stored(rows.join(sizes, "bucket"), "members")
    sigs = classes.select("key", "sig")
    stars = members.filter((F.col("n") > SMALL) & (F.col("key") != F.col("pivot")))
    pairs = stored(stars.select("key", "pivot").distinct(), "pairs")
    alike = stored(_compared(pairs.join(sigs, "key").join(sigs.select(F.col("key").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")), "alike")
    judged = stored(stars.join(alike, ["key", "pivot"]), "judged")
    # Buckets in which most are near the pivot: all that may be linked to a near one are hung on the pivot, near ones are done.
    alike_most = judged.groupBy("bucket").agg(F.avg((F.col("s") >= NEAR).cast("double")).alias("share")).filter("share >= 0.5").select("bucket")
    hung = stored(judged.join(alike_most, "bucket", "left_semi").select("bucket", "key", "pivot", "s"), "hung")
    star_edges = hung.filter(F.col("s") >= FAR).select(F.col("key").alias("u"), F.col("pivot").alias("v")).distinct()
    far = hung.groupBy("bucket").agg(F.min("s").alias("least")).filter(F.col("least") < FAR).select("bucket")
    rest = hung.filter(F.col("s") < NEAR).join(far, "bucket", "left_semi").select("bucket", "key")
    others = members.join(alike_most, "bucket", "left_anti").select("bucket", "key")
    # Whatever is left is compared whole, large buckets by pairs of blocks.
    left = stored(rest.union(others), "left")
    blocks = left.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / (2 * SMALL)).cast("int").alias("blocks"))
    placed = left.join(blocks, "bucket").join(sigs, "key").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = blocks.agg(F.sum(F.pow(F.col("blocks"), 2) * 2 * SMALL)).first()[0] or 0  # about the rows that are compared, blocks counted
    bundles = int(rows) // 20_000 + 1
    bundled = placed.select("bucket", "i", "j", "key", "sig", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(bundles)).alias("bundle"))
    return star_edges.union(bundled.groupBy("bundle").applyInArrow(_whole, "u binary, v binary"))


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[column] > 1
    owner, column = owner[several], column[several]
    out = np.diag([float(len(s)) for s in sets]).astype(np.float32)
    if not len(column):
        return out
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    counts = np.zeros((n, n), np.float32)
    for start in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        x = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - start)), np.float32)
        x[owner[a:b], column[a:b] - start] = 1
        counts += x @ x.T
    np.fill_diagonal(counts, np.diag(out))
    return counts


def _verified(table: pa.Table, similarity: float) -> pa.Table:
    """Link counts and spanning edges of each (root, i, j) of a bundle."""
    table = table.sort_by([("root", "ascending"), ("i", "ascending"), ("j", "ascending"), ("key", "ascending")])
    roots, i, j = table["root"].to_pylist(), table["i"].to_numpy(), table["j"].to_numpy()
    change = np.array([roots[k] != roots[k - 1] for k in range(1, len(roots))], bool) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    cut = np.concatenate(([0], np.flatnonzero(change) + 1, [len(roots)])) if len(roots) else [0]
    keys, sets = table["key"].to_pylist(), table["grams"].to_pylist()
    copies, block = table["copies"].to_numpy(), table["block"].to_numpy()
    out_key, out_root, out_links = [], [], []
    for a, b in zip(cut[:-1], cut[1:]):
        own = [np.frombuffer(s, np.uint64) for s in sets[a:b]]
        size = np.array([len(s) for s in own], np.float32)
        both = _shared(own)
        linked = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-6 * size[:, None]
        np.fill_diagonal(linked, False)
        if i[a] != j[a]:  # pairs inside a block belong to the task of that block alone
            linked &= block[a:b, None] != block[None, a:b]
        out_links += (linked @ copies[a:b].astype(np.float64)).astype(np.int64).tolist()
        out_key += keys[a:b]
        out_root += [keys[a + r] for r in _roots(linked)]
    return pa.table([pa.array(out_key, pa.binary()), pa.array(out_root, pa.binary()), pa.array(out_links, pa.int64())], ["key", "root", "links"])


def _bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of a hash column modulo `BITS`, combined in Spark: at most BITS / 64 rows reach the driver."""
    at = F.pmod(F.col(column), F.lit(BITS).cast("long"))
    word = rows.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, 64L) as int))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[word["word"].to_numpy()] = word["bits"].to_numpy()
    return out.view(np.uint64)


def near_classes(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL,
                 block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key) of all documents, and classes (key, first_id, copies, links, root, group) with copies or links.

    `first_id` is the least id of the class, `root` the least key and `group` the least id of the component, `links` the number of other documents
    with at least the similarity, copies included.
    """
    rows = stored(signed(docs, text_col, similarity, recall), "signed")
    classes = stored(rows.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))).alias("first"), F.count(F.lit(1)).alias("copies"),
        F.first("sig").alias("sig"), F.first("bands").alias("bands")).select(
            "key", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), "copies", "sig", "bands"), "classes")
    found = components(candidates(classes)).withColumnRenamed("node", "key")
    sizes = stored(found, "candidates")
    n = sizes.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    wanted = stored(sizes.join(n, "root").join(classes.select("key", "first_id", "first_hash", "copies"), "key").select(
        F.col("key").alias("wanted_key"), "first_id", "first_hash", "copies", "root", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "wanted")

    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, "first_hash"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy().view(np.uint64) % np.uint64(BITS)
            some = batch.filter(pa.array((bits.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) == 1))
            for part in slices(some, 2):
                sets = [shingles(x) for x in as_bytes(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(set_key, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                                                 ["text_id", "text_hash", "key", "grams"])

    # Texts that surely belong to no wanted class are left out by a bitmap of fixed size before anything is shuffled; the join decides.
    texts = docs.select(F.col("doc_id").alias("text_id"), F.xxhash64(text_col).alias("text_hash"), text_bytes(text_col).alias("raw"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(lean(gather, forget), f"text_id {id_type}, text_hash long, key binary, grams binary")
    matched = found.join(wanted, (F.col("key") == F.col("wanted_key")) & (F.col("text_hash") == F.col("first_hash")) & F.col("text_id").eqNullSafe(F.col("first_id")))
    sets = matched.select("key", "copies", "root", "blocks", "grams").dropDuplicates(["key"])
    sets = sets.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = sets.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    bundles = max(1, wanted.agg(F.sum("blocks")).first()[0] or 0) // block + 1
    bundled = placed.select("root", "i", "j", "key", "copies", "block", "grams", F.pmod(F.xxhash64("root", "i", "j"), F.lit(bundles)).alias("bundle"))
    checked = stored(bundled.groupBy("bundle").applyInArrow(lambda t: _verified(t, similarity), "key binary, root binary, links long"), "verified")
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(checked.select(F.col("key").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "key")
    full = classes.select("key", "first_id", "copies").join(links, "key", "left").join(groups, "key", "left").filter("copies > 1 or links > 0")
    full = stored(full.select("key", "first_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "key").alias("root")), "linked")
    least = stored(full.groupBy("root").agg(F.min("first_id").alias("group")), "groups")
    return rows.select("doc_id", "key"), stored(full.join(least, "root").select("key", "first_id", "copies", "links", "root", "group"), "linked")


def links(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least id of the group; its own without links), n_links, copy_id (least id of equal sets)."""
    rows, linked = near_classes(docs, text_col, similarity, recall)
    return rows.join(linked, "key", "left").select(
        "doc_id", F.coalesce("group", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("first_id", "doc_id").alias("copy_id"))


def one_of_each(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One document of each group (that of the least id; nulls last), and all documents without words, with all columns."""
    rows, linked = near_classes(docs, text_col, similarity, recall)
    at, names = docs.columns.index(text_col), list(docs.columns)
    key = _free("key", names)

    def add_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                keys = pa.array([set_key(shingles(x)) for x in as_bytes(part.column(at))], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, keys], [*names, key])

    keyed = docs.mapInArrow(lean(add_key, forget), T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())]))
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    first = keyed.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(whole, F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(f"`{text_col}`"))).alias("kept"))
    # of a group's classes the one that holds the least id stays; classes of equal least id are settled by the key
    best = linked.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("key"))).alias("least"))
    gone = linked.join(best, "root").filter(F.col("key") != F.col("least.key")).select(F.col("key").alias(key))
    kept = first.join(gone, key, "left_anti").select("kept.*")
    return kept.unionByName(keyed.filter(F.col(key).isNull()).drop(key))


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name

