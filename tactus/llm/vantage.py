"""SimHash near duplicates, linked exactly by a vantage-point tree over the fingerprints.

1. One pass makes a 64-bit fingerprint of each text: a bit is 1 if it is set in over half of the XXH64 values (seed 42) of
   the text's word shingles, repeats counted. From here on each different fingerprint is one row, however many documents
   have it.
2. A vantage-point tree divides the fingerprints into leaves (the shards). A node has a vantage point and a radius: what
   lies within the radius has its home inside, the rest outside. Trees are grown level by level: each leaf that is too
   large gets a tree of its own, fitted on a sample of at most `SAMPLE` of its fingerprints; all fingerprints are routed.
3. The triangle bound says which other leaves can hold a link. A link of the inside and the outside of a node is found
   inside: a fingerprint of the outside that lies within the radius plus the link's distance also visits the inside.
   A visitor follows both sides of a node where the bound allows both, and meets only those who are at home.
4. In a leaf all that are at home are compared with all that the bound of the leaf's own vantage point leaves, in blocks
   of bounded size. What leaves a task is a spanning forest of its links, never the pairs; components of all forests are the groups.

Words: runs without ASCII white space, A-Z lowered. Fewer words than a shingle has: the whole sequence is one. No words
(null, empty, white space): fingerprint zero, linked like any other. Null ids count as larger than all others; a group of
null ids alone has a null id. Repeated rows are documents of their own. An empty table gives an empty result. Extra
columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import as_bytes, lean, slices, stored, text_bytes
from tactus.llm.components import components

WORDS = 3
DISTANCE = 2
SEED = 42
#: Fingerprints at home in a leaf that is not divided any more.
LEAF = 2_048
#: Most fingerprints that a tree is fitted on, and most divisions from its root to a leaf.
SAMPLE, DEPTH = 8_192, 8
#: Leaf numbers have a digit of this base per level.
FAN = 1 << (DEPTH + 1)
MOST_LEVELS = 6
#: Members of a leaf that a task compares at once; larger leaves are cut into blocks, and each pair of blocks is a task.
BLOCK = 32_768
#: Distances computed at once.
CELLS = 1 << 22
#: Words of a long text handled at once.
WINDOW = 1 << 16

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(raw: bytes, n: int = WORDS) -> int:
    """The SimHash of a text's word shingles."""
    words = raw.lower().split()
    if not words:
        return 0
    n = min(n, len(words))
    total, bits = len(words) - n + 1, np.zeros(64, np.int64)
    for start in range(0, total, WINDOW):
        part = words[start:min(start + WINDOW, total) + n - 1]
        h = np.fromiter(map(_hash, map(b" ".join, zip(*(part[k:] for k in range(n))))), "<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > total, bitorder="little").view("<u8")[0])


def signed(docs: DataFrame, text_col: str = "text", n: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every text; fp is the fingerprint's 64 bits as a long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                fps = np.fromiter((fingerprint(x, n) for x in as_bytes(part.column(1))), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes(text_col).alias("raw")).mapInArrow(lean(run), f"doc_id {id_type}, fp long")


NODE = np.dtype([("point", "<u8"), ("radius", "<i4"), ("inside", "<i4"), ("outside", "<i4")])


def _division(x: np.ndarray, distance: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """A vantage point and a radius that leave little work on both sides and at the border; none if all lie too close."""
    best, found = np.inf, None
    for point in rng.choice(x, min(16, len(x)), replace=False):
        share = np.bincount(np.bitwise_count(x ^ point), minlength=66 + 2 * distance) / len(x)
        below = np.concatenate((np.zeros(distance + 1), np.cumsum(share)))  # below[r + distance + 1]: share within r
        for radius in range(64):
            inside = below[radius + distance + 1]
            outside = 1 - inside
            if min(inside, outside) < 0.1:
                continue
            crossing = below[radius + 2 * distance + 1] - inside
            either = below[radius + 2 * distance + 1] - below[radius + 1]
            cost = (inside ** 2 + outside ** 2) / 2 + inside * crossing + either / 3
            if cost < best:
                best, found = cost, (int(point), radius)
    return found if best < 0.95 else None


def grow(sample: np.ndarray, leaves: int, distance: int = DISTANCE, seed: int = 0) -> np.ndarray:
    """A tree of about `leaves` leaves as an array of nodes; children below zero are leaves, numbered from -1 down."""
    rng, nodes = np.random.default_rng(seed), []
    number = 0
    enough = max(8, len(sample) // max(1, leaves))

    def add(x: np.ndarray, depth: int) -> int:
        nonlocal number
        cut = _division(x, distance, rng) if len(x) > enough and depth < DEPTH else None
        if cut is None:
            number += 1
            return -number
        at = len(nodes)
        nodes.append(None)
        near = np.bitwise_count(x ^ np.uint64(cut[0])) <= cut[1]
        nodes[at] = (*cut, add(x[near], depth + 1), add(x[~near], depth + 1))
        return at

    add(sample, 0)
    return np.array(nodes, NODE)


def route(tree: np.ndarray, x: np.ndarray, home: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home) of fingerprints in the leaves where they are at home or visit; leaves count from 1."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    todo = [(0 if len(tree) else -1, np.arange(len(x)), home)]
    while todo:
        at, rows, own = todo.pop()
        if at < 0:
            out.append((rows, -at, own))
            continue
        node = tree[at]
        d = np.bitwise_count(x[rows] ^ node["point"]).astype(np.int32)
        r = node["radius"]
        inside = d <= r + distance  # those beyond the radius as visitors
        outside = np.where(own, d > r, d > r - distance)
        todo.append((int(node["inside"]), rows[inside], own[inside] & (d[inside] <= r)))
        todo.append((int(node["outside"]), rows[outside], own[outside]))
    return (np.concatenate([r for r, _, _ in out]), np.concatenate([np.full(len(r), k) for r, k, _ in out]),
            np.concatenate([h for _, _, h in out]))


def _fitted(big: DataFrame, rows: DataFrame, distance: int) -> DataFrame:
    """A tree for each of the leaves in `big`, fitted on a sample of its fingerprints."""
    chance = F.lit(float(1 << 30)) * F.least(F.lit(1.0), F.lit(float(SAMPLE) * 0.9) / F.col("homes"))
    sample = rows.filter("home").join(big, "leaf").filter(F.pmod(F.xxhash64("fp", "leaf"), F.lit(1 << 30)) < chance)

    def fit(table: pa.Table) -> pa.Table:
        x = np.sort(table["fp"].to_numpy().view(np.uint64))
        homes = table["homes"][0].as_py()
        tree = grow(x, min(1 << DEPTH, -(-2 * homes // LEAF)), distance, len(x))
        return pa.table({"leaf": table["leaf"][:1], "tree": pa.array([tree.tobytes()], pa.binary())})

    return sample.select("leaf", "fp", "homes").groupBy("leaf").applyInArrow(fit, "leaf long, tree binary")


def placed(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(leaf, fp, home) of all different fingerprints `fp`, with a row for each leaf that it lives in or visits."""
    rows = fps.select(F.lit(0).cast("long").alias("leaf"), "fp", F.lit(True).alias("home"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, x = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            home, trees = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).dictionary_encode()
            code = trees.indices.to_numpy(zero_copy_only=False)
            for k, tree in enumerate(trees.dictionary.to_pylist()):
                mine = np.flatnonzero(code == k)
                row, to, own = route(np.frombuffer(tree, NODE), x[mine], home[mine], distance)
                for i in range(0, len(row), 1 << 18):
                    at = mine[row[i:i + (1 << 18)]]
                    yield pa.RecordBatch.from_arrays([pa.array(leaf[at] * FAN + to[i:i + (1 << 18)]), pa.array(x[at].view(np.int64)), pa.array(own[i:i + (1 << 18)])],
                                                     ["leaf", "fp", "home"])

    done = None
    for _ in range(MOST_LEVELS):
        sizes = stored(rows.groupBy("leaf").agg(F.count_if("home").alias("homes")).filter(F.col("homes") > LEAF), "leaves")
        if sizes.isEmpty():
            break
        trees = stored(_fitted(sizes, rows, distance).filter(F.length("tree") > 0), "trees")  # leaves without a division stay as they are
        left = rows.join(trees.select("leaf"), "leaf", "left_anti")
        done = left if done is None else done.union(left)
        rows = stored(rows.join(trees, "leaf").select("leaf", "fp", "home", "tree").mapInArrow(lean(run), "leaf long, fp long, home boolean"), "placed")
    return rows if done is None else done.union(rows)


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each component after adding the edges (a, b) to a labelling whose labels are roots."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def forest(x: np.ndarray, home: np.ndarray, block: np.ndarray, pair: tuple[int, int], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in a leaf: of those at home with all others, of two blocks if `pair` has two."""
    d = np.bitwise_count(x ^ x[np.argmax(home)]).astype(np.int64)
    order = np.lexsort((x, d))
    x, home, block, d = x[order], home[order], block[order], d[order]
    label = np.arange(len(x))
    for k in np.unique(d[home]):
        a, b = np.searchsorted(d, (k - distance, k + distance + 1))  # the triangle bound of the leaf's own vantage point
        own = np.flatnonzero(home & (d == k))
        step = max(1, CELLS // (b - a))
        for i in range(0, len(own), step):
            mine = own[i:i + step]
            near = np.bitwise_count(x[mine, None] ^ x[None, a:b]) <= distance
            if pair[0] != pair[1]:
                near &= block[mine, None] != block[None, a:b]
            u, v = np.nonzero(near)
            label = merged(label, mine[u], v + a)
    linked = np.flatnonzero(label != np.arange(len(x)))
    return x[linked], x[label[linked]]


def edges(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(u, v): edges of fingerprints within the distance whose components are those of all links."""
    rows = placed(fps, distance)
    blocks = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = rows.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def run(table: pa.Table) -> pa.Table:
        home = table["home"].to_numpy()
        u, v = [], []
        if home.any():
            u, v = (e.view(np.int64) for e in forest(table["fp"].to_numpy().view(np.uint64), home, table["block"].to_numpy(),
                                                     (table["i"][0].as_py(), table["j"][0].as_py()), distance))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.select("leaf", "i", "j", "block", "fp", "home").groupBy("leaf", "i", "j").applyInArrow(run, "u long, v long")


def groups(docs: DataFrame, text_col: str = "text", n: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id (the least id that links of fingerprints reach) of every document."""
    rows = stored(signed(docs, text_col, n), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "different")
    roots = stored(components(edges(fps, distance)), "roots").withColumnRenamed("node", "fp")
    of_root = fps.join(roots, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = fps.join(roots.join(of_root, "root"), "fp", "left").select(
        F.col("fp").alias("of_fp"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.join(of_fp, F.col("fp") == F.col("of_fp"), "left").select("doc_id", "fp", "component_id")
