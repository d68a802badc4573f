"""Approximate nearest neighbours by largest inner product: NN-descent builds a graph, queries search it greedily.

* Equal vectors are one node; a node keeps its `MEMBERS` least ids, enough for every answer of fewer neighbours.
* Vectors get one more component that makes all norms equal, so the graph is one of a metric; queries get a zero there.
* Start: every vector goes to its nearest pivots (a bounded sample, drawn several times); sorted by pivot and a random
  projection, the rows are cut into leaves of bounded size, so a cell that holds most vectors is many leaves. The best of
  each leaf are the first neighbours.
* A round of NN-descent: every node sends itself to its neighbours. Two nodes that meet at a third are neighbours'
  neighbours; each meeting place compares those it has met (at most `MEETING`, chosen by hash: a search heuristic, all
  nodes stay indexed) and proposes pairs that beat the worst neighbour a node has. Nodes keep the best `DEGREE`.
  Rounds end when few lists change.
* Search: a query starts at its own node, if it has one, and at the nearest pivots. Each round it asks the nodes of its
  best unexpanded candidates for their neighbours, and the new ones for their vectors. Scores are computed in double
  precision from the original vectors, so what is returned is exact.

Work is done in bundles: groups of about `BUNDLE` nodes, or `ASKING` queries, by hash, so tasks are bounded and even.
Neighbours travel as packed lists, one row per node and place that found them; products with pivots go `STEP` rows at a time.

Null, empty or zero vectors, vectors with null or non-finite components, of another length than most, or with a null id
take no part. Rows of equal id stay apart. An empty table gives no rows. Extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.llm.common import lean, stored

DEGREE = 32
MEETING = 64
PROPOSED = 24
LEAF = 1_024
LEAF_BEST = 16
DRAWS = 8
CELLS = 2
MOST_PIVOTS = 1_024
PIVOT_ROWS = 256
ROUNDS = 10
#: A round that replaces less than this share of all neighbours is the last.
SETTLED = 0.02
BUNDLE = 1_024
#: Queries in a bundle: each is sent up to EXPAND * DEGREE vectors a round, and a task holds a bundle's vectors.
ASKING = 64
#: Rows multiplied with all pivots at a time.
STEP = 512
MEMBERS = 64
EXPAND = 24
BEAM = 192
SEARCH_ROUNDS = 6
ENTRIES = 4


def _bundle(column: str, count: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(max(1, count))).cast("int")


@dataclass
class Index:
    nodes: DataFrame  # node, vec, extra, near (packed node numbers)
    members: DataFrame  # node, id
    pivots: tuple[np.ndarray, np.ndarray]
    size: int
    dtype: str


def valid(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, node) of the vectors that take part; node is a hash of the components."""
    some = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    some = some.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    length = some.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    n = length["n"] if length else 0
    return some.filter(F.size("v") == n).withColumn("node", F.xxhash64("v"))


def _best(u: np.ndarray, w: np.ndarray, s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best distinct w of each u, in descending order of s."""
    order = np.lexsort((w, u))
    u, w, s = u[order], w[order], s[order]
    keep = np.ones(len(u), bool)
    keep[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    keep &= u != w
    u, w, s = u[keep], w[keep], s[keep]
    order = np.lexsort((w, -s, u))
    u, w, s = u[order], w[order], s[order]
    first = np.concatenate(([0], np.flatnonzero(u[1:] != u[:-1]) + 1)) if len(u) else np.zeros(0, int)
    rank = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
    keep = rank < most
    return u[keep], w[keep], s[keep]


def _flat(column, dtype: str) -> np.ndarray:
    """The numbers of a binary column's values in a row; views of its buffer, where it has one."""
    parts = []
    for some in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(some):
            some = some.cast(pa.large_binary())
            edges = np.frombuffer(some.buffers()[1], np.int64)[some.offset:some.offset + len(some) + 1]
            parts.append(np.frombuffer(some.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]].view(dtype))
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype)


def _matrix(column, dtype: str) -> np.ndarray:
    return _flat(column, dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 1), dtype)


def _pairs(m: np.ndarray, s: np.ndarray, most: int, beats: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best partners of each row of a similarity matrix."""
    np.fill_diagonal(s, -np.inf)
    k = min(most, len(m) - 1)
    p = np.argpartition(-s, k - 1, 1)[:, :k]
    q = np.take_along_axis(s, p, 1)
    a, b = np.nonzero(q > beats[:, None] if beats is not None else np.isfinite(q))
    return m[a], m[p[a, b]], q[a, b]


EDGES = "node long, near binary, sims binary"


def _edge_table(u: np.ndarray, w: np.ndarray, s: np.ndarray) -> pa.Table:
    """A row per run of equal u: its w and s, packed."""
    edges = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1], [True]))) if len(u) else np.zeros(1, int)
    w, s = w.astype("<i8").tobytes(), s.astype("<f4").tobytes()
    cut = lambda raw, size: pa.array([raw[a * size:b * size] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary())
    return pa.table([pa.array(u[edges[:-1]].astype(np.int64)), cut(w, 8), cut(s, 4)], ["node", "near", "sims"])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, STEP):
            yield batch.slice(a, STEP)


def _first_edges(nodes: DataFrame, pivots: np.ndarray, dim: int, seed: int) -> DataFrame:
    """Neighbours inside leaves; `pivots` has DRAWS sets of rows with the additional component."""
    sets = np.array_split(pivots, min(DRAWS, len(pivots)))
    project = np.random.default_rng(seed).standard_normal((len(sets), dim)).astype(np.float32)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            x = _matrix(batch.column(1), "<f4")
            for d, p in enumerate(sets):
                s = x @ p.T
                k = min(CELLS, len(p))
                cells, place = np.argpartition(-s, k - 1, 1)[:, :k], x @ project[d]
                for c in range(k):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells[:, c].astype(np.int32) + d * MOST_PIVOTS), pa.array(place), batch.column(0), batch.column(1)], ["cell", "place", "node", "full"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def leaf(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            m = np.concatenate([r[1] for r in rows])
            if len(m) > 1:
                x = np.concatenate([r[2] for r in rows])
                yield from _edge_table(*_pairs(m, x @ x.T, LEAF_BEST)).to_batches()

        n = 0
        for batch in batches:
            cell, node, x = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3), "<f4")
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(edges[:-1], edges[1:]):
                if held and cell[a] != held[0][0]:
                    yield from leaf(held)
                    held, n = [], 0
                while a < b:
                    take = min(b - a, LEAF - n)
                    held.append((cell[a], node[a:a + take], x[a:a + take]))
                    a, n = a + take, n + take
                    if n == LEAF:
                        yield from leaf(held)
                        held, n = [], 0
        if held:
            yield from leaf(held)

    placed = nodes.select("node", "full").mapInArrow(lean(assign), "cell int, place float, node long, full binary")
    return placed.repartitionByRange("cell", "place", "node").sortWithinPartitions("cell", "place", "node").mapInArrow(lean(leaves), EDGES)


GRAPH = "node long, full binary, near binary, sims binary, changed long"


def _kept(nodes: DataFrame, old: DataFrame | None, new: DataFrame, bundles: int) -> DataFrame:
    """The graph with each node's best of old and proposed neighbours; a node is a row."""
    blank = F.lit(None).cast("binary")
    base = (old or nodes.withColumns({"near": blank, "sims": blank})).select("node", "full", "near", "sims")
    rows = new.select("node", blank.alias("full"), "near", "sims")

    def merge(table: pa.Table) -> pa.Table:
        own = table.filter(table["full"].is_valid())
        node, near = own["node"].to_numpy(), [x or b"" for x in own["near"].to_pylist()]
        sizes = pc.fill_null(pc.binary_length(table["near"]), 0).to_numpy() // 8
        u, w, s = _best(np.repeat(table["node"].to_numpy(), sizes), _flat(table["near"], "<i8"), _flat(table["sims"], "<f4"), DEGREE)
        a, b = np.searchsorted(u, node, "left"), np.searchsorted(u, node, "right")
        lists = [w[i:j] for i, j in zip(a, b)]
        changed = [len(x) - len(np.intersect1d(x, np.frombuffer(y, "<i8"))) for x, y in zip(lists, near)]
        return pa.table([own["node"], own["full"], pa.array([x.astype("<i8").tobytes() for x in lists], pa.binary()),
                         pa.array([s[i:j].astype("<f4").tobytes() for i, j in zip(a, b)], pa.binary()), pa.array(changed, pa.int64())],
                        ["node", "full", "near", "sims", "changed"])

    return base.unionByName(rows).groupBy(_bundle("node", bundles).alias("bundle")).applyInArrow(merge, GRAPH)


def _proposed(graph: DataFrame, bundles: int, round_: int) -> DataFrame:
    """Pairs of nodes that meet at a common neighbour: a row per node and place, so a node makes at most `DEGREE` of them at any size."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [np.frombuffer(x, "<i8") for x in batch.column(2).to_pylist()]
            n = [len(x) for x in near]
            worst = np.array([np.frombuffer(x, "<f4")[-1] if k == DEGREE else -np.inf for x, k in zip(batch.column(3).to_pylist(), n)], np.float32)
            for a in range(0, len(n), 256):
                at = np.repeat(np.arange(a, min(a + 256, len(n))), n[a:a + 256])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(near[a:a + 256])), *[c.take(pa.array(at)) for c in (batch.column(0), pa.array(worst), batch.column(1))]],
                                                 ["place", "node", "worst", "full"])

    def meet(table: pa.Table) -> pa.Table:
        place, node, worst = (table[c].to_numpy() for c in ("place", "node", "worst"))
        x = _matrix(table["full"], "<f4")
        chance = (node.astype(np.uint64) ^ np.uint64(round_ * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort((chance, place))
        place = place[order]
        edges = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1:
                at = order[a:min(b, a + MEETING)]
                y = x[at]
                out.append(_pairs(node[at], y @ y.T, PROPOSED, worst[at]))
        return _edge_table(*(np.concatenate([p[i] for p in out]) if out else np.zeros(0) for i in range(3)))

    sent = graph.select("node", "full", "near", "sims").mapInArrow(
        lambda it: send(b.select(["node", "full", "near", "sims"]) for b in it), "place long, node long, worst float, full binary")
    return sent.groupBy(_bundle("place", bundles).alias("bundle")).applyInArrow(meet, EDGES)


def build(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> Index:
    """Indexes every valid row."""
    some = valid(rows, id_col, vec_col)
    dtype = "<f8" if "double" in some.schema["v"].dataType.simpleString() else "<f4"
    ranked = some.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("id"))).filter(F.col("place") <= MEMBERS)
    members = stored(ranked, "members")
    single = members.filter("place = 1")
    size = single.count()
    longest = single.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0] or 0.0

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1).astype(dtype)
            extra = np.sqrt(np.maximum(0.0, longest - (x.astype(float) ** 2).sum(1)))
            full = np.hstack((x, extra[:, None])).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in full], pa.binary())], ["node", "vec", "full"])

    nodes = stored(single.select("node", "v").mapInArrow(extend, "node long, vec binary, full binary"), "nodes")
    bundles = size // BUNDLE + 1
    wanted = min(MOST_PIVOTS, max(1, size // PIVOT_ROWS)) * DRAWS
    picked = nodes.orderBy(F.xxhash64("node", F.lit(seed))).limit(wanted).select("node", "full").toArrow()
    pivots = (picked["node"].to_numpy(), _matrix(picked["full"], "<f4"))
    plain = nodes.select("node", "full")
    if size < 2:
        return Index(nodes.withColumn("near", F.lit(None).cast("binary")), members.select("node", "id"), pivots, size, dtype)
    graph = stored(_kept(plain, None, _first_edges(plain, pivots[1], pivots[1].shape[1], seed), bundles), "graph")
    for k in range(ROUNDS):
        graph = stored(_kept(plain, graph, _proposed(graph, bundles, k), bundles), "graph")
        if graph.agg(F.sum("changed")).first()[0] < SETTLED * DEGREE * size:
            break
    return Index(stored(nodes.select("node", "vec").join(graph.select("node", "near"), "node"), "index"), members.select("node", "id"), pivots, size, dtype)


STATE = "query long, vec binary, seen binary, scores binary, open binary"


def _start(batch: pa.RecordBatch, pivots: tuple[np.ndarray, np.ndarray], dtype: str) -> pa.RecordBatch:
    """First candidates of queries: their own node and the nearest pivots."""
    x = _matrix(batch.column(1), dtype)
    ids, full = pivots
    k = min(ENTRIES, len(ids))
    near = np.argpartition(-(x @ full[:, :-1].T), k - 1, 1)[:, :k] if k else np.zeros((len(x), 0), int)
    first = [np.unique(np.append(ids[p], q)).astype("<i8").tobytes() for p, q in zip(near, batch.column(0).to_numpy())]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.binary())], ["query", "vec", "wanted"])


def search(index: Index, queries: DataFrame, rounds: int = SEARCH_ROUNDS, expand: int = EXPAND, beam: int = BEAM) -> DataFrame:
    """(query, node, score) of the best candidates that the search reaches; `queries` has (query, vec), query being a node's number or any other."""
    dtype, pivots = index.dtype, index.pivots
    count = queries.count() // ASKING + 1
    blank = lambda kind: F.lit(None).cast(kind)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            yield _start(batch, pivots, dtype)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [np.frombuffer(x, "<i8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in wanted])), pa.array(np.concatenate(wanted) if wanted else [], pa.int64())], ["query", "node"])

    def scored(table: pa.Table) -> pa.Table:
        """Adds the vectors that came to each query's candidates and chooses the ones to expand."""
        is_query = table["node"].is_null().to_numpy()
        own, came = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query)).sort_by([("query", "ascending"), ("node", "ascending")])
        x, at = _matrix(came["vec"], dtype).astype(float), came["query"].to_numpy()
        node = came["node"].to_numpy()
        out = []
        for q, vec, seen, scores, opened in zip(*(own[c].to_pylist() for c in ("query", "vec", "seen", "scores", "open"))):
            a, b = np.searchsorted(at, q, "left"), np.searchsorted(at, q, "right")
            ids = np.concatenate((np.frombuffer(seen or b"", "<i8"), node[a:b]))
            s = np.concatenate((np.frombuffer(scores or b"", "<f8"), (x[a:b] * np.frombuffer(vec, dtype).astype(float)).sum(1)))
            done = np.concatenate((np.frombuffer(opened or b"", np.uint8), np.zeros(b - a, np.uint8)))
            order = np.lexsort((ids, -s))
            front = order[:beam]
            chosen = front[done[front] == 0][:expand]
            done = done.copy()
            done[chosen] = 1
            out.append({"query": q, "vec": vec, "seen": ids.astype("<i8").tobytes(), "scores": s.tobytes(), "open": done.tobytes(), "wanted": ids[chosen].astype("<i8").tobytes()})
        return pa.Table.from_pylist(out, schema=pa.schema([("query", pa.int64()), *((c, pa.binary()) for c in ("vec", "seen", "scores", "open", "wanted"))]))

    def fresh(table: pa.Table) -> pa.Table:
        """The neighbours that a query has not seen yet."""
        is_query = table["near"].is_null().to_numpy()
        own, came = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query)).sort_by([("query", "ascending")])
        at, near = came["query"].to_numpy(), came["near"].to_pylist()
        out = []
        for q, seen in zip(own["query"].to_pylist(), own["seen"].to_pylist()):
            a, b = np.searchsorted(at, q, "left"), np.searchsorted(at, q, "right")
            found = np.frombuffer(b"".join(near[a:b]), "<i8")
            out.append({"query": q, "wanted": np.setdiff1d(found, np.frombuffer(seen, "<i8")).tobytes()})
        return pa.Table.from_pylist(out, schema=pa.schema([("query", pa.int64()), ("wanted", pa.binary())]))

    vectors, lists = index.nodes.select("node", "vec"), index.nodes.select("node", "near").filter(F.col("near").isNotNull())
    first = queries.select("query", "vec").mapInArrow(begin, "query long, vec binary, wanted binary")
    state = stored(first.withColumns({c: blank("binary") for c in ("seen", "scores", "open")}), "state")
    wanted = state.select("query", "wanted")
    for k in range(rounds + 1):
        came = wanted.mapInArrow(asked, "query long, node long").join(vectors, "node").select("query", "node", "vec", *[blank("binary").alias(c) for c in ("seen", "scores", "open")])
        both = state.select("query", blank("long").alias("node"), "vec", "seen", "scores", "open").union(came)
        state = stored(both.groupBy(_bundle("query", count).alias("bundle")).applyInArrow(scored, STATE + ", wanted binary"), "state")
        if k < rounds:
            came = state.select("query", "wanted").mapInArrow(asked, "query long, node long").join(lists, "node").select("query", blank("binary").alias("seen"), "near")
            both = state.select("query", "seen", blank("binary").alias("near")).union(came)
            wanted = stored(both.groupBy(_bundle("query", count).alias("bundle")).applyInArrow(fresh, "query long, wanted binary"), "wanted")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for q, seen, scores in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = np.frombuffer(scores, "<f8")
                top = np.argsort(-s, kind="stable")[:beam]
                parts.append((np.full(len(top), q), np.frombuffer(seen, "<i8")[top], s[top]))
            q, n, s = (np.concatenate([p[i] for p in parts]) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(n), pa.array(s)], ["query", "node", "score"])

    return state.select("query", "seen", "scores").mapInArrow(best, "query long, node long, score double")


def nearest(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of every valid row for which `queries` holds, itself excluded."""
    if k >= MEMBERS:
        raise ValueError(f"k must be below {MEMBERS}")
    index = build(rows, id_col, vec_col)
    asking = valid(rows.filter(queries), id_col, vec_col).select(F.col("id").alias("query_id"), "node")
    asking = asking.join(index.nodes.select("node"), "node", "left_semi")
    nodes = asking.select("node").distinct().join(index.nodes.select("node", "vec"), "node").select(F.col("node").alias("query"), "vec")
    found = stored(search(index, nodes), "found")
    # members of a node are in order of id, so the best k + 1 rows of a node of queries hold the best k of each query
    per_node = found.join(index.members, "node").withColumn(
        "place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= k + 1)
    answers = asking.withColumnRenamed("node", "query").join(per_node.select("query", "id", "score"), "query").filter(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return answers.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
