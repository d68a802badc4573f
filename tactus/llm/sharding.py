"""Shards by virtual slots: records are hashed into thousands of fixed slots, shards own slots.

The slot of a record depends on its id only and never changes. A small table maps slots to shards; it has versions.
Balancing and growing edit the map: whole slots move, records are not hashed anew. All that reaches the driver is one
row per slot (`SLOTS` rows), whatever the number of records.

Nulls: a null text has no bytes; a null id has a slot like any other. Repeated ids share a slot. An empty table gives
no rows, and a map in which all slots have zero bytes. Extra columns of the input are not returned.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactus.llm.common import stored

#: Number of virtual slots; fixed for the life of a data set.
SLOTS = 8192
#: Bytes that each record has besides its text.
RECORD_BYTES = 8
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, rows long"


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row per record: id, size, checksum and virtual slot; texts are read once and not shuffled."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of every slot, empty ones included."""
    found = {r[0]: (r[1], r[2]) for r in rows.groupBy("virtual_slot").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()}
    return [(s, *found.get(s, (0, 0))) for s in range(slots)]


def first_map(sizes: list[tuple[int, int, int]], shards: int) -> list[tuple]:
    """Version 0: the largest slots first, each to the shard with the fewest bytes so far."""
    heap = [(0, 0, k) for k in range(shards)]
    out = []
    for slot, size, rows in sorted(sizes, key=lambda x: (-x[1], x[0])):
        held, n, shard = heapq.heappop(heap)
        out.append((0, slot, shard, size, rows))
        heapq.heappush(heap, (held + size, n + 1, shard))
    return sorted(out, key=lambda x: x[1])


def rebalanced(current: list[tuple], sizes: list[tuple[int, int, int]], shards: int, tolerance: float = 0.01) -> list[tuple]:
    """The next version of a map for `shards` shards, with few moves.

    Slots of shards that no longer exist move first. Then slots leave shards above the mean, largest first, for the
    emptiest shard, while that is below the mean less the tolerance and the giver does not fall below it.
    """
    version = max((r[0] for r in current), default=-1) + 1
    size = {s: (b, n) for s, b, n in sizes}
    owner = {r[1]: r[2] for r in current}
    held = [0] * shards
    for slot, shard in owner.items():
        if shard < shards:
            held[shard] += size[slot][0]
    heap = [(b, k) for k, b in enumerate(held)]
    heapq.heapify(heap)

    def emptiest() -> int:
        while heap[0][0] != held[heap[0][1]]:
            heapq.heappop(heap)
        return heap[0][1]

    def move(slot: int, to: int) -> None:
        if owner[slot] < shards:
            held[owner[slot]] -= size[slot][0]
            heapq.heappush(heap, (held[owner[slot]], owner[slot]))
        owner[slot] = to
        held[to] += size[slot][0]
        heapq.heappush(heap, (held[to], to))

    order = sorted(owner, key=lambda s: (-size[s][0], s))
    for slot in order:
        if owner[slot] >= shards:
            move(slot, emptiest())
    mean = sum(held) / max(1, shards)
    for slot in order:
        giver, n, to = owner[slot], size[slot][0], emptiest()
        if n and held[to] < mean * (1 - tolerance) and held[giver] - n >= mean * (1 - tolerance) and held[to] + n < held[giver]:
            move(slot, to)
    return [(version, s, owner[s], *size[s]) for s in sorted(owner)]


def map_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A version of the map as a table; versions are appended, never overwritten."""
    return stored(spark.createDataFrame(rows, MAP_SCHEMA), "slot-map")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds the shard, the map's version and the gapless position inside the shard.

    A record's position is that of its slot (running counts over the map, one row per slot) plus its place in the slot,
    so rows are only ordered within slots, never within whole shards.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = slot_map.select("virtual_slot", "shard", "version", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(inside) - 1)
    return placed.join(bases, "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"),
        "virtual_slot", F.col("version").alias("map_version"))


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """The placed records under the law of near equal bytes, and the map."""
    rows = stored(records(docs, id_col, text_col, slots), "records")
    slot_map = map_table(docs.sparkSession, first_map(slot_bytes(rows, slots), shards))
    return place(rows, slot_map), slot_map
