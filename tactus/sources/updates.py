"""A result set that is updated in place of being rewritten: merge on read over hash buckets.

Recordings are dealt into a fixed number of buckets by their lower-cased file name. A bucket has base files and, after
updates, delta files. A version is a small Parquet table that lists, per table and bucket, the folders that belong to it in order; it
is written last, so readers see an update whole or not at all, and older versions stay readable.

An update writes delta files for the buckets of its recordings only. Readers merge: of a summary the columns that the
latest delta gives win over older ones; pair rows are those of the latest version that gives the recording. Compaction
rewrites only buckets with more than `deltas` delta folders, from the files of those buckets alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactus.functions.text import base_name

BUCKETS = 64
DELTAS = 8
VERSION = "table string, bucket int, folder string, seq long, base boolean"
ROWS = ("dyads", "stable_dyads")


@dataclass(frozen=True)
class ResultSet:
    """One version of a stored result set."""

    spark: SparkSession
    path: str
    version: int
    buckets: int

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(VERSION).parquet(f"{self.path}/versions/{self.version}")


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    key = base_name(F.col("recording"))
    return rows.withColumns({"_k": key, "_bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")})


def _write(table: str, rows: DataFrame, path: str, buckets: int) -> tuple[str, DataFrame]:
    """Writes rows under a folder of their own, a subfolder per bucket; returns it and the buckets that hold rows."""
    folder = f"{path}/{table}/{uuid.uuid4().hex}"
    wide = _bucketed(rows, buckets)
    # each bucket's rows go to few files; a bucket of a large recording is split among tasks by its rows
    wide.drop("_k").repartition("_bucket", F.pmod(F.xxhash64(*rows.columns[:2]), F.lit(8))).write.partitionBy("_bucket").parquet(folder)
    found = rows.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(folder)
    return folder, found.select("_bucket").distinct()


def _listed(spark: SparkSession, parts: Sequence[tuple[str, str, DataFrame]], seq: int, base: bool) -> DataFrame:
    out = spark.createDataFrame([], VERSION)
    for table, folder, found in parts:
        out = out.unionByName(found.select(F.lit(table).alias("table"), F.col("_bucket").alias("bucket"), F.lit(folder).alias("folder"),
                                           F.lit(seq).cast("long").alias("seq"), F.lit(base).alias("base")))
    return out


def create(tables: Mapping[str, DataFrame], path: str, buckets: int = BUCKETS) -> ResultSet:
    """Stores a result set as version 0. Every table needs the column `recording`; summaries have a row per recording."""
    spark = next(iter(tables.values())).sparkSession
    parts = [(name, *_write(name, rows, path, buckets)) for name, rows in tables.items()]
    _listed(spark, parts, 0, True).coalesce(1).write.parquet(f"{path}/versions/0")
    return ResultSet(spark, path, 0, buckets)


def update(held: ResultSet, fresh: Mapping[str, DataFrame], *, add_columns: bool = False) -> ResultSet:
    """The next version: delta files with the given recordings; no row of another one is read or written.

    Columns that the summaries lack are left out, or added with `add_columns`. The summaries name the recordings: pair
    rows of each are replaced, by none if the update has none.
    """
    number = held.version + 1
    if not add_columns:
        known = set(_columns_given(held, "summaries", None))
        fresh = {**fresh, "summaries": fresh["summaries"].select(*[c for c in fresh["summaries"].columns if c in known])}
    parts = [(name, *_write(name, rows, held.path, held.buckets)) for name, rows in fresh.items()]
    new = _listed(held.spark, parts, number, False)
    held.manifest().unionByName(new).coalesce(1).write.parquet(f"{held.path}/versions/{number}")
    return ResultSet(held.spark, held.path, number, held.buckets)


def _folders(held: ResultSet, table: str, chosen: Sequence[int] | None = None) -> list[tuple[str, int, list[int]]]:
    """(folder, seq, buckets) of a table, oldest first: a row per write since the last compaction, not per file."""
    rows = held.manifest().filter(F.col("table") == table)
    if chosen is not None:
        rows = rows.filter(F.col("bucket").isin(list(chosen)))
    found = rows.groupBy("folder", "seq").agg(F.collect_set("bucket").alias("b")).orderBy("seq", "folder").collect()
    return [(r["folder"], r["seq"], sorted(r["b"])) for r in found]


def _read(held: ResultSet, table: str, chosen: Sequence[int] | None) -> DataFrame | None:
    """All stored rows of a table with `_k`, `_bucket` and the `_seq` of their write."""
    out = None
    for folder, seq, listed in _folders(held, table, chosen):
        rows = held.spark.read.option("basePath", folder).parquet(*[f"{folder}/_bucket={b}" for b in listed])
        rows = rows.withColumns({"_k": base_name(F.col("recording")), "_seq": F.lit(seq).cast("long")})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read(held: ResultSet, table: str, chosen: Sequence[int] | None = None) -> DataFrame:
    """A table of this version, of all buckets or the chosen ones."""
    rows = _read(held, table, chosen)
    if table in ROWS:
        summaries = _read(held, "summaries", chosen).groupBy("_k").agg(F.max("_seq").alias("_latest"))
        # a recording's pair rows are those of the write that last gave it
        return rows.join(summaries, "_k").filter(F.col("_seq") == F.col("_latest")).drop("_k", "_seq", "_bucket", "_latest")
    values = [c for c in rows.columns if c not in ("_k", "_seq", "_bucket", "recording")]
    deltas = held.manifest().filter((F.col("table") == table) & ~F.col("base"))
    if deltas.isEmpty():
        return rows.select("recording", *values)
    given = _columns_given(held, table, chosen)
    newest = lambda c: F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col("_seq").isin(given[c]), F.col("_seq")))["v"].alias(c)
    return rows.groupBy("_k").agg(F.min_by("recording", "_seq").alias("recording"), *[newest(c) for c in values]).drop("_k")


def _columns_given(held: ResultSet, table: str, chosen: Sequence[int] | None) -> dict[str, list[int]]:
    """The writes (their seq) whose files have each column; a null that a write gives counts, a missing column does not."""
    out: dict[str, list[int]] = {}
    for folder, seq, listed in _folders(held, table, chosen):
        for c in held.spark.read.option("basePath", folder).parquet(f"{folder}/_bucket={listed[0]}").columns:
            out.setdefault(c, []).append(seq)
    return out


def compact(held: ResultSet, deltas: int = DELTAS) -> ResultSet:
    """The next version with new base files for the buckets that have more than `deltas` delta folders; others keep theirs."""
    manifest = held.manifest()
    grown = manifest.filter(~F.col("base")).groupBy("table", "bucket").count().filter(F.col("count") > deltas).select("bucket").distinct()
    touched = [r["bucket"] for r in grown.collect()]  # at most `BUCKETS` numbers
    if not touched:
        return held
    number = held.version + 1
    names = [r["table"] for r in manifest.select("table").distinct().collect()]
    parts = [(name, *_write(name, read(held, name, touched), held.path, held.buckets)) for name in names]
    kept = manifest.filter(~F.col("bucket").isin(touched))
    kept.unionByName(_listed(held.spark, parts, number, True)).coalesce(1).write.parquet(f"{held.path}/versions/{number}")
    return ResultSet(held.spark, held.path, number, held.buckets)


def opened(spark: SparkSession, path: str, version: int, buckets: int = BUCKETS) -> ResultSet:
    """An existing version."""
    return ResultSet(spark, path, version, buckets)
