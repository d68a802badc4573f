"""The provided tables seen as recordings, onsets, frames, regions and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.layout import lay_out, row_index

HOP_SEC = 0.05
BIN_HZ = 100.0
ORDER = ["t", "event_id"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seconds(ts: str) -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def onsets(spark: SparkSession, sf: str, *, split: bool = True) -> DataFrame:
    """One row per event: a user is a recording, an event type a layer. Oversized users get runs."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("recording"), "event_id", F.col("event_type").alias("layer"),
        seconds("ts").alias("t"), F.col("value").alias("strength"))
    return lay_out(rows, "recording", "t") if split else rows


def frames(spark: SparkSession, sf: str, *, split: bool = True) -> DataFrame:
    """One row per vector: a label is a recording, vectors are frames in id order, magnitudes are bins."""
    rows = table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("recording"), "vec_id",
        F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("bins"),
        F.element_at("embedding", 1).cast("double").alias("x"),
        F.element_at("embedding", 2).cast("double").alias("y"),
        F.element_at("embedding", 3).cast("double").alias("z"))
    rows = lay_out(rows, "recording", "vec_id") if split else rows
    rows = row_index(rows, "recording", "vec_id", "frame").withColumn("frame", F.col("frame") - 1)
    # The vectors have unit length, so the level weights the energy of bin k by k, over all bins.
    weighted = F.transform("bins", lambda v, k: v * v * (k + 1))
    rms = F.sqrt(F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v) / (F.size("bins") * (F.size("bins") + 1) / 2))
    return rows.withColumns({
        "t": F.col("frame") * F.lit(HOP_SEC),
        "rms": rms,
        "volume": F.aggregate("bins", F.lit(0.0), lambda s, v: s + v),
    })


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is a folder or a single file."""
    source = table(spark, sf, name)
    reader = spark.readStream.schema(source.schema)
    if all(f.endswith(f"/{name}.parquet") for f in source.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    return reader.parquet(f"{sf}/{name}.parquet")


def spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Frames in long form, one row per bin."""
    rows = frames(spark, sf)
    return rows.select("recording", "frame", "t", F.posexplode("bins").alias("bin", "mag")).withColumn(
        "freq_hz", F.col("bin") * F.lit(BIN_HZ))


def grouping(spark: SparkSession, sf: str) -> DataFrame:
    """Recording metadata: group and unit from the customer table, matched on the user number."""
    nation = table(spark, sf, "nation")
    customer = table(spark, sf, "customer")
    users = customer.select(F.col("c_custkey").cast("string").alias("recording"),
                            F.col("c_mktsegment").alias("grp"), "c_nationkey", "c_acctbal")
    return users.join(nation, users.c_nationkey == nation.n_nationkey).select(
        "recording", "grp", F.col("n_name").alias("unit"), F.col("n_regionkey").alias("region"),
        F.col("c_acctbal").alias("mass"))


# The same tables as SQL, for the twins.
SQL_ONSETS = """o AS (SELECT CAST(user_id AS VARCHAR) AS recording, event_id, event_type AS layer,
  epoch_us(ts) / 1e6 AS t, value AS strength FROM events)"""
SQL_FRAMES = """f0 AS (SELECT CAST(label AS VARCHAR) AS recording, vec_id,
    row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame,
    list_transform(embedding, lambda x: abs(x::DOUBLE)) AS bins, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y,
    embedding[3]::DOUBLE AS z FROM embeddings),
  f AS (SELECT *, frame * 0.05::DOUBLE AS t, sqrt(list_sum(list_transform(bins, lambda b, k: b * b * k)) / (len(bins) * (len(bins) + 1) / 2)) AS rms,
    list_sum(bins) AS volume FROM f0)"""
SQL_SPECTRUM = SQL_FRAMES + """,
  sp AS (SELECT recording, frame, t, unnest(bins) AS mag, unnest(range(len(bins))) AS bin,
    unnest(range(len(bins))) * 100.0::DOUBLE AS freq_hz FROM f)"""
SQL_GROUPS = """gm AS (SELECT CAST(c_custkey AS VARCHAR) AS recording, c_mktsegment AS grp, n_name AS unit,
  n_regionkey AS region, c_acctbal AS mass FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def sql_tidy(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"
