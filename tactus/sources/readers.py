"""Readers for the file forms recordings come with: tables, label files, JSON settings, frame and bin tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactus.functions.text import base_name, parse_times, stem

# Accepted header names, in order of preference, for metadata tables.
METADATA_ALIASES = {
    "grp": ("group", "population", "condition"),
    "species": ("species", "taxon", "tree_tip", "tip"),
    "lat": ("latitude", "lat"),
    "lon": ("longitude", "long", "lon", "lng"),
    "modality": ("modality", "modality_label"),
    "function": ("function", "function_label"),
    "tempo_bpm": ("tempo_bpm", "tempo", "bpm"),
    "body_mass_kg": ("bodymass_kg", "body_mass_kg", "body_mass", "mass_kg", "mass"),
}
NAME_ALIASES = ("file name", "filename", "file", "audio file", "audio_file", "recording", "name")
AUDIO_ENDINGS = (".wav", ".mp3", ".flac", ".ogg")


def read_table(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv", *, sep: str = ",") -> DataFrame:
    """CSV (all columns text), Parquet, ORC or JSON rows."""
    if fmt == "csv":
        return spark.read.csv(path, header=True, sep=sep, inferSchema=False)
    return spark.read.format(fmt).load(path)


def column_names(table: DataFrame) -> list[str]:
    return table.columns


def distinct_names(table: DataFrame, name_column: str) -> DataFrame:
    return table.select(F.col(name_column).alias("recording")).dropna().distinct()


def onset_table(table: DataFrame, name_column: str, onset_column: str) -> DataFrame:
    """Rows with a text list of times become one row per onset; rows lacking either are skipped."""
    lists = table.filter(F.col(name_column).isNotNull() & F.col(onset_column).isNotNull()).select(
        F.col(name_column).cast("string").alias("recording"), parse_times(F.col(onset_column).cast("string")).alias("_t"))
    return lists.select("recording", F.posexplode("_t").alias("onset_idx", "t"))


def lookup(table: DataFrame, name_column: str, name: str, order: str) -> DataFrame:
    """The first row (by `order`) whose trimmed, lower-cased name equals the wanted one; empty if none."""
    hits = table.filter(F.lower(F.trim(F.col(name_column))) == name.strip().lower())
    return hits.orderBy(order).limit(1)


def lookup_row(table: DataFrame, name_column: str, onset_column: str, name: str, order: str) -> DataFrame:
    """The whole first matching row with its parsed onsets; missing columns or rows are errors."""
    for column in (name_column, onset_column):
        if column not in table.columns:
            raise ValueError(f"column {column!r} is not in the table")
    row = lookup(table, name_column, name, order).withColumn("onsets", parse_times(F.col(onset_column)))
    if row.isEmpty():
        raise ValueError(f"{name!r} is not in column {name_column!r}")
    return row


def first_table_with(tables: DataFrame, name_column: str, name: str, onset_column: str) -> DataFrame:
    """Among many files read together (column `path`), the row of the first path that holds the recording."""
    hits = tables.filter(F.lower(F.trim(F.col(name_column))) == name.strip().lower())
    best = hits.select(F.struct("path", F.col(onset_column).alias("onsets")).alias("_r")).agg(F.min_by("_r", "_r.path").alias("_r"))
    return best.filter("_r IS NOT NULL").select("_r.path", parse_times(F.col("_r.onsets")).alias("onsets"))


def with_path(spark: SparkSession, glob: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.format(fmt)
    reader = reader.option("header", True) if fmt == "csv" else reader
    return reader.load(glob).withColumn("path", F.col("_metadata.file_path"))


def label_times(lines: DataFrame) -> DataFrame:
    """Label files: the first tab-separated field of each line is a time; other lines are skipped.

    Needs path and value, as text files read with their path give.
    """
    parsed = lines.select(stem(base_name(F.col("path"))).alias("recording"), F.split("value", "\t")[0].try_cast("double").alias("t"))
    return parsed.filter(F.col("t").isNotNull() & ~F.isnan("t"))


def read_label_files(spark: SparkSession, glob: str) -> DataFrame:
    lines = spark.read.text(glob).withColumn("path", F.col("_metadata.file_path"))
    return label_times(lines)


SETTING = T.MapType(T.StringType(), T.StringType())


def settings_entries(texts: DataFrame) -> DataFrame:
    """Per-recording settings from JSON objects name -> settings, or single objects with a `filename`.

    `onset_recommendations` beats `settings`, which beats the object itself; keys starting with __ are skipped.
    Needs a text column `value` with one document per row. Gives recording and settings map.
    """
    top = texts.select(F.from_json("value", SETTING).alias("_d")).filter("_d IS NOT NULL")
    single = top.filter(F.col("_d")["filename"].isNotNull()).select(F.col("_d")["filename"].alias("recording"), F.to_json("_d").alias("_v"), F.col("_d").alias("_m"))
    many = top.filter(F.col("_d")["filename"].isNull()).select(F.explode("_d").alias("recording", "_v")).filter(
        ~F.col("recording").startswith("__")).withColumn("_m", F.from_json("_v", SETTING)).filter("_m IS NOT NULL")
    both = single.unionByName(many)
    inner = lambda k: F.from_json(F.col("_m")[k], SETTING)
    rec = inner("onset_recommendations")
    chosen = F.when(F.size(rec) > 0, rec).otherwise(F.coalesce(inner("settings"), F.col("_m")))
    return both.select("recording", chosen.alias("settings"))


REGION = T.StructType([T.StructField(n, t) for n, t in (
    ("t_start", T.DoubleType()), ("t_end", T.DoubleType()), ("f_low", T.DoubleType()), ("f_high", T.DoubleType()),
    ("polarity", T.StringType()), ("layer_name", T.StringType()))])


def focus_regions(texts: DataFrame) -> DataFrame:
    """JSON objects name -> list of regions, one row per region."""
    kind = T.MapType(T.StringType(), T.ArrayType(REGION))
    rows = texts.select(F.explode(F.from_json("value", kind)).alias("recording", "_r"))
    return rows.select("recording", F.explode("_r").alias("_x")).select("recording", "_x.*")


def selected_layers(texts: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Layer documents whose name is wanted: recording (from the folder name), layer, onsets."""
    kind = T.StructType([T.StructField("name", T.StringType()), T.StructField("onsets", T.ArrayType(T.DoubleType())),
                         T.StructField("regions", T.ArrayType(REGION))])
    rows = texts.withColumn("_d", F.from_json("value", kind)).filter(F.col("_d.name").isin(list(wanted)))
    return rows.select(*[c for c in texts.columns if c != "value"], F.col("_d.name").alias("layer"), "_d.onsets", "_d.regions")


MANIFEST = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("polarity", T.StringType()),
                         T.StructField("regions", T.ArrayType(REGION))])


def manifest_regions(texts: DataFrame, source: Column | str | None = None) -> DataFrame:
    """Regions of saved selections, polarity defaulting to the manifest's; near-equal ones appear once."""
    rows = texts.select(F.from_json("value", MANIFEST).alias("_d")).filter("_d.source_file IS NOT NULL")
    if source is not None:
        rows = rows.filter(F.col("_d.source_file") == source)
    rows = rows.select(F.col("_d.source_file").alias("recording"), F.col("_d.polarity").alias("_p"), F.explode("_d.regions").alias("_r"))
    zero = lambda c: F.coalesce(F.col(f"_r.{c}"), F.lit(0.0))
    rows = rows.select("recording", *[zero(c).alias(c) for c in ("t_start", "t_end", "f_low", "f_high")],
                       F.coalesce("_r.polarity", "_p", F.lit("positive")).alias("polarity"), F.col("_r.layer_name").alias("layer_name"))
    keyed = rows.withColumns({"_a": F.round("t_start", 6), "_b": F.round("t_end", 6), "_c": F.round("f_low", 3), "_e": F.round("f_high", 3),
                              "_l": F.coalesce("layer_name", F.lit(""))})
    return keyed.dropDuplicates(["recording", "_a", "_b", "_c", "_e", "polarity", "_l"]).drop("_a", "_b", "_c", "_e", "_l")


def metadata_blocks(texts: DataFrame, general_key: str = "__general_metadata__") -> tuple[DataFrame, DataFrame]:
    """User metadata: per-recording entries and general defaults, both long (key, value); blanks are dropped from the defaults."""
    top = texts.select(F.explode(F.from_json("value", SETTING)).alias("recording", "_v"))
    per = top.filter(~F.col("recording").startswith("__")).withColumn("_m", F.from_json(F.from_json("_v", SETTING)["metadata"], SETTING))
    per = per.filter(F.size("_m") > 0).select("recording", F.explode("_m").alias("key", "value"))
    general = top.filter(F.col("recording") == general_key).select(F.explode(F.from_json("_v", SETTING)).alias("key", "value"))
    return per, general.filter("trim(value) <> ''")


def metadata_columns(header: Sequence[str], aliases: Mapping[str, Sequence[str]] = METADATA_ALIASES) -> dict[str, str]:
    """Which header supplies which field: exact name first, then the aliases in order."""
    lower = {h.lower(): h for h in header}
    found = {}
    for field, names in {"recording": NAME_ALIASES, **aliases}.items():
        hit = next((lower[n] for n in (field, *names) if n in lower), None)
        if hit:
            found[field] = hit
    return found


def import_metadata(table: DataFrame, recordings: DataFrame, fields: Sequence[str], *, order: str) -> DataFrame:
    """Metadata of each recording by exact name, else by its stem as a name, else by stem; what is missing becomes NA.

    A repeated name gives the last row, a repeated stem the first, in the order of the column `order`.
    """
    columns = metadata_columns(table.columns)
    picked = table.select(F.trim(F.col(columns["recording"])).alias("_name"),
                          F.col(order).alias("_o"),
                          *[F.trim(F.col(columns[f])).alias(f) if f in columns else F.lit(None).cast("string").alias(f) for f in fields])
    picked = picked.filter("_name <> ''").withColumn("_row", F.struct(*fields))
    by_name = picked.groupBy("_name").agg(F.max_by("_row", "_o").alias("_a"))
    keys = picked.withColumn("_s", stem(F.regexp_extract("_name", r"([^/\\]*)$", 1)))
    by_stem = keys.groupBy("_s").agg(F.min_by("_row", "_o").alias("_b"))
    rows = recordings.withColumn("_s", stem(F.col("recording"))).join(by_name, F.col("recording") == F.col("_name"), "left")
    rows = rows.join(by_name.select(F.col("_name").alias("_s"), F.col("_a").alias("_c")), "_s", "left").join(by_stem, "_s", "left")
    value = lambda f: F.coalesce(F.when(F.col("_a").isNotNull(), F.col(f"_a.{f}")).when(F.col("_c").isNotNull(), F.col(f"_c.{f}")).otherwise(F.col(f"_b.{f}")), F.lit(""))
    return rows.select("recording", *[F.when(F.lower(value(f)).isin("", "nan"), "NA").otherwise(value(f)).alias(f) for f in fields])


def frame_table(table: DataFrame) -> DataFrame:
    """First three columns are the coordinates; numbers that are missing or not finite become 0."""
    number = lambda c: F.coalesce(F.when(F.abs(F.col(c).try_cast("double")) < float("inf"), F.col(c).try_cast("double")), F.lit(0.0))
    names = dict(zip(table.columns[:3], "xyz", strict=False))
    return table.select(*[number(c).alias(names.get(c, c)) for c in table.columns])


def bin_table(lines: DataFrame) -> DataFrame:
    """Rows of comma-separated numbers as arrays; headers and damaged rows drop out. Needs a text column `value`."""
    nums = F.transform(F.split(F.trim("value"), ","), lambda s: F.trim(s).try_cast("double"))
    rows = lines.filter("trim(value) <> ''").withColumn("bins", nums)
    return rows.filter(~F.exists("bins", lambda v: v.isNull() | F.isnan(v))).drop("value")


ASSET = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "assetId", "label", "revisionId", "audioUrl", "mfccCsvUrl", "fftCsvUrl")])


def asset_catalog(texts: DataFrame, base: str = "") -> DataFrame:
    """Assets of a manifest document, relative addresses resolved against a base."""
    kind = T.StructType([T.StructField("manifestRevision", T.LongType()), T.StructField("assets", T.ArrayType(ASSET))])
    rows = texts.select(F.from_json("value", kind).alias("_m")).select("_m.manifestRevision", F.explode("_m.assets").alias("_a"))
    full = lambda c: F.when(F.col(c).rlike("^([a-z]+:)?//"), F.col(c)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(F.col(c), F.lit("/"))))
    return rows.select("manifestRevision", "_a.*").withColumns({c: full(c) for c in ("audioUrl", "mfccCsvUrl", "fftCsvUrl")})


def supported_files(files: DataFrame, selected: DataFrame | None = None, *, endings: Sequence[str] = AUDIO_ENDINGS) -> tuple[DataFrame, DataFrame]:
    """Files with a supported ending, cut to the selected names, and the selected names that are missing."""
    ends = F.lit(False)
    for e in endings:
        ends = ends | F.lower("name").endswith(e)
    available = files.filter(ends)
    if selected is None:
        return available, available.limit(0).select("name")
    wanted = selected.select("name").distinct()
    return available.join(wanted, "name", "left_semi"), wanted.join(available, "name", "left_anti")


def resolved_settings(recordings: DataFrame, overrides: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Effective settings per recording: its own entries over the global ones."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]).cast("map<string,string>")
    rows = recordings.join(overrides.select("recording", "settings"), "recording", "left")
    own = F.map_filter(F.coalesce("settings", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    rest = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(own), k))
    return rows.select("recording", F.map_concat(rest, own).alias("settings"))
