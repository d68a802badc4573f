"""Writers and table updates: result sets, imports, patches, text exports, manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactus.functions.text import base_name, clock, fixed, format_times, stem
from tactus.layout import RUN, lay_out, plain, row_index
from tactus.operators.frames import gap_filled
from tactus.operators.intervals import dyads
from tactus.operators.matching import match_names
from tactus.operators.metrics import rhythm_metrics

TABLES = ("summaries", "dyads", "stable_dyads", "demographics")


def write_result_set(tables: Mapping[str, DataFrame], path: str, *, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per table."""
    for name, table in tables.items():
        writer = table.write.mode(mode)
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{path}/{name}")


def read_result_set(spark: SparkSession, path: str, names: Sequence[str] = TABLES, *, fmt: str = "parquet") -> dict[str, DataFrame]:
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return {n: reader.format(fmt).load(f"{path}/{n}") for n in names}


def analysed(onsets: DataFrame, *, tolerance: float = 0.1, digits: tuple[int, int] | None = (2, 4)) -> dict[str, DataFrame]:
    """Summaries, pairs and stable pairs of recordings from their onsets."""
    pairs = plain(dyads(onsets, tolerance=tolerance, digits=digits))
    return {"summaries": rhythm_metrics(pairs), "dyads": pairs, "stable_dyads": pairs.filter("stable")}


def upsert(existing: Mapping[str, DataFrame], updates: Mapping[str, DataFrame], *, order: str | None = None,
           add_columns: bool = False) -> dict[str, DataFrame]:
    """Replace recordings in a result set.

    A recording's first summary row takes the new values of columns the table has (all columns with `add_columns`)
    or a row is appended; its pair rows are replaced; other tables pass unchanged. Names match by lower-cased file name.
    """
    norm = lambda c: base_name(F.col(c))
    out = dict(existing)
    new = updates["summaries"].withColumn("_k", norm("recording"))
    old = existing["summaries"].withColumn("_k", norm("recording"))
    cols = [c for c in old.columns if c != "_k"]
    shared = [c for c in new.columns if c in cols and c != "recording"]
    extra = [c for c in new.columns if c not in cols and c != "_k"] if add_columns else []
    if order:
        rank = F.row_number().over(Window.partitionBy("_k").orderBy(order))
        old = old.withColumn("_first", rank == 1)
    else:
        old = old.withColumn("_first", F.lit(True))
    fresh = new.select("_k", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in [*shared, *extra]])
    joined = old.join(fresh, "_k", "left")
    take = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("_first")
    changed = joined.select(*[F.when(take, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c) for c in cols],
                            *[F.when(take, F.col(f"_n_{c}")).alias(c) for c in extra])
    added = new.join(old.select("_k"), "_k", "left_anti").select("recording", *shared, *extra)
    out["summaries"] = changed.unionByName(added, allowMissingColumns=True)
    for name in ("dyads", "stable_dyads"):
        if name in updates:
            rows = existing[name].withColumn("_k", norm("recording")).join(new.select("_k"), "_k", "left_anti").drop("_k")
            out[name] = rows.unionByName(updates[name], allowMissingColumns=True) if name in existing else updates[name]
    return out


def import_matching(source: DataFrame, targets: DataFrame, existing: DataFrame, *, overwrite: bool = True) -> DataFrame:
    """Outcome of every source row (name, onsets array, row_no): imported, overwritten, skipped, duplicate, unmatched.

    Rows without onsets take no part. Existing holds the recordings that already have onsets.
    """
    rows = match_names(source.filter(F.size("onsets") > 0), targets)
    known = existing.select(base_name(F.col("recording")).alias("_k")).distinct().withColumn("_old", F.lit(True))
    rows = rows.withColumn("_k", base_name(F.col("target"))).join(known, "_k", "left")
    status = F.when(F.col("status") != "matched", F.col("status")).when(F.col("_old"), "overwritten" if overwrite else "skipped").otherwise("imported")
    return rows.withColumn("status", status).drop("_k", "_old")


def patch_onsets(table: DataFrame, edits: DataFrame, *, name: str, onset_column: str, order: str, layer_column: str = "onset_layer",
                 digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """Write formatted onsets (and a layer name) into the first row matching each edit (recording, onsets, layer).

    The column is created when missing. Returns the table and a report of old and new values; an edit that
    matches no row raises an error when the report is read.
    """
    key = lambda c: F.lower(F.trim(c))
    had = onset_column in table.columns
    rows = table if had else table.withColumn(onset_column, F.lit(None).cast("string"))
    rows = rows if layer_column in rows.columns else rows.withColumn(layer_column, F.lit(None).cast("string"))
    rows = rows.withColumn("_k", key(F.col(name)))
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy("_k").orderBy(order)) == 1)
    new = edits.select(key(F.col("recording")).alias("_k"), format_times(F.col("onsets"), digits).alias("_new"), F.col("layer").alias("_layer"))
    joined = rows.join(new, "_k", "left")
    hit = F.col("_first") & F.col("_new").isNotNull()
    report = new.join(rows.filter("_first").select("_k", F.col(onset_column).alias("old_value"), F.lit(True).alias("_found")), "_k", "left")
    report = report.select(F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col("_k")))).otherwise(F.col("_k")).alias("recording"),
                           "old_value", F.col("_new").alias("new_value"), F.lit(had).alias("column_existed"))
    table = joined.withColumns({onset_column: F.when(hit, F.col("_new")).otherwise(F.col(onset_column)),
                                layer_column: F.when(hit & F.col("_layer").isNotNull(), F.col("_layer")).otherwise(F.col(layer_column))})
    return table.drop("_k", "_first", "_new", "_layer"), report


# Text exports: one row per line with its place, ready for a partitioned text write

def label_lines(onsets: DataFrame, *, refined: bool = True) -> DataFrame:
    """`time TAB time TAB tag_i`; needs recording, onset_idx (1-based), t."""
    digits, tag = (6, "OnsetR") if refined else (4, "Onset")
    at = fixed("t", digits)
    return onsets.select("recording", "onset_idx", F.format_string(f"%s\t%s\t{tag}_%d", at, at, F.col("onset_idx")).alias("line"))


def transcript_lines(words: DataFrame) -> DataFrame:
    """`[start - end]  word` per interval (recording, seq, start, end, label)."""
    return words.select("recording", "seq", F.format_string(
        "[%s - %s]  %s", fixed("start", 3), fixed("end", 3), F.col("label")).alias("line"))


def subtitle_blocks(words: DataFrame) -> DataFrame:
    """Numbered subtitle blocks; needs `number`, the 1-based position."""
    return words.select("recording", "number", F.concat(
        F.col("number").cast("string"), F.lit("\n"), clock(F.col("start")), F.lit(" --> "), clock(F.col("end")), F.lit("\n"), F.col("label"),
        F.lit("\n")).alias("block"))


def grid_lines(onsets: DataFrame, words: DataFrame, durations: DataFrame) -> DataFrame:
    """Point and interval tiers as lines in order: recording, tier (0 head, 1 points, 2 intervals), item, part, line.

    onsets: recording, onset_idx, t; words: recording, seq, start, end, label; durations: recording, duration.
    """
    points = onsets.groupBy("recording").agg(F.count(F.lit(1)).alias("_n"))
    # Gaps are filled and intervals numbered run by run where a recording is oversized.
    filled = gap_filled(lay_out(words.join(durations, "recording"), "recording", "seq"))
    filled = plain(row_index(lay_out(filled, "recording", "seq"), "recording", ["seq", "part"], "item"))
    spans = filled.groupBy("recording").agg(F.count(F.lit(1)).alias("_m"))
    heads = durations.join(points, "recording", "left").join(spans, "recording", "left").fillna(0, ["_n", "_m"])
    d = fixed("duration", 6)
    tiers = F.when(F.col("_m") > 0, 2).otherwise(1)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    head = [F.lit('File type = "ooTextFile"'), F.lit('Object class = "TextGrid"'), F.lit(""), F.lit("xmin = 0"), text("xmax = ", d),
            F.lit("tiers? <exists>"), text("size = ", tiers.cast("string")), F.lit("item []:")]
    tier = lambda k, cls, name, what, n: [F.lit(f"    item [{k}]:"), F.lit(f'        class = "{cls}"'), F.lit(f'        name = "{name}"'),
                                          F.lit("        xmin = 0"), text("        xmax = ", d), text(f"        {what}: size = ", n.cast("string"))]
    out = lambda df, t, item, lines: df.select("recording", F.lit(t).alias("tier"), item.alias("item"), F.posexplode(F.array(*lines)).alias("part", "line"))
    zero = F.lit(0).cast("int")
    parts = [out(heads, 0, zero, head), out(heads, 1, zero, tier(1, "TextTier", "Onsets", "points", F.col("_n"))),
             out(heads.filter("_m > 0"), 2, zero, tier(2, "IntervalTier", "Words", "intervals", F.col("_m")))]
    at = F.col("onset_idx").cast("int")
    parts.append(out(onsets, 1, at, [text("        points [", at.cast("string"), "]:"), text("            number = ", fixed("t", 6)),
                                     text('            mark = "Onset_', at.cast("string"), '"')]))
    item = F.col("item").cast("int")
    parts.append(out(filled, 2, item, [text("        intervals [", item.cast("string"), "]:"), text("            xmin = ", fixed("start", 6)),
                                       text("            xmax = ", fixed("end", 6)), text('            text = "', F.col("label"), '"')]))
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    return lines


def write_lines(lines: DataFrame, path: str, *, order: Sequence[str], column: str = "line", mode: str = "errorifexists") -> None:
    """Text files in one folder per recording, lines in order.

    Rows are range-partitioned by recording and order, so a long recording spans several numbered files.
    """
    rows = lines.repartitionByRange("recording", *order).sortWithinPartitions("recording", *order)
    rows.select("recording", F.col(column).alias("value")).write.mode(mode).partitionBy("recording").text(path)


def _lined(rows: DataFrame, by: Sequence[str], order: Sequence[str], head: DataFrame, fields: Sequence[str], *kept: str) -> DataFrame:
    """A document as lines: `head` (keys, kept columns, document) as line 0, then one line per row in order; no row holds a whole key."""
    rows = plain(row_index(lay_out(rows, by, order[0]), by, order, "line"))
    lines = rows.select(*by, F.col("line").cast("long").alias("line"), F.to_json(F.struct(*fields)).alias("document"))
    return head.withColumn("line", F.lit(0).cast("long")).select(*by, "line", *kept, "document").unionByName(lines, allowMissingColumns=True)


def analysis_payload(bounds: DataFrame, windows: DataFrame, events: DataFrame) -> DataFrame:
    """Analysis of a selection as JSON: per window a header with its bounds as line 0, then a line for each of its events."""
    by = ["recording", "window_index"]
    rows = windows.join(bounds, "recording")
    body = [c for c in rows.columns if c != "recording"]
    head = rows.select(*by, F.to_json(F.struct("recording", *body)).alias("document"))
    inside = events.drop(RUN).join(windows.select(*by), by, "left_semi")
    return _lined(inside, by, ["t", "frame"], head, ["t", "frame", "strength", "threshold", "ioi_sec"])


def region_manifests(regions: DataFrame) -> DataFrame:
    """Saved selections per recording, polarity and layer: a header with the number of regions as line 0, then a line for each in time order."""
    by = ["recording", "polarity", "layer"]
    head = regions.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n_regions"))
    head = head.select(*by, "n_regions", F.to_json(F.struct(F.lit(1).alias("version"), F.col("recording").alias("source_file"), "polarity",
                                                            F.col("layer").alias("layer_name"), "n_regions")).alias("document"))
    place = ["t_start", "t_end", "f_low", "f_high"]
    return _lined(regions, by, place, head, place, "n_regions")


def publish_assets(catalog: DataFrame, entries: DataFrame, *, revision: int, expected: int | None = None) -> tuple[DataFrame, int]:
    """Replace or add assets by id; each gets its next rev-%04d id and the catalog the next revision.

    `revision` is the catalog's current one; another expectation is refused.
    """
    if expected is not None and expected != revision:
        raise ValueError(f"catalog revision is {revision}, expected {expected}")
    number = F.coalesce(F.regexp_extract("_old", r"^rev-(\d+)$", 1).try_cast("int"), F.lit(0)) + 1
    old = catalog.select("asset_id", F.col("revision_id").alias("_old"))
    fresh = entries.join(old, "asset_id", "left").withColumn("revision_id", F.format_string("rev-%04d", number)).drop("_old")
    kept = catalog.join(entries.select("asset_id"), "asset_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True), revision + 1


def pulse_rows(frames: DataFrame, peaks: DataFrame, value: str, hop: float) -> DataFrame:
    """Per frame: time (6 digits), value (8 digits) and whether a selected peak falls on it."""
    first = frames.groupBy("recording").agg(F.min("t").alias("_t0"))
    at = peaks.join(first, "recording").select("recording", F.round((F.col("t") - F.col("_t0")) / hop).cast("long").alias("frame")).distinct()
    rows = frames.join(at.withColumn("_p", F.lit(1)), ["recording", "frame"], "left")
    return rows.select("recording", "frame", F.round("t", 6).alias("t"), F.round(value, 8).alias("value"), F.coalesce("_p", F.lit(0)).alias("is_peak"))


def replace_recordings(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """All rows of the fresh recordings replace their earlier rows."""
    return existing.join(fresh.select("recording").distinct(), "recording", "left_anti").unionByName(fresh)


def label_name(column: Column) -> Column:
    """File stem for exports of a recording."""
    return stem(base_name(column))
