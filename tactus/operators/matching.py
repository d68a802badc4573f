"""Matching onsets to onsets, frames and regions by time; matching recordings by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.functions.text import base_name, stem
from tactus.layout import RUN, Layout, covered, nearest, running
from tactus.operators.thinning import bridged, spaced
from tactus.session import settled

INFINITE = float("inf")


def _distance(t: str = "t", name: str = "near") -> Column:
    return F.coalesce(F.abs(F.col(t) - F.col(f"{name}.t")), F.lit(INFINITE))


def with_nearest_distance(left: DataFrame, right: DataFrame, *, layout: Layout | None = None) -> DataFrame:
    """Distance from each left onset to the nearest right onset; infinity without one."""
    rows = nearest(left, right.select("recording", F.col("t").alias("_rt")), "recording", "t", "_rt", layout=layout)
    return rows.withColumn("distance", _distance()).drop("near")


def classify_comparison(main: DataFrame, other: DataFrame, tolerance: float, *,
                        layout: Layout | None = None) -> DataFrame:
    """Label main and comparison onsets `shared_main`, `main_only`, `comp_only` or `comp_shared`.

    Each comparison onset claims its nearest main onset (the earlier on a tie) when within the tolerance.
    """
    targets = main.select("recording", F.col("t").alias("_rt"), F.col("event_id").alias("main_id"))
    found = nearest(other, targets, "recording", "t", "_rt", ["main_id"], layout=layout)
    found = found.withColumn("_hit", _distance() <= tolerance)
    claimed = found.filter("_hit").select("recording", F.col("near.main_id").alias("event_id")).distinct()
    sides = main.join(claimed.withColumn("_c", F.lit(True)), ["recording", "event_id"], "left")
    ours = sides.select("recording", "event_id", "t", F.when(F.col("_c"), "shared_main").otherwise("main_only").alias("status"))
    theirs = found.select("recording", "event_id", "t",
                          F.when(F.col("_hit"), "comp_shared").otherwise("comp_only").alias("status"))
    return ours.unionByName(theirs)


def add_shared(main: DataFrame, others: Sequence[DataFrame], tolerance: float, *, duplicate: float = 0.001,
               layout: Layout | None = None) -> DataFrame:
    """Append comparison onsets whose nearest current onset is within the tolerance but not a duplicate.

    Onsets added earlier count as current, so sources are taken one after another, each in time order.
    """
    current = main.select("recording", "event_id", "t", *_run(main))
    for other in others:
        base = with_nearest_distance(other.select("recording", "event_id", "t", *_run(other)), current, layout=layout)
        added = bridged(base, "recording", "t", "distance", duplicate, tolerance, ties=["event_id"],
                        at_most=layout.largest if layout else None).drop("distance")
        current = _append(current, added, layout)
    return current


def merge_sources(existing: DataFrame, sources: Sequence[DataFrame], tolerance: float, *, offset: float = 0.0,
                  layout: Layout | None = None) -> DataFrame:
    """Append onsets that are at least `tolerance` from every onset already present, source by source."""
    current = existing.select("recording", "event_id", "t", *_run(existing))
    for source in sources:
        moved = source.select("recording", "event_id", (F.col("t") + F.lit(offset)).alias("t"), *_run(source))
        free = with_nearest_distance(moved, current, layout=layout).filter(F.col("distance") >= tolerance)
        added = spaced(free.drop("distance"), "recording", "t", tolerance, ties=["event_id"], at_most=layout.largest if layout else None)
        current = _append(current, added, layout)
    return current


def _run(df: DataFrame) -> list[str]:
    return [RUN] if RUN in df.columns else []


def _append(current: DataFrame, added: DataFrame, layout: Layout | None) -> DataFrame:
    if layout is not None and layout.split:
        added = layout.mark(added.drop(RUN))
    return current.unionByName(added.select(*current.columns))


def remove_near(onsets: DataFrame, removed: DataFrame, tolerance: float, *, layout: Layout | None = None) -> DataFrame:
    """Drop onsets closer than the tolerance to any removed time."""
    return with_nearest_distance(onsets, removed, layout=layout).filter(F.col("distance") >= tolerance).drop("distance")


def merge_hits(hits: DataFrame, tolerance: float = 0.001, *, layout: Layout | None = None) -> DataFrame:
    """Combine hits closer than the tolerance to the hit that opened their group: best similarity, all signals."""
    leaders = spaced(hits.select("recording", "event_id", "t", *_run(hits)), "recording", "t", tolerance, ties=["event_id"])

    marked = hits.join(leaders.select("recording", "event_id", F.lit(True).alias("_lead")), ["recording", "event_id"], "left")
    lead = F.when(F.col("_lead"), F.struct("t", "event_id"))
    held = running(marked.withColumn("_l", lead), "recording", ["t", "event_id"], {"_leader": ("max", "_l")})
    return held.groupBy("recording", F.col("_leader.event_id").alias("event_id"), F.col("_leader.t").alias("t")).agg(
        F.max("similarity").alias("similarity"), F.array_sort(F.collect_set("signal_num")).alias("signal_nums"))


# Regions

def within_regions(onsets: DataFrame, regions: DataFrame, *, layout: Layout | None = None) -> DataFrame:
    """Keep onsets inside some positive region, where the recording has any, and outside every negative one."""
    positive, negative = (regions.filter(F.col("polarity") == p) for p in ("positive", "negative"))
    rows = covered(onsets, positive, "recording", "t", "t_start", "t_end", "_in", layout=layout)
    rows = covered(rows, negative, "recording", "t", "t_start", "t_end", "_out", layout=layout)
    demanding = positive.select("recording").distinct().withColumn("_any", F.lit(True))
    rows = rows.join(demanding, "recording", "left")
    return rows.filter((F.col("_in") | F.col("_any").isNull()) & ~F.col("_out")).drop("_in", "_out", "_any")


def regions_with_onset(regions: DataFrame, onsets: DataFrame, margin: float, *,
                       layout: Layout | None = None) -> DataFrame:
    """Flag regions that hold an onset within their bounds widened by the margin.

    The first onset at or after the widened start decides, so no region-onset pairs are formed.
    """
    starts = regions.withColumn("_s", F.col("t_start") - margin)
    targets = onsets.select("recording", F.col("t").alias("_rt"))
    rows = first_after(starts, targets, "recording", "_s", "_rt", layout=layout)
    return rows.withColumn("has_onset", F.coalesce(F.col("_next") <= F.col("t_end") + margin, F.lit(False))).drop("_s", "_next")


def first_after(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, *,
                layout: Layout | None = None) -> DataFrame:
    """Adds `_next`: the first right time >= the left time."""

    a = left.drop(RUN).select(key, F.col(lt).alias("_t"), F.lit(0).alias("_side"),
                              F.struct(*[c for c in left.columns if c != RUN]).alias("_row"))
    b = right.select(key, F.col(rt).alias("_t"), F.lit(1).alias("_side"), F.col(rt).alias("_rt"))
    both = a.unionByName(b, allowMissingColumns=True)
    if layout is not None and layout.split:
        both = layout.mark(both, "_t")
    both = running(both, key, ["_t", "_side"], {"_next": ("min", "_rt")}, reverse=True)
    return both.filter(F.col("_side") == 0).select("_row.*", "_next", *_run(both))


# Frames

def frame_at(onsets: DataFrame, frames: DataFrame, *, tie: str = "later", layout: Layout | None = None) -> DataFrame:
    """Nearest frame for each onset; on a tie the later frame (`tie="earlier"` for the level lookup)."""
    targets = frames.select("recording", F.col("t").alias("_ft"), "frame")
    rows = nearest(onsets, targets, "recording", "t", "_ft", ["frame"], layout=layout, tie=tie)
    return rows.withColumn("frame", F.col("near.frame")).drop("near")


def into_windows(onsets: DataFrame, windowed: DataFrame, hop: float, *, layout: Layout | None = None) -> DataFrame:
    """Attach each onset to the nearest of the selected frames whose window, padded by half a hop (at least 10 ms),
    contains the onset. `windowed` has recording, frame, t, window_index, w_start, w_end.

    Windows are runs of frames with rising ends, so a window that holds the onset has one of the frames next to it.
    """
    pad = max(0.01, max(0.01, hop) * 0.5)
    rows = nearest(onsets, windowed.select("recording", F.col("t").alias("_ft"), "frame", "window_index", "w_start", "w_end"),
                   "recording", "t", "_ft", ["frame", "window_index", "w_start", "w_end"], layout=layout,
                   accept=lambda c: F.col("_t").between(c["w_start"] - pad, c["w_end"] + pad))
    return rows.filter(F.col("near").isNotNull()).withColumns({"frame": F.col("near.frame"), "window_index": F.col("near.window_index")}).drop("near")


def recall_score(examples: DataFrame, detections: DataFrame, tolerance: DataFrame, *,
                 layout: Layout | None = None) -> DataFrame:
    """Share of positive examples met by a detection, less half the share of negative ones, less an excess penalty.

    `tolerance` has one row per recording with `tol` in seconds.
    """
    rows = with_nearest_distance(examples, detections, layout=layout).join(tolerance, "recording")
    hit, pos = F.col("distance") <= F.col("tol"), F.col("polarity") == "positive"
    counts = rows.groupBy("recording").agg(
        F.count(F.when(pos, 1)).alias("n_pos"), F.count(F.when(~pos, 1)).alias("n_neg"),
        F.count(F.when(pos & hit, 1)).alias("pos_hit"), F.count(F.when(~pos & hit, 1)).alias("neg_hit"))
    found = detections.groupBy("recording").agg(F.count(F.lit(1)).alias("n_detected"))
    rows = counts.join(found, "recording", "left").fillna(0, ["n_detected"])
    excess = F.greatest(F.col("n_detected") - F.col("n_pos") * 3, F.lit(0))
    score = (F.col("pos_hit") / F.greatest(F.col("n_pos"), F.lit(1))
             - 0.5 * F.col("neg_hit") / F.greatest(F.col("n_neg"), F.lit(1))
             - F.least(F.lit(0.3), excess * 0.01))
    return rows.withColumn("score", score)


def with_overrides(derived: DataFrame, overrides: DataFrame, target: Sequence[str]) -> DataFrame:
    """Edited onsets replace the derived ones of the same target; other targets keep theirs."""
    keys = list(target)
    edited = overrides.select(*keys).distinct()
    return derived.join(edited, keys, "left_anti").unionByName(overrides.select(*derived.columns))


def target_key(asset: Column, method: Column, ids: Column) -> Column:
    """Text key of a selection: asset, method and its sorted frame ids."""
    return F.concat_ws("::", asset, F.trim(method), F.array_join(F.array_sort(ids).cast("array<string>"), ","))


# Recordings by name and group

def group_by_pattern(rows: DataFrame, column: str, pattern: str, *, label: str = "Ungrouped") -> DataFrame:
    """Group from the capture named `group` of a regular expression searched in the name."""
    java = pattern.replace("(?P<", "(?<")
    names = [part.split(">")[0] for part in java.split("(?<")[1:] if part[0] not in "=!"]
    if "group" not in names:
        return rows.withColumn("grp", F.lit(label))
    at = 1 + _captures_before(java, "(?<group>")
    found = F.when(F.col(column).rlike(java), F.regexp_extract(column, java, at))
    return rows.withColumn("grp", F.coalesce(found, F.lit(label)))


def _captures_before(pattern: str, mark: str) -> int:
    head = pattern[: pattern.index(mark)].replace("\\(", "")
    return sum(1 for i, c in enumerate(head) if c == "(" and (head[i + 1: i + 2] != "?" or head[i + 1: i + 3] == "?<"
               and head[i + 3: i + 4] not in "=!"))


def group_by_mapping(rows: DataFrame, mapping: DataFrame, column: str, *, order: str, label: str = "Ungrouped") -> DataFrame:
    """Group from a mapping table (name, grp); the last row of a repeated name wins."""
    last = mapping.groupBy("name").agg(F.max_by("grp", order).alias("grp"))
    return rows.join(last.withColumnRenamed("name", column), column, "left").withColumn(
        "grp", F.coalesce("grp", F.lit(label)))


def match_names(source: DataFrame, targets: DataFrame, *, name: str = "name", order: str = "row_no") -> DataFrame:
    """Resolve source names to target names: exact file name first, then a stem that is unique among targets.

    Adds `target` and `status`: matched, duplicate (a target already taken by an earlier source row) or unmatched.
    """
    norm = base_name(F.col(name))
    src = source.withColumns({"_n": norm, "_s": stem(norm)})
    tgt = targets.select(F.col("target"), base_name(F.col("target")).alias("_n")).filter("_n != ''")
    exact = tgt.groupBy("_n").agg(F.max("target").alias("_exact"))
    by_stem = tgt.groupBy(stem(F.col("_n")).alias("_s")).agg(F.count(F.lit(1)).alias("_k"), F.max("target").alias("_by_stem"))
    found = src.join(exact, "_n", "left").join(by_stem.filter("_k = 1").drop("_k"), "_s", "left")
    found = settled(found.select(*source.columns, F.when(F.col("_n") != "", F.coalesce("_exact", "_by_stem")).alias("target")))
    first = found.filter(F.col("target").isNotNull()).groupBy("target").agg(F.min(order).alias("_first"))
    status = (F.when(F.col("target").isNull(), "unmatched").when(F.col(order) == F.col("_first"), "matched")
              .otherwise("duplicate"))
    # Rows without a target, however many, are not joined: they would all meet at the null key.
    known = found.filter(F.col("target").isNotNull()).join(first, "target")
    rows = known.unionByName(found.filter(F.col("target").isNull()), allowMissingColumns=True)
    return rows.withColumn("status", status).select(*source.columns, "target", "status")


def merge_metadata(summaries: DataFrame, per_file: DataFrame, general: dict[str, str], fields: Sequence[str]) -> DataFrame:
    """Fill metadata columns: a measured column stays, then the file's value, then the general one, then empty text."""
    slim = per_file.select("recording", *[F.col(f).alias(f"_{f}") for f in fields if f in per_file.columns])
    rows = summaries.join(slim, "recording", "left")
    for f in fields:
        if f not in summaries.columns:
            own = F.col(f"_{f}") if f in per_file.columns else F.lit(None).cast("string")
            rows = rows.withColumn(f, F.coalesce(own, F.lit(general.get(f)), F.lit("")))
    return rows.drop(*[f"_{f}" for f in fields])


def demographics(recordings: DataFrame, per_file: DataFrame, general: dict[str, str], fields: Sequence[str]) -> DataFrame:
    """Every declared field per recording: the file's value, the general value, then NA. Blank counts as missing."""
    rows = recordings.join(per_file, "recording", "left")
    blank = lambda c: F.nullif(c, F.lit(""))
    return rows.select("recording", *[
        F.coalesce(blank(F.col(f)) if f in per_file.columns else F.lit(None), blank(F.lit(general.get(f))), F.lit("NA")).alias(f)
        for f in fields])


def add_missing_columns(summaries: DataFrame, extra: DataFrame, key: str = "recording") -> DataFrame:
    """Left-join only the columns the summaries lack; the placeholder NA becomes null."""
    new = [c for c in extra.columns if c != key and c not in summaries.columns]
    slim = extra.select(key, *[F.nullif(F.col(c), F.lit("NA")).alias(c) for c in new])
    return summaries.join(slim, key, "left")


def unit_pairs(units: DataFrame, unit: str, columns: Sequence[str], tile_units: int = 2_000) -> DataFrame:
    """All unordered pairs of units, a < b: the rows of a distance matrix.

    Units are dealt into tiles of about `tile_units` by hash, so the number of tiles follows their count. Every pair of
    tiles x <= y is one key of an equi-join; no pair is built twice. The result has n(n-1)/2 rows by definition; units
    are aggregates such as species or sites.
    """
    tiles = max(1, -(-units.count() // tile_units))
    body = units.select(F.struct(F.col(unit).alias("unit"), *columns).alias("_u"), F.pmod(F.xxhash64(unit), F.lit(tiles)).cast("int").alias("_t"))
    low = body.select(F.col("_u").alias("_one"), F.col("_t").alias("_x"), F.explode(F.sequence(F.col("_t"), F.lit(tiles - 1))).alias("_y"))
    high = body.select(F.col("_u").alias("_two"), F.col("_t").alias("_y"), F.explode(F.sequence(F.lit(0), F.col("_t"))).alias("_x"))
    pairs = low.join(high, ["_x", "_y"]).filter(F.when(F.col("_x") == F.col("_y"), F.col("_one.unit") < F.col("_two.unit")).otherwise(F.col("_one.unit") != F.col("_two.unit")))
    turned = F.col("_one.unit") > F.col("_two.unit")
    pairs = pairs.select(F.when(turned, F.col("_two")).otherwise(F.col("_one")).alias("_a"), F.when(turned, F.col("_one")).otherwise(F.col("_two")).alias("_b"))
    return pairs.select("_a.unit", "_b.unit", *[x for c in columns for x in (f"_a.{c}", f"_b.{c}")]).toDF(
        "unit_a", "unit_b", *[x for c in columns for x in (f"{c}_a", f"{c}_b")])
