"""Queries that match onsets with onsets, regions and frames, and recordings by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactus.functions.numeric import tidy
from tactus.layout import nearest, plain, plan_layout
from tactus.operators import matching as mt
from tactus.operators.intervals import with_ioi
from tactus.plans.registry import query
from tactus.sources.tables import SQL_FRAMES, SQL_GROUPS, SQL_ONSETS, frames, grouping, onsets, sql_tidy, table

TOL, DUP = 3600.0, 60.0


def _layers(spark, sf, *names):
    rows = onsets(spark, sf, split=False)
    layout = plan_layout(rows, "recording", "t")
    rows = layout.mark(rows)
    return layout, [rows.filter(F.col("layer") == n) for n in names]


def sql_nearest(left: str, right: str) -> str:
    """Each left row with its nearest right row, the earlier one on a tie."""
    return f"""SELECT * FROM (SELECT l.*, r.t AS rt, r.event_id AS rid, row_number() OVER (PARTITION BY l.recording, l.event_id
      ORDER BY abs(l.t - r.t), r.t, r.event_id) AS k FROM {left} l LEFT JOIN {right} r ON l.recording = r.recording) WHERE k = 1"""


SQL_LAYERS = f"""{SQL_ONSETS}, mn AS (SELECT * FROM o WHERE layer = 'click'), cp AS (SELECT * FROM o WHERE layer = 'view'),
  cq AS (SELECT * FROM o WHERE layer = 'error')"""


@query("m5_classify_comparison", f"""WITH {SQL_LAYERS}, nn AS ({sql_nearest('cp', 'mn')})
  SELECT recording, event_id, t, CASE WHEN abs(t - rt) <= {TOL} THEN 'comp_shared' ELSE 'comp_only' END AS status FROM nn
  UNION ALL SELECT recording, event_id, t, CASE WHEN event_id IN (SELECT rid FROM nn WHERE abs(t - rt) <= {TOL}) THEN 'shared_main' ELSE 'main_only' END FROM mn""")
def _(spark, sf):
    layout, (main, other) = _layers(spark, sf, "click", "view")
    return mt.classify_comparison(main, other, TOL, layout=layout)


@query("m6_add_shared_in_order", f"""WITH RECURSIVE {SQL_LAYERS},
  c AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY src, t, event_id) AS rn FROM
    (SELECT recording, event_id, t, 1 AS src FROM cp UNION ALL SELECT recording, event_id, t, 2 FROM cq)),
  b AS (SELECT c.recording, c.rn, any_value(c.event_id) AS event_id, any_value(c.t) AS t, coalesce(min(abs(c.t - mn.t)), 'inf'::DOUBLE) AS base
    FROM c LEFT JOIN mn ON mn.recording = c.recording GROUP BY 1, 2),
  walk AS (SELECT recording, 0::BIGINT AS rn, []::DOUBLE[] AS added, []::BIGINT[] AS ids FROM (SELECT DISTINCT recording FROM b) UNION ALL
    SELECT w.recording, b.rn,
      CASE WHEN least(b.base, coalesce(list_min(list_transform(w.added, lambda x: abs(x - b.t))), 'inf'::DOUBLE)) > {DUP} AND
        least(b.base, coalesce(list_min(list_transform(w.added, lambda x: abs(x - b.t))), 'inf'::DOUBLE)) <= {TOL} THEN list_append(w.added, b.t) ELSE w.added END,
      CASE WHEN least(b.base, coalesce(list_min(list_transform(w.added, lambda x: abs(x - b.t))), 'inf'::DOUBLE)) > {DUP} AND
        least(b.base, coalesce(list_min(list_transform(w.added, lambda x: abs(x - b.t))), 'inf'::DOUBLE)) <= {TOL} THEN list_append(w.ids, b.event_id) ELSE w.ids END
    FROM walk w JOIN b ON b.recording = w.recording AND b.rn = w.rn + 1),
  fin AS (SELECT recording, max_by(ids, rn) AS ids FROM walk GROUP BY 1)
  SELECT recording, event_id, t FROM mn UNION ALL
  SELECT o.recording, o.event_id, o.t FROM (SELECT recording, unnest(ids) AS event_id FROM fin) a JOIN o USING (recording, event_id)""")
def _(spark, sf):
    layout, (main, one, two) = _layers(spark, sf, "click", "view", "error")
    return plain(mt.add_shared(main, [one, two], TOL, duplicate=DUP, layout=layout))


@query("w9_merge_with_suppression", f"""WITH RECURSIVE {SQL_LAYERS},
  c AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY src, t, event_id) AS rn FROM
    (SELECT recording, event_id, t + 30.0 AS t, 1 AS src FROM cp UNION ALL SELECT recording, event_id, t + 30.0, 2 FROM cq)),
  walk AS (SELECT recording, 0::BIGINT AS rn, list(t) AS have, []::BIGINT[] AS ids FROM mn GROUP BY 1 UNION ALL
    SELECT w.recording, c.rn, CASE WHEN list_min(list_transform(w.have, lambda x: abs(x - c.t))) < {TOL} THEN w.have ELSE list_append(w.have, c.t) END,
      CASE WHEN list_min(list_transform(w.have, lambda x: abs(x - c.t))) < {TOL} THEN w.ids ELSE list_append(w.ids, c.event_id) END
    FROM walk w JOIN c ON c.recording = w.recording AND c.rn = w.rn + 1),
  fin AS (SELECT recording, max_by(ids, rn) AS ids FROM walk GROUP BY 1)
  SELECT recording, event_id, t FROM mn UNION ALL
  SELECT o.recording, o.event_id, o.t + 30.0 FROM (SELECT recording, unnest(ids) AS event_id FROM fin) a JOIN o USING (recording, event_id)""")
def _(spark, sf):
    layout, (main, one, two) = _layers(spark, sf, "click", "view", "error")
    return plain(mt.merge_sources(main, [one, two], TOL, offset=30.0, layout=layout))


@query("m6_remove_main_only", f"""WITH {SQL_LAYERS}, nn AS ({sql_nearest('cp', 'mn')})
  SELECT recording, event_id, t FROM mn WHERE event_id IN (SELECT rid FROM nn WHERE abs(t - rt) <= {TOL})""")
def _(spark, sf):
    layout, (main, other) = _layers(spark, sf, "click", "view")
    return mt.classify_comparison(main, other, TOL, layout=layout).filter("status = 'shared_main'").drop("status")


@query("m7_tolerance_anti_join", f"""WITH {SQL_LAYERS} SELECT recording, event_id, t FROM mn WHERE NOT EXISTS
  (SELECT 1 FROM cp WHERE cp.recording = mn.recording AND abs(cp.t - mn.t) < {TOL})""")
def _(spark, sf):
    layout, (main, gone) = _layers(spark, sf, "click", "view")
    return mt.remove_near(main, gone, TOL, layout=layout).select("recording", "event_id", "t")


@query("p5_merge_negative_hits", f"""WITH RECURSIVE {SQL_ONSETS},
  r AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY t, event_id) AS rn, length(layer)::BIGINT AS signal_num FROM o),
  walk AS (SELECT recording, rn, t AS lt, event_id AS lid, strength, signal_num FROM r WHERE rn = 1 UNION ALL
    SELECT w.recording, r.rn, CASE WHEN r.t - w.lt < 7200 THEN w.lt ELSE r.t END, CASE WHEN r.t - w.lt < 7200 THEN w.lid ELSE r.event_id END, r.strength, r.signal_num
    FROM walk w JOIN r ON r.recording = w.recording AND r.rn = w.rn + 1)
  SELECT recording, lid AS event_id, lt AS t, max(strength) AS similarity, array_to_string(list_sort(list_distinct(list(signal_num))), ',') AS signals
  FROM walk GROUP BY 1, 2, 3""")
def _(spark, sf):
    layout, _ = _layers(spark, sf)
    rows = onsets(spark, sf).withColumn("signal_num", F.length("layer").cast("long")).withColumnRenamed("strength", "similarity")
    merged = mt.merge_hits(rows, 7200.0, layout=layout)
    return merged.select("recording", "event_id", "t", "similarity",
                         F.array_join(F.col("signal_nums").cast("array<string>"), ",").alias("signals"))


@query("m18_nearest_existing_per_hit", f"""WITH {SQL_LAYERS}, ex AS (SELECT * FROM o WHERE layer IN ('click', 'view')), nn AS ({sql_nearest('cq', 'ex')})
  SELECT recording, event_id, rid AS existing_id, {sql_tidy('abs(t - rt) * 1000', 3)} AS delta_ms, strength AS similarity FROM nn""")
def _(spark, sf):
    layout, (hits,) = _layers(spark, sf, "error")
    _, (one, two) = _layers(spark, sf, "click", "view")
    existing = one.unionByName(two).select("recording", F.col("t").alias("_rt"), (-F.col("event_id")).alias("neg_id"))

    rows = nearest(hits, existing, "recording", "t", "_rt", ["neg_id"], layout=layout)
    return rows.select("recording", "event_id", (-F.col("near.neg_id")).alias("existing_id"),
                       tidy(F.abs(F.col("t") - F.col("near.t")) * 1000, 3).alias("delta_ms"), F.col("strength").alias("similarity"))


# Regions drawn around sign-ups: strong ones wanted, faint ones unwanted.
SQL_REGIONS = """rg AS (SELECT recording, event_id AS region_id, t - 20000 AS t_start, t + 40000 AS t_end,
  CASE WHEN strength >= 100 THEN 'positive' ELSE 'negative' END AS polarity FROM o WHERE layer = 'signup' AND (strength >= 100 OR strength < 10))"""


def _regions(spark, sf):
    rows = onsets(spark, sf, split=False).filter("layer = 'signup' AND (strength >= 100 OR strength < 10)")
    return rows.select("recording", F.col("event_id").alias("region_id"), (F.col("t") - 20_000).alias("t_start"),
                       (F.col("t") + 40_000).alias("t_end"),
                       F.when(F.col("strength") >= 100, "positive").otherwise("negative").alias("polarity"))


@query("m8_focus_regions", f"""WITH {SQL_ONSETS}, {SQL_REGIONS} SELECT recording, event_id, t FROM o WHERE
  (NOT EXISTS (SELECT 1 FROM rg WHERE rg.recording = o.recording AND polarity = 'positive') OR
   EXISTS (SELECT 1 FROM rg WHERE rg.recording = o.recording AND polarity = 'positive' AND o.t BETWEEN t_start AND t_end))
  AND NOT EXISTS (SELECT 1 FROM rg WHERE rg.recording = o.recording AND polarity = 'negative' AND o.t BETWEEN t_start AND t_end)""")
def _(spark, sf):
    layout, _ = _layers(spark, sf)
    return mt.within_regions(onsets(spark, sf), _regions(spark, sf), layout=layout).select("recording", "event_id", "t")


@query("m9_region_contains_onset", f"""WITH {SQL_ONSETS}, {SQL_REGIONS} SELECT recording, region_id,
  EXISTS (SELECT 1 FROM o WHERE o.layer = 'click' AND o.recording = rg.recording AND o.t >= t_start - 900 AND o.t <= t_end + 900) AS has_onset FROM rg""")
def _(spark, sf):
    layout, (clicks,) = _layers(spark, sf, "click")
    return mt.regions_with_onset(_regions(spark, sf), clicks, 900.0, layout=layout).select("recording", "region_id", "has_onset")


# Onsets on the frame time line: vectors with a positive second component, shifted off the frame grid.
SQL_POINTS = "pt AS (SELECT recording, vec_id AS event_id, frame * 0.05::DOUBLE + abs(x) * 0.2 AS t, rms AS strength, z FROM f WHERE y > 0)"


def points(spark, sf):
    return frames(spark, sf).filter("y > 0").select(
        "recording", F.col("vec_id").alias("event_id"), (F.col("t") + F.abs("x") * 0.2).alias("t"), F.col("rms").alias("strength"), "z")


SQL_FRAME_ROWS = "fr AS (SELECT recording, frame AS event_id, t FROM f)"


@query("m10_frame_at_time", f"""WITH {SQL_FRAMES}, {SQL_POINTS} SELECT recording, event_id, frame FROM (SELECT pt.recording, pt.event_id, f.frame,
  row_number() OVER (PARTITION BY pt.recording, pt.event_id ORDER BY abs(pt.t - f.t), f.t DESC) AS k FROM pt JOIN f USING (recording)) WHERE k = 1""")
def _(spark, sf):
    return mt.frame_at(points(spark, sf), frames(spark, sf), layout=plan_layout(frames(spark, sf), "recording", "t")).select(
        "recording", "event_id", "frame")


@query("m12_nearest_level_frame", f"""WITH {SQL_FRAMES}, {SQL_POINTS} SELECT recording, event_id, frame FROM (SELECT pt.recording, pt.event_id, f.frame,
  row_number() OVER (PARTITION BY pt.recording, pt.event_id ORDER BY abs(pt.t - f.t), f.t) AS k FROM pt JOIN f USING (recording)) WHERE k = 1""")
def _(spark, sf):
    return mt.frame_at(points(spark, sf), frames(spark, sf), tie="earlier",
                       layout=plan_layout(frames(spark, sf), "recording", "t")).select("recording", "event_id", "frame")


@query("m16_recall_of_marked_examples", f"""WITH {SQL_ONSETS}, dt AS (SELECT * FROM o WHERE layer = 'click'),
  tl AS (SELECT recording, least(min(gap) / 2, 1800.0) AS tol FROM (SELECT recording, t - lag(t) OVER (PARTITION BY recording ORDER BY t, event_id) AS gap FROM dt) GROUP BY 1 HAVING min(gap) IS NOT NULL),
  ex AS (SELECT o.recording, strength >= 20 AS pos, EXISTS (SELECT 1 FROM dt WHERE dt.recording = o.recording AND abs(dt.t - o.t) <= tl.tol) AS hit
    FROM o JOIN tl USING (recording) WHERE layer = 'signup'),
  c AS (SELECT recording, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg, count(*) FILTER (pos AND hit) AS pos_hit, count(*) FILTER (NOT pos AND hit) AS neg_hit FROM ex GROUP BY 1),
  n AS (SELECT recording, count(*) AS n_detected FROM dt GROUP BY 1)
  SELECT recording, n_pos, n_neg, pos_hit, neg_hit, n_detected, {sql_tidy('pos_hit / greatest(n_pos, 1) - 0.5::DOUBLE * neg_hit / greatest(n_neg, 1) - least(0.3, greatest(0, n_detected - 3 * n_pos) * 0.01)::DOUBLE')} AS score FROM c JOIN n USING (recording)""")
def _(spark, sf):
    layout, (marked, found) = _layers(spark, sf, "signup", "click")
    gaps = with_ioi(found).groupBy("recording").agg(F.min(F.col("ioi_ms")).alias("_m")).filter("_m IS NOT NULL")
    tol = gaps.select("recording", F.least(F.col("_m") / 2000, F.lit(1800.0)).alias("tol"))
    examples = marked.withColumn("polarity", F.when(F.col("strength") >= 20, "positive").otherwise("negative"))
    rows = mt.recall_score(examples, found, tol, layout=layout)
    return rows.withColumn("score", tidy("score"))


@query("m17_edited_onsets_override", f"""WITH {SQL_ONSETS}, ed AS (SELECT * FROM o WHERE layer = 'error' AND recording IN (SELECT recording FROM o GROUP BY 1 HAVING max(strength) > 200)),
  fin AS (SELECT recording, event_id, t FROM o WHERE layer = 'click' AND recording NOT IN (SELECT recording FROM ed) UNION ALL SELECT recording, event_id, t FROM ed)
  SELECT recording, event_id, {sql_tidy('(t - lag(t) OVER (PARTITION BY recording ORDER BY t, event_id)) * 1000', 3)} AS ioi_ms FROM fin""")
def _(spark, sf):
    rows = onsets(spark, sf)
    busy = rows.groupBy("recording").agg(F.max("strength").alias("_m")).filter("_m > 200").select("recording")
    derived = rows.filter("layer = 'click'").drop("layer", "strength")
    edited = rows.filter("layer = 'error'").join(busy, "recording", "left_semi")
    final = with_ioi(mt.with_overrides(derived, edited, ["recording"]))
    return final.select("recording", "event_id", tidy("ioi_ms", 3).alias("ioi_ms"))


# Names and groups

@query("m1_group_by_name_pattern", r"""SELECT c_custkey, CASE WHEN regexp_matches(c_name, '#0*([1-5])') THEN regexp_extract(c_name, '#0*([1-5])', 1) ELSE 'Ungrouped' END AS grp FROM customer""")
def _(spark, sf):
    rows = table(spark, sf, "customer")
    return mt.group_by_pattern(rows, "c_name", r"#0*(?P<group>[1-5])").select("c_custkey", "grp")


@query("m2_group_by_mapping_table", """SELECT c_custkey, coalesce(grp, 'Ungrouped') AS grp FROM customer LEFT JOIN
  (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS grp FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def _(spark, sf):
    mapping = table(spark, sf, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("grp"), "o_orderkey")
    rows = table(spark, sf, "customer").select(F.col("c_custkey"))
    return mt.group_by_mapping(rows, mapping, "c_custkey", order="o_orderkey")


@query("m3_group_by_summary_column", f"""WITH {SQL_ONSETS}, {SQL_GROUPS} SELECT recording, count(*) AS n_onsets, coalesce(grp, 'Ungrouped') AS grp
  FROM o LEFT JOIN gm USING (recording) GROUP BY 1, 3""")
def _(spark, sf):
    counts = onsets(spark, sf, split=False).groupBy("recording").agg(F.count(F.lit(1)).alias("n_onsets"))
    return counts.join(grouping(spark, sf).select("recording", "grp"), "recording", "left").withColumn(
        "grp", F.coalesce("grp", F.lit("Ungrouped")))


# Outside names: a path in upper case with another ending for most orders, and names without a counterpart.
SQL_NAMES = """tg AS (SELECT lower(c_name) || '.wav' AS target FROM customer UNION ALL SELECT lower(c_name) || '.flac' FROM customer WHERE c_acctbal < 0),
  sr AS (SELECT o_orderkey AS row_no, CASE WHEN o_totalprice > 400000 THEN 'x/Unknown#' || o_custkey ELSE '/Field/Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END ||
    CASE WHEN o_orderstatus = 'F' THEN '.WAV' ELSE '.Mp3 ' END AS name FROM orders)"""


def _names(spark, sf):
    c = table(spark, sf, "customer")
    low = F.lower("c_name")
    targets = c.select(F.concat(low, F.lit(".wav")).alias("target")).unionByName(
        c.filter("c_acctbal < 0").select(F.concat(low, F.lit(".flac")).alias("target")))
    key = F.col("o_custkey").cast("string")
    source = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_no"), F.concat(
        F.when(F.col("o_totalprice") > 400_000, F.concat(F.lit("x/Unknown#"), key)).otherwise(
            F.concat(F.lit("/Field/Customer#"), F.lpad(key, 9, "0"))),
        F.when(F.col("o_orderstatus") == "F", ".WAV").otherwise(".Mp3 ")).alias("name"))
    return source, targets


SQL_MATCHED = f"""{SQL_NAMES}, sn AS (SELECT *, lower(trim(regexp_extract(name, '[^/]*$'))) AS n FROM sr),
  ss AS (SELECT *, regexp_replace(n, '[.][^.]*$', '') AS s FROM sn),
  us AS (SELECT regexp_replace(target, '[.][^.]*$', '') AS s, max(target) AS bt FROM tg GROUP BY 1 HAVING count(*) = 1),
  fd AS (SELECT ss.row_no, ss.name, coalesce(tg.target, us.bt) AS target FROM ss LEFT JOIN tg ON tg.target = ss.n LEFT JOIN us ON us.s = ss.s),
  ms AS (SELECT *, CASE WHEN target IS NULL THEN 'unmatched' WHEN row_no = min(row_no) OVER (PARTITION BY target) THEN 'matched' ELSE 'duplicate' END AS status FROM fd)"""


@query("m4_name_match_exact_then_stem", f"WITH {SQL_MATCHED} SELECT row_no, name, target, status FROM ms")
def _(spark, sf):
    return mt.match_names(*_names(spark, sf)).select("row_no", "name", "target", "status")


SQL_META = """sm AS (SELECT c_custkey AS recording, count(o_orderkey) AS n_orders, c_mktsegment AS segment FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 3),
  pf AS (SELECT o_custkey AS recording, max_by(o_orderpriority, o_orderkey) AS species, 'other' AS segment, CASE WHEN max(o_totalprice) > 300000 THEN '' ELSE 'song' END AS func FROM orders GROUP BY 1)"""
GENERAL = {"species": "finch", "modality": "acoustic", "func": "display"}
FIELDS = ["species", "segment", "modality", "func", "lat"]


def _meta(spark, sf):
    orders = table(spark, sf, "orders")
    counts = orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("_n"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    summaries = customers.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("recording"), F.coalesce("_n", F.lit(0)).alias("n_orders"), F.col("c_mktsegment").alias("segment"))
    per_file = orders.groupBy(F.col("o_custkey").alias("recording")).agg(
        F.max_by("o_orderpriority", "o_orderkey").alias("species"), F.lit("other").alias("segment"),
        F.when(F.max("o_totalprice") > 300_000, "").otherwise("song").alias("func"))
    return summaries, per_file


@query("m13_metadata_merge", f"""WITH {SQL_META} SELECT sm.recording, n_orders, sm.segment, coalesce(species, 'finch') AS species, 'acoustic' AS modality,
  coalesce(func, 'display') AS func, '' AS lat FROM sm LEFT JOIN pf USING (recording)""")
def _(spark, sf):
    return mt.merge_metadata(*_meta(spark, sf), GENERAL, FIELDS)


@query("m14_demographics_table", f"""WITH {SQL_META} SELECT sm.recording, coalesce(nullif(species, ''), 'finch') AS species, coalesce(pf.segment, 'NA') AS segment, 'acoustic' AS modality,
  coalesce(nullif(func, ''), 'display') AS func, 'NA' AS lat FROM sm LEFT JOIN pf USING (recording)""")
def _(spark, sf):
    summaries, per_file = _meta(spark, sf)
    return mt.demographics(summaries.select("recording"), per_file, GENERAL, FIELDS)


@query("s7_summaries_with_demographics", f"""WITH {SQL_META} SELECT sm.recording, n_orders, sm.segment, species, nullif(CASE WHEN func = '' THEN 'NA' ELSE func END, 'NA') AS func FROM sm LEFT JOIN pf USING (recording)""")
def _(spark, sf):
    summaries, per_file = _meta(spark, sf)
    return mt.add_missing_columns(summaries, per_file.withColumn("func", F.when(F.col("func") == "", "NA").otherwise(F.col("func"))))


@query("m15_unit_pairs", """SELECT a.n_name AS unit_a, b.n_name AS unit_b FROM nation a JOIN nation b ON a.n_name < b.n_name""")
def _(spark, sf):
    return mt.unit_pairs(table(spark, sf, "nation"), "n_name", [])
