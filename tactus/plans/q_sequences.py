"""Queries on onset sequences: intervals, pairs, spacing rules, per-recording metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactus.functions.numeric import tidy
from tactus.layout import plain
from tactus.operators import intervals as iv
from tactus.operators import metrics, sweeps
from tactus.operators.thinning import spaced
from tactus.plans.registry import query
from tactus.sources.tables import SQL_ONSETS, onsets, sql_tidy, table

W = "WINDOW w AS (PARTITION BY recording ORDER BY t, event_id)"
TOL = 0.5

SQL_IOI = f"{SQL_ONSETS}, i AS (SELECT *, (t - lag(t) OVER w) * 1000 AS ioi_ms FROM o {W})"
SQL_DYADS = f"""{SQL_ONSETS}, g AS (SELECT recording, event_id, t, row_number() OVER w AS dyad_index,
    (lead(t) OVER w - t) * 1000 AS i1, (lead(t, 2) OVER w - lead(t) OVER w) * 1000 AS i2,
    (lead(t, 3) OVER w - lead(t, 2) OVER w) * 1000 AS i3, (lead(t, 4) OVER w - lead(t, 3) OVER w) * 1000 AS i4
    FROM o {W}),
  d AS (SELECT recording, event_id, t, dyad_index, i1, i2, i1 + i2 AS cycle_ms, least(i1, i2) AS short_ms,
    greatest(i1, i2) AS long_ms, CASE WHEN i1 + i2 > 0 THEN i1 / (i1 + i2) ELSE 0 END AS r_k,
    i3 IS NOT NULL AND greatest(i1, i3) > 0 AND abs(i1 - i3) / greatest(i1, i3) <= {TOL}
      AND (i4 IS NULL OR (greatest(i2, i4) > 0 AND abs(i2 - i4) / greatest(i2, i4) <= {TOL})) AS stable
    FROM g WHERE i2 IS NOT NULL)"""


def _dyads(spark, sf, **kw):
    return iv.dyads(onsets(spark, sf), tolerance=TOL, **kw)


@query("w1_inter_onset_intervals", f"WITH {SQL_IOI} SELECT recording, event_id, {sql_tidy('ioi_ms', 3)} AS ioi_ms FROM i")
def _(spark, sf):
    return plain(iv.with_ioi(onsets(spark, sf)).select("recording", "event_id", tidy("ioi_ms", 3).alias("ioi_ms")))


@query("w2_rolling_ratio", f"""WITH {SQL_ONSETS}, g AS (SELECT recording, event_id, lag(t) OVER w - lag(t, 2) OVER w AS a,
  t - lag(t) OVER w AS b FROM o {W})
  SELECT recording, event_id, {sql_tidy('CASE WHEN a + b > 0 THEN a / (a + b) END')} AS rolling_rk FROM g""")
def _(spark, sf):
    rows = iv.rolling_ratio(onsets(spark, sf))
    return rows.select("recording", "event_id", tidy("rolling_rk").alias("rolling_rk"))


@query("w3_p1_dyads_with_stability", f"""WITH {SQL_DYADS} SELECT recording, dyad_index, {sql_tidy('i1', 3)} AS interval_1_ms,
  {sql_tidy('i2', 3)} AS interval_2_ms, {sql_tidy('cycle_ms', 3)} AS cycle_ms, {sql_tidy('short_ms', 3)} AS short_ms,
  {sql_tidy('long_ms', 3)} AS long_ms, {sql_tidy('r_k')} AS r_k, stable FROM d""")
def _(spark, sf):
    rows = _dyads(spark, sf)
    ms = ["interval_1_ms", "interval_2_ms", "cycle_ms", "short_ms", "long_ms"]
    return rows.select("recording", "dyad_index", *[tidy(c, 3).alias(c) for c in ms], tidy("r_k").alias("r_k"), "stable")


@query("s8_stable_dyad_rows", f"WITH {SQL_DYADS} SELECT recording, dyad_index, {sql_tidy('r_k')} AS r_k FROM d WHERE stable")
def _(spark, sf):
    return _dyads(spark, sf).filter("stable").select("recording", "dyad_index", tidy("r_k").alias("r_k"))


@query("p2_valid_ratio_filter", f"""WITH {SQL_DYADS} SELECT recording, count(*) AS n, {sql_tidy('avg(r_k)')} AS mean_rk FROM d
  WHERE r_k > 0 AND r_k < 1 GROUP BY 1""")
def _(spark, sf):
    rows = iv.valid_ratios(_dyads(spark, sf, index=False))
    return rows.groupBy("recording").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg("r_k")).alias("mean_rk"))


@query("p3_isochronous_band", f"""WITH {SQL_DYADS} SELECT recording, count(*) FILTER (r_k BETWEEN 0.45 AND 0.55) AS n_iso
  FROM d GROUP BY 1""")
def _(spark, sf):
    rows = _dyads(spark, sf, index=False)
    return rows.groupBy("recording").agg(F.count(F.when(iv.isochronous(F.col("r_k")), 1)).alias("n_iso"))


@query("p4_tempo_projection", f"""WITH {SQL_DYADS} SELECT recording, event_id, {sql_tidy('120000 / nullif(cycle_ms, 0)', 9)} AS bpm
  FROM d WHERE 120000 / nullif(cycle_ms, 0) BETWEEN 0.001 AND 0.01""")
def _(spark, sf):
    rows = iv.with_tempo(_dyads(spark, sf, index=False), "ioi", 0.001, 0.01)
    return rows.select("recording", "event_id", tidy("bpm", 9).alias("bpm"))


@query("p5_time_range_removal", f"""WITH {SQL_ONSETS} SELECT recording, event_id, t FROM o
  WHERE NOT (t BETWEEN 1705000000.0 - 60 AND 1706000000.0 + 60)""")
def _(spark, sf):
    rows = iv.without_range(onsets(spark, sf, split=False), 1_706_000_000.0, 1_705_000_000.0, 60.0)
    return rows.select("recording", "event_id", "t")


# Greedy spacing in SQL: link each onset to the first one far enough after it, then follow the links.
def sql_spaced(source: str, gap: str, op: str = ">=") -> str:
    return f"""q AS ({source}), qn AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY t, event_id) AS rn FROM q),
  nx AS (SELECT a.recording, a.rn, min(b.rn) AS nrn FROM qn a JOIN qn b ON a.recording = b.recording AND b.rn > a.rn
    AND b.t - a.t {op} {gap} GROUP BY 1, 2),
  kept AS (SELECT recording, rn FROM qn WHERE rn = 1 UNION ALL
    SELECT k.recording, nx.nrn FROM kept k JOIN nx ON k.recording = nx.recording AND k.rn = nx.rn)"""


# Keep the stronger of close neighbours: walk row by row with the last kept row as state.
def sql_strongest(source: str, gap: str, op: str = ">") -> str:
    return f"""q AS ({source}), qn AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY t, event_id) AS rn FROM q),
  walk AS (SELECT recording, rn, 1 AS grp, t AS kt, strength AS ks, event_id AS kid FROM qn WHERE rn = 1 UNION ALL
    SELECT w.recording, n.rn, w.grp + CASE WHEN n.t - w.kt {op} {gap} THEN 1 ELSE 0 END,
      CASE WHEN n.t - w.kt {op} {gap} OR n.strength > w.ks THEN n.t ELSE w.kt END,
      CASE WHEN n.t - w.kt {op} {gap} OR n.strength > w.ks THEN n.strength ELSE w.ks END,
      CASE WHEN n.t - w.kt {op} {gap} OR n.strength > w.ks THEN n.event_id ELSE w.kid END
    FROM walk w JOIN qn n ON n.recording = w.recording AND n.rn = w.rn + 1),
  kept AS (SELECT recording, grp, max_by(kid, rn) AS event_id, max_by(kt, rn) AS t, max_by(ks, rn) AS strength
    FROM walk GROUP BY 1, 2)"""


ALL = "SELECT recording, event_id, t, strength FROM o"


def _spaced_query(name, gap, inclusive=True):
    op = ">=" if inclusive else ">"

    @query(name, f"""WITH RECURSIVE {SQL_ONSETS}, {sql_spaced(ALL, str(gap), op)}
      SELECT q.recording, q.event_id, q.t FROM kept JOIN qn q ON q.recording = kept.recording AND q.rn = kept.rn""")
    def run(spark, sf):
        rows = spaced(onsets(spark, sf), "recording", "t", gap, inclusive=inclusive, ties=["event_id"])
        return rows.select("recording", "event_id", "t")


_spaced_query("w4_greedy_cluster", 3600.0)
_spaced_query("w5_minimum_interval", 43200.0)


@query("w6_tempo_adaptive_interval", f"""WITH RECURSIVE {SQL_IOI},
  m AS (SELECT recording, greatest(1, CAST(trunc(60000 / (60000 / median(ioi_ms)) * 0.5) AS BIGINT)) / 1000.0::DOUBLE AS gap
    FROM i WHERE ioi_ms IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND median(ioi_ms) > 0),
  q0 AS (SELECT o.recording, o.event_id, o.t, o.strength, coalesce(m.gap, 0) AS gap FROM o LEFT JOIN m USING (recording)),
  {sql_spaced('SELECT * FROM q0', 'a.gap')}
  SELECT recording, count(*) AS n_kept FROM kept GROUP BY 1""")
def _(spark, sf):
    rows = onsets(spark, sf)
    kept = sweeps.tempo_adaptive(rows, fraction=0.5)
    return kept.groupBy("recording").agg(F.count(F.lit(1)).alias("n_kept"))


@query("w7_threshold_sweep", " UNION ALL ".join(
    f"SELECT * FROM (WITH RECURSIVE {SQL_ONSETS}, {sql_spaced(ALL, str(g))} SELECT recording, {g}::DOUBLE AS threshold_sec, "
    "count(*) AS n_kept FROM kept GROUP BY 1)" for g in (0.0, 7200.0, 14400.0, 21600.0)))
def _(spark, sf):
    return sweeps.threshold_sweep(onsets(spark, sf), 0.0, 21_600.0, 7_200.0)


@query("a16_sweep_summary", f"""WITH {SQL_IOI}, n AS ({' UNION ALL '.join(
    f"SELECT * FROM (WITH RECURSIVE {sql_spaced(ALL, str(g))} SELECT recording, {k} AS k, {g}::DOUBLE AS threshold_sec, "
    "count(*) AS n_kept FROM kept GROUP BY 1)" for k, g in enumerate((0.0, 7200.0, 14400.0, 21600.0)))}),
  st AS (SELECT *, n_kept - lag(n_kept) OVER (PARTITION BY recording ORDER BY k) AS diff FROM n),
  best AS (SELECT recording, arg_min(threshold_sec, diff * 1000 + k) AS steepest_sec, -min(diff) AS steepest_drop
    FROM st WHERE diff IS NOT NULL GROUP BY 1),
  s AS (SELECT recording, count(*) AS n_onsets, {sql_tidy('min(ioi_ms)', 2)} AS min_ioi_ms, {sql_tidy('median(ioi_ms)', 2)} AS median_ioi_ms,
    {sql_tidy('avg(ioi_ms)', 2)} AS mean_ioi_ms, {sql_tidy('100.0 * count(*) FILTER (ioi_ms < 3600000) / nullif(count(ioi_ms), 0)', 1)} AS pct_below_1,
    {sql_tidy('100.0 * count(*) FILTER (ioi_ms < 7200000) / nullif(count(ioi_ms), 0)', 1)} AS pct_below_2 FROM i GROUP BY 1)
  SELECT s.*, steepest_sec, steepest_drop FROM s JOIN best USING (recording)""")
def _(spark, sf):
    return sweeps.sweep_summary(onsets(spark, sf), 0.0, 21_600.0, 7_200.0, below_ms=(3_600_000.0, 7_200_000.0))


_combined = """SELECT recording, event_id, t, strength FROM o WHERE layer IN ('click', 'view')"""


@query("w8_combine_with_dedupe", f"""WITH RECURSIVE {SQL_ONSETS}, {sql_spaced(_combined, '600.0', '>')}
  SELECT q.recording, q.event_id, q.t FROM kept JOIN qn q ON q.recording = kept.recording AND q.rn = kept.rn""")
def _(spark, sf):
    rows = onsets(spark, sf)
    both = rows.filter("layer = 'click'").unionByName(rows.filter("layer = 'view'"))
    return spaced(both, "recording", "t", 600.0, inclusive=False, ties=["event_id"]).select("recording", "event_id", "t")


@query("w10_dedupe_keep_strongest", f"""WITH RECURSIVE {SQL_ONSETS}, {sql_strongest(ALL, '7200.0')}
  SELECT recording, event_id, t, strength FROM kept""")
def _(spark, sf):
    rows = spaced(onsets(spark, sf), "recording", "t", 7_200.0, inclusive=False, strength="strength", ties=["event_id"])
    return rows.select("recording", "event_id", "t", "strength")


SQL_ENTROPY = """-sum(CASE WHEN c > 0 THEN c / n * ln(c / n) ELSE 0 END)"""
SQL_METRICS = f"""{SQL_DYADS},
  seq AS (SELECT recording, i1 AS v FROM g WHERE i1 IS NOT NULL),
  cvs AS (SELECT recording, CASE WHEN avg(v) > 0 THEN stddev_pop(v) / avg(v) ELSE 0 END AS cv FROM seq GROUP BY 1),
  scv AS (SELECT recording, CASE WHEN avg(v) > 0 THEN stddev_pop(v) / avg(v) ELSE 0 END AS stable_cv FROM
    (SELECT recording, unnest([i1, i2]) AS v FROM d WHERE stable) GROUP BY 1),
  h AS (SELECT recording, least(floor(r_k * 10), 9) AS b, count(*)::DOUBLE AS c, count(*) FILTER (stable)::DOUBLE AS cs FROM d GROUP BY 1, 2),
  ent AS (SELECT recording, -sum(c / tot * ln(c / tot)) AS rk_entropy,
    CASE WHEN max(tots) > 0 THEN -sum(CASE WHEN cs > 0 THEN cs / tots * ln(cs / tots) ELSE 0 END) END AS stable_entropy FROM
    (SELECT *, sum(c) OVER (PARTITION BY recording) AS tot, sum(cs) OVER (PARTITION BY recording) AS tots FROM h) GROUP BY 1),
  m AS (SELECT recording, count(*) + 2 AS n_onsets, avg(cycle_ms) AS avg_cycle_ms, 400 * avg(abs(r_k - 0.5)) AS npvi,
    stddev_pop(r_k) AS rk_std, count(*) FILTER (stable) AS stable_n, 400 * avg(abs(r_k - 0.5)) FILTER (stable) AS stable_npvi,
    stddev_pop(r_k) FILTER (stable) AS stable_rk_std FROM d GROUP BY 1)"""
METRIC_COLS = ["npvi", "cv", "rk_std", "rk_entropy", "stable_npvi", "stable_cv", "stable_rk_std", "stable_entropy"]


@query("a1_a2_rhythm_summaries", f"""WITH {SQL_METRICS} SELECT recording, n_onsets, {sql_tidy('avg_cycle_ms', 3)} AS avg_cycle_ms, stable_n,
  {', '.join(f'{sql_tidy(c)} AS {c}' for c in METRIC_COLS)} FROM m LEFT JOIN cvs USING (recording)
  LEFT JOIN scv USING (recording) LEFT JOIN ent USING (recording)""")
def _(spark, sf):
    rows = metrics.rhythm_metrics(_dyads(spark, sf))
    return rows.select("recording", "n_onsets", tidy("avg_cycle_ms", 3).alias("avg_cycle_ms"), "stable_n",
                       *[tidy(c).alias(c) for c in METRIC_COLS])


@query("a3_histogram_entropy", f"""WITH {SQL_METRICS} SELECT recording, {sql_tidy('rk_entropy')} AS rk_entropy FROM ent""")
def _(spark, sf):
    rows = _dyads(spark, sf, index=False)
    r = F.col("r_k")
    counts = rows.groupBy("recording").agg(*metrics.bin_counts(r, F.lit(True)))
    return counts.select("recording", tidy(metrics.entropy([F.col(f"_b{i}") for i in range(10)])).alias("rk_entropy"))


@query("a4_explorer_metrics", f"""WITH {SQL_METRICS} SELECT recording, n_onsets, {sql_tidy('nullif(cv, 0)', 4)} AS cv, {sql_tidy('npvi', 4)} AS npvi, {sql_tidy('rk_std', 4)} AS rk_std
  FROM m JOIN cvs USING (recording)""")
def _(spark, sf):
    rows = metrics.rhythm_metrics(_dyads(spark, sf), zero=None)
    return rows.select("recording", "n_onsets", *[tidy(c, 4).alias(c) for c in ("cv", "npvi", "rk_std")])


@query("a5_speech_metrics", f"""WITH {SQL_IOI}, j AS (SELECT *, lag(ioi_ms) OVER w AS p FROM i {W}),
  s AS (SELECT recording, count(*) AS n, avg(ioi_ms) AS m, stddev_pop(ioi_ms) AS sd, avg(abs(ioi_ms - p)) AS pvi,
    100 * avg(CASE WHEN p IS NOT NULL THEN CASE WHEN ioi_ms + p > 0 THEN abs(ioi_ms - p) / ((ioi_ms + p) / 2) ELSE 0 END END) AS np,
    count(*) FILTER (ioi_ms > 36000000) AS pause_count, coalesce(avg(ioi_ms) FILTER (ioi_ms > 36000000), 0) AS mp,
    avg(ioi_ms) FILTER (ioi_ms <= 36000000) AS sp, coalesce(sum(ioi_ms) FILTER (ioi_ms <= 36000000), 0) AS sps, sum(ioi_ms) AS al
    FROM j WHERE ioi_ms IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)
  SELECT recording, round(1000 / m, 3) AS speech_rate, round(m, 2) AS mean_ioi_ms, round(sd, 2) AS std_ioi_ms, round(pvi, 2) AS pvi_raw_ms,
    round(np, 2) AS npvi_pct, round(100 * sd / m, 2) AS varco_pct, round(coalesce(1000 / sp, 1000 / m), 3) AS articulation_rate, pause_count,
    round(mp, 2) AS mean_pause_ms, round(sps / al, 4) AS phonation_ratio FROM s""")
def _(spark, sf):
    return metrics.speech_metrics(onsets(spark, sf), pause_ms=36_000_000.0)


@query("a6_label_interval_metrics", """WITH tn AS (SELECT CAST(conv_id AS VARCHAR) AS recording, turn AS seq, role = 'user' AS v, length(text)::DOUBLE AS d FROM conversations),
  p AS (SELECT *, lag(d) OVER (PARTITION BY recording, v ORDER BY seq) AS pd FROM tn)
  SELECT recording, round(100.0 * sum(d) FILTER (v) / nullif(sum(d), 0), 6) AS percent_v, round(1000 * stddev_pop(d) FILTER (v), 6) AS delta_v_ms,
   round(1000 * stddev_pop(d) FILTER (NOT v), 6) AS delta_c_ms, round(1000 * avg(abs(d - pd)) FILTER (NOT v), 6) AS rpvi_c_ms,
   round(100 * avg(CASE WHEN d + pd > 0 THEN abs(d - pd) / ((d + pd) / 2) ELSE 0 END) FILTER (v AND pd IS NOT NULL), 6) AS npvi_v FROM p GROUP BY 1""")
def _(spark, sf):
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("recording"), F.col("turn").alias("seq"),
        (F.col("role") == "user").alias("is_vowel"), F.lit(0.0).alias("start"), F.length("text").cast("double").alias("end"))
    rows = metrics.label_interval_metrics(turns)
    return rows.select("recording", *[F.round(c, 6).alias(c) for c in rows.columns[1:]])


@query("a7_median_interval_tempo", f"WITH {SQL_IOI} SELECT recording, {sql_tidy('60000 / median(ioi_ms)', 9)} AS bpm FROM i WHERE ioi_ms > 0 GROUP BY 1")
def _(spark, sf):
    return metrics.median_tempo(onsets(spark, sf)).select("recording", tidy("bpm", 9).alias("bpm"))


@query("a14_onset_quality", f"""WITH {SQL_IOI}, q AS (SELECT *, median(ioi_ms) OVER (PARTITION BY recording) AS md FROM i),
  s AS (SELECT recording, count(*) AS n_onsets, avg(ioi_ms) AS m, stddev_pop(ioi_ms) / greatest(avg(ioi_ms), 1e-10) AS cv, min(ioi_ms) AS mn,
    count(*) FILTER (ioi_ms < 60000) AS close_pairs, count(*) FILTER (ioi_ms > md * 0.25 AND ioi_ms < md * 4) / (count(*) - 1) AS reg FROM q GROUP BY 1),
  c AS (SELECT *, greatest(0, 100 - greatest(0, 10 - n_onsets) * 3 - close_pairs * 5 - greatest(0, cv - 1.5) * 10) AS sc FROM s)
  SELECT recording, n_onsets, round(m, 2) AS mean_ioi_ms, round(cv, 3) AS ioi_cv, round(mn, 2) AS min_ioi_ms, close_pairs, round(reg, 3) AS regularity,
    round(least(100, CASE WHEN n_onsets BETWEEN 5 AND 500 THEN sc + 10 ELSE sc END), 1) AS score FROM c""")
def _(spark, sf):
    return metrics.onset_quality(onsets(spark, sf), close_ms=60_000.0)


@query("a15_settings_sweep_best", " ".join(f"""WITH RECURSIVE {SQL_ONSETS},
  c AS ({' UNION ALL '.join(f"SELECT * FROM (WITH RECURSIVE {sql_spaced(ALL, str(g))} SELECT kept.recording, {k} AS cand, qn.t, qn.event_id FROM kept JOIN qn ON kept.recording = qn.recording AND kept.rn = qn.rn)" for k, g in enumerate((0.0, 20000.0, 80000.0)))}),
  i AS (SELECT *, (t - lag(t) OVER (PARTITION BY recording, cand ORDER BY t, event_id)) * 1000 AS ioi_ms FROM c),
  s AS (SELECT recording, cand, count(*) AS n, stddev_pop(ioi_ms) / greatest(avg(ioi_ms), 1e-10) AS cv, count(*) FILTER (ioi_ms < 600000) AS cl FROM i GROUP BY 1, 2),
  z AS (SELECT *, round(least(100, greatest(0, 100 - greatest(0, 10 - n) * 3 - cl * 5 - greatest(0, cv - 1.5) * 10) + CASE WHEN n BETWEEN 5 AND 500 THEN 10 ELSE 0 END), 1) AS score FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY score DESC, cand) AS k FROM z)
  SELECT recording, cand AS best_candidate, score FROM r WHERE k = 1""".split("\n")))
def _(spark, sf):
    rows = onsets(spark, sf)
    return sweeps.best_candidate(rows, (0.0, 20_000.0, 80_000.0), close_ms=600_000.0)


@query("s5_distinct_recordings", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS recording FROM events WHERE user_id IS NOT NULL")
def _(spark, sf):
    return onsets(spark, sf, split=False).select("recording").dropna().distinct()
