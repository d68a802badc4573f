"""Queries on frame tables: selections, windows, detectors, gates, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactus.functions.numeric import tidy
from tactus.layout import plain, plan_layout
from tactus.operators import detectors as dt
from tactus.operators import frames as fr
from tactus.operators import gates, profiles
from tactus.operators import matching as mt
from tactus.operators import selection as sl
from tactus.plans.q_matching import SQL_POINTS, points
from tactus.plans.q_sequences import sql_strongest
from tactus.plans.registry import query
from tactus.sources.tables import HOP_SEC, SQL_FRAMES, SQL_SPECTRUM, frames, spectrum, sql_tidy

WF = "WINDOW w AS (PARTITION BY recording ORDER BY frame)"
# A selection with gaps: frames whose second component is positive.
SQL_WINDOWS = f"""{SQL_FRAMES}, sel AS (SELECT *, greatest(t - 0.025, 0) AS t_start, t + 0.025 AS t_end FROM f WHERE y > 0),
  s1 AS (SELECT *, lag(frame) OVER w AS pf, max(t_end) OVER (PARTITION BY recording ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM sel {WF}),
  wn AS (SELECT *, sum(CASE WHEN pf IS NULL OR (frame > pf + 1 AND t_start > pe + 0.0625) THEN 1 ELSE 0 END) OVER w - 1 AS window_index FROM s1 {WF})"""


def _selected(spark, sf):
    return frames(spark, sf).filter("y > 0")


def _windows(spark, sf):
    return fr.selection_windows(fr.with_bounds(_selected(spark, sf), HOP_SEC), HOP_SEC)


def _r(df, *plain_cols, digits=6, **special):
    return df.select(*plain_cols, *[tidy(c, special.get(c, digits)).alias(c) for c in df.columns if c not in plain_cols])


@query("w12_w13_selection_windows", f"""WITH {SQL_WINDOWS} SELECT recording, frame, window_index::BIGINT AS window_index, {sql_tidy('t_start')} AS t_start, {sql_tidy('t_end')} AS t_end FROM wn""")
def _(spark, sf):
    return _windows(spark, sf).select("recording", "frame", "window_index", tidy("t_start").alias("t_start"), tidy("t_end").alias("t_end"))


@query("a27_selection_bounds", f"""WITH {SQL_WINDOWS} SELECT recording, count(*) AS n_frames, min(frame) AS frame_min, max(frame) AS frame_max,
  {', '.join(f'{sql_tidy(f"{fn}({c})")} AS {n}' for fn, c, n in [('min', 't_start', 'time_min'), ('max', 't_end', 'time_max')] + [(g, c, f'{c}_{g}') for c in 'xyz' for g in ('min', 'max')])},
  {sql_tidy('max(t_end) - min(t_start)')} AS duration FROM wn GROUP BY 1""")
def _(spark, sf):
    rows = profiles.selection_bounds(fr.with_bounds(_selected(spark, sf), HOP_SEC))
    return _r(rows, "recording", "n_frames", "frame_min", "frame_max")


SQL_RISES = f"""{SQL_WINDOWS}, st AS (SELECT *, lag(window_index) OVER w AS pw, lag(volume) OVER w AS pv, lag(bins) OVER w AS pb,
    row_number() OVER (PARTITION BY recording, window_index ORDER BY frame) AS li FROM wn {WF}),
  vd AS (SELECT *, CASE WHEN li > 1 THEN greatest(volume - pv, 0) ELSE 0 END AS strength FROM st),
  sx AS (SELECT *, CASE WHEN li > 1 THEN list_sum(list_transform(range(2, len(bins) + 1), lambda k: greatest(bins[k] - pb[k], 0))) / (len(bins) - 1) ELSE 0 END AS strength FROM st)"""


@query("w14_volume_rise", f"WITH {SQL_RISES} SELECT recording, frame, {sql_tidy('strength')} AS strength FROM vd")
def _(spark, sf):
    return fr.with_strength(_windows(spark, sf), "volume_delta").select("recording", "frame", tidy("strength").alias("strength"))


@query("w15_spectral_flux", f"WITH {SQL_RISES} SELECT recording, frame, {sql_tidy('strength')} AS strength FROM sx")
def _(spark, sf):
    return fr.with_strength(_windows(spark, sf), "spectral_flux").select("recording", "frame", tidy("strength").alias("strength"))


def sql_events(source: str) -> str:
    """Threshold, local maxima, fallback and removal of close events."""
    return f"""ps AS (SELECT recording, window_index, avg(strength) AS m, stddev_pop(strength) AS sd, list_sort(list(strength)) AS l FROM {source} WHERE li > 1 AND strength > 0 GROUP BY 1, 2),
  th AS (SELECT recording, window_index, greatest(1e-6, l[len(l) // 2 + 1] * 1.15, m + sd * 0.18) AS threshold FROM ps),
  nb AS (SELECT *, coalesce(lag(strength) OVER v, 0) AS a, coalesce(lead(strength) OVER v, 0) AS b FROM {source} JOIN th USING (recording, window_index) WINDOW v AS (PARTITION BY recording, window_index ORDER BY frame)),
  pk AS (SELECT *, li > 1 AND strength >= threshold AND strength >= a AND strength >= b AS peak FROM nb),
  fb AS (SELECT *, bool_or(peak) OVER (PARTITION BY recording, window_index) AS anyp, CASE WHEN li > 1 THEN row_number() OVER (PARTITION BY recording, window_index, li > 1 ORDER BY strength DESC, frame) END AS k FROM pk),
  ev AS (SELECT recording, frame AS event_id, t, strength FROM fb WHERE peak OR (NOT anyp AND k = 1 AND strength >= threshold * 0.9)),
  {sql_strongest('SELECT * FROM ev', '0.075')}"""


@query("w17_threshold_peaks_volume", f"WITH RECURSIVE {SQL_RISES}, {sql_events('vd')} SELECT recording, event_id AS frame, {sql_tidy('strength')} AS strength FROM kept")
def _(spark, sf):
    rows = dt.detect_onsets("volume_delta", _selected(spark, sf))
    return rows.select("recording", "frame", tidy("strength").alias("strength"))


@query("w18_flux_events_with_intervals", f"WITH RECURSIVE {SQL_RISES}, {sql_events('sx')} SELECT recording, event_id AS frame, 'spectral_flux' AS method, {sql_tidy('t - lag(t) OVER (PARTITION BY recording ORDER BY t, event_id)')} AS ioi_sec FROM kept")
def _(spark, sf):
    rows = fr.event_intervals(dt.detect_onsets("spectral_flux", _selected(spark, sf)))
    return rows.select("recording", "frame", "method", tidy("ioi_sec").alias("ioi_sec"))


SQL_INTO = f"""{SQL_WINDOWS}, {SQL_POINTS}, wb AS (SELECT recording, window_index, min(t_start) AS ws, max(t_end) AS we FROM wn GROUP BY 1, 2),
  cd AS (SELECT pt.recording, pt.event_id, pt.t, pt.strength, wn.frame, wn.window_index, row_number() OVER (PARTITION BY pt.recording, pt.event_id ORDER BY abs(wn.t - pt.t), wn.frame) AS k
    FROM pt JOIN wb USING (recording) JOIN wn ON wn.recording = pt.recording AND wn.window_index = wb.window_index WHERE pt.t BETWEEN ws - 0.025 AND we + 0.025)"""


@query("m11_edited_onsets_into_windows", f"WITH {SQL_INTO} SELECT recording, event_id, frame, window_index::BIGINT AS window_index FROM cd WHERE k = 1")
def _(spark, sf):
    rows = mt.into_windows(points(spark, sf), _windows(spark, sf), HOP_SEC, layout=plan_layout(frames(spark, sf), "recording", "t"))
    return rows.select("recording", "event_id", "frame", "window_index")


@query("m11_imported_onsets_into_windows", f"""WITH RECURSIVE {SQL_INTO}, {sql_strongest('SELECT recording, event_id, t, 1 AS strength FROM cd WHERE k = 1', '0.075')} SELECT recording, event_id FROM kept""")
def _(spark, sf):
    rows = mt.into_windows(points(spark, sf), _windows(spark, sf), HOP_SEC, layout=plan_layout(frames(spark, sf), "recording", "t"))
    rows = rows.withColumn("strength", F.lit(1.0))
    return fr.spaced(rows, "recording", "t", max(0.01, HOP_SEC * 1.5), inclusive=False, strength="strength", ties=["event_id"]).select("recording", "event_id")


@query("w11_spaced_pulse_maxima", f"""WITH RECURSIVE {SQL_FRAMES}, nb AS (SELECT *, lag(rms) OVER w AS a, lead(rms) OVER w AS b FROM f {WF}),
  {sql_strongest('SELECT recording, frame AS event_id, frame::DOUBLE AS t, rms AS strength FROM nb WHERE rms > a AND rms > b', '3', '>=')} SELECT recording, event_id AS frame FROM kept""")
def _(spark, sf):
    return fr.spaced_maxima(frames(spark, sf), "rms", "t", 150.0, HOP_SEC).select("recording", "frame")


# Detectors

def _edges(source: str) -> str:
    return f"SELECT recording, frame FROM (SELECT *, lag(above) OVER w AS pa FROM {source} {WF}) WHERE above AND NOT pa"


@query("w19_moving_median_detector", f"""WITH {SQL_FRAMES}, z AS (SELECT *, list(rms) OVER (PARTITION BY recording ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM f),
  b AS (SELECT *, rms > 1.05 * list_sort(list_concat(l, list_transform(range(5 - len(l)), lambda q: 0.0::DOUBLE)))[3] AS above FROM z) {_edges('b')}""")
def _(spark, sf):
    return dt.detect_onsets("moving_median", frames(spark, sf), kernel=5, scale=1.05).select("recording", "frame")


@query("w20_cfar_detector", f"""WITH {SQL_FRAMES}, z AS (SELECT *, list_concat(list(rms) OVER (PARTITION BY recording ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING), list(rms) OVER (PARTITION BY recording ORDER BY frame ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING)) AS l FROM f),
  b AS (SELECT *, len(l) = 6 AND rms > list_avg(l) + 1.0 * list_stddev_pop(l) AS above FROM z) {_edges('b')}""")
def _(spark, sf):
    return dt.detect_onsets("cfar", frames(spark, sf), guard=1, training=3, factor=1.0).select("recording", "frame")


_BANDS = [(lo, hi) for lo, hi in zip(dt.mel_edges(0.0, 6400.0, 6), dt.mel_edges(0.0, 6400.0, 6)[1:])]


@query("w21_per_band_voting_detector", f"""WITH {SQL_SPECTRUM}, ed AS (SELECT * FROM (VALUES {', '.join(f'({i}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)' for i, (lo, hi) in enumerate(_BANDS))}) AS v(band, lo, hi)),
  e AS (SELECT recording, frame, band, sum(mag) AS e FROM sp JOIN ed ON freq_hz >= lo AND freq_hz < hi GROUP BY 1, 2, 3),
  x AS (SELECT *, greatest(e - coalesce(lag(e) OVER (PARTITION BY recording, band ORDER BY frame), e), 0) AS fx FROM e),
  z AS (SELECT *, list(fx) OVER (PARTITION BY recording, band ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM x),
  v AS (SELECT recording, frame, count(*) FILTER (fx > 1.2 * list_sort(list_concat(l, list_transform(range(5 - len(l)), lambda q: 0.0::DOUBLE)))[3]) AS votes FROM z GROUP BY 1, 2),
  b AS (SELECT *, votes >= 3 AS above FROM v) SELECT b.recording, b.frame, votes FROM b JOIN ({_edges('b')}) q USING (recording, frame)""")
def _(spark, sf):
    rows = dt.detect_onsets("per_band", frames(spark, sf), kernel=5, scale=1.2, min_bands=3)
    return rows.select("recording", "frame", F.col("votes").cast("long").alias("votes"))


@query("w22_baseline_crossing_detector", f"""WITH {SQL_FRAMES}, z AS (SELECT *, avg(rms) OVER (PARTITION BY recording ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) - avg(rms) OVER (PARTITION BY recording ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS r FROM f),
  b AS (SELECT *, lag(r) OVER w AS pr FROM z {WF}) SELECT recording, frame FROM b WHERE r > 0 AND pr <= 0""")
def _(spark, sf):
    return dt.detect_onsets("baseline_crossing", frames(spark, sf)).select("recording", "frame")


SQL_LEVELS = f"{SQL_FRAMES}, lv AS (SELECT *, 20 * log10(greatest(rms, 1e-10)) AS db, z > -0.1 AS voiced FROM f)"


def _levels(spark, sf):
    return frames(spark, sf).withColumns({"level_db": 20 * F.log10(F.greatest("rms", F.lit(1e-10))), "voiced": F.col("z") > -0.1})


@query("w23_intensity_nuclei", f"""WITH RECURSIVE {SQL_LEVELS}, nb AS (SELECT *, lag(db) OVER w AS a, lead(db) OVER w AS b, max(db) OVER (PARTITION BY recording) - 9 AS fl FROM lv {WF}),
  pk AS (SELECT *, row_number() OVER w AS rn FROM nb WHERE db > a AND db >= b AND db >= fl {WF}),
  wk AS (SELECT recording, rn, frame AS kf, db AS kd, 1 AS grp FROM pk WHERE rn = 1 UNION ALL
    SELECT w.recording, p.rn, CASE WHEN ap OR p.db > w.kd THEN p.frame ELSE w.kf END, CASE WHEN ap OR p.db > w.kd THEN p.db ELSE w.kd END, w.grp + CASE WHEN ap THEN 1 ELSE 0 END
    FROM wk w JOIN pk p ON p.recording = w.recording AND p.rn = w.rn + 1,
      LATERAL (SELECT w.kd - min(lv.db) >= 1.0 AND p.db - min(lv.db) >= 1.0 AS ap FROM lv WHERE lv.recording = w.recording AND lv.frame BETWEEN w.kf AND p.frame) x),
  mg AS (SELECT recording, grp, max_by(kf, rn) AS frame FROM wk GROUP BY 1, 2),
  {sql_strongest('SELECT lv.recording, lv.frame AS event_id, lv.t, lv.db AS strength FROM mg JOIN lv USING (recording, frame) WHERE voiced', '0.2', '>=')}
  SELECT recording, event_id AS frame FROM kept""")
def _(spark, sf):
    return dt.detect_onsets("intensity_nuclei", _levels(spark, sf), threshold_db=-9.0, min_dip_db=1.0, min_pause=0.2).select("recording", "frame")


# Gates

def _layout(spark, sf):
    return plan_layout(frames(spark, sf), "recording", "t")


@query("w24_amplitude_gate", f"""WITH {SQL_FRAMES}, {SQL_POINTS}, n AS (SELECT pt.recording, pt.event_id, f.rms, row_number() OVER (PARTITION BY pt.recording, pt.event_id ORDER BY abs(pt.t - f.t), f.t) AS k FROM pt JOIN f USING (recording)),
  m AS (SELECT recording, max(rms) AS mx FROM f GROUP BY 1) SELECT recording, event_id FROM n JOIN m USING (recording) WHERE k = 1 AND rms >= 0.85 * mx""")
def _(spark, sf):
    return gates.amplitude_gate(points(spark, sf), frames(spark, sf), 0.85, layout=_layout(spark, sf)).select("recording", "event_id")


SQL_SLOPES = f"""{SQL_FRAMES}, {SQL_POINTS}, ds AS (SELECT recording, t, rms - lag(rms) OVER w AS d FROM f {WF}),
  sl AS (SELECT pt.recording, pt.event_id, coalesce(max(d), 0) AS slope FROM pt LEFT JOIN ds ON ds.recording = pt.recording AND ds.t >= pt.t - 0.1 AND ds.t <= pt.t + 0.1 GROUP BY 1, 2)"""


@query("w25_sharpness_gate", f"WITH {SQL_SLOPES}, m AS (SELECT recording, max(slope) AS mx FROM sl GROUP BY 1) SELECT recording, event_id, {sql_tidy('slope')} AS slope FROM sl JOIN m USING (recording) WHERE mx <= 0 OR slope >= 0.4 * mx")
def _(spark, sf):
    return gates.sharpness_gate(points(spark, sf), frames(spark, sf), 0.4, 0.1).select("recording", "event_id", tidy("slope").alias("slope"))


@query("a30_transient_profile", f"""WITH {SQL_SLOPES}, q AS (SELECT recording, greatest(slope, 0) AS s, strength AS e FROM sl JOIN pt USING (recording, event_id))
  SELECT recording, round(avg(s), 6) AS mean_attack_slope, round(avg(e), 6) AS mean_local_energy, round(stddev_pop(s) / greatest(avg(s), 1e-10), 3) AS attack_slope_cv, round(stddev_pop(e) / greatest(avg(e), 1e-10), 3) AS energy_cv, round(median(s), 6) AS median_attack_slope FROM q GROUP BY 1""")
def _(spark, sf):
    rows = gates.local_slope(points(spark, sf), frames(spark, sf), 0.1).withColumnRenamed("strength", "energy")
    return profiles.transient_profile(rows)


@query("w26_broadband_gate", f"""WITH {SQL_SPECTRUM}, {SQL_POINTS}, e AS (SELECT recording, frame, CAST(floor(bin / (64 / 4)) AS INT) AS band, sum(mag * mag) AS e FROM sp GROUP BY 1, 2, 3),
  p AS (SELECT *, max(e) OVER (PARTITION BY recording, band) AS pe FROM e), a AS (SELECT recording, frame, count(*) FILTER (e >= 0.5 * pe) AS n FROM p GROUP BY 1, 2),
  n AS (SELECT pt.recording, pt.event_id, f.frame, row_number() OVER (PARTITION BY pt.recording, pt.event_id ORDER BY abs(pt.t - f.t), f.t DESC) AS k FROM pt JOIN f USING (recording))
  SELECT recording, event_id, a.n AS active_bands FROM n JOIN a USING (recording, frame) WHERE k = 1 AND a.n >= 2""")
def _(spark, sf):
    rows = gates.broadband_gate(points(spark, sf), frames(spark, sf), 64, min_bands=2, bands=4, threshold=0.5, layout=_layout(spark, sf))
    return rows.select("recording", "event_id", F.col("active_bands").cast("long").alias("active_bands"))


# Regions around strong frames, with a band that follows the third component.
SQL_FREG = """rg AS (SELECT recording, vec_id AS region_id, t - 0.2 AS t_start, t + 0.3 AS t_end, CASE WHEN z > 0 THEN 300.0 ELSE 1500.0 END::DOUBLE AS f_low, CASE WHEN z > 0 THEN 3000.0 ELSE 5000.0 END::DOUBLE AS f_high,
    CASE WHEN y > 0 THEN 'positive' ELSE 'negative' END AS polarity, (x + 1) / 2 AS harmonicity FROM f WHERE rms > 0.11)"""


def _regions(spark, sf):
    f = frames(spark, sf).filter("rms > 0.11")
    return plain(f).select("recording", F.col("vec_id").alias("region_id"), (F.col("t") - 0.2).alias("t_start"), (F.col("t") + 0.3).alias("t_end"),
                           F.when(F.col("z") > 0, 300.0).otherwise(1500.0).alias("f_low"), F.when(F.col("z") > 0, 3000.0).otherwise(5000.0).alias("f_high"),
                           F.when(F.col("y") > 0, "positive").otherwise("negative").alias("polarity"), ((F.col("x") + 1) / 2).alias("harmonicity"))


@query("w27_frequency_bounded_gate", f"""WITH {SQL_SPECTRUM}, {SQL_POINTS}, {SQL_FREG},
  lo AS (SELECT pt.recording, pt.event_id, bin, avg(mag * mag) AS p FROM pt JOIN sp ON sp.recording = pt.recording AND sp.t >= pt.t - 0.1 AND sp.t <= pt.t + 0.1 GROUP BY 1, 2, 3),
  tt AS (SELECT recording, event_id, sum(p) AS tot FROM lo GROUP BY 1, 2),
  mt AS (SELECT pt.recording, pt.event_id, rg.region_id, rg.polarity, sum(p) FILTER (bin * 100.0 BETWEEN f_low AND f_high) / any_value(tot) >= 0.5 AS hit FROM pt JOIN rg ON rg.recording = pt.recording AND pt.t BETWEEN t_start AND t_end JOIN lo ON lo.event_id = pt.event_id AND lo.recording = pt.recording JOIN tt ON tt.event_id = pt.event_id AND tt.recording = pt.recording GROUP BY 1, 2, 3, 4)
  SELECT pt.recording, pt.event_id FROM pt LEFT JOIN tt USING (recording, event_id) WHERE tot IS NULL OR pt.recording NOT IN (SELECT recording FROM rg) OR
   (NOT EXISTS (SELECT 1 FROM mt WHERE mt.event_id = pt.event_id AND polarity = 'negative' AND hit) AND (pt.recording NOT IN (SELECT recording FROM rg WHERE polarity = 'positive') OR EXISTS (SELECT 1 FROM mt WHERE mt.event_id = pt.event_id AND polarity = 'positive' AND hit)))""")
def _(spark, sf):
    return gates.frequency_gate(points(spark, sf), _regions(spark, sf), frames(spark, sf), threshold=0.5, half=0.1).select("recording", "event_id")


SQL_TEMPLATE = """pr AS (SELECT rg.recording, region_id, f_low, f_high, frame FROM rg JOIN f ON f.recording = rg.recording AND f.t BETWEEN t_start AND t_end WHERE polarity = 'positive'),
  nn AS (SELECT recording, count(*) AS n FROM pr GROUP BY 1),
  tm AS (SELECT pr.recording, bin, sum(CASE WHEN bin * 100.0 BETWEEN f_low AND f_high THEN mag ELSE 0 END) / any_value(n) AS m FROM pr JOIN sp ON sp.recording = pr.recording AND sp.frame = pr.frame JOIN nn ON nn.recording = pr.recording GROUP BY 1, 2),
  tp AS (SELECT recording, bin, m / sqrt(sum(m * m) OVER (PARTITION BY recording)) AS ref FROM tm)"""


@query("a24_spectral_template", f"WITH {SQL_SPECTRUM}, {SQL_FREG}, {SQL_TEMPLATE} SELECT recording, bin, {sql_tidy('ref')} AS ref FROM tp")
def _(spark, sf):
    return profiles.spectral_template(_regions(spark, sf), frames(spark, sf)).select("recording", F.col("bin").cast("long").alias("bin"), tidy("ref").alias("ref"))


SQL_SIMILAR = f"""{SQL_SPECTRUM}, {SQL_POINTS}, {SQL_FREG}, {SQL_TEMPLATE},
  lm AS (SELECT pt.recording, pt.event_id, bin, avg(mag) AS m FROM pt JOIN sp ON sp.recording = pt.recording AND sp.t >= pt.t - 0.1 AND sp.t <= pt.t + 0.1 GROUP BY 1, 2, 3),
  si AS (SELECT recording, event_id, sum(lm.m * ref) / sqrt(sum(lm.m * lm.m)) AS similarity FROM lm JOIN tp USING (recording, bin) GROUP BY 1, 2)"""


@query("w28_spectral_match_gate", f"WITH {SQL_SIMILAR} SELECT pt.recording, pt.event_id, {sql_tidy('similarity')} AS similarity FROM pt LEFT JOIN si USING (recording, event_id) WHERE similarity IS NULL OR similarity >= 0.6")
def _(spark, sf):
    f = frames(spark, sf)
    rows = gates.spectral_gate(points(spark, sf), profiles.spectral_template(_regions(spark, sf), f), f, 0.1, 0.6)
    return rows.select("recording", "event_id", tidy("similarity").alias("similarity"))


def sql_features(spans: str) -> str:
    """Features of regions given as (recording, region_id, t_start, t_end, f_low, f_high)."""
    return f"""fx AS (SELECT s.recording, s.region_id, f_low, f_high, sp.frame, bin, mag, freq_hz BETWEEN f_low AND f_high AS ib, freq_hz FROM {spans} s JOIN sp ON sp.recording = s.recording AND sp.t BETWEEN s.t_start AND s.t_end),
  fe AS (SELECT recording, region_id, frame, sum(mag * mag) AS al, coalesce(sum(mag * mag) FILTER (ib), 0) AS en FROM fx GROUP BY 1, 2, 3),
  fd AS (SELECT *, en - lag(en) OVER (PARTITION BY recording, region_id ORDER BY frame) AS d FROM fe),
  fg AS (SELECT recording, region_id, sum(al) AS al, sum(en) AS rg, max(en) AS pk, max(d) AS rise FROM fd GROUP BY 1, 2),
  fm AS (SELECT recording, region_id, bin, freq_hz, avg(mag) AS m FROM fx WHERE ib GROUP BY 1, 2, 3, 4),
  fc AS (SELECT recording, region_id, sum(m * freq_hz) / sum(m) AS c FROM fm GROUP BY 1, 2),
  fs AS (SELECT recording, region_id, arg_max(freq_hz, m) AS pf, any_value(c) AS c, sqrt(sum(m * (freq_hz - c) ** 2) / sum(m)) AS bw FROM fm JOIN fc USING (recording, region_id) GROUP BY 1, 2),
  ft AS (SELECT recording, region_id, round(pf, 1) AS peak_frequency_hz, round(c, 1) AS spectral_centroid_hz, round(bw, 1) AS spectral_bandwidth_hz, round(rg / al, 4) AS energy_ratio, round(coalesce(rise / (pk + 1e-10), 0), 4) + 0.0 AS attack_sharpness FROM fg JOIN fs USING (recording, region_id))"""


@query("a23_region_features", f"WITH {SQL_SPECTRUM}, {SQL_FREG}, {sql_features('rg')} SELECT * FROM ft")
def _(spark, sf):
    rows = profiles.region_features(_regions(spark, sf), frames(spark, sf))
    return rows.withColumn("attack_sharpness", F.col("attack_sharpness") + 0.0)


@query("a17_signal_region_summary", f"""WITH {SQL_SPECTRUM}, {SQL_FREG}, {sql_features('rg')} SELECT recording, round(min(f_low), 1) AS f_low, round(max(f_high), 1) AS f_high, round(avg(spectral_centroid_hz), 1) AS spectral_centroid_hz,
  round(avg(spectral_bandwidth_hz), 1) AS spectral_bandwidth_hz, round(avg(harmonicity), 4) AS harmonicity, round(avg(attack_sharpness), 4) AS attack_sharpness, round(avg(energy_ratio), 4) AS energy_ratio, round(avg(t_end - t_start), 4) AS avg_duration_s,
  CASE WHEN avg(harmonicity) > 0.65 THEN 'harmonic' WHEN avg(harmonicity) < 0.35 THEN 'percussive' ELSE 'mixed' END AS signal_character, count(*) AS n_regions FROM ft JOIN rg USING (recording, region_id) GROUP BY 1""")
def _(spark, sf):
    r = _regions(spark, sf)
    return profiles.signal_summary(profiles.region_features(r, frames(spark, sf)).join(r, ["recording", "region_id"]))


@query("a33_marked_example_profile", f"""WITH {SQL_SPECTRUM}, {SQL_FREG}, {sql_features('rg')}, j AS (SELECT ft.*, polarity, harmonicity, t_start AS t FROM ft JOIN rg USING (recording, region_id)),
  i AS (SELECT *, (t - lag(t) OVER (PARTITION BY recording, polarity ORDER BY t, region_id)) * 1000 AS i FROM j)
  SELECT recording, polarity, count(*) AS n_onsets, round(min(peak_frequency_hz), 1) AS f_low, round(max(peak_frequency_hz), 1) AS f_high, round(avg(spectral_centroid_hz), 1) AS mean_centroid_hz, round(avg(spectral_bandwidth_hz), 1) AS mean_bandwidth_hz,
   round(avg(attack_sharpness), 4) AS mean_sharpness, round(avg(harmonicity), 4) AS mean_harmonicity, CASE WHEN avg(harmonicity) > 0.65 THEN 'harmonic' WHEN avg(harmonicity) < 0.35 THEN 'percussive' ELSE 'mixed' END AS signal_character,
   {', '.join(f"CASE WHEN polarity = 'positive' THEN round({e}, 2) END AS {n}_ioi_ms" for n, e in [('min', 'min(i)'), ('max', 'max(i)'), ('mean', 'avg(i)'), ('std', 'stddev_pop(i)'), ('median', 'median(i)')])} FROM i GROUP BY 1, 2""")
def _(spark, sf):
    r = _regions(spark, sf)
    marks = profiles.region_features(r, frames(spark, sf)).join(r, ["recording", "region_id"])
    return profiles.marked_profile(marks.withColumn("t", F.col("t_start")).withColumn("event_id", F.col("region_id")))


REFERENCE = {"spectral_centroid_hz": 3000.0, "spectral_bandwidth_hz": 1500.0, "energy_ratio": 0.8}
CONFIG = {"spectral_centroid_hz": {"enabled": True, "deviation_pct": 6}, "spectral_bandwidth_hz": {"enabled": True, "lower_pct": 5, "upper_pct": 8},
          "energy_ratio": {"enabled": True, "lower_bound": 0.7, "upper_bound": 0.85}, "attack_sharpness": {"enabled": False}, "duration_s": {"enabled": True}}
CHECKS = gates.checks_from(REFERENCE, CONFIG)
SQL_LOCAL = f"""{SQL_SPECTRUM}, {SQL_POINTS}, ls AS (SELECT recording, event_id AS region_id, greatest(t - 0.1, 0) AS t_start, t + 0.1 AS t_end, 300.0::DOUBLE AS f_low, 5500.0::DOUBLE AS f_high FROM pt), {sql_features('ls')}"""
_LIMITS = " AND ".join(f"coalesce({n} BETWEEN {lo!r} AND {hi!r}, false)" for n, (_, lo, hi) in CHECKS.items())


@query("w29_variable_bounds_gate", f"WITH {SQL_LOCAL} SELECT pt.recording, event_id FROM pt LEFT JOIN ft ON ft.recording = pt.recording AND ft.region_id = pt.event_id WHERE {_LIMITS}")
def _(spark, sf):
    return gates.bounds_gate(gates.local_features(points(spark, sf), frames(spark, sf), 0.1, 300.0, 5500.0), CHECKS).select("recording", "event_id")


def _sql_score():
    parts = [f"coalesce(greatest(0, 1 - 0.4 * abs({n} - {ref!r}) / {max(abs(ref - lo), abs(hi - ref), abs(ref) * 0.05, 1e-6)!r}), 0)" for n, (ref, lo, hi) in CHECKS.items()]
    failed = ", ".join(f"CASE WHEN NOT coalesce({n} BETWEEN {lo!r} AND {hi!r}, false) THEN '{n}' END" for n, (_, lo, hi) in CHECKS.items())
    return f"({' + '.join(parts)}) / {len(parts)}", f"coalesce(array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ','), '')"


_SCORE, _FAILED = _sql_score()


@query("w30_weighted_match_score", f"WITH {SQL_LOCAL} SELECT pt.recording, event_id, {sql_tidy(_SCORE)} AS score, {_FAILED} AS failed FROM pt LEFT JOIN ft ON ft.recording = pt.recording AND ft.region_id = pt.event_id")
def _(spark, sf):
    rows = gates.match_score(gates.local_features(points(spark, sf), frames(spark, sf), 0.1, 300.0, 5500.0), CHECKS)
    return rows.select("recording", "event_id", tidy("score").alias("score"), F.array_join("failed", ",").alias("failed"))


@query("w31_region_onset_recovery", f"""WITH {SQL_SPECTRUM}, {SQL_FREG}, {SQL_TEMPLATE}, pb AS (SELECT recording, region_id, probe, t_start + (t_end - t_start) * fr AS t FROM rg, (VALUES (0, 0.05::DOUBLE), (1, 0.25), (2, 0.5), (3, 0.75)) AS v(probe, fr) WHERE polarity = 'positive'),
  ls AS (SELECT recording, region_id * 10 + probe AS region_id, greatest(t - 0.1, 0) AS t_start, t + 0.1 AS t_end, 300.0::DOUBLE AS f_low, 5500.0::DOUBLE AS f_high FROM pb), {sql_features('ls')},
  lm AS (SELECT pb.recording, region_id, probe, bin, avg(mag) AS m FROM pb JOIN sp ON sp.recording = pb.recording AND sp.t >= pb.t - 0.1 AND sp.t <= pb.t + 0.1 GROUP BY 1, 2, 3, 4),
  si AS (SELECT recording, region_id, probe, sum(lm.m * ref) / sqrt(sum(lm.m * lm.m)) AS sim FROM lm JOIN tp USING (recording, bin) GROUP BY 1, 2, 3),
  dg AS (SELECT pb.*, coalesce(sim >= 0.55, true) AND {_SCORE} >= 0.6 AS passed, (coalesce(sim / 0.55, 1) + {_SCORE} / 0.6) / 2 AS combined FROM pb LEFT JOIN si USING (recording, region_id, probe) LEFT JOIN ft ON ft.recording = pb.recording AND ft.region_id = pb.region_id * 10 + pb.probe),
  bs AS (SELECT recording, region_id, max(combined) AS best_ratio, bool_or(passed) AS passed, max(combined) FILTER (passed) AS top FROM dg GROUP BY 1, 2)
  SELECT bs.recording, bs.region_id, {sql_tidy('any_value(best_ratio)')} AS best_ratio, any_value(bs.passed) AS passed, {sql_tidy('min(dg.t) FILTER (dg.passed AND combined >= top - 0.05)')} AS recovered_t FROM bs JOIN dg USING (recording, region_id) GROUP BY 1, 2""")
def _(spark, sf):
    f, r = frames(spark, sf), _regions(spark, sf)
    probes = gates.probe_times(r.filter("polarity = 'positive'")).withColumn("event_id", F.col("region_id") * 10 + F.col("probe"))
    scored = gates.match_score(gates.local_features(probes, f, 0.1, 300.0, 5500.0), CHECKS)
    scored = gates.spectral_similarity(scored, profiles.spectral_template(r, f), f, 0.1)
    out = gates.recovered(gates.diagnosed(scored, 0.55, 0.6))
    return out.select("recording", "region_id", tidy("best_ratio").alias("best_ratio"), "passed", tidy("recovered_t").alias("recovered_t"))


@query("t4_top_candidates_per_region", f"""WITH RECURSIVE {SQL_FRAMES}, {SQL_FREG}, pr AS (SELECT rg.recording, region_id, frame, f.t, rms AS s FROM rg JOIN f ON f.recording = rg.recording AND f.t BETWEEN t_start AND t_end),
  nb AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b FROM pr WINDOW w AS (PARTITION BY recording, region_id ORDER BY frame)),
  k AS (SELECT *, row_number() OVER (PARTITION BY recording, region_id ORDER BY s DESC, t) AS k FROM nb WHERE (a IS NULL OR s >= a) AND (b IS NULL OR s >= b)) SELECT recording, region_id, {sql_tidy('t')} AS t FROM k WHERE k <= 6""")
def _(spark, sf):
    f = frames(spark, sf).withColumn("strength", F.col("rms"))
    return gates.candidate_peaks(_regions(spark, sf), f, most=6).select("recording", "region_id", tidy("t").alias("t"))


# Profiles

@query("a18_level_profile", f"""WITH {SQL_FRAMES}, q AS (SELECT recording, quantile_cont(rms, 0.05) AS p5, quantile_cont(rms, 0.1) AS p10, quantile_cont(rms, 0.9) AS p90, max(rms) AS mx, count(*) AS n FROM f WHERE rms > 0 GROUP BY 1)
  SELECT recording, {sql_tidy('20 * log10(greatest(p10, 1e-10))')} AS noise_floor_db, {sql_tidy('CASE WHEN n < 10 THEN 20 ELSE 20 * log10(p90 / p10) END')} AS snr_db, round(20 * log10(mx) - 20 * log10(p5), 1) AS dynamic_range_db FROM q""")
def _(spark, sf):
    return _r(profiles.level_profile(frames(spark, sf)), "recording", dynamic_range_db=1)


SQL_FLOOR = f"""{SQL_SPECTRUM}, lv AS (SELECT *, 20 * log10(greatest(rms, 1e-10)) AS db FROM f), q AS (SELECT recording, quantile_cont(db, 0.1) AS p10, quantile_cont(db, 0.2) AS p20, median(db) AS p50, max(db) AS pk FROM lv GROUP BY 1),
  rf AS (SELECT recording, 20 * log10(max(mag)) AS r FROM sp GROUP BY 1),
  bl AS (SELECT sp.recording, CASE WHEN freq_hz < 250 THEN 0 WHEN freq_hz < 1000 THEN 1 WHEN freq_hz < 4000 THEN 2 ELSE 3 END AS band, median(greatest(20 * log10(greatest(mag, 1e-5)) - r, -80)) AS b FROM sp JOIN lv ON lv.recording = sp.recording AND lv.frame = sp.frame JOIN q ON q.recording = sp.recording AND db <= p20 JOIN rf ON rf.recording = sp.recording GROUP BY 1, 2),
  sb AS (SELECT recording, median(b) AS s FROM bl GROUP BY 1), lw AS (SELECT lv.recording, db, min(db) OVER p AS lo, max(db) OVER p AS hi FROM lv JOIN q USING (recording) WHERE db <= p50 WINDOW p AS (PARTITION BY recording)),
  hs AS (SELECT recording, least(floor((db - lo) / (hi - lo) * 50), 49) AS i, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS c FROM lw GROUP BY 1, 2),
  md AS (SELECT recording, lo + (i + 0.5) * (hi - lo) / 50 AS m, row_number() OVER (PARTITION BY recording ORDER BY c DESC, i) AS k FROM hs),
  nf AS (SELECT recording, list_sort([p10, s, m])[2] AS noise_floor_db, pk AS peak_db, p10 AS percentile_db, s AS spectral_db, m AS mode_db FROM q JOIN sb USING (recording) JOIN md USING (recording) WHERE k = 1)"""


@query("a19_three_way_noise_floor", f"WITH {SQL_FLOOR} SELECT recording, {', '.join(f'{sql_tidy(c)} AS {c}' for c in ('noise_floor_db', 'peak_db', 'percentile_db', 'spectral_db', 'mode_db'))} FROM nf")
def _(spark, sf):
    return _r(profiles.noise_floor(frames(spark, sf)), "recording")


@query("w41_edit_plan", f"""WITH {SQL_FLOOR}, tb AS (SELECT *, least(greatest(peak_db - (noise_floor_db + 0.5), 1), 60) AS top FROM nf) SELECT recording, frame, {sql_tidy('db')} AS rms_db, {sql_tidy('CASE WHEN db < -18.5 THEN (-18.5 - db) * (1 - 1 / 2.0::DOUBLE) ELSE 0 END')} AS gain_db, db > peak_db - top AS audible FROM lv JOIN tb USING (recording)""")
def _(spark, sf):
    f = frames(spark, sf)
    plan = profiles.edit_plan(f, profiles.top_db(profiles.noise_floor(f), margin=0.5, low=1.0), threshold_db=-18.5, ratio_=2.0)
    return plan.select("recording", "frame", tidy("rms_db").alias("rms_db"), tidy("gain_db").alias("gain_db"), "audible")


@query("w41_audible_spans", f"""WITH {SQL_FLOOR}, tb AS (SELECT *, least(greatest(peak_db - (noise_floor_db + 0.5), 1), 60) AS top FROM nf), a AS (SELECT recording, frame, frame - row_number() OVER (PARTITION BY recording ORDER BY frame) AS g FROM lv JOIN tb USING (recording) WHERE db > peak_db - top)
  SELECT recording, min(frame) AS first_frame, max(frame) AS last_frame FROM a GROUP BY recording, g""")
def _(spark, sf):
    f = frames(spark, sf)
    plan = profiles.edit_plan(f, profiles.top_db(profiles.noise_floor(f), margin=0.5, low=1.0), threshold_db=-18.5, ratio_=2.0)
    return profiles.audible_spans(plan).drop("span")


SQL_PROFILE = f"""{SQL_SPECTRUM}, mp AS (SELECT recording, bin, freq_hz, avg(mag * mag) AS m, stddev_pop(mag * mag) AS sd FROM sp GROUP BY 1, 2, 3), ct AS (SELECT recording, sum(m) AS t, sum(freq_hz * m) / sum(m) AS c FROM mp GROUP BY 1),
  pf AS (SELECT recording, round(arg_max(freq_hz, m), 1) AS dominant_hz, round(any_value(c), 1) AS centroid_hz, round(sqrt(sum(m * (freq_hz - c) ** 2) / any_value(t)), 1) AS bandwidth_hz,
   {', '.join(f"round(coalesce(sum(m) FILTER (freq_hz >= {lo} AND freq_hz < {hi}), 0) / any_value(t), 4) AS {n}" for n, lo, hi in [('below_200', 0, 200), ('to_2000', 200, 2000), ('to_8000', 2000, 8000), ('above_8000', 8000, 8000)])} FROM mp JOIN ct USING (recording) GROUP BY 1)"""


@query("a20_spectral_profile", f"WITH {SQL_PROFILE} SELECT * FROM pf")
def _(spark, sf):
    return profiles.spectral_profile(frames(spark, sf))


@query("a21_tonal_noise", f"""WITH {SQL_PROFILE}, p AS (SELECT *, m / (sd + 1e-10) AS pr, avg(m) OVER (PARTITION BY recording ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS nr FROM mp),
  md AS (SELECT recording, median(pr) AS mp_, median(m) AS mm FROM p GROUP BY 1), h AS (SELECT p.recording, freq_hz FROM p JOIN md USING (recording) WHERE freq_hz BETWEEN 30 AND 6200 AND pr > mp_ * 1.02 AND m > mm * 1.05 AND m > nr * 1.05)
  SELECT recording, array_to_string(list_sort(list(freq_hz))[1:5], ',') AS tones FROM h GROUP BY 1""")
def _(spark, sf):
    rows = profiles.tonal_noise(frames(spark, sf), high_hz=6200.0, prominence=1.02, level=1.05, local=1.05)
    return rows.select("recording", F.array_join(F.col("tones").cast("array<string>"), ",").alias("tones"))


@query("a22_noise_stationarity", f"""WITH {SQL_SPECTRUM}, e AS (SELECT recording, frame, sum(mag * mag) AS e FROM sp GROUP BY 1, 2), q AS (SELECT recording, quantile_cont(e, 0.25) AS q FROM e GROUP BY 1),
  z AS (SELECT sp.*, avg(mag) OVER (PARTITION BY sp.recording, bin) AS mu FROM sp JOIN e ON e.recording = sp.recording AND e.frame = sp.frame JOIN q ON q.recording = sp.recording AND e.e <= q.q)
  SELECT recording, CASE WHEN count(DISTINCT frame) < 5 THEN 0.5 ELSE round(greatest(0, least(1, 1 - avg(abs(mag - mu)) / avg(mu))), 3) END AS stationarity FROM z GROUP BY 1""")
def _(spark, sf):
    return profiles.noise_stationarity(frames(spark, sf))


FEATURES = ["rms", "volume", "x"]


@query("a25_selection_summary_statistics", f"""WITH {SQL_SPECTRUM}, b AS (SELECT recording, sum(mag) AS al, sum(mag) FILTER (bin BETWEEN 4 AND 19) AS se, count(*) FILTER (bin BETWEEN 4 AND 19) AS n, max(mag) FILTER (bin BETWEEN 4 AND 19) AS band_peak FROM sp GROUP BY 1),
  s AS (SELECT recording, count(*) AS frame_count, {', '.join(f'{fn}({c}) AS {c}_{n}' for c in FEATURES for n, fn in (('mean', 'avg'), ('min', 'min'), ('max', 'max'), ('std', 'stddev_pop')))} FROM f GROUP BY 1)
  SELECT recording, frame_count, {', '.join(f'{sql_tidy(f"{c}_{n}")} AS {c}_{n}' for c in FEATURES for n in ('mean', 'min', 'max', 'std'))}, {sql_tidy('band_peak')} AS band_peak, {sql_tidy('se / al')} AS energy_ratio, {sql_tidy('se / n')} AS band_mean FROM s JOIN b USING (recording)""")
def _(spark, sf):
    return _r(profiles.selection_summary(frames(spark, sf), FEATURES, 4, 19), "recording", "frame_count")


@query("a26_coefficient_profile", f"WITH {SQL_SPECTRUM} SELECT recording, bin AS coefficient, {sql_tidy('avg(mag)')} AS mean, {sql_tidy('stddev_pop(mag)')} AS std FROM sp WHERE bin < 13 GROUP BY 1, 2")
def _(spark, sf):
    rows = profiles.coefficient_profile(frames(spark, sf))
    return _r(rows.withColumn("coefficient", F.col("coefficient").cast("long")), "recording", "coefficient")


SQL_MASK = f"""{SQL_SPECTRUM}, pk AS (SELECT recording, max(mag) AS p FROM sp WHERE bin BETWEEN 4 AND 19 GROUP BY 1), ms AS (SELECT sp.*, bin BETWEEN 4 AND 19 AND mag BETWEEN p * (20.0 / 100)::DOUBLE AND p * (80.0 / 100)::DOUBLE AS kept, p FROM sp JOIN pk USING (recording))"""


@query("a28_spectral_mask_statistics", f"WITH {SQL_MASK} SELECT recording, count(*) FILTER (kept) AS kept_cells, count(*) AS total_cells, {sql_tidy('any_value(p)')} AS band_peak, {sql_tidy('sum(mag) FILTER (kept) / sum(mag)')} AS kept_energy_ratio FROM ms GROUP BY 1")
def _(spark, sf):
    return _r(profiles.mask_statistics(frames(spark, sf), 4, 19, 20.0, 80.0), "recording", "kept_cells", "total_cells")


@query("a29_pitch_summary", f"""WITH {SQL_FRAMES}, v AS (SELECT recording, frame, 200 + 1000 * x AS f0 FROM f WHERE 200 + 1000 * x > 0), p AS (SELECT *, 1 / f0 - 1 / lag(f0) OVER w AS d FROM v {WF})
  SELECT recording, round(avg(f0), 2) AS f0_mean, round(stddev_pop(f0), 2) AS f0_std, round(min(f0), 2) AS f0_min, round(max(f0), 2) AS f0_max, round(max(f0) - min(f0), 2) AS f0_range, round(avg(abs(d)) / avg(1 / f0), 6) AS jitter FROM p GROUP BY 1""")
def _(spark, sf):
    return profiles.pitch_summary(frames(spark, sf).withColumn("f0", 200 + 1000 * F.col("x")))


@query("a31_trajectory_steps", f"""WITH {SQL_FRAMES}, d AS (SELECT recording, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS d FROM f {WF}), l AS (SELECT recording, list_sort(list(d)) AS l FROM d WHERE d IS NOT NULL GROUP BY 1)
  SELECT recording, {sql_tidy('l[len(l) // 2 + 1]')} AS median, {sql_tidy('list_avg(l)')} AS mean, {sql_tidy('l[CAST(floor(len(l) * 0.95::DOUBLE) AS INT) + 1]')} AS p95, {sql_tidy('l[CAST(floor(len(l) * 0.99::DOUBLE) AS INT) + 1]')} AS p99, {sql_tidy('l[-1]')} AS max, {sql_tidy('l[-1] / l[len(l) // 2 + 1]')} AS max_over_median FROM l""")
def _(spark, sf):
    return _r(fr.trajectory_steps(frames(spark, sf)), "recording")


@query("a32_filter_setting_rules", f"""WITH {SQL_PROFILE}, {SQL_FREG}, b AS (SELECT recording, min(f_low) FILTER (polarity = 'positive') AS sl, max(f_high) FILTER (polarity = 'positive') AS sh, min(f_low) FILTER (polarity = 'negative') AS nl, max(f_high) FILTER (polarity = 'negative') AS nh FROM rg GROUP BY 1),
  s AS (SELECT *, floor(greatest(20, sl - greatest(50, sl * 0.3::DOUBLE))) AS hb, least(9900, floor(sh + greatest(500, sh * 0.3::DOUBLE))) AS lb FROM pf LEFT JOIN b USING (recording))
  SELECT recording, CASE WHEN sl IS NOT NULL AND nh < sl THEN least(greatest(hb, round_even(nh / 10, 0) * 10), greatest(20, floor(sl - 30))) WHEN sl IS NOT NULL THEN round_even(hb / 10, 0) * 10 WHEN below_200 < 0.05 THEN 200 WHEN below_200 < 0.15 THEN 100 ELSE 60 END::DOUBLE AS highpass_hz,
   CASE WHEN sl IS NOT NULL AND sh < 9500 THEN CASE WHEN nl > sh THEN greatest(least(lb, round_even(nl / 100, 0) * 100), floor(sh + 100)) ELSE round_even(lb / 100, 0) * 100 END WHEN above_8000 > 0.15 THEN 0 WHEN above_8000 < 0.02 THEN 8000 ELSE 0 END::DOUBLE AS lowpass_hz FROM s""")
def _(spark, sf):
    pos, neg = F.col("polarity") == "positive", F.col("polarity") == "negative"
    bands = _regions(spark, sf).groupBy("recording").agg(
        F.min(F.when(pos, F.col("f_low"))).alias("sig_low"), F.max(F.when(pos, F.col("f_high"))).alias("sig_high"),
        F.min(F.when(neg, F.col("f_low"))).alias("neg_low"), F.max(F.when(neg, F.col("f_high"))).alias("neg_high"))
    rows = profiles.spectral_profile(frames(spark, sf)).join(bands, "recording", "left")
    return profiles.filter_settings(rows, top_hz=10_000.0).select("recording", "highpass_hz", "lowpass_hz")


@query("a32_method_choice_rules", f"""WITH {SQL_FRAMES}, {SQL_FREG}, s AS (SELECT recording, avg(harmonicity) FILTER (polarity = 'positive') AS ph, CASE WHEN avg(harmonicity) FILTER (polarity = 'positive') > 0.5 THEN 'harmonic' ELSE 'percussive' END AS pc, CASE WHEN avg(harmonicity) FILTER (polarity = 'negative') > 0.5 THEN 'harmonic' ELSE 'percussive' END AS nc, avg(f_low) / 2000 AS ps FROM rg GROUP BY 1)
  SELECT recording, CASE WHEN coalesce(ph, 0.5) > 0.7 THEN 'spectral_flux' WHEN ps > 0.5 THEN 'baseline_crossing' WHEN pc = 'percussive' AND nc = 'harmonic' THEN 'baseline_crossing' WHEN pc = 'harmonic' AND nc = 'percussive' THEN 'spectral_flux' ELSE 'baseline_crossing' END AS method FROM s""")
def _(spark, sf):
    pos, neg = (F.avg(F.when(F.col("polarity") == p, F.col("harmonicity"))) for p in ("positive", "negative"))
    rows = _regions(spark, sf).groupBy("recording").agg(
        pos.alias("pos_harmonicity"), (F.avg("f_low") / 2000).alias("pos_sharpness"),
        F.when(pos > 0.5, "harmonic").otherwise("percussive").alias("pos_character"), F.when(neg > 0.5, "harmonic").otherwise("percussive").alias("neg_character"))
    return profiles.method_choice(rows).select("recording", "method")


@query("a34_bin_table_statistics", f"""WITH {SQL_SPECTRUM}, l AS (SELECT recording, list_sort(list(mag)) AS l, max(bin) FILTER (mag <> 0) AS top_bin FROM sp GROUP BY 1), n AS (SELECT recording, count(*) AS n_rows, max(len(bins)) AS n_bins FROM f GROUP BY 1)
  SELECT recording, n_rows, n_bins, {sql_tidy('l[1]')} AS low, {sql_tidy('l[-1]')} AS high, {sql_tidy('l[CAST(floor(len(l) * 0.95::DOUBLE) AS INT) + 1]')} AS p95, top_bin FROM l JOIN n USING (recording)""")
def _(spark, sf):
    rows = profiles.bin_table_statistics(frames(spark, sf))
    rows = rows.withColumns({c: F.col(c).cast("long") for c in ("n_bins", "top_bin")})
    return _r(rows, "recording", "n_rows", "n_bins", "top_bin")


# Smoothing, coordinates, template

@query("w32_w34_smoothed_envelope", f"""WITH RECURSIVE {SQL_FRAMES}, mx AS (SELECT recording, max(list_max(bins)) * 1.05::DOUBLE AS c FROM f GROUP BY 1),
  e AS (SELECT recording, frame, list_transform([{', '.join(str(round(i * 63 / 15) + 1) for i in range(16))}], lambda k: (bins[k] / c) ** 0.7::DOUBLE) AS e FROM f JOIN mx USING (recording)),
  walk AS (SELECT recording, frame, list_transform(e, lambda v: v * (1 - 0.8::DOUBLE)) AS s FROM e WHERE frame = 0 UNION ALL
    SELECT w.recording, e.frame, list_transform(range(1, 17), lambda k: w.s[k] * 0.8::DOUBLE + e.e[k] * (1 - 0.8::DOUBLE)) FROM walk w JOIN e ON e.recording = w.recording AND e.frame = w.frame + 1)
  SELECT recording, frame, {sql_tidy('list_max(s)')} AS peak, 16 - list_position(list_reverse(s), list_max(s)) AS peak_bin FROM walk""")
def _(spark, sf):
    rows = fr.smoothed_envelope(frames(spark, sf), 64, target=16, smoothing=0.8, power=0.7, padding_pct=5.0)
    return rows.select("recording", "frame", tidy("peak").alias("peak"), F.col("peak_bin").cast("int").alias("peak_bin"))


@query("w35_centred_cloud", f"""WITH {SQL_FRAMES}, b AS (SELECT recording, {', '.join(f'min({c}) AS l{c}, max({c}) AS h{c}' for c in 'xyz')} FROM f GROUP BY 1)
  SELECT recording, frame, {', '.join(f"{sql_tidy(f'({c} - (l{c} + h{c}) / 2) * 100 / greatest(hx - lx, hy - ly, hz - lz)')} AS n{c}" for c in 'xyz')}, {sql_tidy('(rms - min(rms) OVER (PARTITION BY recording)) / (max(rms) OVER (PARTITION BY recording) - min(rms) OVER (PARTITION BY recording))')} AS nrms FROM f JOIN b USING (recording)""")
def _(spark, sf):
    rows = fr.unit_columns(fr.centred_cloud(frames(spark, sf)), ["rms"])
    return _r(rows.select("recording", "frame", "nx", "ny", "nz", "nrms"), "recording", "frame")


@query("w36_short_clip_coordinates", f"""WITH {SQL_FRAMES} SELECT recording, frame, {sql_tidy('-1 + 2 * frame / (count(*) OVER p - 1)')} AS cx, {sql_tidy('(x - min(x) OVER p) / (max(x) OVER p - min(x) OVER p) - 0.5')} AS cy, {sql_tidy('(y - min(y) OVER p) / (max(y) OVER p - min(y) OVER p) - 0.5')} AS cz FROM f WINDOW p AS (PARTITION BY recording)""")
def _(spark, sf):
    rows = fr.short_clip_coordinates(frames(spark, sf), "x", "y")
    return _r(rows.select("recording", "frame", "cx", "cy", "cz"), "recording", "frame")


TEMPLATE = [[0.1, -0.1, 0.0], [0.0, 0.1, 0.1], [-0.1, 0.0, 0.1], [0.05, 0.05, -0.1]]
_SQD = " + ".join(f"(v[i + {k + 1}][{j + 1}] - {val!r}::DOUBLE) ** 2" for k, vec in enumerate(TEMPLATE) for j, val in enumerate(vec))


@query("w42_template_distance_mask", f"""WITH {SQL_FRAMES}, l AS (SELECT recording, list([x, y, z] ORDER BY frame) AS v, count(*) AS n FROM f GROUP BY 1), u AS (SELECT recording, n, v, unnest(range(n)) AS p FROM l),
  d AS (SELECT recording, n, p, CASE WHEN p >= 2 AND p - 2 < n - 4 THEN (SELECT sqrt({_SQD}) FROM (SELECT p - 2 AS i)) END AS d FROM u),
  m AS (SELECT *, coalesce(d, max(d) OVER (PARTITION BY recording)) AS e FROM d), s AS (SELECT *, (e - min(e) OVER q) / (max(e) OVER q - min(e) OVER q) AS distance FROM m WINDOW q AS (PARTITION BY recording))
  SELECT recording, p AS frame, {sql_tidy('distance')} AS distance, distance <= quantile_cont(distance, 0.2) OVER (PARTITION BY recording) AS kept FROM s""")
def _(spark, sf):
    rows = frames(spark, sf).withColumn("vec", F.array("x", "y", "z"))
    return fr.template_mask(rows, "vec", [TEMPLATE], 20.0).select("recording", "frame", tidy("distance").alias("distance"), "kept")


# Selection geometry

@query("p6_time_window", f"WITH {SQL_FRAMES} SELECT recording, frame FROM f WHERE t BETWEEN 0.5 AND 2.0")
def _(spark, sf):
    return sl.in_time(frames(spark, sf), *sl.time_window(0.5, 2.0, 5.0)).select("recording", "frame")


@query("p7_frequency_window", f"WITH {SQL_FRAMES} SELECT recording, frame, 16::INT AS n_bins, {sql_tidy('list_sum(bins[1:16])')} AS band_sum FROM f")
def _(spark, sf):
    band = sl.in_band(F.col("bins"), *sl.frequency_window(-10, 99, 16, 64))
    return frames(spark, sf).select("recording", "frame", F.size(band).alias("n_bins"), tidy(F.aggregate(band, F.lit(0.0), lambda s, v: s + v)).alias("band_sum"))


@query("p8_amplitude_range", f"WITH {SQL_MASK} SELECT recording, frame, bin FROM ms WHERE kept")
def _(spark, sf):
    rows = sl.in_amplitude(spectrum(spark, sf), 4, 19, *sl.amplitude_window(20.0, 80.0))
    return rows.select("recording", "frame", F.col("bin").cast("long").alias("bin"))


SQL_PCT = f"""{SQL_FRAMES}, pc AS (SELECT recording, frame, {', '.join(f'({c} - min({c}) OVER p) / (max({c}) OVER p - min({c}) OVER p) * 100 AS {c}p' for c in 'xyz')} FROM f WINDOW p AS (PARTITION BY recording))"""


@query("p9_three_plane_box", f"WITH {SQL_PCT} SELECT recording, frame FROM pc WHERE xp BETWEEN 20 AND 80 AND yp BETWEEN 10 AND 70 AND zp BETWEEN 30 AND 90")
def _(spark, sf):
    box = sl.box_volume({"xz": (10, 80, 95, 30), "yz": (70, 10, 0, 90), "xy": (20, 130, 0, 100)})
    return sl.in_box(sl.with_percents(frames(spark, sf)), box).select("recording", "frame")


@query("p10_plane_and_polygon", f"""WITH {SQL_PCT}, e AS (SELECT * FROM (VALUES (10.0::DOUBLE, 20.0::DOUBLE, 30.0::DOUBLE, 90.0::DOUBLE), (80.0, 30.0, 10.0, 20.0), (60.0, 85.0, 80.0, 30.0), (30.0, 90.0, 60.0, 85.0)) AS v(x0, y0, x1, y1))
  SELECT recording, frame FROM pc WHERE xp BETWEEN 10 AND 90 AND zp BETWEEN 5 AND 95 AND (SELECT count(*) FROM e WHERE (y0 > zp) <> (y1 > zp) AND yp < (x1 - x0) * (zp - y0) / (y1 - y0) + x0) % 2 = 1""")
def _(spark, sf):
    planes = {"xz": (10, 90, 5, 95), "yz": [(10.0, 20.0), (80.0, 30.0), (60.0, 85.0), (30.0, 90.0)]}
    return sl.by_planes(sl.with_percents(frames(spark, sf)), planes).select("recording", "frame")


@query("p13_percent_to_frames", f"WITH {SQL_FRAMES} SELECT recording, CAST(floor(0.123::DOUBLE * (count(*) - 1) + 0.5) AS BIGINT) AS start_frame, CAST(floor(0.875::DOUBLE * (count(*) - 1) + 0.5) AS BIGINT) AS end_frame FROM f GROUP BY 1")
def _(spark, sf):
    counts = frames(spark, sf).groupBy("recording").agg(F.count(F.lit(1)).alias("n"))
    a, b = sl.percent_frames(F.lit(87.5), F.lit(12.3), F.col("n"))
    return counts.select("recording", a.cast("long").alias("start_frame"), b.cast("long").alias("end_frame"))


SQL_IDS = f"""{SQL_FRAMES}, g AS (SELECT recording, list_sort(list(frame) FILTER (y > 0)) AS a, list_sort(list(frame) FILTER (z > 0)) AS b FROM f GROUP BY 1)"""


def _ids(spark, sf):
    pick = lambda c: F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.col("frame"))))
    return frames(spark, sf).groupBy("recording").agg(pick("y").alias("a"), pick("z").alias("b"))


def _text(c):
    return F.array_join(c.cast("array<string>"), ",")


@query("p14_normal_selection_ids", f"WITH {SQL_FRAMES} SELECT recording, array_to_string(list_sort(list_distinct(list(CAST(floor(x * 100 + 0.5) AS BIGINT)) FILTER (floor(x * 100 + 0.5) >= 0 AND floor(x * 100 + 0.5) < 20))), ',') AS ids FROM f GROUP BY 1")
def _(spark, sf):
    rows = frames(spark, sf).groupBy("recording").agg(F.collect_list(F.col("x") * 100).alias("raw"))
    return rows.select("recording", _text(sl.normal_ids(F.col("raw"), F.lit(20))).alias("ids"))


@query("t6_group_set_operations", f"""WITH {SQL_IDS} SELECT recording, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS joined, array_to_string(list_sort(list_filter(a, lambda v: NOT list_contains(b, v))), ',') AS removed,
  array_to_string(list_sort(list_intersect(a, b)), ',') AS part FROM g""")
def _(spark, sf):
    rows = _ids(spark, sf)
    part, _rest = sl.split(F.col("a"), F.col("b"))
    return rows.select("recording", _text(sl.merged(F.col("a"), F.col("b"))).alias("joined"), _text(sl.without(F.col("a"), F.col("b"))).alias("removed"), _text(part).alias("part"))


@query("t9_effective_and_inverted_selection", f"WITH {SQL_FRAMES} SELECT recording, frame FROM f WHERE NOT (y > 0 OR z > 0)")
def _(spark, sf):
    f = frames(spark, sf)
    chosen = sl.effective(f.filter("y > 0"), f.filter("z > 0"))
    return sl.inverted(f, chosen).select("recording", "frame")


@query("t8_region_move_between_layers", f"""WITH {SQL_FRAMES}, {SQL_FREG} SELECT recording, region_id, CASE WHEN polarity = 'negative' THEN 'noise' ELSE 'base' END AS layer FROM rg""")
def _(spark, sf):
    r = _regions(spark, sf).withColumn("layer", F.lit("base"))
    return sl.copy_regions(r, F.col("polarity") == "negative", "noise", move=True).select("recording", "region_id", "layer")


@query("t8_region_copy_between_layers", f"""WITH {SQL_FRAMES}, {SQL_FREG} SELECT recording, region_id, 'base' AS layer FROM rg UNION ALL SELECT recording, region_id, 'noise' FROM rg WHERE polarity = 'negative'""")
def _(spark, sf):
    r = _regions(spark, sf).withColumn("layer", F.lit("base"))
    return sl.copy_regions(r, F.col("polarity") == "negative", "noise").select("recording", "region_id", "layer")
