"""Known values on single operators."""

import math

import pytest
from pyspark.sql import functions as F

from tactus.functions import text as tx
from tactus.operators import frames as fr
from tactus.operators import gates, metrics
from tactus.operators import intervals as iv
from tactus.operators import matching as mt
from tactus.operators import selection as sl
from tactus.operators.thinning import spaced
from tactus.sources import writers as wr


def onsets_of(spark, times, recording="a"):
    return spark.createDataFrame([(recording, i, float(t)) for i, t in enumerate(times)], "recording string, event_id long, t double")


def from_intervals(spark, ms):
    times = [0.0]
    for i in ms:
        times.append(times[-1] + i / 1000)
    return onsets_of(spark, times)


def test_stable_flags(spark):
    rows = iv.dyads(from_intervals(spark, [100, 200, 100, 200, 100]), tolerance=0.1).orderBy("dyad_index")
    assert [r.stable for r in rows.collect()] == [True, True, True, False]


def test_alike(spark):
    row = spark.range(1).select(iv.alike(F.lit(0.0), F.lit(10.0), 0.2).alias("a"), iv.alike(F.lit(10.0), F.lit(11.0), 0.2).alias("b")).first()
    assert (row.a, row.b) == (False, True)


def test_dyads_and_metrics(spark):
    pairs = iv.dyads(from_intervals(spark, [100, 200, 100]), digits=(2, 4))
    rows = pairs.orderBy("dyad_index").collect()
    assert [r.r_k for r in rows] == [0.3333, 0.6667]
    assert [r.cycle_ms for r in rows] == [300.0, 300.0]
    m = metrics.rhythm_metrics(pairs).first()
    assert m.npvi == pytest.approx(66.68)
    assert m.cv == pytest.approx(0.353553, abs=1e-6)
    assert m.rk_std == pytest.approx(0.1667)
    assert m.avg_cycle_ms == 300


def test_stable_subset(spark):
    pairs = spark.createDataFrame([("a", 1, 100.0, 200.0, 300.0, 0.3333, True)],
                                  "recording string, dyad_index long, interval_1_ms double, interval_2_ms double, cycle_ms double, r_k double, stable boolean")
    m = metrics.rhythm_metrics(pairs).first()
    assert m.stable_npvi == pytest.approx(66.68)
    assert m.stable_cv == pytest.approx(0.333333, abs=1e-6)
    assert (m.stable_rk_std, m.stable_entropy) == (0, 0)


def test_speech_metrics(spark):
    m = metrics.speech_metrics(from_intervals(spark, [100, 120, 400, 140])).first()
    assert (m.speech_rate, m.mean_ioi_ms, m.std_ioi_ms, m.pvi_raw_ms) == (5.263, 190.0, 122.07, 186.67)
    assert (m.npvi_pct, m.varco_pct, m.articulation_rate) == (74.06, 64.25, 8.333)
    assert (m.pause_count, m.mean_pause_ms, m.phonation_ratio) == (1, 400.0, 0.4737)


def test_pulse_maxima(spark):
    curve = [0, .5, .2, .9, .1, .2, 0, .8, 0]
    rows = spark.createDataFrame([("a", i, i * 0.05, float(v)) for i, v in enumerate(curve)], "recording string, frame long, t double, v double")
    kept = fr.spaced_maxima(rows, "v", "t", 130.0, 0.05).orderBy("t").collect()
    assert [round(r.t, 6) for r in kept] == [0.15, 0.35]


def test_comparison(spark):
    main = onsets_of(spark, [.1, .2, .5])
    one, two = onsets_of(spark, [.1004, .7]), onsets_of(spark, [.5])
    a = {(r.event_id, r.status) for r in mt.classify_comparison(main, one, 0.005).collect()}
    assert {(0, "shared_main"), (1, "main_only"), (2, "main_only"), (1, "comp_only"), (0, "comp_shared")} == a
    b = {(r.event_id, r.status) for r in mt.classify_comparison(main, two, 0.005).collect()}
    assert (2, "shared_main") in b and (0, "comp_shared") in b


def test_add_shared_depends_on_order(spark):
    main, other = onsets_of(spark, [.1]), onsets_of(spark, [.103, .1035, .1004, .7])
    # Sources are taken in time order here: .1004 is a duplicate, .103 joins, .1035 is a duplicate of it.
    rows = mt.add_shared(main, [other], 0.005)
    assert sorted(r.t for r in rows.collect()) == [.1, .103]


def test_broadband(spark):
    energy = {0: [4.0, 0.1], 1: [4.0, 4.0], 2: [0.1, 4.0]}
    frames = spark.createDataFrame([("a", f, float(f), [math.sqrt(v) for v in e]) for f, e in energy.items()],
                                   "recording string, frame long, t double, bins array<double>")
    kept = gates.broadband_gate(onsets_of(spark, [0.0, 1.0, 2.0]), frames, 2, min_bands=2, bands=2, threshold=0.5)
    assert [r.t for r in kept.collect()] == [1.0]


def test_variable_bounds(spark):
    rows = spark.createDataFrame([(1, 105.0), (2, 121.0), (3, None)], "id int, pitch double")
    checks = gates.checks_from({"pitch": 100.0}, {"pitch": {"enabled": True, "deviation_pct": 10}})
    assert [r.id for r in gates.bounds_gate(rows, checks).collect()] == [1]


def test_match_threshold_ends():
    assert gates.threshold_for([5.0], gates.SPECTRAL_LIMIT) == pytest.approx(0.55)
    assert gates.threshold_for([250.0], gates.VARIABLE_LIMIT) == pytest.approx(0.52)


def test_selection_contracts():
    assert sl.time_window(-2, 8, 5) == (0, 5)
    assert sl.frequency_window(-10, 99, 16, 64) == (0, 15)
    assert sl.amplitude_window(-5, 140) == (0, 100)
    with pytest.raises(ValueError):
        sl.time_window(3, 3, 5)


def test_box_needs_all_axes():
    assert sl.box_volume({"xz": (0, 50, 0, 50)}) is None
    assert sl.box_volume({"xz": (0, 50, 10, 60), "xy": (20, 80, 5, 95)}) == {"x": (20, 50), "y": (5, 95), "z": (10, 60)}


@pytest.mark.parametrize("text, want", [
    ("0.1, 0.5", [0.1, 0.5]), ("[0.2, 0.8, 1.4]", [0.2, 0.8, 1.4]), ("(0.3;0.1)", [0.1, 0.3]), ("0.1 0.2  0.3", [0.1, 0.2, 0.3]),
    ("", []), ("bad, 0.4, x", [0.4]), ("nan, inf, 1", [1.0])])
def test_parse_times(spark, text, want):
    assert spark.range(1).select(tx.parse_times(F.lit(text)).alias("t")).first().t == want


def test_parse_null(spark):
    assert spark.range(1).select(tx.parse_times(F.lit(None).cast("string")).alias("t")).first().t == []


def test_clock_and_labels(spark):
    row = spark.range(1).select(tx.clock(F.lit(3661.25)).alias("c"), tx.safe_label(F.lit("a b/c")).alias("s"), tx.slug(F.lit("--A b")).alias("g")).first()
    assert (row.c, row.s, row.g) == ("01:01:01.250", "a_b_c", "a-b")


def test_first_publish(spark):
    empty = spark.createDataFrame([], "asset_id string, revision_id string")
    new = spark.createDataFrame([("x",)], "asset_id string")
    table, revision = wr.publish_assets(empty, new, revision=0)
    assert table.first().revision_id == "rev-0001" and revision == 1
    with pytest.raises(ValueError):
        wr.publish_assets(empty, new, revision=3, expected=2)


def test_strict_and_loose_spacing(spark):
    rows = onsets_of(spark, [0.0, 0.5, 1.0, 1.25])
    assert [r.t for r in spaced(rows, "recording", "t", 0.5).orderBy("t").collect()] == [0.0, 0.5, 1.0]
    assert [r.t for r in spaced(rows, "recording", "t", 0.5, inclusive=False).orderBy("t").collect()] == [0.0, 1.0]
