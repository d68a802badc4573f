"""Split and unsplit layouts give the same results; a third of the rows belongs to one key."""

import random

import pytest
from pyspark.sql import functions as F

from tactus import layout as lo
from tactus.operators import detectors as dt
from tactus.operators import frames as fr
from tactus.operators import groups as gr
from tactus.operators import intervals as iv
from tactus.operators import matching as mt
from tactus.operators import metrics, stats
from tactus.operators.thinning import bridged, spaced


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [("hot" if i % 3 == 0 else f"r{rng.randrange(20)}", i, rng.choice([rng.random() * 100, 50 + rng.random() * 0.5]), rng.random())
            for i in range(900)]
    return spark.createDataFrame(data, "recording string, event_id long, t double, strength double").cache()


@pytest.fixture(scope="module")
def plan(rows):
    return lo.plan_layout(rows, "recording", "t", hot_rows=100, run_rows=40)


def same(a, b, digits=9):
    key = lambda r: tuple(round(v, digits) if isinstance(v, float) and v == v else str(v) for v in r)
    b = b.select(*a.columns)
    assert sorted(map(key, a.collect()), key=str) == sorted(map(key, b.collect()), key=str)


def test_only_the_hot_key_is_split(plan, rows):
    assert plan.hot == (("hot",),) and len(plan.cuts) > 5
    runs = plan.mark(rows).groupBy(lo.RUN).count().collect()
    assert max(r["count"] for r in runs if r[lo.RUN] > 0) < 200


def test_ranges_are_refined_beyond_the_largest_number_of_cuts(rows, monkeypatch):
    monkeypatch.setattr(lo, "MAX_RUNS", 4)
    many = lo.plan_layout(rows, "recording", "t", hot_rows=100, run_rows=20)
    assert many.parts > 1
    marked = many.mark(rows).filter("recording = 'hot'")
    assert marked.select(lo.RUN).distinct().count() > 6
    pairs = [(r.t, r[lo.RUN]) for r in marked.orderBy("t").collect()]
    assert all(a[1] <= b[1] for a, b in zip(pairs, pairs[1:]))
    same(lo.row_index(rows, "recording", ["t", "event_id"], "n"), lo.plain(lo.row_index(many.mark(rows), "recording", ["t", "event_id"], "n")))


@pytest.mark.parametrize("most_runs", [10_000, 4])
def test_rows_without_order_or_key_stay(rows, monkeypatch, most_runs):
    monkeypatch.setattr(lo, "MAX_RUNS", most_runs)
    odd = rows.withColumns({
        "recording": F.when(F.col("recording") == "hot", F.lit(None)).otherwise(F.col("recording")),
        "t": F.when(F.col("event_id") % 31 == 0, F.lit(None)).when(F.col("event_id") % 37 == 0, F.lit(float("nan"))).otherwise(F.col("t"))})
    plan = lo.plan_layout(odd, "recording", "t", hot_rows=100, run_rows=40)
    assert plan.hot == ((None,),) and (plan.parts > 1) == (most_runs == 4)
    marked, order = plan.mark(odd), ["t", "event_id"]
    assert marked.filter(F.col(lo.RUN).isNull()).isEmpty()
    cols = {"a": ("event_id", -2), "b": ("event_id", 1)}
    same(lo.shift(odd, "recording", order, cols), lo.plain(lo.shift(marked, "recording", order, cols)))
    same(lo.row_index(odd, "recording", order, "n"), lo.plain(lo.row_index(marked, "recording", order, "n")))
    total = {"s": ("sum", "event_id"), "m": ("max", "event_id")}
    same(lo.running(odd, "recording", order, total), lo.plain(lo.running(marked, "recording", order, total)))
    frame = {"f": lambda w: F.sum("event_id").over(w)}
    same(lo.framed(odd, "recording", order, frame, 3, 2), lo.plain(lo.framed(marked, "recording", order, frame, 3, 2)))


def test_every_row_is_split_when_too_many_keys_are_hot(rows, monkeypatch):
    monkeypatch.setattr(lo, "MAX_LISTED_KEYS", 3)
    many = lo.plan_layout(rows, "recording", "t", hot_rows=10, run_rows=100)
    assert many.hot is None
    cols = {"a": ("t", -2), "b": ("t", 1)}
    same(lo.shift(rows, "recording", ["t", "event_id"], cols), lo.plain(lo.shift(many.mark(rows), "recording", ["t", "event_id"], cols)))


def test_shift(rows, plan):
    cols = {"a": ("t", -1), "b": ("t", 2), "c": ("strength", -4), "d": ("t", 4)}
    order = ["t", "event_id"]
    same(lo.shift(rows, "recording", order, cols), lo.plain(lo.shift(plan.mark(rows), "recording", order, cols)))


@pytest.mark.parametrize("reverse", [False, True])
def test_running(rows, plan, reverse):
    aggs = {"n": ("sum", F.lit(1)), "hi": ("max", "strength"), "lo": ("min", "strength"), "part": ("max", F.when(F.col("strength") > 0.9, F.struct("t", "event_id")))}
    order = ["t", "event_id"]
    same(lo.running(rows, "recording", order, aggs, reverse=reverse), lo.plain(lo.running(plan.mark(rows), "recording", order, aggs, reverse=reverse)))


@pytest.mark.parametrize("before, after", [(3, 2), (0, 49), (9, -2), (-2, 9)])
def test_framed(rows, plan, before, after):
    aggs = {"s": lambda w: F.sum("strength").over(w), "n": lambda w: F.count("strength").over(w)}
    order = ["t", "event_id"]
    same(lo.framed(rows, "recording", order, aggs, before, after), lo.plain(lo.framed(plan.mark(rows), "recording", order, aggs, before, after)))


@pytest.mark.parametrize("tie", ["earlier", "later"])
def test_nearest(rows, plan, tie):
    right = rows.filter("strength > 0.8").select("recording", F.col("t").alias("rt"), F.col("event_id").alias("rid"))
    a = lo.nearest(rows, right, "recording", "t", "rt", ["rid"], tie=tie)
    b = lo.nearest(plan.mark(rows), right, "recording", "t", "rt", ["rid"], tie=tie, layout=plan)
    same(a, lo.plain(b))
    brute = {(r.recording, r.event_id): r.d for r in rows.join(right, "recording").groupBy("recording", "event_id").agg(F.min(F.abs(F.col("t") - F.col("rt"))).alias("d")).collect()}
    for r in a.filter("near IS NOT NULL").collect():
        assert abs(abs(r.t - r.near.t) - brute[(r.recording, r.event_id)]) < 1e-12


def test_covered(rows, plan):
    spans = rows.filter("strength > 0.97").select("recording", F.col("t").alias("s"), (F.col("t") + F.col("event_id") % 7).alias("e"))
    a = lo.covered(rows, spans, "recording", "t", "s", "e", "inside")
    same(a, lo.plain(lo.covered(plan.mark(rows), spans, "recording", "t", "s", "e", "inside", layout=plan)))
    hits = rows.join(spans, "recording").filter("t BETWEEN s AND e").select("event_id").distinct().count()
    assert a.filter("inside").count() == hits


@pytest.mark.parametrize("probs", [[0.0, 0.25, 0.5, 0.9, 1.0]])
@pytest.mark.parametrize("rule", ["linear", "upper"])
def test_quantiles(rows, probs, rule):
    a = lo.exact_quantiles(rows, "recording", "strength", probs, "q", rule=rule)
    b = lo.exact_quantiles(rows, "recording", "strength", probs, "q", rule=rule, hot_rows=50, run_rows=20)
    want = {r.recording: r.q for r in a.collect()}
    for r in b.collect():
        assert r.q == pytest.approx(want[r.recording], abs=1e-12)


def test_around_finds_every_frame(rows):
    frames = rows.select("recording", F.col("t").alias("ft"), F.col("event_id").alias("fid"))
    got = lo.around(rows, frames, "recording", "t", "ft", 0.5).count()
    want = rows.join(frames, "recording").filter("ft >= t - 0.5D AND ft <= t + 0.5D").count()
    assert got == want


@pytest.mark.parametrize("gap", [0.01, 2.0])
@pytest.mark.parametrize("options", [{}, {"inclusive": False}, {"inclusive": False, "strength": "strength"}])
def test_spacing_in_runs(rows, plan, gap, options):
    a = spaced(rows, "recording", "t", gap, ties=["event_id"], **options)
    b = spaced(plan.mark(rows), "recording", "t", gap, ties=["event_id"], fold_rows=0, **options)
    same(a, b)
    by_key: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (r.t, r.event_id)):
        kept = by_key.setdefault(r.recording, [])
        d = r.t - kept[-1].t if kept else None
        if not kept or (d >= gap if options.get("inclusive", True) else d > gap):
            kept.append(r)
        elif "strength" in options and r.strength > kept[-1].strength:
            kept[-1] = r
    want = sorted(r.event_id for kept in by_key.values() for r in kept)
    assert sorted(r.event_id for r in a.collect()) == want


def test_spacing_without_split_but_large(rows):
    same(spaced(rows, "recording", "t", 0.5, ties=["event_id"]), spaced(rows, "recording", "t", 0.5, ties=["event_id"], fold_rows=0))


@pytest.mark.parametrize("reach", [0.05, 2.0])
def test_bridging_in_runs(rows, plan, reach):
    base = mt.with_nearest_distance(rows.filter("strength <= 0.8"), rows.filter("strength > 0.95"))
    split = plan.mark(base.drop(lo.RUN))
    a = bridged(base, "recording", "t", "distance", 0.01, reach, ties=["event_id"])
    b = bridged(split, "recording", "t", "distance", 0.01, reach, ties=["event_id"], fold_rows=0)
    same(a, b)


def test_metrics_of_a_split_recording(rows, plan):
    a = metrics.rhythm_metrics(iv.dyads(rows, tolerance=0.4))
    b = metrics.rhythm_metrics(iv.dyads(plan.mark(rows), tolerance=0.4))
    same(a, b, 6)


def test_windows_and_detectors_of_a_split_recording(rows, spark):
    f = rows.withColumn("frame", F.col("event_id")).withColumn("rms", F.col("strength")).withColumn("volume", F.col("strength")).withColumn("t", F.col("event_id") * 0.05)
    f = f.withColumn("bins", F.array(F.col("strength"), 1 - F.col("strength"), F.col("strength") * 2)).drop("strength", "event_id")
    part = lo.plan_layout(f, "recording", "frame", hot_rows=100, run_rows=40)
    for name, settings in (("moving_median", {}), ("cfar", {}), ("spectral_flux", {})):
        a, b = dt.detect_onsets(name, f, **settings), dt.detect_onsets(name, part.mark(f), **settings)
        same(a.select("recording", "frame"), b.select("recording", "frame"))
    with pytest.raises(ValueError):
        dt.detect_onsets("no such method", f)
    a = fr.smoothed_envelope(f, 3, target=3, smoothing=0.8, power=1.0, padding_pct=0.0).select("recording", "frame", "peak")
    state, want = {}, {}
    top = {r.recording: r.m for r in f.groupBy("recording").agg(F.max(F.array_max("bins")).alias("m")).collect()}
    for r in sorted(f.collect(), key=lambda r: r.frame):
        old, gap = state.get(r.recording, ([0.0] * 3, None))
        state[r.recording] = ([o * 0.8 + 0.2 * v / top[r.recording] for o, v in zip(old, r.bins)], r.frame)
        want[(r.recording, r.frame)] = max(state[r.recording][0])
    dense = f.filter("recording = 'hot'").withColumn("frame", (F.col("frame") / 3).cast("long"))
    got = fr.smoothed_envelope(dense, 3, target=3, smoothing=0.8, power=1.0, padding_pct=0.0).collect()
    for r in got:
        assert r.peak == pytest.approx(want[("hot", r.frame * 3)], rel=1e-9)
    assert a.count() == f.count()


def test_group_tests_of_split_values(rows, monkeypatch):
    data = rows.withColumn("grp", F.when(F.col("recording") == "hot", "x").otherwise(F.substring("recording", 2, 1))).withColumn("r_k", F.round("strength", 3))
    a = [stats.ks_uniform(data), stats.ks_rest(data), gr.ratio_summary(data, data)]
    a = [sorted(map(tuple, d.collect()), key=str) for d in a]
    real = lo.plan_layout
    small = lambda df, keys, order, **kw: real(df, keys, order, hot_rows=20, run_rows=15)
    for module in (lo, stats, gr):
        monkeypatch.setattr(module, "plan_layout", small, raising=False)
    b = [stats.ks_uniform(data), stats.ks_rest(data), gr.ratio_summary(data, data)]
    b = [sorted(map(tuple, d.collect()), key=str) for d in b]
    for left, right in zip(a, b):
        for l, r in zip(left, right):
            assert l == pytest.approx(r, abs=1e-9) if all(isinstance(v, float) for v in l) else [v if not isinstance(v, float) else round(v, 9) for v in l] == [v if not isinstance(v, float) else round(v, 9) for v in r]


def test_nuclei_of_long_stretches(rows):
    f = rows.select("recording", F.col("event_id").alias("frame"), (F.col("event_id") * 0.05).alias("t"), (F.col("strength") * 20).alias("level_db"),
                    (F.col("strength") > 0.2).alias("voiced"))
    part = lo.plan_layout(f, "recording", "frame", hot_rows=100, run_rows=40)
    settings = {"threshold_db": -12.0, "min_dip_db": 7.0, "min_pause": 0.0}
    a = dt.detect_onsets("intensity_nuclei", f, **settings).select("recording", "frame")
    b = dt.detect_onsets("intensity_nuclei", part.mark(f), fold_rows=0, **settings).select("recording", "frame")
    same(a, b)
    want = []
    for name in {r.recording for r in f.select("recording").distinct().collect()}:
        v = [(r.frame, r.level_db, r.voiced) for r in f.filter(F.col("recording") == name).orderBy("frame").collect()]
        floor = max(x[1] for x in v) - 12.0
        peaks = [i for i in range(1, len(v) - 1) if v[i][1] > v[i - 1][1] and v[i][1] >= v[i + 1][1] and v[i][1] >= floor]
        kept = peaks[:1]
        for j in peaks[1:]:
            low = min(x[1] for x in v[kept[-1]: j + 1])
            if v[kept[-1]][1] - low >= 7.0 and v[j][1] - low >= 7.0:
                kept.append(j)
            elif v[j][1] > v[kept[-1]][1]:
                kept[-1] = j
        want += [(name, v[i][0]) for i in kept if v[i][2]]
    assert sorted(map(tuple, a.collect())) == sorted(want)


def jobs_of(spark, name, make):
    spark.sparkContext.setJobGroup(name, name)
    made = make().collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return made, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_grow_with_the_logarithm_of_the_runs(spark):
    """One key without any wide gap: every run depends on the one before."""
    n = 1_200
    one = spark.range(n).select(F.lit("k").alias("recording"), F.col("id").alias("event_id"), (F.col("id") * 0.1).alias("t"))
    counts = {}
    for runs in (8, 64):
        marked = one.withColumn(lo.RUN, F.floor(F.col("event_id") * runs / n).cast("long") + 1)
        kept, counts[runs] = jobs_of(spark, f"spacing-{runs}", lambda m=marked: spaced(m, "recording", "t", 0.25, ties=["event_id"], fold_rows=0))
        assert sorted(r.event_id for r in kept) == list(range(0, n, 3))
    assert counts[64] < counts[8] + 3 * 14  # three more doublings, not 56 more runs


def test_a_gap_that_spans_many_runs(spark):
    rows = spark.range(600).select(F.lit(None).cast("string").alias("recording"), F.col("id").alias("event_id"), (F.col("id") * 1.0).alias("t"), (F.col("id") * 7 % 600).cast("double").alias("strength"))
    marked = rows.withColumn(lo.RUN, F.floor(F.col("event_id") / 10).cast("long") + 1)
    kept = spaced(marked, "recording", "t", 200.0, ties=["event_id"], fold_rows=0).collect()
    assert sorted(r.event_id for r in kept) == [0, 200, 400]
    same(spaced(marked, "recording", "t", 95.0, inclusive=False, strength="strength", ties=["event_id"], fold_rows=0),
         spaced(rows, "recording", "t", 95.0, inclusive=False, strength="strength", ties=["event_id"]))


def test_long_spans_go_to_few_nodes(spark):
    rng = random.Random(5)
    ranges = [(0, 0), (5, 5), (0, 1 << 20), (-7, 1_000_003), (3, 4)] + [(a, a + rng.randrange(200)) for a in (rng.randrange(-300, 300) for _ in range(60))]
    table = spark.createDataFrame(ranges, "a long, b long").select("a", "b", lo.dyadic_nodes(F.col("a"), F.col("b")).alias("nodes"))
    for r in table.collect():
        assert len(r.nodes) <= 2 * (r.b - r.a + 1).bit_length()
        parts = sorted((n.node << n.level, (n.node + 1) << n.level) for n in r.nodes)
        assert parts[0][0] == r.a and parts[-1][1] == r.b + 1 and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))


def test_frames_within_spans_equal_the_filter(rows):
    spans = rows.filter("event_id % 7 = 0").select("recording", F.col("event_id").alias("span"), (F.col("t") - 1).alias("a"), (F.col("t") + F.pow(F.lit(2.0), F.col("event_id") % 8) - 2).alias("b"))
    frames = rows.select("recording", F.col("event_id").alias("fid"), F.col("t").alias("ft"))
    got = lo.within_spans(spans, frames, "recording", "a", "b", "ft", 0.3).select("span", "fid").collect()
    want = spans.join(frames, "recording").filter("ft BETWEEN a AND b").select("span", "fid").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 1_000


def test_interval_tiers_of_a_split_recording(rows, monkeypatch):
    from tactus.sources import writers as wr

    words = rows.filter("recording IN ('hot', 'r1')").select("recording", F.col("event_id").alias("seq"), F.lit("w").alias("label"), (F.col("event_id") + F.col("strength") * 0.5).alias("start"),
                                                             (F.col("event_id") + 0.9).alias("end"))
    durations = words.groupBy("recording").agg((F.max("end") + 1).alias("duration"))
    points = lo.row_index(words.select("recording", "seq", F.col("start").alias("t")), "recording", "seq", "onset_idx")
    whole = sorted(map(tuple, wr.grid_lines(points, words, durations).collect()))
    monkeypatch.setattr(wr, "lay_out", lambda df, keys, order: lo.lay_out(df, keys, order, hot_rows=100, run_rows=40))
    assert sorted(map(tuple, wr.grid_lines(points, words, durations).collect())) == whole and len(whole) > 3_000
