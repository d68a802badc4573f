"""Designs with aliased columns, long stretches of frames with array columns, updates of unknown recordings."""

import duckdb
import numpy as np
import pytest
import __spark_entry__ as entry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_interaction_with_groups_has_a_unique_fit(spark):
    """A number and its product with every group add up, so one product is aliased; the others equal least squares."""
    from tactus.operators import models

    rng = np.random.default_rng(5)
    x, g = rng.gamma(2, 0.3, 400), rng.choice(["a", "b", "c"], 400, p=[0.5, 0.3, 0.2])
    y = 10 + 3 * x + np.array([{"a": 0, "b": 2, "c": -1}[c] for c in g]) + x * (g == "b") + rng.normal(size=400)
    rows = spark.createDataFrame([(float(b), float(a), str(c), 1.0) for a, b, c in zip(x, y, g)], "y double, x double, grp string, one double")
    found = {r.term: r for r in models.regression(rows, "y ~ x + grp + x:grp").collect()}
    a, b = (g == "a").astype(float), (g == "b").astype(float)  # the rarest group is the reference
    design = np.column_stack([x, a, b, x * a, x * b, np.ones(400)])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    error = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * ((y - design @ beta) ** 2).sum() / 394)
    for term, value, e in zip(["x", "grp_a", "grp_b", "x:grp_a", "x:grp_b", "(Intercept)"], beta, error):
        assert found[term].estimate == pytest.approx(value, rel=1e-6) and found[term].std_error == pytest.approx(e, rel=1e-6)
    assert len(found) == 7 and found["x:grp_c"].estimate is None and found["x:grp_c"].std_error is None
    assert {r.term: r.estimate is None for r in models.regression(rows, "y ~ one").collect()} == {"one": True, "(Intercept)": False}
    assert models.model_comparison(rows, "y ~ x + grp + x:grp", "y ~ x").first().df == 4


@pytest.mark.parametrize("runs", [False, True])
def test_long_stretches_keep_array_columns(spark, runs):
    from tactus.layout import lay_out
    from tactus.operators import detectors as dt

    rng = np.random.default_rng(2)
    level = 60 + 3 * rng.normal(size=900)
    level[::40] -= 30
    rows = spark.createDataFrame([("a", i, i * 0.05, float(v), bool(i % 5), None if i % 7 == 0 else [float(v), 1.0]) for i, v in enumerate(level)],
                                 "recording string, frame long, t double, level_db double, voiced boolean, bins array<double>")
    find = lambda df, **k: {r.frame: r.bins for r in dt.detect_onsets("intensity_nuclei", df, threshold_db=-12.0, min_dip_db=1.0, min_pause=0.1, **k).collect()}
    want = find(rows)
    assert len(want) > 20 and None in want.values()
    assert find(lay_out(rows, "recording", "frame", hot_rows=100, run_rows=150) if runs else rows, fold_rows=1) == want


def test_update_of_recordings_that_are_not_held(spark, tmp_path):
    """Recordings without clicks are in the update alone; the twin lists the held ones."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    events = events.filter("NOT (user_id % 3 = 0 AND event_type = 'click')").withColumn("value", F.col("value") + 150)
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["k3_upsert_adds_columns"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["k3_upsert_adds_columns"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 3


def test_counts_of_replicates_equal_the_draws(spark):
    from tactus.functions.numeric import DRAW_MODULUS, draw
    from tactus.operators import stats

    items, far = [*range(60), 2_147_483_646, 2_147_483_647, 99_999_999_999], 2_000
    table = spark.createDataFrame([(i,) for i in items], "i long").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(far - 1))))
    u = draw(42, F.col("r"), F.col("i")) / F.lit(float(DRAW_MODULUS))
    want = table.select("i", "r", sum((u >= p).cast("int") for p in stats.POISSON_ONE).alias("w")).orderBy("i", "r").toPandas()["w"]
    assert (stats._poisson_counts(42, far, np.array(sorted(items))).ravel() == want.to_numpy()).all()


def test_replicates_are_not_moved(spark, monkeypatch):
    """Keys of one chunk are finished where they are summed, a row each at any number of replicates; keys over several chunks have the same limits."""
    from tactus.operators import stats

    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(k, float(v)) for k, n in (("a", 700), ("b", 50), ("c", 1), (None, 64)) for v in rng.normal(size=n)], "grp string, v double")
    whole = {r.grp: r for r in stats.bootstrap_mean(rows, "v", 200, 7).collect()}
    assert set(whole) == {"a", "b", "c", None}
    monkeypatch.setattr(stats, "CHUNK", 64)
    for r in stats.bootstrap_mean(rows.repartition(3), "v", 200, 7).collect():
        assert (r.ci_low, r.ci_high) == pytest.approx((whole[r.grp].ci_low, whole[r.grp].ci_high), abs=1e-12)
    written, keep = [], stats.settled
    monkeypatch.setattr(stats, "settled", lambda df: written.append(keep(df)) or written[-1])
    monkeypatch.setattr(stats, "CHUNK", 1_000)
    for reps in (20, 2_000):
        assert stats.bootstrap_mean(rows, "v", reps, 7).count() == 4
    assert [df.count() for df in written] == [4, 4] and all(df.filter("_sums IS NULL").count() == 4 for df in written)


def test_permuted_rows_are_scored_in_many_tasks(spark, monkeypatch):
    """Numbering the rows leaves them in one task; scoring must not stay there."""
    from tactus.operators import discriminant as ds

    rows = spark.createDataFrame([(f"r{i}", "ab"[i % 2], float(i % 7), float(i % 5)) for i in range(400)], "recording string, grp string, p double, q double")
    want = ds.permutation_test(rows, "grp", ["p", "q"], permutations=30, mode="leave_one_out").first()
    monkeypatch.setattr(ds, "ROWS", 50)
    parts, apply = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, *a: parts.append(df.rdd.getNumPartitions()) or apply(df, *a))
    assert ds.permutation_test(rows, "grp", ["p", "q"], permutations=30, mode="leave_one_out").first() == want
    assert parts and min(parts) == 4


def test_sessions_share_calls(spark, tmp_path):
    """Calls of the streamed comparison follow the bundles, not the sessions; the events are those of the batch query."""
    from tactus.streaming import sessions as ss

    names = "session_id string, seq long, asset_id string, path string, revision_id string, status string, playhead long, selection string"
    rows = [(f"s{i % 40}", i, "ab"[i % 2], "p", f"rev-{i % 3}", "clean", i % 5 or None, "w") for i in range(400)]
    table = spark.createDataFrame(rows, names)
    want = list(map(tuple, ss.change_events(table).collect()))
    last = spark.createDataFrame([(None, 1_000_000, *[None] * 6)], names)
    for part in (table, last):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(names).parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_seconds(F.col("seq") + 1))
        events = ss.change_event_stream(stream, lateness="1 day", idle_sec=1e9, bundles=3)
        ss.run_to_files(events, f"{tmp_path}/out", f"{tmp_path}/chk")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == sorted(want, key=str)
