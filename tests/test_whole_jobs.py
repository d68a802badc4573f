"""Registered queries and writers do the whole job: full grids, all predictors, one header per document."""

import math

import __spark_entry__ as entry
import numpy as np

SF = "/root/testdata/sf0.001"


def test_densities_cover_the_whole_grid(spark):
    run = lambda name: entry.queries()[name](spark, SF).toPandas()
    one, two = run("g24_kernel_density"), run("g24_kernel_density_2d")
    assert set(one.groupby("grp")["x"].nunique()) == {200} and one["x"].min() == -0.1 and abs(one["x"].max() - 1.1) < 1e-9
    assert set(two.groupby("grp").size()) == {1600} and set(two.groupby("grp")["y"].nunique()) == {40}
    assert all(abs(g["density"].sum() * 1.2 / 199 - 1) < 0.05 for _, g in one.groupby("grp"))


def test_density_sums_equal_brute_force(spark, monkeypatch):
    from tactus.operators import groups as gr

    monkeypatch.setattr(gr, "KERNEL_VALUES", 40)
    rng = np.random.default_rng(1)
    pts = [(g, float(u), float(v)) for g in ("a", "b") for u, v in rng.normal(size=(60, 2))] + [("c", 1.0, 1.0)]
    rows = spark.createDataFrame(pts, "grp string, u double, v double").repartition(3)
    grid = [-1.0, 0.0, 0.5, 2.0]
    found = gr.gaussian_density_2d(rows, "u", "v", grid, grid[:3], factor=0.3).collect()
    assert len(found) == 24
    for r in found:
        xy = np.array([p[1:] for p in pts if p[0] == r.grp])
        cov = np.cov(xy.T) * 0.09
        d = xy - (r.x, r.y)
        want = np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)).mean() / (2 * math.pi * math.sqrt(np.linalg.det(cov)))
        assert abs(r.density - want) < 1e-9


def _brute_force(x, y, classes):
    means = np.array([x[y == c].mean(0) for c in classes])
    within = sum((x[y == c] - m).T @ (x[y == c] - m) for c, m in zip(classes, means)) / (len(x) - len(classes))
    return means, np.linalg.pinv(within + 1e-8 * np.eye(x.shape[1]))


def test_discriminants_use_six_predictors(spark):
    from tactus.plans.q_models import SIX
    from tactus.sources.tables import grouping, onsets

    run = lambda name: entry.queries()[name](spark, SF).toPandas()
    assert len(SIX) == 6 and list(run("g19_discriminant_loadings")["feature"]) == SIX
    rows = run("a1_a2_rhythm_summaries").merge(grouping(spark, SF).toPandas(), on="recording")
    times = onsets(spark, SF, split=False).toPandas().groupby("recording")["t"].apply(np.sort)
    rows["duration_s"] = [times[r][-1] - times[r][0] for r in rows["recording"]]
    rows["mean_ioi_ms"] = [np.diff(times[r]).mean() * 1000 for r in rows["recording"]]
    rows = rows.dropna(subset=[*SIX, "grp"])
    rows = rows[rows.groupby("grp")["grp"].transform("size") >= 3]
    x, y = rows[SIX].to_numpy(float), rows["grp"].to_numpy()
    x, classes = (x - x.mean(0)) / x.std(0), sorted(set(y))
    pick = lambda v, means, inv: classes[np.argmax([m @ inv @ v - m @ inv @ m / 2 for m in means])]
    model = _brute_force(x, y, classes)
    found = run("g17_discriminant_resubstitution").set_index("recording")["predicted"]
    assert dict(found) == {r: pick(v, *model) for r, v in zip(rows["recording"], x)}
    left = [pick(x[i], *_brute_force(np.delete(x, i, 0), np.delete(y, i), classes)) == y[i] for i in range(len(x))]
    loo = run("g17_discriminant_leave_one_out").iloc[0]
    assert loo["n"] == len(x) and abs(loo["ccr"] - np.mean(left)) < 1e-6
    table = run("g19_confusion_matrix").set_index("grp")
    assert all(table.loc[c, p] == ((y == c) & (found[rows["recording"]].to_numpy() == p)).sum() for c in classes for p in classes)


def test_documents_have_one_header_at_any_size(spark):
    from pyspark.sql import functions as F
    from tactus.sources import writers as wr

    n = 10_001
    place = [(F.col("id") * k).cast("double").alias(c) for k, c in enumerate(("t_start", "t_end", "f_low", "f_high"), 1)]
    found = wr.region_manifests(spark.range(n).select(F.lit("a").alias("recording"), F.lit("positive").alias("polarity"), F.lit("base").alias("layer"), *place))
    assert [r.n_regions for r in found.filter("line = 0").collect()] == [n]
    lines = found.filter("line > 0").select("line", F.get_json_object("document", "$.t_start").cast("double").alias("t")).orderBy("line").collect()
    assert [(r.line, r.t) for r in lines] == [(i + 1, float(i)) for i in range(n)]
    windows = spark.createDataFrame([("a", 0, 5), ("a", 1, 7)], "recording string, window_index long, w_frames long")
    events = spark.range(n).select(F.lit("a").alias("recording"), F.lit(0).cast("long").alias("window_index"), F.col("id").cast("double").alias("t"), F.col("id").alias("frame"),
                                   *[F.lit(1.0).alias(c) for c in ("strength", "threshold", "ioi_sec")])
    docs = wr.analysis_payload(spark.createDataFrame([("a", 0.5)], "recording string, low double"), windows, events)
    heads = {r.window_index: r.document for r in docs.filter("line = 0").collect()}
    assert heads == {0: '{"recording":"a","window_index":0,"w_frames":5,"low":0.5}', 1: '{"recording":"a","window_index":1,"w_frames":7,"low":0.5}'}
    assert docs.count() == n + 2
