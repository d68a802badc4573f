"""Queries comparing groups of recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactus.functions.numeric import draw_sql, tidy
from tactus.layout import plain
from tactus.operators import groups as gr
from tactus.operators import intervals as iv
from tactus.operators import metrics, stats
from tactus.plans.q_sequences import SQL_DYADS, SQL_IOI, SQL_METRICS, TOL
from tactus.plans.registry import query
from tactus.session import settled
from tactus.sources.tables import SQL_GROUPS, grouping, onsets, sql_tidy, table

SQL_GD = f"{SQL_DYADS}, {SQL_GROUPS}, gd AS (SELECT d.*, grp, unit FROM d JOIN gm USING (recording)), rk AS (SELECT * FROM gd WHERE r_k > 0 AND r_k < 1)"


def _pairs(spark, sf):
    rows = iv.dyads(onsets(spark, sf), tolerance=TOL, index=False)
    return plain(rows).join(grouping(spark, sf).select("recording", "grp", "unit"), "recording")


def _ratios(spark, sf):
    return iv.valid_ratios(_pairs(spark, sf))


def _rounded(df, *plain_cols, digits=6, **special):
    return df.select(*plain_cols, *[tidy(c, special.get(c, digits)).alias(c) for c in df.columns if c not in plain_cols])


@query("a8_group_ratio_summary", f"""WITH {SQL_GD}, gl AS (SELECT DISTINCT grp FROM gm),
  s AS (SELECT grp, count(*) AS n, avg(r_k) AS m, median(r_k) AS md, stddev_samp(r_k) AS sd, avg((r_k BETWEEN 0.45 AND 0.55)::INT) AS p FROM rk GROUP BY 1)
  SELECT grp, coalesce(n, 0) AS n_events, {sql_tidy('m')} AS mean_r, {sql_tidy('md')} AS median_r, {sql_tidy('sd')} AS std_r, {sql_tidy('p')} AS prop_iso FROM gl LEFT JOIN s USING (grp)""")
def _(spark, sf):
    return _rounded(gr.ratio_summary(_ratios(spark, sf), grouping(spark, sf)), "grp", "n_events")


@query("a9_ratio_histogram_levels", f"""WITH {SQL_GD}, h AS (SELECT grp, recording, CAST(least(floor(r_k * 30), 29) AS INT) AS bin FROM rk),
  c AS (SELECT 'recording' AS level, grp, recording, bin, count(*) AS n FROM h GROUP BY 2, 3, 4 UNION ALL
    SELECT 'group', grp, NULL, bin, count(*) FROM h GROUP BY 2, 4 UNION ALL SELECT 'corpus', NULL, NULL, bin, count(*) FROM h GROUP BY 4)
  SELECT *, {sql_tidy('n * 30.0::DOUBLE / sum(n) OVER (PARTITION BY level, grp, recording)')} AS density FROM c""")
def _(spark, sf):
    rows = gr.ratio_histogram(_ratios(spark, sf), bins=30, density=True)
    return rows.withColumn("density", tidy("density"))


SQL_ISO = """iso AS (SELECT grp, recording, count(*) AS n_events, avg((r_k BETWEEN 0.45 AND 0.55)::INT) AS prop_iso FROM rk GROUP BY 1, 2 HAVING count(*) >= 5)"""


@query("a10_isochrony_by_recording", f"WITH {SQL_GD}, {SQL_ISO} SELECT grp, recording, n_events, {sql_tidy('prop_iso')} AS prop_iso FROM iso")
def _(spark, sf):
    return _rounded(gr.isochrony_by_recording(_ratios(spark, sf)), "grp", "recording", "n_events")


@query("a10_isochrony_by_group", f"""WITH {SQL_GD}, {SQL_ISO} SELECT grp, count(*) AS n_units, {sql_tidy('avg(prop_iso)')} AS mean_prop,
  {sql_tidy('stddev_samp(prop_iso)')} AS sd_prop, {sql_tidy('(0.55 - 0.45)::DOUBLE')} AS chance FROM iso GROUP BY 1""")
def _(spark, sf):
    return _rounded(gr.isochrony_by_group(gr.isochrony_by_recording(_ratios(spark, sf))), "grp", "n_units")


@query("a11_tempo_ratio_density", f"""WITH {SQL_GD}, b AS (SELECT grp, r_k, 120000 / nullif(cycle_ms, 0) AS bpm FROM rk),
  c AS (SELECT grp, CASE WHEN bpm BETWEEN 0 AND 0.01 THEN CAST(least(floor((bpm - 0) / (0.01 / 40)::DOUBLE), 39) AS INT) END AS x_bin, CAST(least(floor(r_k / (1.0 / 40)::DOUBLE), 39) AS INT) AS y_bin FROM b),
  n AS (SELECT grp, x_bin, y_bin, count(*) AS n FROM c WHERE x_bin IS NOT NULL AND grp IN (SELECT grp FROM c GROUP BY 1 HAVING count(*) >= 10) GROUP BY ALL
    UNION ALL SELECT NULL, x_bin, y_bin, count(*) FROM c WHERE x_bin IS NOT NULL GROUP BY ALL)
  SELECT grp, x_bin, y_bin, {sql_tidy('n / sum(n) OVER (PARTITION BY grp)', 9)} AS z FROM n""")
def _(spark, sf):
    rows = iv.with_tempo(_ratios(spark, sf))
    out = gr.tempo_ratio_density(rows, "bpm", x_range=(0.0, 0.01), normalise="per_group")
    return out.withColumn("z", tidy("z", 9))


def _file_metrics(spark, sf):
    rows = metrics.rhythm_metrics(iv.dyads(onsets(spark, sf), tolerance=TOL))
    return settled(rows.join(grouping(spark, sf), "recording"))


SQL_FILES = f"{SQL_METRICS}, {SQL_GROUPS}, fm AS (SELECT m.recording, npvi, cv, rk_std, rk_entropy, n_onsets, grp, unit, mass FROM m JOIN cvs USING (recording) JOIN ent USING (recording) JOIN gm USING (recording))"
SQL_LONG = f"{SQL_FILES}, lg AS (UNPIVOT (SELECT grp, npvi, cv, rk_entropy FROM fm) ON npvi, cv, rk_entropy INTO NAME metric VALUE value)"
THREE = ["npvi", "cv", "rk_entropy"]


@query("a12_group_metric_distribution", f"""WITH {SQL_LONG} SELECT grp, metric, count(*) AS n, {sql_tidy('avg(value)')} AS mean, {sql_tidy('min(value)')} AS low,
  {sql_tidy('quantile_cont(value, 0.25)')} AS q1, {sql_tidy('median(value)')} AS median, {sql_tidy('quantile_cont(value, 0.75)')} AS q3, {sql_tidy('max(value)')} AS high FROM lg GROUP BY 1, 2""")
def _(spark, sf):
    return _rounded(gr.metric_distribution(_file_metrics(spark, sf), THREE), "grp", "metric", "n")


@query("a13_unit_mean_and_median", f"""WITH {SQL_FILES} SELECT unit, {sql_tidy('avg(npvi)')} AS npvi, {sql_tidy('avg(cv)')} AS cv, {sql_tidy('median(rk_entropy)')} AS rk_entropy FROM fm GROUP BY 1""")
def _(spark, sf):
    rows = _file_metrics(spark, sf)
    means = gr.unit_values(rows, ["npvi", "cv"])
    return _rounded(means.join(gr.unit_values(rows, ["rk_entropy"], by="median"), "unit"), "unit")


@query("p15_numeric_listwise_deletion", """WITH e AS (SELECT event_id, value, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE regexp_extract(props, '([0-9]+)', 1) END AS DOUBLE) AS k FROM events)
  SELECT event_id, value, k FROM e WHERE value IS NOT NULL AND k IS NOT NULL""")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value", F.when(F.col("event_type") == "error", "n/a").otherwise(
        F.regexp_extract("props", "([0-9]+)", 1)).alias("k"))
    return gr.numeric_complete(rows, ["value", "k"])


@query("p16_sparse_classes_dropped", f"""WITH {SQL_FILES} SELECT recording, unit FROM fm WHERE unit IN (SELECT unit FROM fm GROUP BY 1 HAVING count(*) >= 6)""")
def _(spark, sf):
    return gr.drop_sparse_classes(_file_metrics(spark, sf), "unit", 6).select("recording", "unit")


@query("p17_standardised_metrics", f"""WITH {SQL_FILES} SELECT recording, {', '.join(f"{sql_tidy(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()')} AS {c}" for c in THREE)} FROM fm""")
def _(spark, sf):
    rows = _file_metrics(spark, sf).select("recording", *THREE)
    return _rounded(gr.standardised(rows, gr.varying(rows, THREE)), "recording")


@query("w37_dispersion_boundary", f"""WITH {SQL_GD}, z AS (SELECT grp, cycle_ms, row_number() OVER o AS pos, stddev_samp(r_k) OVER (o ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS disp,
    count(*) OVER (o ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS n, lead(cycle_ms, 25) OVER o AS centre FROM gd WINDOW o AS (PARTITION BY grp ORDER BY cycle_ms, recording, event_id)),
  h AS (SELECT grp, min_by(centre, pos) AS c, min(pos) AS p FROM z WHERE n = 50 AND disp > 0.27 GROUP BY 1)
  SELECT grp, {sql_tidy('c', 3)} AS boundary_ms, p - 1 + 25 AS boundary_idx FROM (SELECT DISTINCT grp FROM gd) LEFT JOIN h USING (grp)""")
def _(spark, sf):
    rows = gr.dispersion_boundary(_pairs(spark, sf), threshold=0.27)
    return rows.select("grp", tidy("boundary_ms", 3).alias("boundary_ms"), "boundary_idx")


@query("w37_entropy_boundary", f"""WITH {SQL_GD}, w AS (SELECT grp, cycle_ms, row_number() OVER o AS pos, list(least(floor(r_k * 10), 9)) OVER (o ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS bs,
    lead(cycle_ms, 25) OVER o AS centre FROM gd WINDOW o AS (PARTITION BY grp ORDER BY cycle_ms, recording, event_id)),
  u AS (SELECT grp, pos, centre, unnest(bs) AS b FROM w WHERE len(bs) = 50), c AS (SELECT grp, pos, centre, b, count(*) / 50 AS p FROM u GROUP BY ALL),
  e AS (SELECT grp, pos, centre, -sum(p * log2(p)) AS disp FROM c GROUP BY ALL), h AS (SELECT grp, min_by(centre, pos) AS c, min(pos) AS p FROM e WHERE disp > 3.1 GROUP BY 1)
  SELECT grp, {sql_tidy('c', 3)} AS boundary_ms, p - 1 + 25 AS boundary_idx FROM (SELECT DISTINCT grp FROM gd) LEFT JOIN h USING (grp)""")
def _(spark, sf):
    rows = gr.dispersion_boundary(_pairs(spark, sf), threshold=3.1, method="entropy")
    return rows.select("grp", tidy("boundary_ms", 3).alias("boundary_ms"), "boundary_idx")


@query("w38_raster_order", f"""WITH {SQL_GD} SELECT grp, recording, event_id, row_number() OVER (PARTITION BY grp ORDER BY cycle_ms, recording, event_id) - 1 AS y,
  {sql_tidy('-short_ms', 3)} AS x_short, {sql_tidy('long_ms', 3)} AS x_long FROM gd""")
def _(spark, sf):
    rows = gr.raster_order(_pairs(spark, sf))
    return plain(rows).select("grp", "recording", "event_id", "y", tidy("x_short", 3).alias("x_short"), tidy("x_long", 3).alias("x_long"))


@query("t1_group_display_order", f"""WITH {SQL_GROUPS}, g AS (SELECT DISTINCT grp FROM gm)
  SELECT grp, row_number() OVER (ORDER BY CASE grp WHEN 'MACHINERY' THEN 1 WHEN 'ABSENT' THEN 2 WHEN 'BUILDING' THEN 3 ELSE 9 END, grp) AS position FROM g""")
def _(spark, sf):
    return gr.display_order(grouping(spark, sf), ["MACHINERY", "ABSENT", "BUILDING"])


# The whole grids: 200 even points past both ends of the ratios; 40 x 40 points over ratios and tempo between given limits
# (pairs beyond them take no part), as cycles per 1,000 seconds.
EVEN_GRID = [1.2 * i / 199 - 0.1 for i in range(200)]
TEMPO_RANGE = (0.0, 2.0)
TEMPO_GRID, RATIO_GRID = [TEMPO_RANGE[0] + (TEMPO_RANGE[1] - TEMPO_RANGE[0]) * i / 39 for i in range(40)], [i / 39 for i in range(40)]


@query("g24_kernel_density", f"""WITH {SQL_GD}, s AS (SELECT grp, count(*) AS n, stddev_samp(r_k) * count(*) ** -0.2 AS h FROM rk GROUP BY 1)
  SELECT grp, x, {sql_tidy('sum(exp(-0.5::DOUBLE * ((x - r_k) / h) ** 2) / (h * sqrt(2 * pi()) * n))')} AS density
  FROM rk JOIN s USING (grp), (SELECT 1.2::DOUBLE * unnest(range(200)) / 199 - 0.1::DOUBLE AS x) GROUP BY 1, 2""")
def _(spark, sf):
    return _rounded(gr.gaussian_density(_ratios(spark, sf), "r_k", EVEN_GRID), "grp", "x")


@query("g24_kernel_density_2d", f"""WITH {SQL_GD}, q AS (SELECT grp, 1e6 / cycle_ms AS u, r_k FROM rk WHERE 1e6 / cycle_ms BETWEEN {TEMPO_RANGE[0]} AND {TEMPO_RANGE[1]}),
  s AS (SELECT grp, count(*) AS n, var_samp(u) AS vx, var_samp(r_k) AS vy, covar_samp(u, r_k) AS c FROM q GROUP BY 1)
  SELECT grp, x, y, {sql_tidy('sum(exp(-0.5::DOUBLE * (vy * (x - u) ** 2 - 2 * c * (x - u) * (y - r_k) + vx * (y - r_k) ** 2) / ((vx * vy - c * c) * 0.09)) / (2 * pi() * 0.09 * sqrt(vx * vy - c * c) * n))')} AS density
  FROM q JOIN s USING (grp), (SELECT 2.0::DOUBLE * unnest(range(40)) / 39 AS x), (SELECT unnest(range(40)) / 39::DOUBLE AS y) GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = gr.within_range(_ratios(spark, sf).withColumn("u", F.lit(1e6) / F.col("cycle_ms")), "u", TEMPO_RANGE)
    return _rounded(gr.gaussian_density_2d(rows, "u", "r_k", TEMPO_GRID, RATIO_GRID, factor=0.3), "grp", "x", "y")


# Distribution tests

SQL_KS = f"""{SQL_GD}, e AS (SELECT grp, r_k, count(*) OVER (PARTITION BY grp ORDER BY r_k) AS c, row_number() OVER (PARTITION BY grp ORDER BY r_k) AS i, count(*) OVER (PARTITION BY grp) AS n FROM rk)"""


@query("g1_ks_against_uniform", f"""WITH {SQL_KS} SELECT grp, n, {sql_tidy('max(greatest(i / n - r_k, r_k - (i - 1) / n))')} AS d FROM e GROUP BY 1, 2""")
def _(spark, sf):
    return stats.ks_uniform(_ratios(spark, sf)).select("grp", "n", tidy("d").alias("d"))


@query("g1_ks_against_uniform_p_value")
def _(spark, sf):
    return stats.ks_uniform(_ratios(spark, sf)).select("grp", "n", tidy("d").alias("d"), tidy("p", 9).alias("p"))


SQL_KS2 = f"""{SQL_GD}, gs AS (SELECT DISTINCT grp AS g FROM rk), v AS (SELECT DISTINCT r_k AS x FROM rk),
  k AS (SELECT grp, r_k, count(*) AS c FROM rk GROUP BY 1, 2),
  gx AS (SELECT g, x, coalesce(sum(c) FILTER (grp = g), 0) AS own, coalesce(sum(c) FILTER (grp <> g), 0) AS oth FROM gs, v LEFT JOIN k ON k.r_k = v.x GROUP BY 1, 2),
  cu AS (SELECT g, x, sum(own) OVER w / sum(own) OVER p AS fg, sum(oth) OVER w / sum(oth) OVER p AS fr, sum(own) OVER p AS n, sum(oth) OVER p AS n_rest FROM gx
    WINDOW w AS (PARTITION BY g ORDER BY x), p AS (PARTITION BY g)),
  rn AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(fg - fr) DESC, x) AS k FROM cu)"""


@query("g2_g3_ks_against_rest_and_point", f"""WITH {SQL_KS2} SELECT g AS grp, n::BIGINT AS n, n_rest::BIGINT AS n_rest, {sql_tidy('abs(fg - fr)')} AS d, {sql_tidy('x')} AS at, {sql_tidy('fg')} AS f_group, {sql_tidy('fr')} AS f_rest FROM rn WHERE k = 1""")
def _(spark, sf):
    return _rounded(stats.ks_rest(_ratios(spark, sf)).drop("p"), "grp", "n", "n_rest")


# A null sample from another table: quantities as shares of the largest one and one more.
SQL_NULL = f"""{SQL_GD}, nl AS (SELECT l_quantity / 51.0::DOUBLE AS x FROM lineitem WHERE l_quantity IS NOT NULL), pt AS (SELECT DISTINCT x FROM (SELECT x FROM nl UNION ALL SELECT r_k FROM rk WHERE r_k IS NOT NULL)),
  nc AS (SELECT x, count(*) AS c FROM nl GROUP BY 1), gc AS (SELECT grp, r_k AS x, count(*) AS c FROM rk WHERE r_k IS NOT NULL GROUP BY 1, 2),
  cd AS (SELECT g.grp, pt.x, sum(coalesce(gc.c, 0)) OVER w / sum(coalesce(gc.c, 0)) OVER p AS fg, sum(coalesce(nc.c, 0)) OVER w / sum(coalesce(nc.c, 0)) OVER p AS fn, sum(coalesce(gc.c, 0)) OVER p AS n, sum(coalesce(nc.c, 0)) OVER p AS n_null
    FROM (SELECT DISTINCT grp FROM gc) g CROSS JOIN pt LEFT JOIN gc ON gc.grp = g.grp AND gc.x = pt.x LEFT JOIN nc ON nc.x = pt.x WINDOW w AS (PARTITION BY g.grp ORDER BY pt.x), p AS (PARTITION BY g.grp))"""


@query("g2_ks_against_given_null", f"""WITH {SQL_NULL} SELECT grp, n::BIGINT AS n, n_null::BIGINT AS n_null, {sql_tidy('max(abs(fg - fn))')} AS d, {sql_tidy('greatest(max(fg - fn), 0)')} AS d_greater, {sql_tidy('greatest(max(fn - fg), 0)')} AS d_less FROM cd GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows, null = _ratios(spark, sf), table(spark, sf, "lineitem").select((F.col("l_quantity") / 51.0).alias("r_k"))
    one = lambda alternative, name: stats.ks_against(rows, null, alternative=alternative).select("grp", "n", "n_null", tidy("d").alias(name))
    return one("two-sided", "d").join(one("greater", "d_greater"), ["grp", "n", "n_null"]).join(one("less", "d_less"), ["grp", "n", "n_null"])


@query("g2_resampled_null_distance")
def _(spark, sf):
    rows = _ratios(spark, sf)
    null = stats.resample_rest(rows, 10_000, 42)
    own = rows.groupBy("grp", "r_k").agg(F.count(F.lit(1)).alias("n")).withColumn("_own", F.lit(True))
    both = own.unionByName(null.withColumn("_own", F.lit(False)))
    both = both.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    out = stats.two_samples(both, "grp", "r_k", F.col("_own"))
    return out.select("grp", "n_a", "n_b", tidy("d").alias("d"))


SQL_WIL = f"""{SQL_GD}, {SQL_ISO}, df AS (SELECT grp, prop_iso - 0.1::DOUBLE AS d FROM iso), nz AS (SELECT grp, d, rank() OVER (PARTITION BY grp ORDER BY abs(d)) AS rk0, count(*) OVER (PARTITION BY grp, abs(d)) AS t FROM df WHERE d <> 0),
  v AS (SELECT grp, sum(rk0 + (t - 1) / 2) FILTER (d > 0) AS vp, sum(rk0 + (t - 1) / 2) FILTER (d < 0) AS vm FROM nz GROUP BY 1)"""


@query("g4_wilcoxon_signed_rank", f"""WITH {SQL_WIL}, n AS (SELECT grp, count(*) AS n_units FROM df GROUP BY 1)
  SELECT grp, n_units, CASE WHEN n_units >= 2 THEN least(coalesce(vp, 0), coalesce(vm, 0)) END AS v FROM n LEFT JOIN v USING (grp)""")
def _(spark, sf):
    return stats.signed_rank(gr.isochrony_by_recording(_ratios(spark, sf)), "prop_iso", 0.1).select("grp", "n_units", "v")


def sql_erfc(x: str) -> str:
    """Complementary error function of a non-negative number by its power series."""
    x = f"greatest({x}, 1e-12)"
    series = f"list_sum(list_transform(range(0, 90), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln({x}) - lgamma(k + 1)) / (2 * k + 1)))"
    return f"CASE WHEN {x} > 4.5 THEN 0 ELSE 1 - 2 / sqrt(pi()) * {series} END"


def sql_adjusted(tests: str, within: str = "") -> str:
    """Step-up adjustment over the tests with a p-value, and the marks."""
    part = f"PARTITION BY {within} " if within else ""
    return f"""aj AS (SELECT *, least(1, min(p * m / i) OVER ({part}ORDER BY p DESC, i DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM
    (SELECT *, row_number() OVER ({part}ORDER BY p) AS i, count(*) OVER ({part}) AS m FROM {tests}))"""


SQL_MARK = "CASE WHEN p_adj < 0.001 THEN '***' WHEN p_adj < 0.01 THEN '**' WHEN p_adj < 0.05 THEN '*' ELSE '' END AS mark"


# Without ties the exact law applies: the number of subsets of the ranks with each sum.
@query("g4_g6_g25_wilcoxon_p_adjusted", f"""WITH RECURSIVE {SQL_WIL}, dp AS (SELECT 0 AS r, [1.0::DOUBLE] AS w UNION ALL
    SELECT r + 1, list_transform(range(1, (r + 1) * (r + 2) // 2 + 2), lambda s: coalesce(w[s], 0) + CASE WHEN s > r + 1 THEN coalesce(w[s - (r + 1)], 0) ELSE 0 END) FROM dp WHERE r < 50), tt AS (SELECT grp, count(*) AS n, sum(t * t - 1) AS ties FROM nz GROUP BY 1),
  zz AS (SELECT grp, vp, n, ties, (coalesce(vp, 0) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM v JOIN tt USING (grp)),
  pp AS (SELECT grp, vp AS v, CASE WHEN ties = 0 AND n <= 50 THEN list_sum(list_slice(w, CAST(ceil(vp) AS INT) + 1, len(w))) / 2 ** n WHEN z >= 0 THEN 0.5 * ({sql_erfc('abs(z) / sqrt(2)')}) ELSE 1 - 0.5 * ({sql_erfc('abs(z) / sqrt(2)')}) END AS p FROM zz LEFT JOIN dp ON dp.r = n), {sql_adjusted('pp')}
  SELECT grp, v, {sql_tidy('p')} AS p, {sql_tidy('p_adj')} AS p_adj, {SQL_MARK} FROM aj""")
def _(spark, sf):
    tests = stats.signed_rank(gr.isochrony_by_recording(_ratios(spark, sf)), "prop_iso", 0.1, alternative="greater")
    rows = stats.adjusted(tests, "fdr_bh").withColumn("mark", stats.stars(F.col("p_adj")))
    return rows.select("grp", "v", tidy("p").alias("p"), tidy("p_adj").alias("p_adj"), "mark")


@query("g5_bootstrap_mean_interval", f"""WITH {SQL_GD}, {SQL_ISO}, q AS (SELECT grp, prop_iso, row_number() OVER (PARTITION BY grp ORDER BY prop_iso) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM iso),
  dr AS (SELECT grp, rep, prop_iso, {stats.poisson_sql(draw_sql(42, 'rep', 'pos'))} AS w FROM q, (SELECT unnest(range(2000)) AS rep)),
  bm AS (SELECT grp, rep, sum(w * prop_iso) / sum(w) AS m FROM dr GROUP BY 1, 2 HAVING sum(w) > 0)
  SELECT grp, {sql_tidy('quantile_cont(m, 0.025)')} AS ci_low, {sql_tidy('quantile_cont(m, 0.975)')} AS ci_high FROM bm GROUP BY 1""")
def _(spark, sf):
    return _rounded(stats.bootstrap_mean(gr.isochrony_by_recording(_ratios(spark, sf)), "prop_iso", 2_000, 42), "grp")


# Multiple comparison, on one z-test per recording of the mean ratio against one half.
SQL_Z = f"""{SQL_DYADS}, zt AS (SELECT recording, least(1.0, exp(-abs(avg(r_k) - 0.5) * sqrt(count(*)) / stddev_samp(r_k))) AS p FROM d GROUP BY 1),
  zr AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM zt)"""


def _z_tests(spark, sf):
    rows = iv.dyads(onsets(spark, sf), tolerance=TOL, index=False)
    z = F.abs(F.avg("r_k") - 0.5) * F.sqrt(F.count(F.lit(1)).cast("double")) / F.stddev_samp("r_k")
    return rows.groupBy("recording").agg(F.least(F.lit(1.0), F.exp(-z)).alias("p"))


@query("g6_bonferroni", f"WITH {SQL_Z} SELECT recording, {sql_tidy('least(1, p * m)')} AS p_adj FROM zr")
def _(spark, sf):
    return stats.adjusted(_z_tests(spark, sf), "bonferroni").select("recording", tidy("p_adj").alias("p_adj"))


@query("g6_benjamini_hochberg", f"""WITH {SQL_Z}, b AS (SELECT recording, p, least(1, min(p * m / i) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS a FROM zr)
  SELECT recording, {sql_tidy('a')} AS p_adj, CASE WHEN a < 0.001 THEN '***' WHEN a < 0.01 THEN '**' WHEN a < 0.05 THEN '*' ELSE '' END AS mark FROM b""")
def _(spark, sf):
    rows = stats.adjusted(_z_tests(spark, sf), "fdr_bh")
    return rows.select("recording", tidy("p_adj").alias("p_adj"), stats.stars(F.col("p_adj")).alias("mark"))


SQL_PAIRS = f"""{SQL_LONG}, pr AS (SELECT a.grp AS group_a, b.grp AS group_b FROM (SELECT DISTINCT grp FROM fm) a, (SELECT DISTINCT grp FROM fm) b WHERE a.grp < b.grp),
  al AS (SELECT metric, group_a, group_b, value, grp = group_a AS fa FROM lg JOIN pr ON grp = group_a OR grp = group_b),
  rk2 AS (SELECT *, rank() OVER (PARTITION BY metric, group_a, group_b ORDER BY value) + (count(*) OVER (PARTITION BY metric, group_a, group_b, value) - 1) / 2 AS r,
    count(*) FILTER (fa) OVER (PARTITION BY metric, group_a, group_b ORDER BY value) / count(*) FILTER (fa) OVER (PARTITION BY metric, group_a, group_b) AS f1,
    count(*) FILTER (NOT fa) OVER (PARTITION BY metric, group_a, group_b ORDER BY value) / count(*) FILTER (NOT fa) OVER (PARTITION BY metric, group_a, group_b) AS f2 FROM al)"""


@query("g7_pairwise_rank_and_ks_statistics", f"""WITH {SQL_PAIRS} SELECT metric, group_a, group_b, count(*) FILTER (fa) AS n_a, count(*) FILTER (NOT fa) AS n_b,
  sum(r) FILTER (fa) - count(*) FILTER (fa) * (count(*) FILTER (fa) + 1) / 2 AS u, {sql_tidy('max(abs(f1 - f2))')} AS d FROM rk2 GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = stats.pairwise(_file_metrics(spark, sf), THREE)
    return rows.select("metric", "group_a", "group_b", "n_a", "n_b", "u", tidy("d").alias("d"))


@query("g7_pairwise_p_values", f"""WITH {SQL_PAIRS}, us AS (SELECT metric, group_a, group_b, count(*) FILTER (fa) AS na, count(*) FILTER (NOT fa) AS nb, sum(r) FILTER (fa) - count(*) FILTER (fa) * (count(*) FILTER (fa) + 1) / 2 AS u FROM rk2 GROUP BY 1, 2, 3),
  pp AS (SELECT metric, group_a, group_b, least(1, {sql_erfc('greatest(0, greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sqrt(na * nb * (na + nb + 1) / 12) / sqrt(2)')}) AS p FROM us), {sql_adjusted('pp', 'metric')}
  SELECT metric, group_a, group_b, {sql_tidy('p')} AS p, {sql_tidy('p_adj')} AS p_adj, {SQL_MARK} FROM aj""")
def _(spark, sf):
    rows = stats.pairwise(_file_metrics(spark, sf), THREE)
    return rows.select("metric", "group_a", "group_b", tidy("p").alias("p"), tidy("p_adj").alias("p_adj"), stats.stars(F.col("p_adj")).alias("mark"))


@query("g7_pairwise_ks_p_values")
def _(spark, sf):
    rows = stats.pairwise(_file_metrics(spark, sf), THREE, test="ks", correction="bonferroni")
    return rows.select("metric", "group_a", "group_b", tidy("p").alias("p"), tidy("p_adj").alias("p_adj"))


# Autocorrelation

SQL_LAG = f"""{SQL_IOI}, {SQL_GROUPS}, q AS (SELECT recording, ioi_ms, row_number() OVER w - 1 AS i FROM i WHERE ioi_ms IS NOT NULL {{W}}),
  dt AS (SELECT recording, i, count(*) OVER (PARTITION BY recording) AS n, ioi_ms - (regr_slope(ioi_ms, i) OVER (PARTITION BY recording) * i + regr_intercept(ioi_ms, i) OVER (PARTITION BY recording)) AS a FROM q),
  pp AS (SELECT recording, n, a, lead(a) OVER (PARTITION BY recording ORDER BY i) AS b FROM dt WHERE n >= 5),
  lg AS (SELECT recording, any_value(n) AS n_intervals, count(*) AS n_pairs, corr(a, b) AS r FROM pp WHERE b IS NOT NULL GROUP BY 1)""".replace("{W}", "WINDOW w AS (PARTITION BY recording ORDER BY t, event_id)")
Q975 = 1.959963984540054


def _lag_pairs(spark, sf, detrend="linear"):
    return stats.interval_pairs(iv.with_ioi(onsets(spark, sf)), detrend=detrend)


@query("g8_lag_one_autocorrelation", f"WITH {SQL_LAG} SELECT recording, n_intervals, n_pairs, {sql_tidy('r')} AS r_lag1 FROM lg")
def _(spark, sf):
    return _rounded(stats.lag_one(_lag_pairs(spark, sf)), "recording", "n_intervals", "n_pairs")


@query("g9_fisher_interval", f"""WITH {SQL_LAG} SELECT recording, {sql_tidy(f'tanh(atanh(r) - {Q975} / sqrt(n_pairs - 3))')} AS ci_low, {sql_tidy(f'tanh(atanh(r) + {Q975} / sqrt(n_pairs - 3))')} AS ci_high FROM lg""")
def _(spark, sf):
    return _rounded(stats.fisher_interval(stats.lag_one(_lag_pairs(spark, sf))).select("recording", "ci_low", "ci_high"), "recording")


@query("g9_bootstrap_pair_interval", f"""WITH {SQL_LAG.replace("ioi_ms - (regr_slope(ioi_ms, i) OVER (PARTITION BY recording) * i + regr_intercept(ioi_ms, i) OVER (PARTITION BY recording)) AS a", "ioi_ms - avg(ioi_ms) OVER (PARTITION BY recording) AS a")},
  ps AS (SELECT recording, a, b, row_number() OVER (PARTITION BY recording ORDER BY a, b) - 1 AS pos, count(*) OVER (PARTITION BY recording) AS m FROM pp WHERE b IS NOT NULL),
  sd AS (SELECT recording, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM ps GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0),
  un AS (SELECT recording, pos, (a - ma) / sa AS a, (b - mb) / sb AS b FROM ps JOIN sd USING (recording)),
  dr AS (SELECT *, {stats.poisson_sql(draw_sql(42, 'rep', 'pos'))} AS w FROM un, (SELECT unnest(range(1000)) AS rep)),
  sm AS (SELECT recording, rep, sum(w * a) / sum(w) AS xa, sum(w * b) / sum(w) AS xb, sum(w * a * a) / sum(w) AS aa, sum(w * b * b) / sum(w) AS bb, sum(w * a * b) / sum(w) AS ab FROM dr GROUP BY 1, 2 HAVING sum(w) > 0),
  rs AS (SELECT recording, rep, (ab - xa * xb) / sqrt((aa - xa * xa) * (bb - xb * xb)) AS r FROM sm WHERE aa - xa * xa > 1e-15 AND bb - xb * xb > 1e-15)
  SELECT recording, {sql_tidy('quantile_cont(r, 0.025)')} AS ci_low, {sql_tidy('quantile_cont(r, 0.975)')} AS ci_high FROM rs GROUP BY 1""")
def _(spark, sf):
    return _rounded(stats.bootstrap_lag_one(_lag_pairs(spark, sf, "mean"), 1_000, 42), "recording")


@query("g10_pooled_autocorrelation", f"""WITH {SQL_LAG}, z AS (SELECT grp, count(*) AS n_files, sum(atanh(r) * greatest(n_pairs - 3, 1)) / sum(greatest(n_pairs - 3, 1)) AS z, 1 / sqrt(sum(greatest(n_pairs - 3, 1))) AS se FROM lg JOIN gm USING (recording) GROUP BY 1)
  SELECT grp, n_files, {sql_tidy('tanh(z)')} AS r_lag1_zmean, {sql_tidy(f'tanh(z - {Q975} * se)')} AS ci_low, {sql_tidy(f'tanh(z + {Q975} * se)')} AS ci_high FROM z""")
def _(spark, sf):
    rows = stats.lag_one(_lag_pairs(spark, sf)).join(grouping(spark, sf).select("recording", "grp"), "recording")
    return _rounded(stats.pooled_lag_one(rows), "grp", "n_files")
