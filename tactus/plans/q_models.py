"""Queries for mining, matrix correlation, classification and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactus.functions.numeric import wide_draw_sql, tidy
from tactus.operators import discriminant as ds
from tactus.operators import distance as di
from tactus.operators import groups as gr
from tactus.operators import mining, models, profiles
from tactus.plans.q_frames import _regions
from tactus.plans.q_groups import SQL_FILES, THREE, _file_metrics, _rounded
from tactus.plans.registry import query
from tactus.session import settled
from tactus.sources.tables import frames, onsets, sql_tidy, table

LABELS = ["low", "mid", "high"]
_ITEM = lambda c: f"'{c}=' || CASE WHEN {c} >= quantile_cont({c}, 2 / 3) OVER () THEN 'high' WHEN {c} >= quantile_cont({c}, 1 / 3) OVER () THEN 'mid' ELSE 'low' END"
SQL_TX = f"{SQL_FILES}, tx AS (SELECT recording, list_sort([{', '.join(_ITEM(c) for c in THREE)}, 'Group=' || grp]) AS items FROM fm)"
SQL_SETS = f"""{SQL_TX}, sb AS (SELECT recording, list_filter(items, lambda x, i: (m >> (i - 1)) % 2 = 1) AS s FROM tx, (SELECT unnest(range(1, 16)) AS m)),
  fi AS (SELECT array_to_string(s, ' & ') AS itemset, len(s) AS size, count(*) / (SELECT count(*) FROM tx) AS support FROM sb GROUP BY 1, 2 HAVING count(*) / (SELECT count(*) FROM tx) >= 0.08)"""


def _tx(spark, sf):
    rows = _file_metrics(spark, sf)
    return mining.transactions(rows, mining.bin_edges(rows, THREE, 3), LABELS, group="grp")


def _sets(spark, sf):
    return settled(mining.frequent_itemsets(_tx(spark, sf), min_support=0.08))


@query("g11_items_from_bins", f"WITH {SQL_TX} SELECT recording, array_to_string(items, ', ') AS items FROM tx")
def _(spark, sf):
    return _tx(spark, sf).select("recording", F.array_join(F.array_sort("items"), ", ").alias("items"))


@query("g12_t3_frequent_itemsets", f"WITH {SQL_SETS} SELECT itemset, CAST(size AS INT) AS size, {sql_tidy('support')} AS support FROM fi")
def _(spark, sf):
    return mining.itemset_order(_sets(spark, sf)).select(F.array_join("items", " & ").alias("itemset"), "size", tidy("support").alias("support"))


SQL_RULES = f"""{SQL_SETS}, sp AS (SELECT string_split(itemset, ' & ') AS its, support FROM fi WHERE size >= 2),
  ru AS (SELECT support, len(its) AS size, array_to_string(list_filter(its, lambda x, i: (m >> (i - 1)) % 2 = 1), ' & ') AS antecedent, array_to_string(list_filter(its, lambda x, i: (m >> (i - 1)) % 2 = 0), ' & ') AS consequent FROM sp, (SELECT unnest(range(1, 15)) AS m) WHERE m < (1 << len(its)) - 1),
  rl AS (SELECT antecedent, consequent, ru.size, ru.support, ru.support / a.support AS confidence, ru.support / a.support / c.support AS lift FROM ru JOIN fi a ON a.itemset = antecedent JOIN fi c ON c.itemset = consequent
    WHERE ru.support / a.support >= 0.5 AND ru.support / a.support / c.support >= 1.1)"""


@query("g13_association_rules", f"WITH {SQL_RULES} SELECT antecedent, consequent, CAST(size AS INT) AS size, {sql_tidy('support')} AS support, {sql_tidy('confidence')} AS confidence, {sql_tidy('lift')} AS lift FROM rl")
def _(spark, sf):
    rows = mining.rules(_sets(spark, sf), min_confidence=0.5)
    return rows.select("antecedent", "consequent", "size", *[tidy(c).alias(c) for c in ("support", "confidence", "lift")])


@query("t2_top_rules", f"WITH {SQL_RULES} SELECT antecedent, consequent, {sql_tidy('lift')} AS lift FROM (SELECT * FROM rl ORDER BY round(lift, 9) DESC, round(confidence, 9) DESC, round(support, 9) DESC, antecedent, consequent LIMIT 15)")
def _(spark, sf):
    rows = mining.rules(_sets(spark, sf), min_confidence=0.5)
    rows = rows.withColumns({c: F.round(c, 9) for c in ("lift", "confidence", "support")})
    return mining.top_rules(rows, 15).select("antecedent", "consequent", tidy("lift").alias("lift"))


# Units with invented places: coordinates follow the nation number.
SQL_UNITS = f"""{SQL_FILES}, un AS (SELECT n_name AS unit, (n_nationkey * 37 % 120 - 60)::DOUBLE AS lat, (n_nationkey * 53 % 300 - 150)::DOUBLE AS lon, avg(npvi) AS npvi, avg(cv) AS cv, avg(rk_entropy) AS rk_entropy, avg(mass) AS mass FROM fm JOIN nation ON n_name = unit GROUP BY 1, 2, 3),
  pa AS (SELECT a.unit AS unit_a, b.unit AS unit_b, abs(a.npvi - b.npvi) AS dm, sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2) AS dp, abs(a.mass - b.mass) AS dc,
    2 * 6371.0 * asin(sqrt(least(1, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))) AS dg FROM un a JOIN un b ON a.unit < b.unit)"""


def _units(spark, sf):
    n = table(spark, sf, "nation")
    places = n.select(F.col("n_name").alias("unit"), (F.col("n_nationkey") * 37 % 120 - 60).cast("double").alias("lat"),
                      (F.col("n_nationkey") * 53 % 300 - 150).cast("double").alias("lon"))
    return settled(gr.unit_values(_file_metrics(spark, sf), [*THREE, "mass"]).join(places, "unit"))


@query("g14_metric_and_geographic_distances", f"WITH {SQL_UNITS} SELECT unit_a, unit_b, {sql_tidy('dm')} AS metric, {sql_tidy('dg')} AS km, {sql_tidy('dp')} AS planar FROM pa")
def _(spark, sf):
    u = _units(spark, sf)
    rows = di.metric_distances(u, "npvi").withColumnRenamed("d", "metric")
    rows = rows.join(di.geographic_distances(u).withColumnRenamed("d", "km"), ["unit_a", "unit_b"])
    return _rounded(rows.join(di.geographic_distances(u, planar=True).withColumnRenamed("d", "planar"), ["unit_a", "unit_b"]), "unit_a", "unit_b")


@query("g14_multivariate_distances", f"""WITH {SQL_UNITS}, z AS (SELECT unit, {', '.join(f'({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-12) AS {c}' for c in THREE)} FROM un)
  SELECT a.unit AS unit_a, b.unit AS unit_b, {sql_tidy('sqrt(' + ' + '.join(f'(a.{c} - b.{c}) ** 2' for c in THREE) + ')')} AS d FROM z a JOIN z b ON a.unit < b.unit""")
def _(spark, sf):
    return _rounded(di.multivariate_distances(_units(spark, sf), THREE), "unit_a", "unit_b")


# Names of the units and groups of the provided tables.
NATIONS = [f"NATION_{i}" for i in range(25)]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("k12_wide_distance_matrix", f"""WITH {SQL_UNITS}, bo AS (SELECT unit_a, unit_b, {sql_tidy('dp', 3)} AS d FROM pa UNION ALL SELECT unit_b, unit_a, {sql_tidy('dp', 3)} FROM pa UNION ALL SELECT unit, unit, 0 FROM un)
  SELECT unit_a, {', '.join(f"max(d) FILTER (unit_b = '{u}') AS {u}" for u in NATIONS)} FROM bo GROUP BY 1""")
def _(spark, sf):
    rows = di.geographic_distances(_units(spark, sf), planar=True)
    return di.wide_matrix(rows.withColumn("d", tidy("d", 3)), NATIONS)


SQL_SWAP = f"""ui AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS i FROM un), pm AS (SELECT perm, unit, row_number() OVER (PARTITION BY perm ORDER BY {wide_draw_sql(42, 'perm', 'i')}, i) - 1 AS at FROM ui, (SELECT unnest(range(1, 1000)) AS perm)),
  sw AS (SELECT perm, pm.unit, ui.unit AS si FROM pm JOIN ui ON ui.i = pm.at)"""


def sql_permuted(a: str, b: str) -> str:
    return f"""mv AS (SELECT s.perm, p.unit_a, p.unit_b, p.{a} AS d, q.{b} AS db, p.dc FROM pa p JOIN sw s ON s.unit = p.unit_a JOIN sw t ON t.perm = s.perm AND t.unit = p.unit_b JOIN pa q ON q.unit_a = least(s.si, t.si) AND q.unit_b = greatest(s.si, t.si)
    UNION ALL SELECT 0, unit_a, unit_b, {a}, {b}, dc FROM pa)"""


@query("g15_mantel", f"""WITH {SQL_UNITS}, {SQL_SWAP}, {sql_permuted('dm', 'dg')}, r AS (SELECT perm, corr(d, db) AS r FROM mv GROUP BY 1), b AS (SELECT r AS ro FROM r WHERE perm = 0)
  SELECT {sql_tidy('ro')} AS r_obs, {sql_tidy('(count(*) FILTER (r >= ro) + 1) / (count(*) + 1)')} AS p FROM r, b WHERE perm > 0 GROUP BY ro""")
def _(spark, sf):
    u = _units(spark, sf)
    return _rounded(di.mantel(di.metric_distances(u, "npvi"), di.geographic_distances(u), permutations=999))


@query("g15_mantel_spearman_two_sided", f"""WITH {SQL_UNITS}, {SQL_SWAP}, p2 AS (SELECT unit_a, unit_b, rank() OVER (ORDER BY dm) + (count(*) OVER (PARTITION BY dm) - 1) / 2 AS dm, rank() OVER (ORDER BY dg) + (count(*) OVER (PARTITION BY dg) - 1) / 2 AS dg, dc FROM pa),
  {sql_permuted('dm', 'dg').replace('pa p', 'p2 p').replace('pa q', 'p2 q').replace('FROM pa)', 'FROM p2)')}, r AS (SELECT perm, corr(d, db) AS r FROM mv GROUP BY 1), b AS (SELECT r AS ro FROM r WHERE perm = 0)
  SELECT {sql_tidy('ro')} AS r_obs, {sql_tidy('(count(*) FILTER (abs(r) >= abs(ro)) + 1) / (count(*) + 1)')} AS p FROM r, b WHERE perm > 0 GROUP BY ro""")
def _(spark, sf):
    u = _units(spark, sf)
    return _rounded(di.mantel(di.metric_distances(u, "npvi"), di.geographic_distances(u), permutations=999, method="spearman", alternative="two-sided"))


@query("g16_partial_mantel", f"""WITH {SQL_UNITS}, {SQL_SWAP}, {sql_permuted('dm', 'dg')}, rs AS (SELECT perm, d - regr_slope(d, dc) OVER p * dc AS ra, db - regr_slope(db, dc) OVER p * dc AS rb FROM mv WINDOW p AS (PARTITION BY perm)),
  r AS (SELECT perm, corr(ra, rb) AS r FROM rs GROUP BY 1), b AS (SELECT r AS ro FROM r WHERE perm = 0)
  SELECT {sql_tidy('ro')} AS r_obs, {sql_tidy('(count(*) FILTER (r >= ro) + 1) / (count(*) + 1)')} AS p FROM r, b WHERE perm > 0 GROUP BY ro""")
def _(spark, sf):
    u = _units(spark, sf)
    return _rounded(di.partial_mantel(di.metric_distances(u, "npvi"), di.geographic_distances(u), di.metric_distances(u, "mass"), permutations=999))


@query("g16_partial_mantel_spearman", f"""WITH {SQL_UNITS}, {SQL_SWAP}, p2 AS (SELECT unit_a, unit_b, {', '.join(f'rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}' for c in ('dm', 'dg', 'dc'))} FROM pa),
  {sql_permuted('dm', 'dg').replace('pa p', 'p2 p').replace('pa q', 'p2 q').replace('FROM pa)', 'FROM p2)')}, rs AS (SELECT perm, d - regr_slope(d, dc) OVER p * dc AS ra, db - regr_slope(db, dc) OVER p * dc AS rb FROM mv WINDOW p AS (PARTITION BY perm)),
  r AS (SELECT perm, corr(ra, rb) AS r FROM rs GROUP BY 1), b AS (SELECT r AS ro FROM r WHERE perm = 0)
  SELECT {sql_tidy('ro')} AS r_obs, {sql_tidy('(count(*) FILTER (r >= ro) + 1) / (count(*) + 1)')} AS p FROM r, b WHERE perm > 0 GROUP BY ro""")
def _(spark, sf):
    u = _units(spark, sf)
    return _rounded(di.partial_mantel(di.metric_distances(u, "npvi"), di.geographic_distances(u), di.metric_distances(u, "mass"), permutations=999, method="spearman"))


# Classification

SIX = ["n_onsets", "duration_s", "npvi", "cv", "rk_entropy", "mean_ioi_ms"]


def _six(spark, sf):
    """Complete rows of classes with three or more, the varying ones of the six predictors standardised; and their names."""
    t = onsets(spark, sf, split=False)
    spans = t.groupBy("recording").agg((F.max("t") - F.min("t")).alias("duration_s"), (F.count("t") - 1).alias("_gaps"))
    rows = _file_metrics(spark, sf).join(spans, "recording").withColumn("mean_ioi_ms", F.col("duration_s") * 1000 / F.nullif(F.col("_gaps"), F.lit(0)))
    rows = gr.numeric_complete(rows.select("recording", "grp", "unit", *SIX), SIX).filter("grp IS NOT NULL")
    rows = settled(gr.drop_sparse_classes(rows, "grp", 3))
    found = gr.varying(rows, SIX)
    return gr.standardised(rows, found), found


# The pooled covariance and the class means as one table of columns: x<i>, and a<i><j> of the covariance and m<i> of the
# mean, solved for z = covariance^-1 mean by elimination, a step per common table.
def sql_solved(source: str, keys: str) -> str:
    d = range(1, 7)
    cells = [f"a{i}{j}" for i in d for j in d] + [f"b{i}" for i in d]
    steps = [f"s0 AS (SELECT {keys}, {', '.join(cells)} FROM {source})"]
    for k in d:
        entry = lambda c, row, k=k: f"{c} / a{k}{k} AS {c}" if row == k else f"{c} - a{row}{k} * {c[0] + str(k) + c[2:] if c[0] == 'a' else 'b' + str(k)} / a{k}{k} AS {c}"
        steps.append(f"s{k} AS (SELECT {keys}, {', '.join(entry(c, int(c[1])) for c in cells)} FROM s{k - 1})")
    return ", ".join(steps)


SQL_SIX = f"""{SQL_FILES}, sp AS (SELECT recording, max(t) - min(t) AS duration_s, count(*) - 1 AS gaps FROM o GROUP BY 1),
  r6 AS (SELECT recording, grp, n_onsets, duration_s, npvi, cv, rk_entropy, duration_s * 1000 / nullif(gaps, 0) AS mean_ioi_ms FROM fm JOIN sp USING (recording) WHERE grp IS NOT NULL),
  c6 AS (SELECT * FROM r6 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SIX)} QUALIFY count(*) OVER (PARTITION BY grp) >= 3),
  z6 AS (SELECT recording, grp, {', '.join(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS x{i}' for i, c in enumerate(SIX, 1))} FROM c6)"""


def sql_discriminant(rows: str, key: str) -> str:
    """Class means and pooled covariance of each key, its solutions and the scores; `rows` has key, grp and x1 to x6."""
    d = range(1, 7)
    return f"""lg AS (SELECT {key}, grp, count(*) AS n, {', '.join(f'avg(x{i}) AS b{i}' for i in d)}, {', '.join(f'covar_pop(x{i}, x{j}) * count(*) AS c{i}{j}' for i in d for j in d)} FROM {rows} GROUP BY 1, 2),
  lp AS (SELECT {key}, {', '.join(f"sum(c{i}{j}) / (sum(n) - count(*)){' + 1e-8' if i == j else ''} AS a{i}{j}" for i in d for j in d)} FROM lg GROUP BY 1),
  gp AS (SELECT * FROM lg JOIN lp USING ({key})), {sql_solved('gp', f'{key}, grp')},
  lw AS (SELECT s6.{key}, s6.grp, {', '.join(f's6.b{i} AS w{i}' for i in d)}, {' + '.join(f's6.b{i} * lg.b{i}' for i in d)} AS q FROM s6 JOIN lg ON lg.{key} = s6.{key} AND lg.grp = s6.grp)"""


SCORE = " + ".join(f"w{i} * x{i}" for i in range(1, 7)) + " - q / 2"
SQL_LDA = f"""{SQL_SIX}, k6 AS (SELECT 0 AS k, * FROM z6), {sql_discriminant('k6', 'k')}, pd AS (SELECT recording, any_value(z6.grp) AS grp, arg_max(lw.grp, {SCORE}) AS predicted FROM z6, lw GROUP BY 1)"""


@query("g17_discriminant_resubstitution", f"WITH {SQL_LDA} SELECT recording, grp, predicted FROM pd")
def _(spark, sf):
    rows, found = _six(spark, sf)
    return ds.classify(rows, "grp", found).select("recording", "grp", "predicted")


@query("g17_discriminant_leave_one_out", f"""WITH {SQL_SIX}, tr AS (SELECT l.recording AS rid, t.* FROM z6 l JOIN z6 t ON t.recording <> l.recording), {sql_discriminant('tr', 'rid')},
  pd AS (SELECT recording, any_value(z6.grp) AS grp, arg_max(lw.grp, {SCORE}) AS predicted FROM z6 JOIN lw ON lw.rid = recording GROUP BY 1) SELECT count(*) AS n, {sql_tidy('avg((grp = predicted)::INT)')} AS ccr FROM pd""")
def _(spark, sf):
    rows, found = _six(spark, sf)
    return _rounded(ds.correct_rate(ds.classify(rows, "grp", found, mode="leave_one_out"), "grp"), "n")


@query("g17_discriminant_by_folds")
def _(spark, sf):
    rows, found = _six(spark, sf)
    return _rounded(ds.correct_rate(ds.classify(rows, "grp", found, mode="kfold", prior="empirical"), "grp"), "n")


@query("g18_discriminant_permutation_test")
def _(spark, sf):
    rows, found = _six(spark, sf)
    return _rounded(ds.permutation_test(rows, "grp", found, permutations=999, mode="leave_one_out"), "n", "n_classes")


@query("g18_unit_level_permutation_test")
def _(spark, sf):
    rows, found = _six(spark, sf)
    return _rounded(ds.permutation_test(rows, "grp", found, permutations=999, unit="unit"), "n", "n_classes")


@query("g19_confusion_matrix", f"""WITH {SQL_LDA} SELECT grp, {', '.join(f"count(*) FILTER (predicted = '{c}') AS {c}" for c in SEGMENTS)} FROM pd GROUP BY 1""")
def _(spark, sf):
    rows, found = _six(spark, sf)
    return ds.confusion(ds.classify(rows, "grp", found), "grp", SEGMENTS)


@query("g19_discriminant_loadings")
def _(spark, sf):
    rows, found = _six(spark, sf)
    return ds.loadings(rows, "grp", found)


# Models

@query("g20_coefficient_limits", f"""WITH {SQL_FILES}, rg AS (SELECT count(*) AS n, regr_slope(npvi, cv) AS b, regr_intercept(npvi, cv) AS a, avg(cv) AS mx, regr_sxx(npvi, cv) AS sxx, regr_syy(npvi, cv) - regr_slope(npvi, cv) * regr_sxy(npvi, cv) AS sse FROM fm WHERE npvi IS NOT NULL AND cv IS NOT NULL),
  ec AS (SELECT 'cv' AS term, b AS est, sqrt(sse / (n - 2) / sxx) AS se FROM rg UNION ALL SELECT '(Intercept)', a, sqrt(sse / (n - 2) * (1 / n + mx * mx / sxx)) FROM rg)
  SELECT term, {sql_tidy('se')} AS std_error, {sql_tidy('est - 1.959963984540054 * se')} AS ci_low, {sql_tidy('est + 1.959963984540054 * se')} AS ci_high FROM ec""")
def _(spark, sf):
    found = models.regression(_file_metrics(spark, sf), "npvi ~ cv")
    return found.select("term", *[tidy(c).alias(c) for c in ("std_error", "ci_low", "ci_high")])


@query("g20_regression_coefficients", f"WITH {SQL_FILES} SELECT 'cv' AS term, {sql_tidy('regr_slope(npvi, cv)')} AS estimate FROM fm UNION ALL SELECT '(Intercept)', {sql_tidy('regr_intercept(npvi, cv)')} FROM fm")
def _(spark, sf):
    return models.regression(_file_metrics(spark, sf), "npvi ~ cv").select("term", tidy("estimate").alias("estimate"))


@query("g20_regression_with_groups_and_interaction")
def _(spark, sf):
    return _rounded(models.regression(_file_metrics(spark, sf), "npvi ~ cv + grp + cv:grp"), "term")


@query("g21_unit_mean_regression", f"""WITH {SQL_UNITS}, z AS (SELECT npvi, (cv - avg(cv) OVER ()) / stddev_pop(cv) OVER () AS c FROM un) SELECT 'cv' AS term, {sql_tidy('regr_slope(npvi, c)')} AS estimate FROM z UNION ALL SELECT '(Intercept)', {sql_tidy('regr_intercept(npvi, c)')} FROM z""")
def _(spark, sf):
    return models.unit_regression(_file_metrics(spark, sf), "npvi", ["cv"]).select("term", tidy("estimate").alias("estimate"))


@query("g26_likelihood_ratio_test", f"WITH {SQL_FILES} SELECT {sql_tidy('-count(*) * ln(1 - regr_r2(npvi, cv))')} AS lrt, 1::INT AS df FROM fm")
def _(spark, sf):
    return models.model_comparison(_file_metrics(spark, sf), "npvi ~ cv", "npvi ~ 1").select(tidy("lrt").alias("lrt"), "df")


@query("g22_scaled_reduction")
def _(spark, sf):
    rows = models.reduced(frames(spark, sf), "bins")
    return rows.select("recording", "frame", *[F.col("reduced")[i].alias(f"c{i}") for i in range(3)])


@query("g23_region_clusters")
def _(spark, sf):
    r = _regions(spark, sf)
    rows = settled(profiles.region_features(r, frames(spark, sf)).join(r.select("recording", "region_id", "harmonicity"), ["recording", "region_id"]))
    return models.region_clusters(rows).select("recording", "region_id", "cluster")
