"""Regression, reduction and clustering with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, RFormula, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.functions.tails import chi_square_p, normal_quantile
from tactus.operators.groups import standardised, unit_values


#: A column is a combination of earlier ones when they leave less than this share of its variance.
ALIASED = 1e-9


def _independent(data: DataFrame, names: Sequence[str]) -> list[int]:
    """Columns of the design that are no combination of the intercept and earlier ones, from their correlations."""
    if not names:
        return []
    dense = data.select(array_to_vector(vector_to_array("_features")).alias("_dense"))
    varies = dense.select(Summarizer.variance(F.col("_dense"))).first()[0].toArray() > 0
    left = np.nan_to_num(Correlation.corr(dense, "_dense").first()[0].toArray())
    kept = []
    for i in range(len(names)):
        if varies[i] and left[i, i] > ALIASED:
            kept.append(i)
            left -= np.outer(left[:, i], left[i]) / left[i, i]
    return kept


def _fitted(rows: DataFrame, formula: str, family: str):
    """The model, the names of the design's columns and the numbers of those that are fitted."""
    design = RFormula(formula=formula, featuresCol="_features", labelCol="_label").fit(rows)
    data = design.transform(rows)
    attrs = data.schema["_features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = [a["name"] for _, a in sorted(((a["idx"], a) for group in attrs.values() for a in group), key=lambda t: t[0])]
    kept = _independent(data, names)
    if len(kept) < len(names):
        data = data.withColumn("_features", array_to_vector(F.array().cast("array<double>"))) if not kept else VectorSlicer(
            inputCol="_features", outputCol="_kept", indices=kept).transform(data).drop("_features").withColumnRenamed("_kept", "_features")
    model = GeneralizedLinearRegression(family=family, featuresCol="_features", labelCol="_label", maxIter=25).fit(data)
    return model, names, kept


def regression(rows: DataFrame, formula: str, *, family: str = "gaussian", level: float = 0.95) -> DataFrame:
    """Coefficient table of a fixed-effect model: term, estimate, standard error, p-value and normal confidence limits.
    Text columns are coded against a reference level; interactions are written a:b. A term that is a combination of earlier
    ones, as is an interaction's part for the reference level, is not fitted and has null figures."""
    model, names, kept = _fitted(rows, formula, family)
    s = model.summary
    terms = [*[names[i] for i in kept], "(Intercept)"]
    values = [*[float(v) for v in model.coefficients], float(model.intercept)]
    q = normal_quantile(1 - (1 - level) / 2)
    errors = [float(v) for v in s.coefficientStandardErrors]
    table = [(t, v, e, float(p), v - q * e, v + q * e) for t, v, e, p in zip(terms, values, errors, s.pValues, strict=True)]
    table += [(t, *[None] * 5) for i, t in enumerate(names) if i not in kept]
    return rows.sparkSession.createDataFrame(table, "term string, estimate double, std_error double, p double, ci_low double, ci_high double")


def model_comparison(rows: DataFrame, formula: str, null_formula: str, *, family: str = "gaussian") -> DataFrame:
    """Both AICs and the likelihood-ratio test of the model against the null model (null has fewer terms)."""
    full, _, terms = _fitted(rows, formula, family)
    null, _, null_terms = _fitted(rows, null_formula, family)
    n = full.summary.numInstances
    if family == "gaussian":
        log_lik = lambda m: -0.5 * n * (math.log(2 * math.pi * m.summary.deviance / n) + 1)
        lrt = 2 * (log_lik(full) - log_lik(null))
    else:
        lrt = null.summary.deviance - full.summary.deviance
    df = len(terms) - len(null_terms)
    table = [(float(full.summary.aic), float(null.summary.aic), float(lrt), df, chi_square_p(lrt, df) if df else None)]
    return rows.sparkSession.createDataFrame(table, "aic double, aic_null double, lrt double, df int, p double")


def unit_regression(rows: DataFrame, response: str, predictors: Sequence[str], *, unit: str = "unit") -> DataFrame:
    """Regression on unit means with standardised predictors, the form without a covariance of units."""
    means = unit_values(rows, [response, *predictors], unit=unit).dropna()
    return regression(standardised(means, predictors), f"{response} ~ {' + '.join(predictors)}")


def reduced(frames: DataFrame, vector: str, *, components: int = 3) -> DataFrame:
    """Scale every dimension and project onto the leading components (array column `reduced`)."""

    data = frames.withColumn("_v", array_to_vector(vector))
    steps = Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True),
                             PCA(k=components, inputCol="_z", outputCol="_p")])
    out = steps.fit(data).transform(data)
    return out.withColumn("reduced", vector_to_array("_p")).drop("_v", "_z", "_p")


CLUSTER_FEATURES = ("spectral_centroid_hz", "spectral_bandwidth_hz", "harmonicity", "attack_sharpness")


def region_clusters(regions: DataFrame, *, most: int = 6, seed: int = 42) -> DataFrame:
    """Cluster analysed regions on four standardised features; one cluster when they hardly differ.

    The number of clusters is the one with the best silhouette, at most `most`.
    """
    row = regions.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for c in CLUSTER_FEATURES
                                                      for f, k in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    spread = [row[f"s_{c}"] or 0.0 for c in CLUSTER_FEATURES]
    mean = [abs(row[f"m_{c}"] or 0.0) for c in CLUSTER_FEATURES]
    alike = (spread[0] / max(mean[0], 1.0) < 0.15 and spread[1] / max(mean[1], 1.0) < 0.15
             and spread[2] < 0.15 and spread[3] < 0.15)
    if row["n"] <= 1 or alike:
        return regions.withColumn("cluster", F.lit(0))
    data = regions.withColumns({f"_{c}": (F.col(c) - row[f"m_{c}"]) / F.lit(row[f"s_{c}"]) if row[f"s_{c}"] > 1e-6 else F.lit(0.0)
                                for c in CLUSTER_FEATURES})
    data = VectorAssembler(inputCols=[f"_{c}" for c in CLUSTER_FEATURES], outputCol="features").transform(data)
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    best, best_score = None, -2.0
    for k in range(2, min(most, row["n"]) + 1):
        found = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data).transform(data)
        if found.select("cluster").distinct().count() < 2:
            continue
        score = judge.evaluate(found)
        if score > best_score:
            best, best_score = found, score
    out = best if best is not None else data.withColumn("cluster", F.lit(0))
    return out.select(*regions.columns, "cluster")
