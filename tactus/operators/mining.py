"""Items, frequent itemsets and association rules over recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.layout import exact_quantiles


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int, method: str = "quantile") -> dict[str, list[float]]:
    """Cut points per feature, the outer ones widened a little. A few numbers per feature reach the driver."""
    if method == "equal_width":
        box = rows.agg(*[f(c).alias(f"{n}_{c}") for c in features for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
        edges = {c: [box[f"lo_{c}"] + (box[f"hi_{c}"] - box[f"lo_{c}"]) * i / bins for i in range(bins + 1)] for c in features}
    else:
        edges = {}
        for c in features:
            q = exact_quantiles(rows.withColumn("_all", F.lit(0)), "_all", c, [i / bins for i in range(bins + 1)], "_q")
            edges[c] = list(q.first()["_q"])
    for e in edges.values():
        e[0] -= 1e-9
        e[-1] += 1e-9
    return edges


def transactions(rows: DataFrame, edges: dict[str, list[float]], labels: Sequence[str], *, group: str | None = None) -> DataFrame:
    """One `feature=label` item per feature, and `Group=...` where asked for."""
    items = []
    for c, e in edges.items():
        at = sum(((F.col(c) >= x).cast("int") for x in e[2:-1]), (F.col(c) >= e[1]).cast("int")) if len(e) > 2 else F.lit(0)
        at = F.least(at, F.lit(len(labels) - 1))
        items.append(F.concat(F.lit(f"{c}="), F.element_at(F.array(*[F.lit(x) for x in labels]), at + 1)))
    if group:
        items.append(F.concat(F.lit("Group="), F.col(group)))
    return rows.select("recording", F.array_distinct(F.array(*items)).alias("items"))


def frequent_itemsets(tx: DataFrame, *, min_support: float = 0.15, max_size: int = 4) -> DataFrame:
    """Itemsets with at least the given support, largest size limited; (items ascending, size, support)."""
    n = tx.count()
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(tx)
    sets = model.freqItemsets.filter(F.size("items") <= max_size)
    return sets.select(F.array_sort("items").alias("items"), F.size("items").alias("size"), (F.col("freq") / F.lit(float(n))).alias("support"))


def rules(itemsets: DataFrame, *, min_confidence: float = 0.6, min_lift: float = 1.1, group_consequent: bool = False) -> DataFrame:
    """Every split of an itemset into antecedent and consequent that is confident and lifted enough."""
    name = lambda c: F.array_join(c, " & ")
    sets = itemsets.withColumn("key", name(F.col("items")))
    cut = sets.filter("size >= 2").withColumn("_m", F.explode(F.expr("sequence(1, shiftleft(1, size) - 2)")))
    bit = lambda want: F.expr(f"filter(items, (x, i) -> (shiftright(_m, i) & 1) = {want})")
    cut = cut.select("items", "size", "support", bit(1).alias("_a"), bit(0).alias("_c"))
    if group_consequent:
        cut = cut.filter(F.exists("_c", lambda x: x.startswith("Group=")))
    cut = cut.select("size", "support", name(F.col("_a")).alias("antecedent"), name(F.col("_c")).alias("consequent"))
    one = sets.select(F.col("key").alias("antecedent"), F.col("support").alias("antecedent_support"))
    two = sets.select(F.col("key").alias("consequent"), F.col("support").alias("consequent_support"))
    out = cut.join(one, "antecedent").join(two, "consequent")
    out = out.withColumn("confidence", F.col("support") / F.col("antecedent_support"))
    out = out.withColumn("lift", F.col("confidence") / F.col("consequent_support"))
    return out.filter((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))


def top_rules(found: DataFrame, n: int = 15) -> DataFrame:
    return found.orderBy(F.desc("lift"), F.desc("confidence"), F.desc("support"), "antecedent", "consequent").limit(n)


def itemset_order(itemsets: DataFrame) -> DataFrame:
    """Small sets first, frequent ones first within a size."""
    return itemsets.orderBy("size", F.desc("support"), F.array_join("items", " & "))
