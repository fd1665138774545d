"""Redundancy of evidence: findings by equivalence tests, REML pools, zone probabilities, scores and their status.

Studies with a null estimate or without a positive variance take no part in pools, neither do null groups. A pool's
between-study variance is found by searching a grid of its logarithm, narrowed round by round; each round is one grouped
sum over the studies for all pools at once, so no group meets in one task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.special import NORMAL, Z975, t_ppf
from sieveline.plans.lineage import cut

#: Logarithm of the smallest variance searched, points of a round's grid, and rounds; a round narrows 8 times.
LOWEST, POINTS, ROUNDS = math.log(1e-12), 16, 9
HIGH_I2, SPARSE, RESOLVED = 0.6, 0.5, 80.0


def finding(estimate: Column, se: Column, low: float, high: float, alpha: float = 0.05) -> Column:
    """clinically_equivalent if the interval of level 1 - 2 alpha lies within [low, high], then benefit or harm if the interval of level
    1 - alpha lies beyond it, else inconclusive; null without an estimate or a positive error."""
    narrow, wide = NORMAL.inv_cdf(1 - alpha) * se, NORMAL.inv_cdf(1 - alpha / 2) * se
    found = F.when((estimate - narrow >= low) & (estimate + narrow <= high), "clinically_equivalent").when(estimate - wide > high, "benefit").when(estimate + wide < low, "harm").otherwise("inconclusive")
    return F.when(estimate.isNotNull() & (se > 0), found)


def weighted(rows: DataFrame, groups: DataFrame, by: list[str], keep: list[str], tau2: Column) -> DataFrame:
    """Sums over each group with weights 1 / (v + tau2)."""
    w, y = F.col("_w"), F.col("_y")
    joined = rows.join(groups, by).withColumn("_w", 1 / (F.col("_v") + tau2))
    return joined.groupBy(*by, *keep).agg(F.sum(-F.ln("_w")).alias("logs"), F.sum(w).alias("sw"), F.sum(w * y).alias("swy"), F.sum(w * y * y).alias("swyy"))


def narrowed(rows: DataFrame, span: DataFrame, by: list[str]) -> DataFrame:
    step = (F.col("high") - F.col("low")) / POINTS
    grid = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(POINTS))).alias("_at")).withColumn("_log", F.col("low") + F.col("_at") * step)
    sums = weighted(rows, grid, by, ["k", "low", "high", "_log"], F.exp("_log"))
    loss = F.col("logs") + F.ln("sw") + F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")
    best = sums.groupBy(*by, "k", "low", "high").agg(F.min(F.struct(loss.alias("loss"), "_log")).alias("best"))
    return best.select(*by, "k", F.greatest(F.col("low"), F.col("best._log") - step).alias("low"), F.least(F.col("high"), F.col("best._log") + step).alias("high"))


def reml(studies: DataFrame, by: list[str], estimate: str = "estimate", variance: str = "variance") -> DataFrame:
    """Pools of 2 studies or more: k, tau2, mean, se, ci_low, ci_high, q, i2, information, prediction_low, prediction_high.
    From 3 studies on, the error is Hartung and Knapp's with a floor of 1 and the bounds are Student's."""
    rows = cut(studies.where((F.col(variance) > 0) & F.col(estimate).isNotNull()).select(*by, F.col(estimate).alias("_y"), F.col(variance).alias("_v")))
    top = F.ln(F.greatest(100 * F.coalesce(F.var_samp("_y"), F.lit(0.0)), 100 * F.max("_v"), F.lit(1.0)))
    span = cut(rows.groupBy(*by).agg(F.count("*").alias("k"), F.lit(LOWEST).alias("low"), top.alias("high")).where("k >= 2"))
    for _ in range(ROUNDS):
        span = cut(narrowed(rows, span, by))
    fixed = weighted(rows, span.select(*by), by, [], F.lit(0.0)).select(*by, F.greatest(F.lit(0.0), F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")).alias("q"))
    tau2 = span.select(*by, "k", F.exp((F.col("low") + F.col("high")) / 2).alias("tau2"))
    pooled = weighted(rows, tau2, by, ["k", "tau2"], F.col("tau2")).join(fixed, by)

    @F.pandas_udf("double")
    def student(df: pd.Series) -> pd.Series:
        known = {d: t_ppf(0.975, float(d)) for d in df.unique() if d > 0}
        return df.map(known).astype("float64")

    many = F.col("k") >= 3
    left = F.greatest(F.lit(0.0), F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw"))
    out = pooled.select(*by, "k", "tau2", "q", F.col("sw").alias("information"), (F.col("swy") / F.col("sw")).alias("mean"), F.sqrt(F.when(many, F.greatest(F.lit(1.0), left / (F.col("k") - 1))).otherwise(1.0) / F.col("sw")).alias("se"), student(F.col("k") - 1).alias("t1"), student(F.col("k") - 2).alias("t2"))
    bound, reach = F.when(many, F.col("t1")).otherwise(Z975) * F.col("se"), F.when(many, F.col("t2") * F.sqrt(F.col("tau2") + F.col("se") * F.col("se")))
    i2 = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("k") - 1), "q"), F.lit(0.0)))
    m = F.col("mean")
    return out.select(*by, "k", "tau2", "mean", "se", (m - bound).alias("ci_low"), (m + bound).alias("ci_high"), "q", i2.alias("i2"), "information", (m - reach).alias("prediction_low"), (m + reach).alias("prediction_high"))


def redundancy(pools: DataFrame, low: float, high: float, precision: float = 0.5) -> DataFrame:
    """Adds harm, clinically_negligible, benefit (probabilities of a next study's zone), resolution, maturity, score and status."""

    @F.pandas_udf("struct<harm:double,clinically_negligible:double,benefit:double>")
    def zones(mean: pd.Series, sd: pd.Series) -> pd.DataFrame:
        below = [NORMAL.cdf((low - m) / s) for m, s in zip(mean, sd, strict=True)]
        above = [1 - NORMAL.cdf((high - m) / s) for m, s in zip(mean, sd, strict=True)]
        return pd.DataFrame({"harm": below, "clinically_negligible": [max(0.0, 1 - b - a) for b, a in zip(below, above, strict=True)], "benefit": above})

    names = ("harm", "clinically_negligible", "benefit")
    spread = pools.withColumn("_z", zones("mean", F.sqrt(F.col("tau2") + F.col("se") * F.col("se")))).select("*", "_z.*").drop("_z")
    entropy = -sum((F.when(F.col(n) > 0, F.col(n) * F.ln(n)).otherwise(0.0) for n in names), F.lit(0.0))
    target = min(abs(low), abs(high)) * precision / Z975
    scored = spread.withColumns({"resolution": 1 - entropy / math.log(3), "maturity": F.least(F.lit(1.0), F.col("information") * target * target)})
    scored = scored.withColumn("score", 100 * F.col("resolution") * F.col("maturity"))
    largest = F.greatest(*names)
    zone = F.when(F.col("harm") == largest, "harm").when(F.col("clinically_negligible") == largest, "clinically_negligible").otherwise("benefit")
    torn = F.coalesce((F.col("i2") >= HIGH_I2) & (F.col("prediction_low") < low) & (F.col("prediction_high") > high), F.lit(False))
    status = F.when(torn, "conflicting_evidence").when(F.col("maturity") < SPARSE, "sparse_or_imprecise").when(F.col("score") >= RESOLVED, F.concat(F.lit("resolved_"), zone)).otherwise("uncertain")
    return scored.withColumn("status", status)
