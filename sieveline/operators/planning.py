"""Merged evidence, pools of comparable studies, the lean of a record, and the planning of a new study.

Defined results: what can't be computed is null, never a guess; groups of fewer than three studies aren't pooled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sieveline.functions.special import NORMAL, Z975, beta_cdf, beta_ppf
from sieveline.operators.evidence import random_effects

# Scales in the order in which derived effects stand in, weights of evidence tiers, shares and thresholds.
DERIVED_ORDER = ("SMD", "logOR", "MD", "logRR")
TIER_WEIGHTS = {"numeric": 1.0, "derived": 1.0, "reconstructed": 0.75}
OTHER_WEIGHT = 0.5
CONFLICT_SHARE, CONFLICT_WEIGHT = 0.3, 3.0
REPEAT_FROM, CHANGE_FROM = 0.5, 0.25
TARGET_POWER, MOST_PARTICIPANTS = 0.8, 10_000_000
Z80 = NORMAL.inv_cdf(TARGET_POWER)


def merged_evidence(reported: Column, derived: dict[str, Column], requested: str | None) -> Column:
    """struct(scale, estimate, se, low, high, tier). reported: such a struct without a tier, null if there is none; derived:
    by scale, struct(estimate, se) or null. What is reported on the requested scale wins, then what is derived for
    it; if nothing is reported, the first derived scale stands in."""

    def of(scale: str) -> Column:
        d = derived[scale]
        return F.when(d["estimate"].isNotNull() & d["se"].isNotNull(), F.struct(F.lit(scale).alias("scale"), d["estimate"].alias("estimate"), d["se"].alias("se"), (d["estimate"] - Z975 * d["se"]).alias("low"), (d["estimate"] + Z975 * d["se"]).alias("high"), F.lit("derived").alias("tier")))

    own = F.when(reported["low"].isNotNull() & reported["high"].isNotNull(), F.struct(*[reported[c].alias(c) for c in ("scale", "estimate", "se", "low", "high")], F.lit("reported").alias("tier")))
    none = F.lit(None)
    target = of(requested) if requested in derived else none
    stand_in = F.coalesce(*[of(s) for s in DERIVED_ORDER if s in derived], none)
    wanted = own["scale"] == requested if requested is not None else F.lit(True)
    return F.when(own.isNotNull() & wanted, own).otherwise(F.coalesce(target, own, stand_in))


def comparable(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def pool_groups(studies: DataFrame) -> DataFrame:
    """studies: scale, outcome, unit, intervention, comparator, direction, label (of a group judged alike, or null), tier,
    bucket, is_review, estimate, se. Those that may be pooled with the columns of their pool's key: a label replaces
    outcome and comparison, a derived or labelled SMD is in units of SD, a difference of means needs a unit."""
    sd = (F.col("scale") == "SMD") & ((F.col("tier") == "derived") | F.col("label").isNotNull())
    labelled = F.col("label").isNotNull()
    keyed = studies.where(~F.coalesce("is_review", F.lit(False)) & ~F.col("bucket").isin("failed", "unreported") & F.col("estimate").isNotNull() & F.col("se").isNotNull())
    keyed = keyed.select(
        "estimate", "se", "scale",
        F.when(labelled, F.concat(F.lit("group:"), comparable(F.col("label")))).otherwise(comparable(F.col("outcome"))).alias("outcome"),
        F.when(sd, "SD").otherwise(F.trim(F.coalesce("unit", F.lit("")))).alias("unit"),
        *[F.when(labelled, "").otherwise(comparable(F.col(c))).alias(c) for c in ("intervention", "comparator")],
        comparable(F.col("direction")).alias("direction"),
    )
    return keyed.where((F.col("outcome") != "") & ((F.col("scale") != "MD") | (F.col("unit") != "")))


POOL_KEY = ["scale", "outcome", "unit", "intervention", "comparator", "direction"]


def pools(studies: DataFrame) -> DataFrame:
    """Random-effects pools of at least three comparable studies; the largest first, then by outcome and scale."""
    return random_effects(pool_groups(studies), POOL_KEY).orderBy(F.desc("k"), "outcome", "scale", *POOL_KEY)


def variance_factor(scale: Column, outcome_sd: Column, baseline_risk: Column) -> Column:
    """Variance of an estimate times the participants of a study with even arms; null where the plan lacks a value."""
    inside = (baseline_risk > 0) & (baseline_risk < 1)
    return F.when(scale == "SMD", 4.0).when((scale == "MD") & (outcome_sd > 0), 4 * outcome_sd * outcome_sd).when((scale == "logOR") & inside, 4 / (baseline_risk * (1 - baseline_risk))).when((scale == "logRR") & inside, 4 * (1 - baseline_risk) / baseline_risk)


def planned_se(factor: Column, n: Column) -> Column:
    """With the two arms' actual sizes, which differ by one in an odd total; null below 4."""
    one = F.floor(n / 2)
    return F.when(n >= 4, F.sqrt(factor / 4 * (1 / one + 1 / (n - one))))


def planned(se: Column, margin: Column, alpha: float = 0.05) -> dict[str, Column]:
    """The effect that is detected with a power of 0.8, half the width of the interval about no effect, and its verdict."""
    half = Z975 * se
    return {"mde": (-NORMAL.inv_cdf(alpha / 2) + Z80) * se, "null_half_width": half, "null_verdict": F.when(half < margin, "credible_null").when(half >= margin, "inconclusive")}


def expected_power(estimate: float, spread: float, se: float, alpha: float) -> float:
    """Expected power of a two-sided test when the effect is normal about the estimate with this variance."""
    cut, sd = -NORMAL.inv_cdf(alpha / 2) * se, math.sqrt(spread + se * se)
    return min(1.0, max(0.0, NORMAL.cdf((-cut - estimate) / sd) + NORMAL.cdf((estimate - cut) / sd)))


def smallest_n(estimate: float, spread: float, factor: float, alpha: float = 0.05, target: float = TARGET_POWER) -> int | None:
    """The smallest even number of participants with the target power. Power may not grow with n all the way, so the
    search doubles up to a number that suffices and halves below it; null above MOST_PARTICIPANTS."""
    suffices = lambda n: expected_power(estimate, spread, math.sqrt(factor / n), alpha) >= target
    enough = 4
    while not suffices(enough):
        if enough == MOST_PARTICIPANTS:
            return None
        enough = min(2 * enough, MOST_PARTICIPANTS)
    arms = range(2, enough // 2 + 1)
    low, high = 0, len(arms) - 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if suffices(2 * arms[middle]) else (middle + 1, high)
    return 2 * arms[low]


@F.pandas_udf(LongType())
def required_n(estimate: pd.Series, tau2: pd.Series, se: pd.Series, factor: pd.Series) -> pd.Series:
    """For rows of pools; null where a value is."""
    rows = zip(estimate, tau2, se, factor, strict=True)
    return pd.Series([smallest_n(e, t + s * s, f) if not any(x is None or np.isnan(x) for x in (e, t, s, f)) else None for e, t, s, f in rows], dtype="Int64")


def expected_value(assurance: Column, success: float = 100.0, null: float = 20.0, cost: float = 30.0) -> Column:
    return assurance * success + (1 - assurance) * null - cost


def record_sums(classified: DataFrame, by: list[str]) -> DataFrame:
    """classified: bucket, tier. Weighted successes and failures, the counts of each verdict that answers, the rest."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for p in TIER_WEIGHTS.items() for x in p])[F.col("tier")], F.lit(OTHER_WEIGHT))
    success, failure = F.col("bucket") == "effect", F.col("bucket").isin("credible_null", "reported_null")
    either = F.coalesce(success | failure, F.lit(False))
    return classified.groupBy(*by).agg(
        F.sum(F.when(success, weight).otherwise(0.0)).alias("successes"), F.sum(F.when(failure, weight).otherwise(0.0)).alias("failures"),
        F.count_if(either).alias("informative"), F.count_if(~either).alias("uninformative"),
    )


def leaning(sums: DataFrame) -> DataFrame:
    """Adds p_effect, p_open (twice the smaller tail at even odds), low, high, conflict and state to rows of sums."""

    @F.pandas_udf("low double, high double, below double")
    def beta(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(beta_ppf(0.025, x, y), beta_ppf(0.975, x, y), beta_cdf(0.5, x, y)) for x, y in zip(a, b, strict=True)], columns=["low", "high", "below"])

    a, b, weight = 1 + F.col("successes"), 1 + F.col("failures"), F.col("successes") + F.col("failures")
    rows = sums.withColumns({"law": beta(a, b), "p_effect": a / (a + b), "conflict": F.coalesce(F.try_divide(F.least("successes", "failures"), weight), F.lit(0.0))})
    contested = (F.col("conflict") >= CONFLICT_SHARE) & (weight >= CONFLICT_WEIGHT)
    state = F.when(weight == 0, "unknown").when(contested, "contested").when(F.lit(0.5).between(F.col("law.low"), F.col("law.high")), "open").when(F.col("law.low") > 0.5, "favours_effect").otherwise("favours_null")
    return rows.select("*", F.col("law.low").alias("low"), F.col("law.high").alias("high"), (2 * F.least("law.below", 1 - F.col("law.below"))).alias("p_open"), state.alias("state")).drop("law")


def decided(rows: DataFrame, se: Column, margin: Column, alpha: float = 0.05) -> DataFrame:
    """Adds power (null without a design), p_pursue and recommendation to rows with p_open and state."""
    z = -NORMAL.inv_cdf(alpha / 2)

    @F.pandas_udf("double")
    def normal(x: pd.Series) -> pd.Series:
        return x.map(lambda v: NORMAL.cdf(v) if v == v else None)

    shift = F.when(se > 0, margin / se)
    rows = rows.withColumn("power", (1 - normal(z - shift)) + normal(-z - shift))
    rows = rows.withColumn("p_pursue", F.col("p_open") * F.coalesce("power", F.lit(1.0)))
    advice = F.when(F.col("state") == "contested", "pursue_with_changes").when(F.col("p_pursue") >= REPEAT_FROM, "pursue").when(F.col("p_pursue") >= CHANGE_FROM, "pursue_with_changes").otherwise("deprioritize")
    return rows.withColumn("recommendation", advice)
