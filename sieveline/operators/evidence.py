"""Evidence statistics: effects from arm summaries, verdicts, random-effects pools, asymmetry, reporting counts.

Everything is a Column expression or a grouped aggregate. Missing inputs give null effects; a study without bounds on
the wanted scale is inconclusive. Verdict bounds are strict: an interval within (-margin, margin) is a credible null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.special import DETECTABLE, NORMAL, Z975

# Verdicts, in the order they are reported in.
BUCKETS = ("credible_null", "effect", "inconclusive", "failed", "unreported", "review")


def hedges(n1: Column, m1: Column, s1: Column, n2: Column, m2: Column, s2: Column) -> tuple[Column, Column]:
    """Hedges' g and its standard error; null unless both arms have 2 participants and a positive deviation, or if |d| > 5."""
    usable = (n1 >= 2) & (n2 >= 2) & (s1 > 0) & (s2 > 0)
    pooled = F.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2))
    d = (m1 - m2) / pooled
    j = 1 - 3 / (4 * (n1 + n2 - 2) - 1)
    se = j * F.sqrt((n1 + n2) / (n1 * n2) + d * d / (2 * (n1 + n2)))
    fine = usable & (F.abs(d) <= 5)
    return F.when(fine, j * d), F.when(fine, se)


def mean_difference(n1: Column, m1: Column, s1: Column, n2: Column, m2: Column, s2: Column) -> tuple[Column, Column]:
    usable = (n1 >= 2) & (n2 >= 2) & (s1 > 0) & (s2 > 0)
    return F.when(usable, m1 - m2), F.when(usable, F.sqrt(s1 * s1 / n1 + s2 * s2 / n2))


def log_odds_ratio(e1: Column, n1: Column, e2: Column, n2: Column) -> tuple[Column, Column]:
    """Half an event is added to all cells if any is empty; null if both arms have no event or no non-event."""
    empty = (e1 == 0) | (e2 == 0) | (e1 == n1) | (e2 == n2)
    usable = (n1 > 0) & (n2 > 0) & ~((e1 == 0) & (e2 == 0)) & ~((e1 == n1) & (e2 == n2))
    add = F.when(empty, 0.5).otherwise(0.0)
    a, b, c, d = e1 + add, n1 - e1 + add, e2 + add, n2 - e2 + add
    return F.when(usable, F.ln(a * d / (b * c))), F.when(usable, F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))


def interval(estimate: Column, se: Column) -> tuple[Column, Column]:
    return estimate - Z975 * se, estimate + Z975 * se


def rescaled_interval(estimate: Column, low: Column, high: Column, level: float) -> tuple[Column, Column]:
    """95 % bounds from bounds of another level."""
    se = (high - low) / (2 * NORMAL.inv_cdf((1 + level) / 2))
    return interval(estimate, se)


def detectable_effect(se: Column) -> Column:
    return DETECTABLE * se


def verdict(estimate: Column, low: Column, high: Column, margin: float, *, failed: Column | None = None, review: Column | None = None, unreported: Column | None = None) -> Column:
    """bucket[:reason] of a study: failure, review and missing report first, then equivalence before effect."""
    no = F.lit(False)
    flag = lambda c: F.coalesce(c, no) if c is not None else no
    known = low.isNotNull() & high.isNotNull() & estimate.isNotNull()
    return (
        F.when(flag(failed), "failed")
        .when(flag(review), "review")
        .when(flag(unreported), "unreported")
        .when(~known, "inconclusive:no_result")
        .when((low > -margin) & (high < margin), "credible_null")
        .when(((low > 0) | (high < 0)) & (F.abs(estimate) >= margin), "effect")
        .otherwise("inconclusive:wide_interval")
    )


def direction(estimate: Column, low: Column, high: Column) -> Column:
    return F.when(low > 0, "positive").when(high < 0, "negative").otherwise("unclear")


def bucket_counts(verdicts: DataFrame, column: str = "verdict") -> DataFrame:
    """bucket, n for every bucket, 0 where none; reasons are folded."""
    names = verdicts.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    counts = verdicts.groupBy(F.split(column, ":")[0].alias("bucket")).agg(F.count("*").alias("n"))
    return names.join(F.broadcast(counts), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def random_effects(studies: DataFrame, by: list[str], estimate: str = "estimate", se: str = "se", least: int = 3) -> DataFrame:
    """DerSimonian-Laird pools of at least `least` studies: k, mean, pooled_se, tau2, q, ci_low, ci_high.

    Both passes over a group are sums, so they combine map-side; the between-study variance of each group joins back.
    """
    v = F.col(se) * F.col(se)
    rows = studies.where((F.col(se) > 0) & F.col(estimate).isNotNull()).withColumn("_w", 1 / v)
    y, w = F.col(estimate), F.col("_w")
    first = rows.groupBy(*by).agg(F.count("*").alias("k"), F.sum("_w").alias("sw"), F.sum(w * y).alias("swy"), F.sum(w * y * y).alias("swyy"), F.sum(w * w).alias("sww")).where(F.col("k") >= least)
    q = F.greatest(F.lit(0.0), F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw"))
    tau2 = F.greatest(F.lit(0.0), F.try_divide(q - (F.col("k") - 1), F.col("sw") - F.col("sww") / F.col("sw")))
    spread = first.select(*by, "k", q.alias("q"), F.coalesce(tau2, F.lit(0.0)).alias("tau2"))
    again = rows.join(spread, by).withColumn("_r", 1 / (v + F.col("tau2")))
    pooled = again.groupBy(*by).agg(F.first("k").alias("k"), F.first("q").alias("q"), F.first("tau2").alias("tau2"), (F.sum(F.col("_r") * y) / F.sum("_r")).alias("mean"), F.sqrt(1 / F.sum("_r")).alias("pooled_se"))
    low, high = interval(F.col("mean"), F.col("pooled_se"))
    return pooled.withColumns({"ci_low": low, "ci_high": high})


def egger(studies: DataFrame, by: list[str], estimate: str = "estimate", se: str = "se", least: int = 10) -> DataFrame:
    """Regression of estimate/se on 1/se: k, slope, intercept and the intercept's standard error, of groups with at least
    `least` studies and some spread."""
    x, y = 1 / F.col(se), F.col(estimate) / F.col(se)
    rows = studies.where(F.col(se) > 0).select(*by, x.alias("x"), y.alias("y"))
    fitted = rows.groupBy(*by).agg(F.count("*").alias("k"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.avg("x").alias("mx"))
    left = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")) / (F.col("k") - 2)
    se_intercept = F.sqrt(left * (1 / F.col("k") + F.col("mx") * F.col("mx") / F.col("sxx")))
    return fitted.where((F.col("k") >= least) & (F.col("sxx") > 0)).select(*by, "k", "slope", "intercept", se_intercept.alias("se_intercept"))


def file_drawer(trials: DataFrame, completed: Column, reported: Column, overdue: Column) -> DataFrame:
    """completed, unreported, overdue, share of completed trials without a report."""
    missing = completed & ~F.coalesce(reported, F.lit(True))
    counted = trials.agg(F.count_if(completed).alias("completed"), F.count_if(missing).alias("unreported"), F.count_if(missing & F.coalesce(overdue, F.lit(False))).alias("overdue"))
    return counted.withColumn("share", F.try_divide("unreported", "completed"))


def year_histogram(rows: DataFrame, date: str) -> DataFrame:
    return rows.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n"))


def citation_range(cited: Column, source: Column, low: int | None, high: int | None) -> Column:
    """Registry rows have no citations and are exempt from the range."""
    inside = F.lit(True)
    if low is not None:
        inside &= cited >= low
    if high is not None:
        inside &= cited <= high
    return F.coalesce(inside, F.lit(False)) | source.isin("ctgov", "merged")
