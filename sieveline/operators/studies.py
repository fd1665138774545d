"""Studies in tiers: numeric ones, effects rebuilt from exact p-values, qualitative ones, and the analyses of clusters.

Defined results: missing fields take the defaults of DEFAULTS; a confidence interval gives a standard error only if it
has a positive width; a p-value isn't turned into an effect, and `rebuild_fault` names why, unless its operator is "=",
it lies within (0, 1], its direction is -1 or 1, its test is known and its sizes and degrees of freedom are positive; a
one-sided p-value of 1 gives no finite effect and counts as a fault; studies without a cluster take no part in analyses.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sieveline.functions.special import NORMAL, t_upper
from sieveline.operators.redundancy import finding, redundancy, reml

#: Fields of a study file.
STUDY_SCHEMA = """study_id string, cluster_id string, year int, design string, population string, intervention string, comparator string,
outcome string, timepoint string, measure string, scale_id string, higher_is_better boolean, effect double, se double, ci_low double,
ci_high double, ci_level double, p_value double, p_operator string, test_type string, two_sided boolean, direction int, n1 int, n2 int,
df double, qualitative_label string, qualitative_text string, risk_of_bias string, methodologically_failed boolean,
completed_unreported boolean, pico_compatible boolean, primary_result boolean"""
DEFAULTS = {
    "higher_is_better": True, "ci_level": 0.95, "p_operator": "=", "two_sided": True, "risk_of_bias": "unknown", "methodologically_failed": False,
    "completed_unreported": False, "pico_compatible": True, "primary_result": True,
}
#: What a qualitative label says.
QUALITATIVE = {
    "benefit": "benefit", "harm": "harm", "null_credible": "clinically_equivalent", "null_underpowered": "inconclusive", "mixed": "mixed",
    "methodologically_failed": "methodologically_failed", "unclear": "unclassifiable",
}
MEASURES = {"two_sample_t": "hedges_g", "one_sample_t": "cohen_dz", "paired_t": "cohen_dz", "correlation_t": "fisher_z", "chi_square_1df": "phi"}
TIERS = ("full_quant", "p_reconstructed", "qualitative", "unextractable", "methodologically_failed", "completed_unreported")
#: The analyses of a cluster: name, whether rebuilt effects take part, whether studies of high risk are left out.
RUNS = (("primary", False, False), ("excluding_high_risk", False, True), ("with_p_reconstruction", True, True))


@F.pandas_udf(DoubleType())
def upper_point(tail: pd.Series, df: pd.Series) -> pd.Series:
    found = pd.Series(t_upper(tail.to_numpy("float64", na_value=float("nan")), df.to_numpy("float64", na_value=float("nan"))))
    return found.where(found.notna(), None)


def mapped(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def rebuilt(studies: DataFrame) -> DataFrame:
    """Adds rebuilt_effect, rebuilt_variance, rebuilt_measure (null where impossible) and rebuild_fault (null without a
    p-value)."""
    test, n1, n2, given = F.col("test_type"), F.col("n1"), F.col("n2"), F.col("df")
    two, single = test == "two_sample_t", test.isin("one_sample_t", "paired_t")
    df = F.when(two, F.coalesce(given, n1 + n2 - 2)).when(single, F.coalesce(given, n1 - 1)).when(test == "correlation_t", F.coalesce(given, n1 - 2)).when(test == "chi_square_1df", F.lit(float("inf")))
    sized = (n1 > 0) & (~two | (n2 > 0)) & ((test != "correlation_t") | (n1 > 3))
    tail = F.when(F.col("two_sided") | (test == "chi_square_1df"), F.col("p_value") / 2).otherwise(F.col("p_value"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    fault = (
        F.when(F.col("p_value").isNull(), None).when(no(F.col("p_operator") == "="), "p_operator").when(no((F.col("p_value") > 0) & (F.col("p_value") <= 1)), "p_value")
        .when(no(F.col("direction").isin(-1, 1)), "direction").when(no(test.isin(*MEASURES)), "test_type").when(no(sized), "n").when(no(df > 0), "df").when(tail >= 1, "p_value")
    )
    rows = studies.withColumns({"rebuild_fault": fault, "_df": df})
    fit = F.col("p_value").isNotNull() & F.col("rebuild_fault").isNull()
    rows = rows.withColumn("_t", F.col("direction") * upper_point(F.when(fit, tail), F.when(fit, F.col("_df"))))
    t, m = F.col("_t"), F.col("_df")
    d, j = t * F.sqrt(1 / n1 + 1 / n2), F.when(m > 1, 1 - 3 / (4 * m - 1)).otherwise(1.0)
    dz, phi = t / F.sqrt(n1), t / F.sqrt(n1)
    effect = F.when(two, j * d).when(single, dz).when(test == "correlation_t", F.atanh(t / F.sqrt(t * t + m))).otherwise(phi)
    variance = F.when(two, ((n1 + n2) / (n1.cast("double") * n2) + d * d / (2 * m)) * j * j).when(single, 1 / n1 + dz * dz / (2 * F.greatest(m, F.lit(1.0)))).when(test == "correlation_t", 1 / (n1 - 3)).otherwise(1 / n1)
    return rows.withColumns({"rebuilt_effect": F.when(fit, effect), "rebuilt_variance": F.when(fit, variance), "rebuilt_measure": F.when(fit, mapped(test, MEASURES))}).drop("_df", "_t")


def with_defaults(studies: DataFrame) -> DataFrame:
    """All fields of a study, missing columns as nulls and nulls as their defaults."""
    have = {c.lower() for c in studies.columns}
    fields = [(f.split()[0], f.split()[1]) for f in STUDY_SCHEMA.replace("\n", " ").split(", ")]
    chosen = [(F.col(n) if n in have else F.lit(None)).cast(kind) for n, kind in fields]
    return studies.select(*[F.coalesce(c, F.lit(DEFAULTS[n])).alias(n) if n in DEFAULTS else c.alias(n) for c, (n, _) in zip(chosen, fields, strict=True)])


def tiered(studies: DataFrame, low: float = -0.2, high: float = 0.2, alpha: float = 0.05) -> DataFrame:
    """The studies with tier, finding, analysis_effect (higher is better), variance, se and reconstructed."""
    rows = rebuilt(with_defaults(studies))
    level = F.col("ci_level")

    @F.pandas_udf("double")
    def normal_point(levels: pd.Series) -> pd.Series:
        known = {x: NORMAL.inv_cdf(0.5 + x / 2) for x in levels.dropna().unique() if 0 < x < 1}
        return levels.map(known).astype("float64")

    width = F.col("ci_high") - F.col("ci_low")
    own = F.when(F.col("se") > 0, F.col("se")).when((width > 0) & (level > 0) & (level < 1), width / (2 * normal_point(level)))
    labelled = (F.coalesce("qualitative_label", F.lit("")) != "") | (F.coalesce("qualitative_text", F.lit("")) != "")
    tier = (
        F.when(F.col("methodologically_failed"), "methodologically_failed").when(F.col("completed_unreported"), "completed_unreported")
        .when(F.col("effect").isNotNull() & F.col("_own").isNotNull(), "full_quant").when(F.col("rebuilt_effect").isNotNull(), "p_reconstructed").when(labelled, "qualitative").otherwise("unextractable")
    )
    rows = rows.withColumn("_own", own).withColumn("tier", tier).withColumn("reconstructed", F.col("tier") == "p_reconstructed")
    by_tier = lambda full, again: F.when(F.col("tier") == "full_quant", full).when(F.col("reconstructed"), again)
    effect = by_tier(F.col("effect"), F.col("rebuilt_effect"))
    rows = rows.withColumns({
        "analysis_effect": F.when(F.col("higher_is_better"), effect).otherwise(-effect), "variance": by_tier(F.col("_own") * F.col("_own"), F.col("rebuilt_variance")),
        "measure": F.when(F.col("reconstructed"), F.coalesce("measure", "rebuilt_measure")).otherwise(F.col("measure")), "scale_id": F.when(F.col("reconstructed"), F.coalesce("scale_id", "rebuilt_measure")).otherwise(F.col("scale_id")),
    })
    rows = rows.withColumn("se", F.coalesce(F.sqrt("variance"), F.col("se")))
    said = F.coalesce(mapped(F.lower(F.trim(F.coalesce("qualitative_label", F.lit("unclear")))), QUALITATIVE), F.lit("unclassifiable"))
    verdict = F.when(F.col("variance").isNotNull(), finding(F.col("analysis_effect"), F.col("se"), low, high, alpha)).when(F.col("tier") == "qualitative", said).when(F.col("tier") == "unextractable", "unclassifiable").otherwise(F.col("tier"))
    return rows.withColumn("finding", verdict).drop("_own", "rebuilt_effect", "rebuilt_variance", "rebuilt_measure")


def analyses(tiers: DataFrame, low: float = -0.2, high: float = 0.2) -> DataFrame:
    """One row per run of RUNS and cluster: counts of records and tiers, n_high_risk, n_eligible, status, score, k, mean,
    se, tau2, i2, resolution, maturity. Clusters with under 2 eligible studies, or whose studies differ in measure,
    scale, outcome, time or orientation, aren't pooled."""
    runs = F.explode(F.array(*[F.struct(F.lit(n).alias("run"), F.lit(r).alias("rebuilt"), F.lit(h).alias("safe")) for n, r, h in RUNS]))
    dealt = tiers.where("cluster_id IS NOT NULL").select("*", runs.alias("_run")).select("*", "_run.*").drop("_run")
    fit = F.col("pico_compatible") & F.col("primary_result") & F.col("analysis_effect").isNotNull() & F.col("variance").isNotNull() & (~F.col("safe") | (F.col("risk_of_bias") != "high")) & (F.col("rebuilt") | ~F.col("reconstructed"))
    sign = F.to_json(F.struct("measure", "scale_id", "outcome", "timepoint", "higher_is_better"))
    dealt = dealt.withColumn("_fit", fit).withColumn("_sign", F.when(F.col("_fit"), sign))
    tally = [F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in TIERS]
    counted = dealt.groupBy("run", "cluster_id").agg(F.count("*").alias("n_records"), *tally, F.count_if(F.col("risk_of_bias") == "high").alias("n_high_risk"), F.count_if("_fit").alias("n_eligible"), F.min("_sign").alias("_least"), F.max("_sign").alias("_most"))
    alike = F.col("_least") == F.col("_most")
    pooled = dealt.where("_fit").join(counted.where((F.col("n_eligible") >= 2) & alike).select("run", "cluster_id"), ["run", "cluster_id"], "left_semi")
    scored = redundancy(reml(pooled, ["run", "cluster_id"], "analysis_effect"), low, high).select("run", "cluster_id", F.col("status").alias("_status"), "score", "k", "mean", "se", "tau2", "i2", "resolution", "maturity")
    status = F.when(F.col("n_eligible") < 2, "insufficient_numeric_evidence").when(~alike, "not_poolable").otherwise(F.col("_status"))
    return counted.join(scored, ["run", "cluster_id"], "left").withColumn("status", status).drop("_least", "_most", "_status")
