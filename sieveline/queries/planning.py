"""Queries of merged evidence, pools, record leans and plans; line items and parts stand for studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.operators import planning as P
from sieveline.sources.tables import table

#: Line items as studies; the same text serves both engines.
STUDY_COLUMNS = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CASE l_partkey % 4 WHEN 0 THEN 'SMD' WHEN 1 THEN 'MD' WHEN 2 THEN 'logOR' ELSE 'logRR' END AS scale", "l_discount - 0.05 AS estimate",
    "CASE WHEN l_linenumber < 6 THEN 0.01 + l_tax END AS se", "CASE WHEN l_suppkey % 9 > 0 THEN concat('  Outcome  ', cast(l_suppkey % 5 AS {text})) END AS outcome", "CASE WHEN l_suppkey % 3 > 0 THEN ' kg ' END AS unit",
    "CASE WHEN l_suppkey % 2 = 0 THEN 'Drug  A' ELSE 'drug a' END AS intervention", "'placebo' AS comparator", "CASE WHEN l_linenumber = 2 THEN 'UP' END AS direction", "CASE WHEN l_suppkey % 7 = 0 THEN 'Pain Scales' END AS label",
    "CASE l_linenumber % 3 WHEN 0 THEN 'numeric' WHEN 1 THEN 'derived' ELSE 'reconstructed' END AS tier", "CASE WHEN l_quantity < 5 THEN 'failed' WHEN l_quantity < 20 THEN 'effect' WHEN l_quantity < 35 THEN 'credible_null' WHEN l_quantity < 40 THEN 'reported_null' ELSE 'inconclusive' END AS bucket",
    "CASE WHEN l_quantity > 45 THEN l_linenumber = 1 END AS is_review",
)


def studies(spark, d):
    return table(spark, d, "lineitem").selectExpr(*[c.format(text="string") for c in STUDY_COLUMNS])


STUDIES_SQL = "SELECT " + ", ".join(STUDY_COLUMNS).format(text="VARCHAR") + " FROM lineitem"


def study_pools(spark, d):
    found = P.pools(studies(spark, d))
    return found.select(*P.POOL_KEY, "k", *[F.round(c, 6).alias(c) for c in ("mean", "pooled_se", "tau2")])


def merged_evidence(spark, d):
    """What counts of a study on the scale of odds: reported, derived for it, or the first derived."""
    rows = studies(spark, d)
    reported = F.struct("scale", "estimate", "se", F.when(F.col("l_linenumber") < 4, F.col("estimate") - F.col("se")).alias("low"), (F.col("estimate") + F.col("se")).alias("high"))
    pair = lambda test, shift: F.struct(F.when(test, F.col("estimate") + shift).alias("estimate"), F.lit(0.5).alias("se"))
    derived = {"SMD": pair(F.col("l_suppkey") % 2 == 0, 1), "logOR": pair(F.col("l_suppkey") % 5 == 0, 2), "MD": pair(F.col("l_suppkey") % 3 == 0, 3)}
    found = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", P.merged_evidence(reported, derived, "logOR").alias("e"))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "e.scale", "e.tier", F.round("e.estimate", 6).alias("estimate"), F.round("e.low", 6).alias("low"))


def planned_designs(spark, d):
    part = table(spark, d, "part")
    scale = F.get(F.array(*[F.lit(s) for s in ("SMD", "MD", "logOR", "logRR", "logHR")]), (F.col("p_partkey") % 5).cast("int"))
    factor = P.variance_factor(scale, F.col("p_size").cast("double"), F.col("p_size") / 50)
    se = P.planned_se(factor, F.col("p_partkey") % 300)
    plan = P.planned(se, F.lit(0.4))
    return part.select("p_partkey", F.round(factor, 6).alias("factor"), F.round(se, 6).alias("se"), F.round(plan["mde"], 6).alias("mde"), F.round(plan["null_half_width"], 6).alias("null_half_width"), plan["null_verdict"].alias("null_verdict"))


def record_sums(spark, d):
    return P.record_sums(studies(spark, d).withColumn("supplier", F.col("l_suppkey")), ["supplier"]).withColumns({c: F.round(c, 6) for c in ("successes", "failures")})


def record_decisions(spark, d):
    """The lean of each supplier's record and what to do, for a study of 200 participants and a margin of 0.2."""
    sums = P.record_sums(studies(spark, d).withColumn("supplier", F.col("l_suppkey")), ["supplier"])
    rows = P.decided(P.leaning(sums), F.lit((4 / 200) ** 0.5), F.lit(0.2))
    return rows.withColumns({c: F.round(c, 9) for c in ("p_effect", "conflict", "low", "high", "p_open", "power", "p_pursue")})


def required_sizes(spark, d):
    """Participants for a power of 0.8 in each pool of standardised differences."""
    found = P.pools(studies(spark, d)).where("scale = 'SMD'")
    return found.select(*P.POOL_KEY, P.required_n(F.col("mean"), F.col("tau2"), F.col("pooled_se"), F.lit(4.0)).alias("n"))


QUERIES = {q.__name__: q for q in (study_pools, merged_evidence, planned_designs, record_sums, record_decisions, required_sizes)}
_TEXT = "lower(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')))"
ORACLES = {
    "study_pools": f"""WITH s AS ({STUDIES_SQL}), keyed AS (
        SELECT estimate, se, scale, CASE WHEN label IS NOT NULL THEN 'group:' || {_TEXT.format("label")} ELSE {_TEXT.format("outcome")} END AS outcome,
          CASE WHEN scale = 'SMD' AND (tier = 'derived' OR label IS NOT NULL) THEN 'SD' ELSE trim(coalesce(unit, '')) END AS unit,
          CASE WHEN label IS NOT NULL THEN '' ELSE {_TEXT.format("intervention")} END AS intervention, CASE WHEN label IS NOT NULL THEN '' ELSE {_TEXT.format("comparator")} END AS comparator, {_TEXT.format("direction")} AS direction
        FROM s WHERE NOT coalesce(is_review, false) AND bucket NOT IN ('failed', 'unreported') AND se IS NOT NULL
      ), usable AS (SELECT *, 1 / (se * se) AS w FROM keyed WHERE outcome <> '' AND (scale <> 'MD' OR unit <> '')),
      first_ AS (SELECT scale, outcome, unit, intervention, comparator, direction, count(*) AS k, greatest(0, (greatest(0, sum(w * estimate * estimate) - sum(w * estimate) ^ 2 / sum(w)) - (count(*) - 1)) / (sum(w) - sum(w * w) / sum(w))) AS tau2 FROM usable GROUP BY ALL HAVING count(*) >= 3)
      SELECT scale, outcome, unit, intervention, comparator, direction, any_value(k) AS k, round(sum(estimate / (se * se + tau2)) / sum(1 / (se * se + tau2)), 6) AS mean, round(sqrt(1 / sum(1 / (se * se + tau2))), 6) AS pooled_se, round(any_value(tau2), 6) AS tau2
      FROM usable JOIN first_ USING (scale, outcome, unit, intervention, comparator, direction) GROUP BY ALL""",
    "merged_evidence": f"""WITH s AS ({STUDIES_SQL}), r AS (SELECT *, l_linenumber < 4 AND se IS NOT NULL AS reported FROM s)
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CASE WHEN reported AND scale = 'logOR' THEN scale WHEN l_suppkey % 5 = 0 THEN 'logOR' WHEN reported THEN scale WHEN l_suppkey % 2 = 0 THEN 'SMD' WHEN l_suppkey % 3 = 0 THEN 'MD' END AS scale,
        CASE WHEN reported AND scale = 'logOR' THEN 'reported' WHEN l_suppkey % 5 = 0 THEN 'derived' WHEN reported THEN 'reported' WHEN l_suppkey % 2 = 0 OR l_suppkey % 3 = 0 THEN 'derived' END AS tier,
        round(CASE WHEN reported AND scale = 'logOR' THEN estimate WHEN l_suppkey % 5 = 0 THEN estimate + 2 WHEN reported THEN estimate WHEN l_suppkey % 2 = 0 THEN estimate + 1 WHEN l_suppkey % 3 = 0 THEN estimate + 3 END, 6) AS estimate,
        round(CASE WHEN reported AND scale = 'logOR' THEN estimate - se WHEN l_suppkey % 5 = 0 THEN estimate + 2 - 1.959963984540054 * 0.5 WHEN reported THEN estimate - se WHEN l_suppkey % 2 = 0 THEN estimate + 1 - 1.959963984540054 * 0.5 WHEN l_suppkey % 3 = 0 THEN estimate + 3 - 1.959963984540054 * 0.5 END, 6) AS low
      FROM r""",
    "planned_designs": """WITH f AS (SELECT p_partkey, p_partkey % 300 AS n, CASE p_partkey % 5 WHEN 0 THEN 4.0::DOUBLE WHEN 1 THEN CASE WHEN p_size > 0 THEN 4.0::DOUBLE * p_size * p_size END
        WHEN 2 THEN CASE WHEN p_size BETWEEN 1 AND 49 THEN 4 / ((p_size / 50) * (1 - p_size / 50)) END WHEN 3 THEN CASE WHEN p_size BETWEEN 1 AND 49 THEN 4 * (1 - p_size / 50) / (p_size / 50) END END AS factor FROM part),
      s AS (SELECT *, CASE WHEN n >= 4 THEN sqrt(factor / 4 * (1 / (n // 2) + 1 / (n - n // 2))) END AS se FROM f)
      SELECT p_partkey, round(factor, 6) AS factor, round(se, 6) AS se, round(2.8015852181129683 * se, 6) AS mde, round(1.959963984540054 * se, 6) AS null_half_width, CASE WHEN 1.959963984540054 * se < 0.4 THEN 'credible_null' WHEN se IS NOT NULL THEN 'inconclusive' END AS null_verdict FROM s""",
    "record_sums": f"""WITH s AS (SELECT *, CASE tier WHEN 'reconstructed' THEN 0.75::DOUBLE ELSE 1.0 END AS w FROM ({STUDIES_SQL}))
      SELECT l_suppkey AS supplier, round(coalesce(sum(w) FILTER (bucket = 'effect'), 0), 6) AS successes, round(coalesce(sum(w) FILTER (bucket IN ('credible_null', 'reported_null')), 0), 6) AS failures,
        count(*) FILTER (bucket IN ('effect', 'credible_null', 'reported_null')) AS informative, count(*) FILTER (bucket NOT IN ('effect', 'credible_null', 'reported_null')) AS uninformative FROM s GROUP BY 1""",
}
