"""Evidence queries. Arms are the return flags R and N of the line items of each brand and type of part."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.special import NORMAL, Z975, assurance, beta_ppf
from sieveline.functions.text import overdue
from sieveline.operators import evidence as E
from sieveline.sources.tables import table

MARGIN = 0.2
TODAY = "2001-09-01"


def arms(spark: SparkSession, d: str) -> DataFrame:
    """One row a study: n, mean and deviation of both arms. One aggregate holds both arms, so there is one shuffle."""
    items = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("R", "N")).select("l_partkey", "l_returnflag", "l_quantity")
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    both = items.join(parts, items["l_partkey"] == parts["p_partkey"])
    quantity = lambda flag: F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))
    found = []
    for number, flag in ((1, "R"), (2, "N")):
        found += [F.count(quantity(flag)).alias(f"n{number}"), F.avg(quantity(flag)).alias(f"m{number}"), F.stddev_samp(quantity(flag)).alias(f"s{number}")]
    return both.groupBy("p_brand", "p_type").agg(*found)


def effects(spark: SparkSession, d: str) -> DataFrame:
    columns = [F.col(c) for c in ("n1", "m1", "s1", "n2", "m2", "s2")]
    g, se = E.hedges(*columns)
    rows = arms(spark, d).select("p_brand", "p_type", g.alias("estimate"), se.alias("se"))
    low, high = E.interval(F.col("estimate"), F.col("se"))
    return rows.withColumns({"ci_low": low, "ci_high": high})


def judged(spark: SparkSession, d: str) -> DataFrame:
    return effects(spark, d).withColumn("verdict", E.verdict(F.col("estimate"), F.col("ci_low"), F.col("ci_high"), MARGIN))


def rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, 6) for n in names})


ARMS_SQL = """
arms AS (
  SELECT p_brand, p_type, count(*) FILTER (l_returnflag = 'R') AS n1, count(*) FILTER (l_returnflag = 'N') AS n2,
         avg(l_quantity) FILTER (l_returnflag = 'R') AS m1, avg(l_quantity) FILTER (l_returnflag = 'N') AS m2,
         stddev_samp(l_quantity) FILTER (l_returnflag = 'R') AS s1, stddev_samp(l_quantity) FILTER (l_returnflag = 'N') AS s2
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('R', 'N') GROUP BY ALL
), d AS (
  SELECT *, (m1 - m2) / sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)) AS d, 1 - 3.0 / (4 * (n1 + n2 - 2) - 1) AS j
  FROM arms WHERE n1 >= 2 AND n2 >= 2
), effects AS (
  SELECT a.p_brand, a.p_type, CASE WHEN d.s1 > 0 AND d.s2 > 0 AND abs(d.d) <= 5 THEN d.j * d.d END AS estimate,
         CASE WHEN d.s1 > 0 AND d.s2 > 0 AND abs(d.d) <= 5 THEN d.j * sqrt((d.n1 + d.n2)::DOUBLE / (d.n1 * d.n2) + d.d * d.d / (2 * (d.n1 + d.n2))) END AS se
  FROM arms a LEFT JOIN d USING (p_brand, p_type)
), bounded AS (
  SELECT *, estimate - 1.959963984540054 * se AS ci_low, estimate + 1.959963984540054 * se AS ci_high FROM effects
), judged AS (
  SELECT *, CASE WHEN estimate IS NULL OR se IS NULL THEN 'inconclusive:no_result' WHEN ci_low > -0.2 AND ci_high < 0.2 THEN 'credible_null'
    WHEN (ci_low > 0 OR ci_high < 0) AND abs(estimate) >= 0.2 THEN 'effect' ELSE 'inconclusive:wide_interval' END AS verdict FROM bounded
)"""


def arm_effects(spark, d):
    return rounded(judged(spark, d), "estimate", "se", "ci_low", "ci_high")


def verdict_counts(spark, d):
    return E.bucket_counts(judged(spark, d))


def effect_directions(spark, d):
    rows = judged(spark, d).where("verdict = 'effect'").select(E.direction(F.col("estimate"), F.col("ci_low"), F.col("ci_high")).alias("direction"))
    return rows.groupBy("direction").agg(F.count("*").alias("n"))


def dl_pool(spark, d):
    return rounded(E.random_effects(effects(spark, d), ["p_type"]), "q", "tau2", "mean", "pooled_se", "ci_low", "ci_high")


def egger_test(spark, d):
    return rounded(E.egger(effects(spark, d), ["p_type"]), "slope", "intercept", "se_intercept")


def planned_assurance(spark, d):
    """For each pool the chance that a further study of 200 finds an effect; the normal law runs in a pandas UDF."""
    @F.pandas_udf("double")
    def chance(mean: pd.Series, variance: pd.Series) -> pd.Series:
        return pd.Series([assurance(m, v, (4 / 200) ** 0.5) for m, v in zip(mean, variance, strict=True)])

    pools = E.random_effects(effects(spark, d), ["p_type"])
    return pools.select("p_type", "k", F.round(chance("mean", F.col("tau2") + F.col("pooled_se") * F.col("pooled_se")), 6).alias("assurance"))


def pursuit(spark, d):
    """Posterior share of effects among decided studies with a uniform prior: mean, 95 % interval and state."""
    counted = judged(spark, d).groupBy("p_type").agg(F.count_if(F.col("verdict") == "effect").cast("double").alias("a"), F.count_if(F.col("verdict") == "credible_null").cast("double").alias("b"))

    @F.pandas_udf("struct<low:double,high:double>")
    def bounds(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(beta_ppf(0.025, x + 1, y + 1), beta_ppf(0.975, x + 1, y + 1)) for x, y in zip(a, b, strict=True)], columns=["low", "high"])

    rows = counted.withColumn("i", bounds("a", "b")).select("p_type", "a", "b", ((F.col("a") + 1) / (F.col("a") + F.col("b") + 2)).alias("mean"), F.col("i.low").alias("low"), F.col("i.high").alias("high"))
    conflict = F.least("a", "b") / (F.col("a") + F.col("b"))
    state = (
        F.when(F.col("a") + F.col("b") == 0, "unknown")
        .when((conflict >= 0.3) & (F.col("a") + F.col("b") >= 3), "contested")
        .when((F.col("low") <= 0.5) & (F.col("high") >= 0.5), "open")
        .when(F.col("low") > 0.5, "favours_effect")
        .otherwise("favours_null")
    )
    return rounded(rows.withColumn("state", state), "mean", "low", "high")


def ci_rescaled(spark, d):
    """Arm differences stated with 90 % bounds, brought to 95 %, and the detectable effect."""
    est, se = E.mean_difference(*[F.col(c) for c in ("n1", "m1", "s1", "n2", "m2", "s2")])
    z90 = NORMAL.inv_cdf(0.95)
    rows = arms(spark, d).select("p_brand", "p_type", est.alias("estimate"), se.alias("se")).where("se > 0")
    low, high = E.rescaled_interval(F.col("estimate"), F.col("estimate") - z90 * F.col("se"), F.col("estimate") + z90 * F.col("se"), 0.90)
    return rounded(rows.select("p_brand", "p_type", "estimate", low.alias("ci_low"), high.alias("ci_high"), E.detectable_effect(F.col("se")).alias("mde")), "estimate", "ci_low", "ci_high", "mde")


def binary_effects(spark, d):
    """Log odds ratios of urgent orders, one market segment against the rest, by order status."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    hit = F.col("o_orderpriority").startswith("1")
    arm = F.col("c_mktsegment") == "BUILDING"
    counted = rows.groupBy("o_orderstatus").agg(F.count_if(arm & hit).alias("e1"), F.count_if(arm).alias("n1"), F.count_if(~arm & hit).alias("e2"), F.count_if(~arm).alias("n2"))
    est, se = E.log_odds_ratio(*[F.col(c) for c in ("e1", "n1", "e2", "n2")])
    return counted.select("o_orderstatus", "e1", "n1", "e2", "n2", F.round(est, 6).alias("estimate"), F.round(se, 6).alias("se"))


def file_drawer(spark, d):
    """Orders without line items are completed trials without a report."""
    orders = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("completed"))
    reported = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("reported", F.lit(True))
    rows = orders.join(reported, "o_orderkey", "left")
    out = E.file_drawer(rows, F.col("completed").isNotNull(), F.coalesce("reported", F.lit(False)), overdue(F.col("completed"), F.lit(TODAY).cast("date")))
    return rounded(out, "share")


def year_hist(spark, d):
    return E.year_histogram(table(spark, d, "orders").select("o_orderdate"), "o_orderdate").select(F.col("year").cast("int").alias("year"), "n")


def corpus_filters(spark, d):
    """Orders of two years within a range, of which a group is exempt."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", F.when(F.col("o_orderstatus") == "O", "ctgov").otherwise("openalex").alias("source"))
    inside = F.col("o_orderdate").between("1996-01-01", "1997-12-31")
    kept = rows.where(inside & E.citation_range(F.col("o_totalprice"), F.col("source"), 100_000, 200_000))
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.count_if(~F.col("o_totalprice").between(100_000, 200_000)).alias("exempt"))


QUERIES = {
    "arm_effects": arm_effects, "verdict_counts": verdict_counts, "effect_directions": effect_directions, "dl_pool": dl_pool, "egger": egger_test,
    "assurance": planned_assurance, "pursuit": pursuit, "ci_rescaled": ci_rescaled, "binary_effects": binary_effects, "file_drawer": file_drawer,
    "year_hist": year_hist, "corpus_filters": corpus_filters,
}

ORACLES = {
    "arm_effects": f"WITH {ARMS_SQL} SELECT p_brand, p_type, round(estimate, 6) AS estimate, round(se, 6) AS se, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, verdict FROM judged",
    "verdict_counts": f"""WITH {ARMS_SQL}, names AS (SELECT unnest({list(E.BUCKETS)}) AS bucket)
SELECT bucket, count(verdict)::BIGINT AS n FROM names LEFT JOIN judged ON split_part(verdict, ':', 1) = bucket GROUP BY bucket""",
    "effect_directions": f"WITH {ARMS_SQL} SELECT CASE WHEN ci_low > 0 THEN 'positive' WHEN ci_high < 0 THEN 'negative' ELSE 'unclear' END AS direction, count(*)::BIGINT AS n FROM judged WHERE verdict = 'effect' GROUP BY ALL",
    "dl_pool": f"""WITH {ARMS_SQL}, w AS (SELECT *, 1 / (se * se) AS w FROM effects WHERE se > 0), s AS (
  SELECT p_type, count(*) AS k, sum(w) AS sw, sum(w * estimate) AS swy, sum(w * estimate * estimate) AS swyy, sum(w * w) AS sww FROM w GROUP BY p_type HAVING count(*) >= 3
), t AS (SELECT p_type, k, greatest(0, swyy - swy * swy / sw) AS q, greatest(0, (greatest(0, swyy - swy * swy / sw) - (k - 1)) / (sw - sww / sw)) AS tau2 FROM s),
p AS (SELECT p_type, any_value(k) AS k, any_value(q) AS q, any_value(tau2) AS tau2, sum(estimate / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS mean, sqrt(1 / sum(1 / (se * se + tau2))) AS pooled_se FROM w JOIN t USING (p_type) GROUP BY p_type)
SELECT p_type, k::BIGINT AS k, round(q, 6) AS q, round(tau2, 6) AS tau2, round(mean, 6) AS mean, round(pooled_se, 6) AS pooled_se, round(mean - {Z975!r} * pooled_se, 6) AS ci_low, round(mean + {Z975!r} * pooled_se, 6) AS ci_high FROM p""",
    "egger": f"""WITH {ARMS_SQL}, r AS (SELECT p_type, 1 / se AS x, estimate / se AS y FROM effects WHERE se > 0),
f AS (SELECT p_type, count(*) AS k, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, avg(x) AS mx FROM r GROUP BY p_type)
SELECT p_type, k::BIGINT AS k, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(sqrt(greatest(0, syy - slope * slope * sxx) / (k - 2) * (1.0 / k + mx * mx / sxx)), 6) AS se_intercept FROM f WHERE k >= 10 AND sxx > 0""",
    "ci_rescaled": f"""WITH {ARMS_SQL}, m AS (SELECT p_brand, p_type, m1 - m2 AS estimate, sqrt(s1 * s1 / n1 + s2 * s2 / n2) AS se FROM arms WHERE n1 >= 2 AND n2 >= 2 AND s1 > 0 AND s2 > 0)
SELECT p_brand, p_type, round(estimate, 6) AS estimate, round(estimate - {Z975!r} * se, 6) AS ci_low, round(estimate + {Z975!r} * se, 6) AS ci_high, round({E.DETECTABLE!r} * se, 6) AS mde FROM m WHERE se > 0""",
    "binary_effects": """WITH c AS (
  SELECT o_orderstatus, count(*) FILTER (c_mktsegment = 'BUILDING' AND o_orderpriority LIKE '1%') AS e1, count(*) FILTER (c_mktsegment = 'BUILDING') AS n1,
         count(*) FILTER (c_mktsegment <> 'BUILDING' AND o_orderpriority LIKE '1%') AS e2, count(*) FILTER (c_mktsegment <> 'BUILDING') AS n2
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderstatus
), a AS (SELECT *, CASE WHEN e1 = 0 OR e2 = 0 OR e1 = n1 OR e2 = n2 THEN 0.5 ELSE 0 END AS h FROM c)
SELECT o_orderstatus, e1::BIGINT AS e1, n1::BIGINT AS n1, e2::BIGINT AS e2, n2::BIGINT AS n2, round(ln((e1 + h)::DOUBLE * (n2 - e2 + h) / ((n1 - e1 + h) * (e2 + h))), 6) AS estimate,
       round(sqrt(1.0 / (e1 + h)::DOUBLE + 1.0 / (n1 - e1 + h)::DOUBLE + 1.0 / (e2 + h)::DOUBLE + 1.0 / (n2 - e2 + h)::DOUBLE), 6) AS se FROM a""",
    "file_drawer": f"""WITH r AS (SELECT o.o_orderkey, CAST(o_orderdate AS DATE) AS done, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey) AS reported FROM orders o)
SELECT count(*)::BIGINT AS completed, count(*) FILTER (NOT reported)::BIGINT AS unreported, count(*) FILTER (NOT reported AND done + INTERVAL 1 YEAR < DATE '{TODAY}')::BIGINT AS overdue, round(count(*) FILTER (NOT reported) / count(*), 6) AS share FROM r""",
    "year_hist": "SELECT year(o_orderdate)::INTEGER AS year, count(*)::BIGINT AS n FROM orders GROUP BY ALL",
    "corpus_filters": """WITH r AS (SELECT CASE WHEN o_orderstatus = 'O' THEN 'ctgov' ELSE 'openalex' END AS source, o_totalprice, o_orderdate FROM orders)
SELECT source, count(*)::BIGINT AS n, count(*) FILTER (NOT o_totalprice BETWEEN 100000 AND 200000)::BIGINT AS exempt FROM r
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' AND (o_totalprice BETWEEN 100000 AND 200000 OR source IN ('ctgov', 'merged')) GROUP BY source""",
}
