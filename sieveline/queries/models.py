"""Queries of fitted models: k-means, principal axes, bands between regions, calibration, REML pools, inverted texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions.bibliography import text_of_index
from sieveline.operators import redundancy as D
from sieveline.operators import regions as R
from sieveline.operators import vectors as V
from sieveline.queries.evidence import ARMS_SQL, effects, rounded
from sieveline.queries.maps import ASSIGN, WIDE, assigned, embeddings
from sieveline.sources.tables import table

WIDTH, REGIONS, CUTOFF, BOUNDS = 64, 8, 5, (-0.2, 0.2)


def kmeans(spark, d):
    _, rows = R.kmeans(embeddings(spark, d), WIDTH, REGIONS)
    return rounded(rows, "cosine")


def pca(spark, d):
    rows = embeddings(spark, d)
    return rounded(R.projected(rows, *R.principal_axes(rows, WIDTH)), "x", "y")


def pairs(spark, d):
    return R.region_pairs(V.centroids(embeddings(spark, d), "label"))


def region_threshold(spark, d):
    return rounded(R.neighbour_threshold(pairs(spark, d), -1.0), "threshold")


def region_gaps(spark, d):
    return rounded(R.gaps(embeddings(spark, d), assigned(spark, d), pairs(spark, d), -1.0), "separation", "openness")


def calibrated(spark, d):
    """Regions of the rows before the cutoff, judged by the rows after it; the last digit of the id serves as the year."""
    rows = embeddings(spark, d)
    past, future = rows.where(F.col("vec_id") % 10 < CUTOFF), rows.where(F.col("vec_id") % 10 >= CUTOFF)
    centres = V.centroids(past, "label")
    marks = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), "quality", "toxic")
    before, after = (V.assign(part, centres, "label").join(marks, "vec_id", "left") for part in (past, future))
    counted = before.groupBy("label").agg(F.count("*").alias("attempts"), F.count_if(F.col("quality").isNull()).alias("dark"), F.count_if(F.col("quality") == 1).alias("nulls"), F.count_if(F.col("toxic") == 1).alias("effects"), F.count("quality").alias("read"))
    states = counted.select("label", "attempts", V.region_label(*[F.col(c) for c in ("attempts", "dark", "nulls", "effects", "read")]).alias("state"))
    return rounded(R.calibration(states, after, F.col("quality") == 1, F.col("toxic") == 1), "later_null_share")


def findings(spark, d):
    return effects(spark, d).select("p_brand", "p_type", D.finding(F.col("estimate"), F.col("se"), *BOUNDS).alias("finding"))


def reml_pool(spark, d):
    return D.reml(effects(spark, d).withColumn("variance", F.col("se") * F.col("se")), ["p_type"])


def redundancy_scores(spark, d):
    return D.redundancy(reml_pool(spark, d), *BOUNDS).select("p_type", "k", F.round("mean", 5).alias("mean"), F.round("score", 3).alias("score"), "status")


def inverted_text(spark, d):
    """Each text as an inverted index in JSON, and back."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("place", "word"))
    places = words.groupBy("doc_id", "word").agg(F.collect_list("place").alias("places"))
    index = places.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("word", "places")))).alias("index"))
    return docs.select("doc_id").join(index, "doc_id", "left").select("doc_id", F.coalesce(text_of_index(F.col("index")), F.lit("")).alias("text"))


QUERIES = {
    "kmeans": kmeans, "pca": pca, "region_threshold": region_threshold, "region_gaps": region_gaps, "calibration": calibrated, "findings": findings,
    "reml_pool": reml_pool, "redundancy_scores": redundancy_scores, "inverted_text": inverted_text,
}

UNITS = """u AS (SELECT r, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u, c AS v FROM c),
pr AS (SELECT a.r AS l, b.r AS r, a.v AS va, b.v AS vb, list_cosine_similarity(a.v, b.v) AS separation, list_transform(list_zip(a.u, b.u), lambda z: z[1] + z[2]) AS mid FROM u a JOIN u b ON a.r < b.r),
th AS (SELECT greatest(-1.0::DOUBLE, quantile_cont(separation, 0.9)) AS threshold FROM pr)"""

ORACLES = {
    "region_threshold": f"WITH {ASSIGN}, {UNITS} SELECT round(threshold, 6) AS threshold FROM th",
    "region_gaps": f"""WITH {ASSIGN}, {UNITS},
near AS (SELECT pr.* FROM pr, th WHERE separation >= threshold AND NOT EXISTS (SELECT 1 FROM u o WHERE o.r NOT IN (pr.l, pr.r) AND list_cosine_similarity(o.v, pr.mid) >= least(list_cosine_similarity(pr.va, pr.mid), list_cosine_similarity(pr.vb, pr.mid)))),
met AS (SELECT l, r, separation, list_cosine_similarity(e, va) AS x, list_cosine_similarity(e, vb) AS y, list_cosine_similarity(e, mid) AS z FROM near JOIN b ON b.label IN (l, r) JOIN w USING (vec_id)),
n AS (SELECT l, r, separation, count(*) FILTER (x >= y AND x >= z) AS nl, count(*) FILTER (y > x AND y >= z) AS nr, count(*) AS n FROM met GROUP BY ALL)
SELECT l, r, round(separation, 6) AS separation, least(nl, nr)::BIGINT AS support, (n - nl - nr)::BIGINT AS band, round(1 - (n - nl - nr) / least(nl, nr), 6) AS openness, (n - nl - nr) <= 0.1::DOUBLE * least(nl, nr) AS open FROM n WHERE least(nl, nr) > 0""",
    "calibration": f"""WITH {WIDE}, cp AS (SELECT label, place, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS place FROM w WHERE vec_id % 10 < {CUTOFF}) GROUP BY ALL),
c AS (SELECT label AS r, list(m ORDER BY place) AS c FROM cp GROUP BY label),
b AS (SELECT vec_id, r AS label FROM w, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(w.e, c.c) DESC, r) = 1),
m AS (SELECT b.label, vec_id % 10 < {CUTOFF} AS past, quality, toxic FROM b LEFT JOIN labels ON doc_id = vec_id),
n AS (SELECT label, count(*) FILTER (past) AS a, count(*) FILTER (past AND quality IS NULL) AS dark, count(*) FILTER (past AND quality = 1) AS nulls, count(*) FILTER (past AND toxic = 1) AS effects, count(quality) FILTER (past) AS seen,
  count(*) FILTER (NOT past) AS later, count(*) FILTER (NOT past AND quality = 1) AS later_null, count(*) FILTER (NOT past AND toxic = 1) AS later_effect FROM m GROUP BY label),
s AS (SELECT *, CASE WHEN a < 5 THEN 'thin' WHEN dark / a >= 0.34 THEN 'dark' WHEN nulls / a >= 0.5 THEN 'null_saturated' WHEN least(nulls, effects) / a >= 0.25 THEN 'contested' WHEN seen / a < 0.1 THEN 'unread' ELSE 'active' END AS state FROM n WHERE a > 0)
SELECT state, count(*)::BIGINT AS regions, sum(a)::BIGINT AS prior_attempts, sum(later)::BIGINT AS later_papers, sum(later_null)::BIGINT AS later_null, sum(later_effect)::BIGINT AS later_effect, round(CASE WHEN sum(later) > 0 THEN sum(later_null) / sum(later) END, 6) AS later_null_share FROM s GROUP BY state""",
    "findings": f"""WITH {ARMS_SQL} SELECT p_brand, p_type, CASE WHEN estimate IS NULL OR NOT se > 0 THEN NULL
  WHEN estimate - 1.6448536269514715 * se >= -0.2 AND estimate + 1.6448536269514715 * se <= 0.2 THEN 'clinically_equivalent' WHEN estimate - 1.959963984540054 * se > 0.2 THEN 'benefit'
  WHEN estimate + 1.959963984540054 * se < -0.2 THEN 'harm' ELSE 'inconclusive' END AS finding FROM effects""",
    "inverted_text": r"SELECT doc_id, coalesce(array_to_string(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), ' '), '') AS text FROM documents",
}
