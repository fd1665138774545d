"""Queries of corpus scope, populations and placements."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions.text import cosine
from sieveline.operators import scope as S
from sieveline.operators import vectors as V
from sieveline.queries.maps import embeddings, one_vector
from sieveline.sources.tables import table

STEMS = ["COLD", "promo"]


def coarse_scope(spark, d):
    part = table(spark, d, "part")
    return part.where(S.coarse(part, STEMS, "p_name", "title", "p_type")).select("p_partkey")


def exact_scope(spark, d):
    """Orders as works with topics: in scope by a topic or its subfield, and indexed by one of three marks."""
    url = lambda n: F.concat(F.lit("https://x.example/T"), n.cast("string"))
    topic = F.struct(url(F.col("o_custkey") % 50).alias("id"), F.concat(F.lit("fields/"), (F.col("o_orderkey") % 30).cast("string")).alias("subfield"))
    works = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.array(topic)).alias("topics"), F.create_map(F.lit("pmid"), F.when(F.col("o_custkey") % 3 == 0, "1")).alias("ids"), F.when(F.col("o_custkey") % 4 == 0, F.array(F.lit("pubmed"))).alias("indexed_in"))
    return works.where(S.in_topics(F.col("topics"), ["T1", "T7", "T12"], ["3"]) & S.is_indexed(works)).select("o_orderkey")


def population_terms(spark, d):
    said = F.concat(F.lit("Adults aged 18 years with "), F.col("c_mktsegment"), F.lit(" disease of the Knee, "), F.col("c_nationkey").cast("string"), F.lit(" "), F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(S.specific_terms(said), " ").alias("terms"))


def screened_orders(spark, d):
    orders = table(spark, d, "orders")
    ids = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.screened(orders, ids, S.population_clause(F.col("o_orderpriority"), ["urgent"]), "o_orderkey").select("o_orderkey")


def store_counts(spark, d):
    rows = embeddings(spark, d)
    return S.store_counts(rows, F.when(F.col("vec_id") % 3 > 0, "study"), F.when(F.col("vec_id") % 4 > 0, F.col("embedding")))


def placement(spark, d):
    """Vector 0 among all others: the nearest vectors and the region of the nearest centre."""
    rows = embeddings(spark, d)
    target = one_vector(spark, d, 0)
    near = rows.where("vec_id <> 0").join(F.broadcast(target)).select(F.lit("neighbor").alias("kind"), F.col("vec_id").alias("id"), F.round(cosine(F.col("embedding"), F.col("v0")), 6).alias("cosine")).orderBy(F.desc("cosine"), "id").limit(10)
    centres = V.centroids(rows.where("vec_id <> 0"), "label").join(F.broadcast(target))
    region = centres.select(F.lit("region").alias("kind"), F.col("label").cast("bigint").alias("id"), F.round(cosine(F.col("centroid"), F.col("v0")), 6).alias("cosine")).orderBy(F.desc("cosine"), "id").limit(1)
    return near.union(region)


QUERIES = {q.__name__: q for q in (coarse_scope, exact_scope, population_terms, screened_orders, store_counts, placement)}
ORACLES = {
    "coarse_scope": "SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name || ' ' || p_type), 'cold|promo')",
    "exact_scope": "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 > 0 AND (o_custkey % 50 IN (1, 7, 12) OR o_orderkey % 30 = 3) AND (o_custkey % 3 = 0 OR o_custkey % 4 = 0)",
    "population_terms": "SELECT c_custkey, 'with ' || lower(c_mktsegment) || ' disease of the knee' AS terms FROM customer",
    "screened_orders": "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)",
    "store_counts": "SELECT count(*) FILTER (vec_id % 3 > 0) AS studies, count(*) FILTER (vec_id % 3 > 0 AND vec_id % 4 > 0) AS embedded, count(*) AS documents FROM embeddings",
    "placement": """WITH w AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), z AS (SELECT e AS t FROM w WHERE vec_id = 0),
      n AS (SELECT 'neighbor' AS kind, vec_id AS id, round(list_cosine_similarity(e, t), 6) AS cosine FROM w, z WHERE vec_id <> 0 ORDER BY 3 DESC, 2 LIMIT 10),
      m AS (SELECT label, place, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS place FROM w WHERE vec_id <> 0) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY place) AS c FROM m GROUP BY 1),
      r AS (SELECT 'region' AS kind, label::BIGINT AS id, round(list_cosine_similarity(c, t), 6) AS cosine FROM c, z ORDER BY 3 DESC, 2 LIMIT 1)
      SELECT * FROM n UNION ALL SELECT * FROM r""",
}
