"""Vector, region and graph queries. The tables' vectors have little structure, so floors are lower than the defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.operators import graph as G
from sieveline.operators import vectors as V
from sieveline.sources.tables import table

FLOOR = 0.25


def embeddings(spark, d):
    return table(spark, d, "embeddings")


def one_vector(spark, d, key):
    """A single row, addressed by key."""
    return embeddings(spark, d).where(F.col("vec_id") == key).select(F.col("embedding").alias(f"v{key}"))


def knn_topk(spark, d):
    rows = embeddings(spark, d).join(F.broadcast(one_vector(spark, d, 0)))
    return V.nearest(rows, F.col("v0"), 20).withColumn("cosine", F.round("cosine", 6))


def concept_arith(spark, d):
    rows = embeddings(spark, d)
    for key in (0, 1, 2):
        rows = rows.join(F.broadcast(one_vector(spark, d, key)))
    return V.nearest(rows, V.combine([F.col("v0"), F.col("v1"), F.col("v2")], [1, -1, 1]), 20).withColumn("cosine", F.round("cosine", 6))


def assigned(spark, d):
    rows = embeddings(spark, d)
    return V.assign(rows, V.centroids(rows, "label"), "label")


def centroid_assign(spark, d):
    return assigned(spark, d).withColumn("cosine", F.round("cosine", 6))


def region_stats(spark, d):
    """Size, coherence and median length of the documents of each region."""
    rows = assigned(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars"), "vec_id", "left")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("cosine"), 6).alias("coherence"), F.median("n_chars").alias("median_chars"))


def region_labels(spark, d):
    rows = assigned(spark, d).join(table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), "quality", "toxic"), "vec_id", "left")
    c = rows.groupBy("label").agg(F.count("*").alias("attempts"), F.count_if(F.col("quality").isNull()).alias("dark"), F.count_if(F.col("quality") == 1).alias("nulls"), F.count_if(F.col("toxic") == 1).alias("effects"), F.count_if(F.col("quality").isNotNull()).alias("read"))
    return c.select("label", "attempts", V.region_label(*[F.col(x) for x in ("attempts", "dark", "nulls", "effects", "read")]).alias("state"))


def edges(spark, d):
    return V.neighbour_edges(embeddings(spark, d), 5, FLOOR)


def neighbor_edges(spark, d):
    return edges(spark, d).withColumn("cosine", F.round("cosine", 6))


def prune_edges(spark, d):
    return V.prune_edges(edges(spark, d), 2).withColumn("cosine", F.round("cosine", 6))


def components(spark, d):
    return G.connected_components(edges(spark, d))


def degree_radius(spark, d):
    return G.degrees(edges(spark, d)).withColumn("radius", F.round("radius", 6))


def pagerank(spark, d):
    """Customers cite the suppliers of their orders, suppliers the customers of their nation with the lowest keys."""
    bought = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()
    back = table(spark, d, "supplier").join(table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.min("c_custkey").alias("c")), "s_nationkey").select((F.col("s_suppkey") * 2 + 1).alias("src"), (F.col("c") * 2).alias("dst"))
    nodes = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("id")).union(table(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id")))
    return G.pagerank(nodes, bought.union(back)).withColumn("rank", F.round("rank", 9))


QUERIES = {
    "knn_topk": knn_topk, "concept_arith": concept_arith, "centroid_assign": centroid_assign, "region_stats": region_stats, "region_labels": region_labels,
    "neighbor_edges": neighbor_edges, "prune_edges": prune_edges, "components": components, "degree_radius": degree_radius, "pagerank": pagerank,
}

WIDE = "w AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
ASSIGN = f"""{WIDE}, cp AS (SELECT label, place, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS place FROM w) GROUP BY ALL),
c AS (SELECT label AS r, list(m ORDER BY place) AS c FROM cp GROUP BY label),
s AS (SELECT vec_id, r AS label, list_cosine_similarity(e, c) AS cosine FROM w, c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) = 1)"""
EDGES = f"""{WIDE}, p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.e, b.e) AS cosine FROM w a JOIN w b ON a.vec_id <> b.vec_id),
k AS (SELECT * FROM p WHERE cosine >= {FLOOR} QUALIFY row_number() OVER (PARTITION BY i ORDER BY cosine DESC, j) <= 5),
edges AS (SELECT least(i, j) AS src, greatest(i, j) AS dst, max(cosine) AS cosine FROM k GROUP BY ALL)"""

ORACLES = {
    "knn_topk": f"WITH {WIDE} SELECT w.vec_id, round(list_cosine_similarity(w.e, q.e), 6) AS cosine FROM w, (SELECT e FROM w WHERE vec_id = 0) q ORDER BY list_cosine_similarity(w.e, q.e) DESC, w.vec_id LIMIT 20",
    "concept_arith": f"""WITH {WIDE}, t AS (SELECT list_transform(list_zip(a.e, b.e, c.e), lambda z: z[1] - z[2] + z[3]) AS t FROM (SELECT e FROM w WHERE vec_id = 0) a, (SELECT e FROM w WHERE vec_id = 1) b, (SELECT e FROM w WHERE vec_id = 2) c)
SELECT vec_id, round(list_cosine_similarity(e, t), 6) AS cosine FROM w, t ORDER BY list_cosine_similarity(e, t) DESC, vec_id LIMIT 20""",
    "centroid_assign": f"WITH {ASSIGN} SELECT vec_id, label, round(cosine, 6) AS cosine FROM b",
    "region_stats": f"WITH {ASSIGN} SELECT label, count(*)::BIGINT AS n, round(avg(cosine), 6) AS coherence, median(n_chars) AS median_chars FROM b LEFT JOIN documents ON doc_id = vec_id GROUP BY label",
    "region_labels": f"""WITH {ASSIGN}, n AS (SELECT b.label, count(*) AS a, count(*) FILTER (quality IS NULL) AS dark, count(*) FILTER (quality = 1) AS nulls, count(*) FILTER (toxic = 1) AS effects, count(quality) AS seen FROM b LEFT JOIN labels l ON l.doc_id = b.vec_id GROUP BY b.label)
SELECT label, a::BIGINT AS attempts, CASE WHEN a < 5 THEN 'thin' WHEN dark / a >= 0.34 THEN 'dark' WHEN nulls / a >= 0.5 THEN 'null_saturated' WHEN least(nulls, effects) / a >= 0.25 THEN 'contested' WHEN seen / a < 0.1 THEN 'unread' ELSE 'active' END AS state FROM n""",
    "neighbor_edges": f"WITH {EDGES} SELECT src, dst, round(cosine, 6) AS cosine FROM edges",
    "prune_edges": f"""WITH {EDGES}, n AS (SELECT src AS node, * FROM edges UNION ALL SELECT dst AS node, * FROM edges)
SELECT DISTINCT src, dst, round(cosine, 6) AS cosine FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY node ORDER BY cosine DESC, src, dst) <= 2)""",
    "components": f"""WITH RECURSIVE {EDGES}, both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.seen = e.a)
SELECT node, min(seen) AS component FROM reach GROUP BY node""",
    "degree_radius": f"WITH {EDGES}, e AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) SELECT node, count(*)::BIGINT AS degree, round(3.0::DOUBLE + 5.0 * least(1.0, sqrt(count(*) / 8)), 6) AS radius FROM e GROUP BY node",
}
