"""Queries of predicates, counts, orders and groups over lists; orders stand for studies, line items for their details."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.operators import lists as L
from sieveline.sources.tables import table

TODAY = "2001-09-01"
TITLES = ("Systematic reviews of care", "A peer review system", "Guidelines for practice", "Clinical guidelines on care", "Meta-analysis of trials", "Recommendations of ours", "A trial")


def orders(spark, d):
    return table(spark, d, "orders")


def titled(column):
    return F.get(F.array(*[F.lit(t) for t in TITLES]), (column % len(TITLES)).cast("int"))


def nonprimary_titles(spark, d):
    rows = orders(spark, d).select("o_orderkey", titled(F.col("o_orderkey")).alias("title"), F.when(F.col("o_custkey") % 3 == 0, "article").when(F.col("o_custkey") % 3 == 1, "editorial").alias("kind"))
    return rows.where(L.is_nonprimary(F.col("title"), F.col("kind"))).select("o_orderkey", "title")


def match_counts(spark, d):
    kind, review = F.when(F.col("o_orderstatus") != "P", "study"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey") % 5 == 1)
    return L.match_counts(orders(spark, d), F.col("o_totalprice") > 100000, kind, review, F.col("o_orderpriority") == "1-URGENT")


def spin_rate(spark, d):
    return L.spin_rate(orders(spark, d), F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 0, F.col("o_totalprice") > 200000)


def rare_populations(spark, d):
    return L.rarest(table(spark, d, "part"), F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")), 3)


def effect_trend(spark, d):
    price = F.col("l_extendedprice")
    return L.trend(table(spark, d, "lineitem"), "l_linenumber", F.when(price > 40000, "positive").when(price < 20000, "negative").otherwise("unclear"))


def usage_rollup(spark, d):
    rows = table(spark, d, "conversations").select(F.length("text").alias("i"), (F.length("text") * 2).alias("o"), (F.col("turn") * 10).alias("ms"), (F.col("turn") % 2 == 0).alias("cached"))
    return L.usage(rows, F.col("i"), F.col("o"), 0.5, 1.5, F.col("ms"), F.col("cached"))


def year_axis(spark, d):
    years = orders(spark, d).where("o_totalprice > 150000 AND year(o_orderdate) % 3 <> 0").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return L.year_axis(years)


def paired_agreement(spark, d):
    return L.agreement(orders(spark, d), F.col("o_orderstatus") != "P", F.col("o_orderkey") % 4 != 0).select("pairs", "agreed", F.round("rate", 9).alias("rate"), "enable")


def region_exemplars(spark, d):
    return L.first_of(table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), "s_nationkey", 3, F.desc("s_acctbal"), F.col("s_suppkey"))


def fused_by_place(spark, d):
    rows = orders(spark, d).where("o_orderkey <= 400")
    one = rows.select(F.lit(0).alias("list"), F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 97).cast("int").alias("rank"))
    two = rows.select(F.lit(1).alias("list"), F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 89).cast("int").alias("rank"))
    both = one.union(two).groupBy("list", "id").agg(F.min("rank").alias("rank"))
    return L.fused_by_place(both).limit(25)


def paper_sorts(spark, d):
    """The first 20 orders under each sort key."""
    verdicts = F.array(*[F.lit(v) for v in L.ANSWER_ORDER])
    rows = orders(spark, d).select(
        F.col("o_orderkey").alias("place"), F.get(verdicts, (F.col("o_custkey") % 6).cast("int")).alias("verdict"), F.when(F.col("o_custkey") % 7 > 0, F.when(F.col("o_custkey") % 7 == 1, 0).otherwise(F.year("o_orderdate"))).alias("year"),
        F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey")).alias("sample"), F.floor(F.col("o_totalprice")).cast("bigint").alias("citations"),
    )
    out = None
    for key in ("answer", "newest", "oldest", "sample", "citations"):
        found = rows.orderBy(*L.paper_order(key, *[F.col(c) for c in ("verdict", "year", "sample", "citations", "place")])).limit(20).select(F.lit(key).alias("sort"), "place")
        out = found if out is None else out.union(found)
    return out


def keyword_pull(spark, d):
    rows = table(spark, d, "documents").select("doc_id", L.pulled(F.col("text"), ["license", "the"], ["der", "que"]).alias("pull"))
    return rows.orderBy(F.desc("pull"), "doc_id").limit(50)


def id_batches(spark, d):
    return L.batches(orders(spark, d).select("o_orderkey"), "o_orderkey", 40)


def list_unions(spark, d):
    """Regions' sorted unions of market segments and priorities, and whether the segments are among the first three."""
    flags = lambda at: F.array(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.concat(F.lit(at), F.col("c_nationkey").cast("string")))
    rows = table(spark, d, "customer").select("c_custkey", L.united(flags("n"), flags("m"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("x")))).alias("tags"))
    return rows.select("c_custkey", F.array_join("tags", ",").alias("tags"), L.contains_all(F.array(F.lit("x")), F.col("tags")).alias("has_x"))


def exclusive_groups(spark, d):
    lines = table(spark, d, "lineitem").where("l_partkey <= 300")
    claims = lines.select(F.col("l_linenumber").alias("position"), F.concat(F.lit("g"), F.col("l_linenumber").cast("string")).alias("label"), F.col("l_suppkey").alias("id")).distinct()
    return L.exclusive_groups(claims, table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id")))


def ordered_get(spark, d):
    wanted = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("vec_id"), F.col("l_orderkey").alias("position"))
    return L.ordered_get(table(spark, d, "embeddings"), wanted, "vec_id", "embedding")


def overlaid_rows(spark, d):
    page = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))
    extracted = orders(spark, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return L.overlaid(page, extracted, "c_custkey", "c_mktsegment", "c_acctbal")


def extraction_due(spark, d):
    row = {"is_review": F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey") % 4 == 1), "abstract": F.when(F.col("o_orderstatus") == "O", F.lit(" ")).otherwise(F.col("o_orderpriority")), "pmcid": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")), "source": F.when(F.col("o_custkey") % 5 == 0, "ctgov"), "extracted_on": F.when(F.col("o_orderkey") % 2 == 0, F.to_date("o_orderdate"))}
    return orders(spark, d).where(L.extractable(row, F.lit(TODAY).cast("date"), 1500)).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def topic_domains(spark, d):
    return table(spark, d, "nation").where(L.in_domain(F.concat(F.lit("https://topics.example/domains/"), F.col("n_regionkey").cast("string")), "1", "3")).select("n_nationkey")


QUERIES = {q.__name__: q for q in (nonprimary_titles, match_counts, spin_rate, rare_populations, effect_trend, usage_rollup, year_axis, paired_agreement, region_exemplars, fused_by_place, paper_sorts, keyword_pull, id_batches, list_unions, exclusive_groups, ordered_get, overlaid_rows, extraction_due, topic_domains)}

_TITLES = "[" + ", ".join(f"'{t}'" for t in TITLES) + "]"
_SORTED = """SELECT '{key}' AS sort, place FROM (SELECT * FROM rows_ ORDER BY verdict = 'inconclusive', {order} place LIMIT 20)"""
_SORTS = {"answer": "answer,", "newest": "nullif(year, 0) DESC NULLS LAST,", "oldest": "nullif(year, 0) ASC NULLS LAST,", "sample": "sample DESC NULLS LAST,", "citations": "citations DESC NULLS LAST,"}
ORACLES = {
    "nonprimary_titles": f"""SELECT o_orderkey, title FROM (SELECT o_orderkey, {_TITLES}[1 + o_orderkey % {len(TITLES)}] AS title, CASE o_custkey % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'editorial' END AS kind FROM orders)
        WHERE kind = 'editorial' OR title IN ('{TITLES[0]}', '{TITLES[2]}', '{TITLES[3]}', '{TITLES[4]}')""",
    "match_counts": """SELECT count(*) AS total, count(*) FILTER (hit) AS matched, count(*) - count(*) FILTER (hit) AS excluded, count(*) FILTER (hit AND o_orderpriority = '1-URGENT') AS controlled
        FROM (SELECT *, o_totalprice > 100000 AND o_custkey % 5 <> 1 AS hit FROM orders)""",
    "spin_rate": """SELECT count(*) AS checked, count(*) FILTER (o_totalprice > 200000) AS spun, count(*) FILTER (o_totalprice > 200000) / count(*) AS rate FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0""",
    "rare_populations": "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2, 1 LIMIT 3",
    "effect_trend": """SELECT l_linenumber, count(*) FILTER (l_extendedprice > 40000) AS positive, count(*) FILTER (l_extendedprice < 20000) AS negative, count(*) FILTER (l_extendedprice BETWEEN 20000 AND 40000) AS unclear FROM lineitem GROUP BY 1""",
    "usage_rollup": """SELECT count(*) AS calls, sum(3 * length(text))::BIGINT AS tokens, round(sum(length(text) * 3.5 / 1e6) FILTER (turn % 2 <> 0), 6) AS paid, round(sum(length(text) * 3.5 / 1e6), 6) AS uncached_cost, sum(turn * 10)::BIGINT AS millis FROM conversations""",
    "year_axis": """WITH y AS (SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE o_totalprice > 150000 AND year(o_orderdate) % 3 <> 0 GROUP BY 1),
        axis AS (SELECT unnest(range((SELECT min(year) FROM y), (SELECT max(year) FROM y) + 1))::INT AS year)
        SELECT axis.year, coalesce(n, 0) AS n, coalesce(n, 0) = (SELECT max(n) FROM y) AND (SELECT count(*) FROM y WHERE n = (SELECT max(n) FROM y)) = 1 AS peak FROM axis LEFT JOIN y USING (year)""",
    "paired_agreement": """SELECT count(*) AS pairs, count(*) FILTER (ok) AS agreed, round(count(*) FILTER (ok) / count(*), 9) AS rate, count(*) FILTER (ok) = count(*) AS enable FROM (SELECT o_orderstatus <> 'P' AND o_orderkey % 4 <> 0 AS ok FROM orders)""",
    "region_exemplars": "SELECT s_nationkey, s_suppkey, s_acctbal, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier) WHERE place <= 3",
    "fused_by_place": """WITH r AS (SELECT 0 AS list, o_custkey AS id, min(o_orderkey % 97) AS rank FROM orders WHERE o_orderkey <= 400 GROUP BY 2 UNION ALL SELECT 1, o_custkey, min(o_orderkey % 89) FROM orders WHERE o_orderkey <= 400 GROUP BY 2)
        SELECT id, round(sum(1.0::DOUBLE / (rank + 61)), 12) AS score FROM r GROUP BY id ORDER BY 2 DESC, min((list, rank)) LIMIT 25""",
    "paper_sorts": f"""WITH rows_ AS (SELECT o_orderkey AS place, (o_custkey % 6) + 1 AS answer, [{', '.join(f"'{v}'" for v in L.ANSWER_ORDER)}][1 + o_custkey % 6] AS verdict, CASE WHEN o_custkey % 7 > 1 THEN year(o_orderdate) WHEN o_custkey % 7 = 1 THEN 0 END AS year,
        CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS sample, floor(o_totalprice)::BIGINT AS citations FROM orders) """ + " UNION ALL ".join(_SORTED.format(key=k, order=o) for k, o in _SORTS.items()),
    "keyword_pull": """SELECT doc_id, (contains(t, 'license')::INT + contains(t, 'the')::INT - contains(t, 'der')::INT - contains(t, 'que')::INT) AS pull FROM (SELECT doc_id, lower(text) AS t FROM documents) ORDER BY 2 DESC, 1 LIMIT 50""",
    "id_batches": "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 40)::BIGINT AS batch, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 40)::INT AS slot FROM orders",
    "list_unions": """SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'n' || c_nationkey, 'm' || c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'x' END], lambda x: x IS NOT NULL))), ',') AS tags, c_custkey % 3 = 0 AS has_x FROM customer""",
    "exclusive_groups": """WITH c AS (SELECT l_suppkey AS id, min(l_linenumber) AS position FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey <= 300 AND s_acctbal > 0 GROUP BY 1)
        SELECT 'g' || position AS label, id FROM c WHERE position IN (SELECT position FROM c GROUP BY 1 HAVING count(*) >= 2)""",
    "ordered_get": "SELECT e.vec_id, e.label, w.position FROM embeddings e JOIN (SELECT l_suppkey AS vec_id, min(l_orderkey) AS position FROM lineitem WHERE l_quantity > 49 GROUP BY 1) w USING (vec_id)",
    "overlaid_rows": "SELECT c_custkey, coalesce(p, c_mktsegment) AS c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "extraction_due": f"""SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey % 4 <> 1 AND (o_orderstatus <> 'O' OR o_orderkey % 3 = 0) AND o_custkey % 5 <> 0
        AND NOT (o_orderkey % 2 = 0 AND date_diff('day', o_orderdate::DATE, DATE '{TODAY}') <= 1500) GROUP BY 1""",
    "topic_domains": "SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)",
}
