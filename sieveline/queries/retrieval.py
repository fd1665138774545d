"""Retrieval, text and linking queries over documents, conversations, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators import linking as L
from sieveline.operators import retrieval as R
from sieveline.sources.tables import table
from sieveline.streaming import windows

TERMS = ["license", "public", "the", "version"]


def bm25_topk(spark, d):
    scores = R.bm25(table(spark, d, "documents"), "doc_id", "text", TERMS)
    return scores.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


def fused(spark, d):
    """BM25, an authority signal and a vector leg in one ranking."""
    docs = table(spark, d, "documents")
    lexical = R.ranked(R.bm25(docs, "doc_id", "text", ["license", "public"]).withColumn("score", F.round("score", 6)), 100)
    known = R.authority(docs.select(F.col("doc_id").alias("id"), "n_chars"), {"n_chars": 1000.0}).withColumn("score", F.round("score", 6))
    vectors = table(spark, d, "embeddings")
    target = F.array(*[F.lit(1.0 if k == 0 else 0.0) for k in range(64)])
    near = vectors.select(F.col("vec_id").alias("id"), F.round(T.cosine(F.col("embedding"), target), 6).alias("score"))
    return R.rrf([lexical, R.ranked(known, 100), R.ranked(near, 100)], limit=50).select("id", F.round("score", 9).alias("score"))


def authority_rank(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return R.authority(rows, {"n_chars": 2000.0}).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(25)


def null_terms(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    found = R.significant_terms(rows, "doc_id", "text", F.col("quality") == 0)
    return found.withColumn("score", F.round("score", 6))


def concept_rows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    both = R.concept_match(F.col("t"), ["the", "of"], ["licen"])
    some = R.concept_match(F.col("t"), ["the", "of"], ["licen"], 0.6)
    return rows.select("doc_id", both.alias("all_terms"), some.alias("most_terms"))


def sentence_stats(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"))


def text_keys(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.title_key(c).alias("title_key"), T.title_key(T.shortened(c, 120)).alias("short_key"), F.length(T.fold(c)).cast("bigint").alias("folded"), T.token_estimate(c).cast("bigint").alias("n_tokens"))


def line_budget(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return R.line_budget(rows, "doc_id", ["pos"], "line", 5).select("doc_id", "line", F.col("place").cast("bigint").alias("place"), "truncated")


def turn_budget(spark, d):
    return R.character_budget(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", 400)


def alias_dedupe(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.array(F.concat(F.lit("c"), F.col("o_custkey")), F.concat(F.lit("p"), F.round("o_totalprice", 0).cast("bigint"))).alias("aliases"))
    return L.alias_duplicates(rows, "pos", F.col("aliases"))


def missing_refs(spark, d):
    return L.missing_references(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


def semi_backfill(spark, d):
    wanted = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return L.backfill(table(spark, d, "orders").select("o_orderkey", "o_custkey"), wanted, "o_custkey")


def first_linked(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return L.first_link(rows, "l_suppkey", [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")])


def merged_rows(spark, d):
    """Old prices by part against new ones, with a cached rank that survives unchanged names."""
    part = table(spark, d, "part")
    old = part.select("p_partkey", "p_name", "p_retailprice", F.lit("read").alias("state")).where("p_partkey % 3 <> 0")
    new = part.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("p_name"), (F.col("p_retailprice") + 1).alias("p_retailprice"), F.lit(None).cast("string").alias("state")).where("p_partkey % 2 = 0")
    return L.merge_rows(old, new, "p_partkey", "p_name", ["state"]).withColumn("p_retailprice", F.round("p_retailprice", 4))


def hash_sample(spark, d):
    return L.hash_sample(table(spark, d, "embeddings").select("vec_id"), "vec_id", "seed-1", 40)


def thinned(spark, d):
    return L.thinned(table(spark, d, "documents").select("doc_id"), "doc_id", 4)


def set_ops(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    parts = {"both": a.intersect(b), "only_orders": a.subtract(b), "either": a.union(b).distinct()}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.union(one)
    return out


def props_json(spark, d):
    rows = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def tumbling(spark, d):
    rows = windows.windowed_counts(table(spark, d, "events"), "1 hour")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(spark, d):
    rows = windows.sessions(table(spark, d, "events"), "30 minutes")
    return rows.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


TOKENS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


def bm25_sql(terms: list[str]) -> str:
    words = ", ".join(f"'{t}'" for t in terms)
    return f"""t AS (SELECT doc_id AS id, {TOKENS_SQL} AS ts FROM documents), c AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM t),
p AS (SELECT id, len(ts) AS length, term, count(*) AS tf FROM (SELECT id, ts, unnest(ts) AS term FROM t) WHERE term IN ({words}) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bm AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM p JOIN f USING (term), c GROUP BY id)"""


QUERIES = {
    "bm25_topk": bm25_topk, "rrf_fuse": fused, "authority_rank": authority_rank, "significant_terms": null_terms, "concept_match": concept_rows, "sentence_stats": sentence_stats,
    "text_keys": text_keys, "line_budget": line_budget, "turn_budget": turn_budget, "alias_dedupe": alias_dedupe, "missing_refs": missing_refs, "semi_backfill": semi_backfill,
    "first_linked": first_linked, "merge_rows": merged_rows, "hash_sample": hash_sample, "hash_thinning": thinned, "set_ops": set_ops, "props_json": props_json, "tumbling": tumbling, "sessions": user_sessions,
}

ORACLES = {
    "bm25_topk": f"WITH {bm25_sql(TERMS)} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20",
    "rrf_fuse": f"""WITH {bm25_sql(['license', 'public'])},
a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm),
b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(n_chars / (n_chars + 1000.0), 6) DESC, doc_id) AS rank FROM documents WHERE n_chars > 0),
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) DESC, vec_id) AS rank FROM embeddings),
u AS (SELECT * FROM a WHERE rank <= 100 UNION ALL SELECT * FROM b WHERE rank <= 100 UNION ALL SELECT * FROM v WHERE rank <= 100)
SELECT id, round(s, 9) AS score FROM (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM u GROUP BY id) ORDER BY s DESC, id LIMIT 50""",
    "authority_rank": "SELECT doc_id AS id, round(n_chars / (n_chars + 2000.0), 6) AS score FROM documents WHERE n_chars > 0 ORDER BY score DESC, id LIMIT 25",
    "significant_terms": f"""WITH r AS (SELECT quality = 0 AS fg, list_distinct({TOKENS_SQL}) AS ts FROM documents JOIN labels USING (doc_id)), n AS (SELECT count(*) FILTER (fg) AS nf, count(*) AS nb FROM r),
t AS (SELECT term, count(*) FILTER (fg) AS fg, count(*) AS bg FROM (SELECT fg, unnest(ts) AS term FROM r) GROUP BY term HAVING count(*) FILTER (fg) >= 3)
SELECT term, fg::BIGINT AS fg, bg::BIGINT AS bg, round(s, 6) AS score FROM (SELECT term, fg, bg, (fg / nf - bg / nb) * (fg / nf) / (bg / nb) AS s FROM t, n) WHERE s > 0 ORDER BY s DESC, term LIMIT 12""",
    "concept_match": f"""WITH r AS (SELECT doc_id, {TOKENS_SQL} AS ts FROM documents), h AS (SELECT doc_id, list_contains(ts, 'the')::INT + list_contains(ts, 'of')::INT + (len(list_filter(ts, lambda x: starts_with(x, 'licen'))) > 0)::INT AS h FROM r)
SELECT doc_id, h >= 3 AS all_terms, h >= 2 AS most_terms FROM h""",
    "sentence_stats": r"""SELECT doc_id, len(string_split(regexp_replace(trim(coalesce(text, ''), ' '), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)))::BIGINT AS n_sentences FROM documents""",
    "text_keys": r"""SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS title_key, trim(regexp_replace(lower(CASE WHEN length(text) > 120 THEN text[:119] || '…' ELSE coalesce(text, '') END), '[^a-z0-9]+', ' ', 'g')) AS short_key,
 length(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))))::BIGINT AS folded, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS n_tokens FROM documents""",
    "line_budget": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
f AS (SELECT doc_id, line, min(pos) AS p FROM l GROUP BY ALL), r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS place, count(*) OVER (PARTITION BY doc_id) > 5 AS truncated FROM f)
SELECT doc_id, line, place::BIGINT AS place, truncated FROM r WHERE place <= 5""",
    "turn_budget": """WITH b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations)
SELECT conv_id, turn, substring(text, 1, (400 - used)::BIGINT) AS text FROM b WHERE used < 400""",
    "alias_dedupe": """WITH a AS (SELECT o_orderkey AS pos, unnest(['c' || o_custkey, 'p' || CAST(round(o_totalprice, 0) AS BIGINT)]) AS alias FROM orders), f AS (SELECT pos, min(pos) OVER (PARTITION BY alias) < pos AS late FROM a)
SELECT pos, bool_or(late) AS duplicate FROM f GROUP BY pos""",
    "missing_refs": "SELECT DISTINCT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "semi_backfill": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "first_linked": "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) = 1",
    "merge_rows": """WITH o AS (SELECT p_partkey, p_name, p_retailprice, 'read' AS state FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || '!' ELSE p_name END AS p_name, p_retailprice + 1 AS p_retailprice FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(n.p_partkey, o.p_partkey) AS p_partkey, CASE WHEN n.p_partkey IS NOT NULL THEN n.p_name ELSE o.p_name END AS p_name, round(CASE WHEN n.p_partkey IS NOT NULL THEN n.p_retailprice ELSE o.p_retailprice END, 4) AS p_retailprice,
 CASE WHEN n.p_partkey IS NULL OR o.p_name = n.p_name THEN o.state END AS state FROM o FULL JOIN n ON o.p_partkey = n.p_partkey""",
    "hash_sample": "SELECT vec_id FROM embeddings ORDER BY md5(vec_id || 'seed-1'), vec_id LIMIT 40",
    "set_ops": """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT 'both' AS part, count(*)::BIGINT AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only_orders', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""",
    "props_json": "WITH r AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(k)::BIGINT AS n, sum(k)::BIGINT AS total, max(k) AS most FROM r GROUP BY event_type",
    "tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sessions": """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true)::INT AS fresh FROM events), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*)::BIGINT AS n_sessions, max(n)::BIGINT AS longest FROM c GROUP BY user_id""",
}
