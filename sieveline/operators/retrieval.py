"""Retrieval: BM25, authority saturation, reciprocal rank fusion, significant terms, budgets.

Postings are (id, term, tf) rows; document frequencies and lengths are aggregates joined back, so no index lives on
the driver. Queries are short term lists and are pushed into the posting scan before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.functions.text import tokens


def postings(documents: DataFrame, doc_id: str, text: str, terms: list[str] | None = None) -> DataFrame:
    """id, term, tf; only the given terms, if any."""
    rows = documents.select(F.col(doc_id).alias("id"), F.explode(tokens(F.col(text))).alias("term"))
    if terms is not None:
        rows = rows.where(F.col("term").isin(*terms))
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(documents: DataFrame, doc_id: str, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score of the documents that hold any of the terms: sum of idf * tf (k1 + 1) / (tf + k1 (1 - b + b len / mean))."""
    lengths = documents.select(F.col(doc_id).alias("id"), F.size(tokens(F.col(text))).alias("length"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    found = postings(documents, doc_id, text, terms)
    frequencies = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    joined = found.join(F.broadcast(frequencies), "term").join(lengths, "id").join(F.broadcast(corpus))  # one row, and one a term
    return joined.groupBy("id").agg(F.sum(weight).alias("score"))


def saturation(x: Column, pivot: float) -> Column:
    return x / (x + pivot)


def authority(rows: DataFrame, signals: dict[str, float]) -> DataFrame:
    """Adds score, the sum of the saturated signals (column: pivot); rows without any positive signal are absent."""
    parts = {c: F.when(F.col(c) > 0, saturation(F.col(c), pivot)) for c, pivot in signals.items()}
    some = F.coalesce(*parts.values()).isNotNull()
    return rows.where(some).withColumn("score", sum((F.coalesce(p, F.lit(0.0)) for p in parts.values()), F.lit(0.0)))


def ranked(scores: DataFrame, limit: int) -> DataFrame:
    """id, rank of the best rows, ties to the smaller id. The cut comes before the window, which sees `limit` rows."""
    best = scores.orderBy(F.desc("score"), "id").limit(limit)
    return best.select("id", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("rank"))


def rrf(rankings: list[DataFrame], k: int = 60, limit: int = 500) -> DataFrame:
    """id, score = sum of 1 / (k + rank), best first, ties to the smaller id."""
    together = rankings[0].select("id", "rank")
    for r in rankings[1:]:
        together = together.unionByName(r.select("id", "rank"))
    fused = together.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(limit)


def significant_terms(documents: DataFrame, doc_id: str, text: str, foreground: Column, least: int = 3, top: int = 12) -> DataFrame:
    """term, fg, bg, score: (fg share - bg share) * fg share / bg share over document frequencies."""
    rows = documents.select(F.col(doc_id).alias("id"), foreground.alias("is_fg"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    totals = documents.agg(F.count_if(foreground).alias("n_fg"), F.count("*").alias("n_bg"))
    counted = rows.groupBy("term").agg(F.count_if("is_fg").alias("fg"), F.count("*").alias("bg")).where(F.col("fg") >= least)
    share, base = F.col("fg") / F.col("n_fg"), F.col("bg") / F.col("n_bg")
    scored = counted.join(F.broadcast(totals)).withColumn("score", (share - base) * share / base).where("score > 0")
    return scored.select("term", "fg", "bg", "score").orderBy(F.desc("score"), "term").limit(top)


def starting_with(stem: str) -> Callable[[Column], Column]:
    return lambda token: token.startswith(stem)


def concept_match(token_array: Column, terms: list[str], stems: list[str], share: float | None = None) -> Column:
    """Whether all terms (or a share of them, rounded up) match: a term as a token, a stem as a token's start."""
    hits = [F.array_contains(token_array, t) for t in terms] + [F.exists(token_array, starting_with(s)) for s in stems]
    wanted = len(hits) if share is None else max(1, -(-len(hits) * round(share * 100) // 100))
    return sum((h.cast("int") for h in hits), F.lit(0)) >= wanted


def line_budget(rows: DataFrame, group: str, order: list[str], line: str, limit: int) -> DataFrame:
    """The first `limit` distinct lines of each group in the given order, with place and whether the group was cut."""
    first = rows.groupBy(group, line).agg(F.min(F.struct(*order)).alias("_at"))
    place = F.row_number().over(W.partitionBy(group).orderBy("_at"))
    total = F.count("*").over(W.partitionBy(group))
    return first.select(group, line, place.alias("place"), (total > limit).alias("truncated")).where(F.col("place") <= limit)


def character_budget(rows: DataFrame, group: str, order: str, text: str, limit: int) -> DataFrame:
    """Texts of each group in order until `limit` characters are used, the last one cut."""
    before = F.coalesce(F.sum(F.length(text)).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    used = rows.withColumn("_before", before).where(F.col("_before") < limit)
    return used.withColumn(text, F.substring(F.col(text), F.lit(1), (limit - F.col("_before")).cast("int"))).drop("_before")
