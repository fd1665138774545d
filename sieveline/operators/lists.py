"""Predicates, counts, orders and groups over lists of studies, as DataFrame and column expressions.

Defined results: null flags count as false unless said otherwise; orders are total, ties go by the place given; empty
tables give empty results, or zeros where one row of counts is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The order of verdicts in answers, titles of syntheses and guidelines, and kinds of primary work.
ANSWER_ORDER = ("effect", "credible_null", "reported_null", "failed", "unreported", "inconclusive")
SYNTHESES = (
    "systematic review", "scoping review", "narrative review", "umbrella review", "literature review", "integrative review", "rapid review",
    "meta-analysis", "meta analysis", "metaanalysis", "meta-analyses", "meta analyses", "metaanalyses", "clinical practice guideline", "clinical practice recommendations",
    "consensus guideline", "consensus recommendations", "evidence-based guideline", "evidence-based recommendations", "evidence based guideline", "evidence based recommendations",
)
GUIDES, GUIDE_KINDS, GUIDE_LINKS = ("guideline", "guidelines", "recommendation", "recommendations"), ("", "international ", "clinical ", "practice "), ("for", "on", "from")
PRIMARY_KINDS = ("article", "preprint", "dissertation")


# -- predicates


def is_synthesis(title: Column) -> Column:
    """Whether a title names a synthesis or begins as a guideline does; words count whole, a plural s may follow."""
    named = r"\b(" + "|".join(SYNTHESES) + r")s?\b"
    opens = r"^(" + "|".join(GUIDE_KINDS) + r")(" + "|".join(GUIDES) + r")\s+(" + "|".join(GUIDE_LINKS) + r")\b"
    text = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " ")
    return text.rlike(named) | text.rlike(opens)


def is_nonprimary(title: Column, kind: Column) -> Column:
    return F.coalesce(~kind.isin(*PRIMARY_KINDS), F.lit(False)) | is_synthesis(title)


def is_primary_study(kind: Column, is_review: Column) -> Column:
    """A missing kind counts as a study, a missing review flag as no review."""
    return (F.coalesce(kind, F.lit("study")) == "study") & ~F.coalesce(is_review, F.lit(False))


def in_domain(url: Column, *domains: str) -> Column:
    """Whether the last part of a topic's address is one of the domains."""
    return F.coalesce(F.substring_index(url, "/", -1).isin(*domains), F.lit(False))


def extractable(row: dict[str, Column], today: Column, days: int) -> Column:
    """Whether a study is to be extracted: no review, with an abstract or full text, not from a registry alone, and not
    extracted within so many days."""
    false = F.lit(False)
    fresh = F.coalesce(F.date_diff(today, row["extracted_on"]) <= days, false)
    return ~F.coalesce(row["is_review"], false) & (F.coalesce(F.length(F.trim(row["abstract"])) > 0, false) | row["pmcid"].isNotNull()) & ~F.coalesce(row["source"] == "ctgov", false) & ~fresh


# -- counts


def match_counts(rows: DataFrame, matched: Column, kind: Column, is_review: Column, has_control: Column) -> DataFrame:
    """One row: total, matched studies, excluded (0 at least), controlled ones among the matched."""
    hit = F.coalesce(matched, F.lit(False)) & is_primary_study(kind, is_review)
    found = rows.agg(F.count("*").alias("total"), F.count_if(hit).alias("matched"), F.count_if(hit & F.coalesce(has_control, F.lit(False))).alias("controlled"))
    return found.select("total", "matched", F.greatest(F.col("total") - F.col("matched"), F.lit(0).cast("bigint")).alias("excluded"), "controlled")


def spin_rate(rows: DataFrame, linked: Column, has_results: Column, spun: Column) -> DataFrame:
    """One row: linked studies with results, those of them with possible spin, and the share (null of none)."""
    base = F.coalesce(linked & has_results, F.lit(False))
    found = rows.agg(F.count_if(base).alias("checked"), F.count_if(base & F.coalesce(spun, F.lit(False))).alias("spun"))
    return found.withColumn("rate", F.try_divide("spun", "checked"))


def rarest(rows: DataFrame, value: Column, n: int) -> DataFrame:
    """The n values, trimmed and not empty, that occur least; ties by value."""
    texts = rows.select(F.trim(value).alias("value")).where("value <> ''")
    return texts.groupBy("value").agg(F.count("*").alias("n")).orderBy("n", "value").limit(n)


def trend(rows: DataFrame, key: str, direction: Column) -> DataFrame:
    """A row for each key with the number of studies of each direction."""
    return rows.groupBy(key).agg(*[F.count_if(F.coalesce(direction == d, F.lit(False))).alias(d) for d in ("positive", "negative", "unclear")])


def usage(calls: DataFrame, tokens_in: Column, tokens_out: Column, price_in: float, price_out: float, millis: Column, cached: Column) -> DataFrame:
    """One row: calls, tokens, cost of the calls that weren't cached and of all as if none were, and latency."""
    cost = (tokens_in * price_in + tokens_out * price_out) / 1e6
    return calls.agg(
        F.count("*").alias("calls"), F.coalesce(F.sum(tokens_in + tokens_out), F.lit(0).cast("bigint")).alias("tokens"), F.round(F.coalesce(F.sum(F.when(~cached, cost)), F.lit(0.0)), 6).alias("paid"),
        F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 6).alias("uncached_cost"), F.coalesce(F.sum(millis), F.lit(0).cast("bigint")).alias("millis"),
    )


def year_axis(counts: DataFrame) -> DataFrame:
    """counts: year, n. All years from the first to the last, 0 where there are none; peak marks the one year with the most."""
    ends = counts.agg(F.min("year").alias("low"), F.max("year").alias("high"), F.max("n").alias("most"))
    sole = counts.join(F.broadcast(ends)).where("n = most").agg(F.count("*").alias("peaks"))
    years = ends.where("low IS NOT NULL").crossJoin(F.broadcast(sole)).select(F.explode(F.sequence("low", "high")).alias("year"), "most", "peaks")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return years.join(counts, "year", "left").select("year", n.alias("n"), ((n == F.col("most")) & (F.col("peaks") == 1)).alias("peak"))


def agreement(pairs: DataFrame, verified: Column, equal: Column) -> DataFrame:
    """One row: pairs, those verified on both sides with equal facts, the rate, and whether all agree."""
    found = pairs.agg(F.count("*").alias("pairs"), F.count_if(F.coalesce(verified & equal, F.lit(False))).alias("agreed"))
    return found.select("pairs", "agreed", F.try_divide("agreed", "pairs").alias("rate"), ((F.col("pairs") > 0) & (F.col("agreed") == F.col("pairs"))).alias("enable"))


# -- orders


def first_of(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each key; place from 1."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def fused_by_place(rankings: DataFrame, k: int = 60) -> DataFrame:
    """rankings: list, id, rank (from 0). Reciprocal ranks 1 / (k + rank + 1) summed by id; ties to the id met first, list
    by list."""
    score = F.sum(1.0 / (F.col("rank") + k + 1))
    return rankings.groupBy("id").agg(F.round(score, 12).alias("score"), F.min(F.struct("list", "rank")).alias("met")).orderBy(F.desc("score"), "met").select("id", "score")


def paper_order(key: str, verdict: Column, year: Column, sample: Column, citations: Column, place: Column) -> list[Column]:
    """Sort columns of a list of papers: inconclusive ones last, then by the key with unknowns last, then as they came."""
    known_year = F.nullif(year, F.lit(0))
    answer = F.array_position(F.array(*[F.lit(v) for v in ANSWER_ORDER]), verdict)
    keys = {"answer": [answer], "relevance": [], "newest": [known_year.desc_nulls_last()], "oldest": [known_year.asc_nulls_last()], "sample": [sample.desc_nulls_last()], "citations": [citations.desc_nulls_last()]}
    return [F.coalesce(verdict == "inconclusive", F.lit(False)), *keys[key], place]


def table_order(caption: Column, outcome: str, baseline: str, place: Column) -> list[Column]:
    """Tables of outcomes first, those of baselines last."""
    text = F.lower(F.coalesce(caption, F.lit("")))
    return [F.when(text.rlike(outcome), 0).when(text.rlike(baseline), 2).otherwise(1), place]


def pulled(text: Column, plus: list[str], minus: list[str]) -> Column:
    """How many of the wanted words a text holds less how many unwanted ones."""
    body = F.lower(F.coalesce(text, F.lit("")))
    hits = lambda words: sum((body.contains(w.lower()).cast("int") for w in words), F.lit(0))
    return hits(plus) - hits(minus)


def batches(rows: DataFrame, key: str, size: int, parts: int = 64) -> DataFrame:
    """batch and slot of each row in the order of the key, batches of `size`, without one ordered task: rows are dealt to
    ranges of the key, whose counts are summed first."""
    ranged = rows.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id())
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    placed = ranged.withColumn("row", F.row_number().over(W.partitionBy("part").orderBy(key))).join(F.broadcast(before), "part")
    at = F.col("before") + F.col("row") - 1
    return placed.select(*[F.col(c) for c in rows.columns], F.floor(at / size).cast("bigint").alias("batch"), (at % size).cast("int").alias("slot"))


# -- sets and groups


def united(*lists: Column) -> Column:
    """Sorted distinct values of all lists, without nulls; a null list is empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*[F.coalesce(x, empty) for x in lists]))))


def contains_all(inner: Column, outer: Column) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def exclusive_groups(claims: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """claims: position, label, id; known: id. Each known id belongs to the first group that claims it; groups that keep
    fewer than `least` ids go. Returns label, id."""
    owned = claims.join(known.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min_by("label", "position").alias("label"), F.min("position").alias("position"))
    sizes = owned.groupBy("position").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("position")
    return owned.join(sizes, "position", "left_semi").select("label", "id")


def ordered_get(store: DataFrame, wanted: DataFrame, key: str, *without: str) -> DataFrame:
    """The stored rows of the wanted ids (id, position), each once at its first position; ids that aren't stored are left out."""
    first = wanted.groupBy(key).agg(F.min("position").alias("position"))
    return store.drop(*without).join(first, key)


def overlaid(page: DataFrame, extracted: DataFrame, key: str, *names: str) -> DataFrame:
    """The page's rows with the named columns replaced where an extracted row of the id has them."""
    over = extracted.select(key, *[F.col(n).alias(f"over_{n}") for n in names])
    return page.join(over, key, "left").select(*[F.coalesce(f"over_{c}", c).alias(c) if c in names else F.col(c) for c in page.columns])
