"""Mixing sources to target weights by entropy balancing.

Each source gets a token target. Of all document rates between 0 and `max_copies` that meet the target, those nearest
to 1 in relative entropy are r(x) = min(max_copies, exp(l * x)), x a document's size over its source's mean size: the
rates are exponentially tilted, and the multiplier l of each source solves a convex dual, done by Newton steps. The
constraints of different sources share no document, so the dual separates by source and the steps run distributed,
one task a source, on the counts of documents of each size. (The distinct sizes of a source are at most the square
root of twice its words.) Rates become whole copies by carrying the rounding error from the largest size to the
smallest, so each source's taken words miss its target by about half of its smallest documents' size.

Defined results: a null or blank text has size 0 and takes 0 words; a null source is a source of its own, after all
others; repeated rows are separate documents of equal rank; a source of size 0 has target 0; an empty table gives an
empty result; further columns of the documents, whatever their names, pass through `mix` untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.llm.text import SPACE_RE, free_name, keep_columns, ship_package, text_of
from sieveline.plans.lineage import cut, stored

# Fixed values of the production mix.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_COPIES = 2

#: Parts in which documents of one source and size are ranked, so that no task gets all of a hot size.
RANK_PARTS = 256
#: Ids that may be broadcast; beyond that a join is shuffled.
BROADCAST_IDS = 400_000


def size_of(text: str = "text") -> Column:
    """Words of the text."""
    return F.regexp_count(text_of(text), F.lit(SPACE_RE.replace("[", "[^"))).cast("bigint")


def fill_targets(sizes: np.ndarray, weights: np.ndarray, share: float, most: float) -> np.ndarray:
    """Shares by weight of share * sum(sizes); a source stops at most * its size and the excess is shared again."""
    left, limit, target = share * float(sizes.sum()), most * sizes.astype(float), np.zeros(len(sizes))
    open_ = np.ones(len(sizes), bool)
    while open_.any():
        give = left * weights / weights[open_].sum()
        over = open_ & (give > limit)
        if not over.any():
            target[open_] = give[open_]
            break
        target[over] = limit[over]
        left -= float(limit[over].sum())
        open_ &= ~over
    return target


def tilt(sizes: np.ndarray, counts: np.ndarray, target: float, most: float, steps: int = 60) -> np.ndarray:
    """Rates of the sizes that meet the target: safeguarded Newton steps on the dual, which increases in l."""
    total = float((sizes * counts).sum())
    if total <= 0 or target <= 0:
        return np.zeros(len(sizes))
    if target >= most * total:
        return np.full(len(sizes), float(most))
    x, mass, cap = sizes / (total / counts.sum()), sizes * counts, np.log(most)
    positive = x[sizes > 0].min()
    low, high, l = -1.0, cap / positive, 0.0
    while (mass * np.exp(np.minimum(low * x, cap))).sum() > target:
        low *= 2
    for _ in range(steps):
        rate = np.exp(np.minimum(l * x, cap))
        miss = float((mass * rate).sum()) - target
        if abs(miss) <= 1e-9 * target:
            break
        low, high = (low, l) if miss > 0 else (l, high)
        slope = float((mass * x * rate)[l * x < cap].sum())
        step = l - miss / slope if slope > 0 else low - 1
        l = step if low < step < high else (low + high) / 2
    return np.exp(np.minimum(l * x, cap))


def round_copies(sizes: np.ndarray, counts: np.ndarray, rates: np.ndarray, most: int) -> np.ndarray:
    """Copies that each size takes in all, from the largest size on; what rounding leaves is carried on in words."""
    out, carry = np.zeros(len(sizes), np.int64), 0.0
    for k in np.argsort(-sizes, kind="stable"):
        if sizes[k] > 0:
            want = sizes[k] * counts[k] * rates[k] + carry
            out[k] = min(max(round(want / sizes[k]), 0), most * int(counts[k]))
            carry = want - out[k] * sizes[k]
    return out


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_COPIES) -> DataFrame:
    """One row a source: source, source_size, target. Only this table of sources comes to the driver."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size")).toPandas()
    rows = rows.assign(_null=rows["source"].isna(), _key=[(s or "").encode("utf-32-be", "surrogatepass") for s in rows["source"]]).sort_values(["_null", "_key"]).reset_index(drop=True)
    cycle = np.array([weights[i % len(weights)] for i in range(len(rows))])
    rows["target"] = fill_targets(rows["source_size"].to_numpy(np.int64), cycle, share, most) if len(rows) else []
    data = [(s if isinstance(s, str) else None, int(n), float(t)) for s, n, t in zip(rows["source"], rows["source_size"], rows["target"], strict=True)]
    return sized.sparkSession.createDataFrame(data, "source string, source_size bigint, target double")


def copies_by_size(cells: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """cells: source, size, n, target. Adds copies, the copies that all n documents of the cell take together."""

    def solve(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("size")
        sizes, counts = cell["size"].to_numpy(np.float64), cell["n"].to_numpy(np.float64)
        rates = tilt(sizes, counts, float(cell["target"].iloc[0]), most)
        return cell.assign(copies=round_copies(sizes, counts, rates, most))[["source", "size", "n", "copies"]]

    return cells.groupBy("source").applyInPandas(solve, "source string, size bigint, n bigint, copies bigint")


def plan_mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_COPIES) -> DataFrame:
    """documents: any columns with doc_id, text, source. Returns doc_id, size, source_size, target, copies, with a
    row for each document. Ties of a size are broken by a hash of the id, so that reruns agree."""
    spark = documents.sparkSession
    ship_package(spark)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(RANK_PARTS)).cast("int")
    sized = cut(keep_columns(documents, "doc_id", "source", "text").select("doc_id", "source", size_of().alias("size"), part.alias("part")))
    targets = source_targets(sized, weights, share, most)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    parts = sized.groupBy("source", "size", "part").agg(F.count("*").alias("n_part"))
    cells = parts.groupBy("source", "size").agg(F.sum("n_part").alias("n"))
    cells = cells.join(targets, same(cells, targets), "left").select(cells["source"], "size", "n", "target")
    solved = copies_by_size(cells, most)
    # A cell's copies go to its parts in proportion: part k ends at floor(copies * (documents up to k) / n).
    up_to = F.sum("n_part").over(W.partitionBy("source", "size").orderBy("part"))
    parts = parts.withColumn("up_to", up_to)
    shared = parts.join(solved, same(parts, solved) & (parts["size"] == solved["size"]), "left").select(
        parts["source"], parts["size"], "part", "n_part",
        (F.expr("(copies * up_to) div n") - F.expr("(copies * (up_to - n_part)) div n")).alias("part_copies"),
    )
    ranked = sized.withColumn("rank", F.row_number().over(W.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")))
    out = ranked.join(shared, same(ranked, shared) & (ranked["size"] == shared["size"]) & (ranked["part"] == shared["part"]), "left").select(
        "doc_id", ranked["source"], ranked["size"],
        (F.expr("part_copies div n_part") + (F.col("rank") <= F.expr("part_copies % n_part")).cast("bigint")).alias("copies"),
    )
    return out.join(targets, same(out, targets), "left").select("doc_id", "size", "source_size", "target", F.least("copies", F.lit(most)).alias("copies"))


def mix(documents: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, all columns untouched. Rows of one id are taken equally often, the
    least of their copies."""
    plan = plan_mix(documents)
    of, times = free_name(documents, "taken_id"), free_name(documents, "taken_times")
    taken = stored(plan.where("copies > 0").groupBy("doc_id").agg(F.min("copies").cast("int").alias(times)).withColumnRenamed("doc_id", of))
    found = documents.join(F.broadcast(taken) if taken.count() <= BROADCAST_IDS else taken, documents["doc_id"].eqNullSafe(taken[of]))
    return found.select(*[documents[c] for c in documents.columns], F.explode(F.array_repeat(F.lit(0), taken[times])).alias(times)).drop(times)


def mixed_documents(documents: DataFrame) -> DataFrame:
    """Digest columns: doc_id, size, source_size, target, taken, copies."""
    plan = plan_mix(documents)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), "copies")
