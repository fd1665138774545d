"""Map operators: k-means and principal axes, the neighbour threshold, bands between regions, calibration.

A pass over the vectors yields one set of partial sums a partition, which a grouped sum combines; only a model (k
centroids, or one matrix of the vectors' width) reaches the driver. Vectors that are null, of another width, not finite
or all zero take no part; ties go to the smaller region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import cosine, dot, norm, usable_vector
from sieveline.plans.lineage import cut

#: Rows that k-means is seeded from at most, the first by a hash of the key and the seed.
SEED_ROWS = 4_096
#: Pairs of regions with their vectors that may be broadcast.
BROADCAST_PAIRS = 5_000


def unit(batch: pd.Series) -> np.ndarray:
    x = np.array(batch.tolist(), dtype=np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)


def summed(rows: DataFrame, parts) -> np.ndarray:
    """The sum over all batches of the flat arrays that parts(batch) yields; one array a partition leaves a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                now = parts(batch)
                total = now if total is None else total + now
        if total is not None:
            yield pd.DataFrame({"place": np.arange(len(total)), "value": total})

    together = rows.mapInPandas(run, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    return together.sort_values("place")["value"].to_numpy()


def seeds(rows: DataFrame, k: int, seed: int, key: str, vector: str) -> np.ndarray:
    """k-means++ in cosine space on a bounded sample: a candidate weighs clip(1 - best cosine, 0) squared."""
    place, share = F.xxhash64(key, F.lit(seed)), min(1.0, 4 * SEED_ROWS / max(rows.count(), 1))
    sample = rows.where(F.pmod(place, F.lit(1 << 40)) <= int(share * (1 << 40))).orderBy(place, key).limit(SEED_ROWS).toPandas()
    if not len(sample):
        return np.zeros((0, 0))
    x, draw = unit(sample[vector]), np.random.default_rng(seed)
    chosen = [x[draw.integers(len(x))]]
    while len(chosen) < min(k, len(x)):
        weight = np.clip(1 - (x @ np.array(chosen).T).max(axis=1), 0, None) ** 2
        chosen.append(x[draw.choice(len(x), p=weight / weight.sum()) if weight.sum() > 0 else draw.integers(len(x))])
    return np.array(chosen)


def kmeans(rows: DataFrame, width: int, k: int, iterations: int = 25, seed: int = 0, key: str = "vec_id", vector: str = "embedding", warm: np.ndarray | None = None) -> tuple[np.ndarray, DataFrame]:
    """Unit centroids, and key, region, cosine of each row. `warm` centroids replace the seeding; an empty region keeps its
    centroid; iterations end early once no centroid moves."""
    usable = cut(rows.where(usable_vector(F.col(vector), width)).select(key, vector))
    centres = seeds(usable, k, seed, key, vector) if warm is None else warm
    if not len(centres):
        return centres, usable.select(key, F.lit(None).cast("int").alias("region"), F.lit(None).cast("double").alias("cosine"))
    for _ in range(iterations):

        def parts(batch: pd.DataFrame, centres: np.ndarray = centres) -> np.ndarray:
            x = unit(batch[vector])
            total = np.zeros_like(centres)
            np.add.at(total, (x @ centres.T).argmax(axis=1), x)
            return total.ravel()

        total = summed(usable, parts).reshape(centres.shape)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        moved = np.where(length > 1e-8, total / np.maximum(length, 1e-8), centres)
        still, centres = np.abs(moved - centres).max() < 1e-9, moved
        if still:
            break

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = unit(batch[vector]) @ centres.T
                yield pd.DataFrame({key: batch[key], "region": near.argmax(axis=1).astype("int32"), "cosine": near.max(axis=1)})

    return centres, usable.mapInPandas(assign, f"{key} bigint, region int, cosine double")


def principal_axes(rows: DataFrame, width: int, axes: int = 2, vector: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """The mean and the leading axes of the covariance; each axis's weight of the largest magnitude is positive."""

    def parts(batch: pd.DataFrame) -> np.ndarray:
        x = np.array(batch[vector].tolist(), dtype=np.float64)
        return np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))

    total = summed(rows.where(usable_vector(F.col(vector), width)).select(vector), parts)
    if not len(total):
        return np.zeros(width), np.eye(axes, width)
    mean = total[1 : width + 1] / total[0]
    _, found = np.linalg.eigh(total[width + 1 :].reshape(width, width) / total[0] - np.outer(mean, mean))
    leading = found[:, ::-1][:, :axes].T
    return mean, leading * np.sign(leading[np.arange(len(leading)), np.abs(leading).argmax(axis=1)])[:, None]


def projected(rows: DataFrame, mean: np.ndarray, axes: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, x, y by expressions of Spark."""
    usable = rows.where(usable_vector(F.col(vector), len(mean)))
    flat = lambda values: F.array(*[F.lit(float(v)) for v in values])
    return usable.select(key, *[(dot(F.col(vector), flat(a)) - float(mean @ a)).alias(n) for n, a in zip("xy", axes)])


def region_pairs(centres: DataFrame, region: str = "label") -> DataFrame:
    """l < r with their centroids a and b, separation (cosine), midpoint, and blocked: whether a third region is at least as
    close to the midpoint as the farther parent. centres is a model of a few hundred rows, held as one array."""
    model = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(region).alias("r"), F.col("centroid").alias("c")))).alias("model"))
    left = centres.select(F.col(region).alias("l"), F.col("centroid").alias("a")).join(F.broadcast(model))
    both = left.select("l", "a", "model", F.explode(F.filter("model", lambda m: m["r"] > F.col("l"))).alias("m")).select("l", "a", "model", F.col("m.r").alias("r"), F.col("m.c").alias("b"))
    lengths = both.withColumns({"na": norm(F.col("a")), "nb": norm(F.col("b"))})
    middle = lengths.withColumn("midpoint", F.zip_with("a", "b", lambda x, y: x / F.col("na") + y / F.col("nb")))
    farther = F.least(cosine(F.col("a"), F.col("midpoint")), cosine(F.col("b"), F.col("midpoint")))
    third = F.exists("model", lambda m: (m["r"] != F.col("l")) & (m["r"] != F.col("r")) & (cosine(m["c"], F.col("midpoint")) >= F.col("farther")))
    return middle.withColumn("farther", farther).select("l", "r", "a", "b", "midpoint", cosine(F.col("a"), F.col("b")).alias("separation"), third.alias("blocked"))


def neighbour_threshold(pairs: DataFrame, floor: float = 0.35, share: float = 0.9) -> DataFrame:
    """One row: threshold, the interpolated percentile of all separations, the floor at least."""
    return pairs.agg(F.greatest(F.lit(floor), F.coalesce(F.percentile("separation", F.lit(share)), F.lit(floor))).alias("threshold"))


def gaps(rows: DataFrame, assigned: DataFrame, pairs: DataFrame, floor: float = 0.35, occupancy: float = 0.1, region: str = "label", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """l, r, separation, support, band, openness, open of each near pair that no third region blocks.

    The members of both regions go to the nearest of the two centroids and the midpoint: support is the thinner
    centroid's share, band the midpoint's. Rows meet the pairs by region; counting combines map-side.
    """
    near = cut(pairs.join(F.broadcast(neighbour_threshold(pairs, floor))).where("separation >= threshold AND NOT blocked").drop("threshold", "blocked"))
    ends = near.select("*", F.explode(F.array("l", "r")).alias("_end"))
    members = rows.join(assigned.select(key, F.col(region).alias("_end")), key).select("_end", vector)
    met = members.join(F.broadcast(ends) if near.count() <= BROADCAST_PAIRS else ends, "_end")
    to = lambda c: cosine(F.col(vector), F.col(c))
    scored = met.select("l", "r", "separation", to("a").alias("x"), to("b").alias("y"), to("midpoint").alias("z"))
    counted = scored.groupBy("l", "r", "separation").agg(F.count_if((F.col("x") >= F.col("y")) & (F.col("x") >= F.col("z"))).alias("at_l"), F.count_if((F.col("y") > F.col("x")) & (F.col("y") >= F.col("z"))).alias("at_r"), F.count("*").alias("n"))
    support, band = F.least("at_l", "at_r"), F.col("n") - F.col("at_l") - F.col("at_r")
    return counted.where(support > 0).select("l", "r", "separation", support.alias("support"), band.alias("band"), (1 - band / support).alias("openness"), (band <= occupancy * support).alias("open"))


def calibration(regions: DataFrame, later: DataFrame, is_null: Column, is_effect: Column, region: str = "label") -> DataFrame:
    """regions: region, state, attempts before a cutoff; later: rows after it with their nearest region. Returns by state the
    regions, prior attempts, later rows, nulls and effects, and the nulls' share (null without later rows)."""
    arrived = later.groupBy(region).agg(F.count("*").alias("n"), F.count_if(is_null).alias("nulls"), F.count_if(is_effect).alias("effects"))
    both = regions.join(arrived, region, "left")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    out = both.groupBy("state").agg(F.count("*").alias("regions"), total("attempts", "prior_attempts"), total("n", "later_papers"), total("nulls", "later_null"), total("effects", "later_effect"))
    return out.withColumn("later_null_share", F.try_divide("later_null", "later_papers"))
