"""Event-time windows that run alike on a batch and on a stream, and running centroids per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total per tumbling or sliding window; a stream drops rows later than `late`."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("at", late)
    window = F.window("at", size, slide) if slide else F.window("at", size)
    counted = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, n of runs of a user's events with gaps below `gap`."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("at", late)
    counted = rows.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("session_start"), "n")


class RunningCentroids:
    """Mini-batch centroids: each batch moves a centroid by its share of all vectors seen, then back to length 1.

    `update` fits foreachBatch. Only sums by region reach the driver. The first vectors of the first batch with enough
    rows, by key, are the seeds.
    """

    def __init__(self, k: int, key: str = "vec_id", vector: str = "embedding"):
        self.k, self.key, self.vector = k, key, vector
        self.centres: np.ndarray | None = None
        self.seen = np.zeros(k)

    def update(self, batch: DataFrame, number: int = 0) -> None:
        if self.centres is None:
            rows = batch.orderBy(self.key).limit(self.k).select(self.vector).collect()
            if len(rows) < self.k:
                return
            self.centres = np.array([list(r[0]) for r in rows], float)
            self.centres /= np.maximum(np.linalg.norm(self.centres, axis=1, keepdims=True), 1e-8)
        sums = batch.select(self.vector).mapInPandas(self._sums(), "region int, n bigint, total array<double>").groupBy("region").agg(F.sum("n").alias("n"), F.collect_list("total").alias("totals")).collect()
        for row in sums:
            share = row["n"] / (self.seen[row["region"]] + row["n"])
            mean = np.sum([list(t) for t in row["totals"]], axis=0) / row["n"]
            moved = self.centres[row["region"]] * (1 - share) + mean * share
            self.centres[row["region"]] = moved / max(float(np.linalg.norm(moved)), 1e-8)
            self.seen[row["region"]] += row["n"]

    def _sums(self) -> Callable:
        import pandas as pd

        centres, vector = self.centres, self.vector

        def run(batches):
            total, n = np.zeros_like(centres), np.zeros(len(centres), int)
            for batch in batches:
                x = np.array([list(v) for v in batch[vector]], float)
                at = (x @ centres.T).argmax(axis=1)
                np.add.at(total, at, x)
                np.add.at(n, at, 1)
            used = np.flatnonzero(n)
            yield pd.DataFrame({"region": used.astype("int32"), "n": n[used], "total": list(total[used])})

        return run
