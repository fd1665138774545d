"""Folding the frames of a growing map into its state.

Points and links arrive once and pile up; which region a point is in is sent again with each frame for the points so
far, and the last frame that names a point decides; the last placement that isn't null stays.

Defined results: rows with a null frame are left out; a region for a place beyond the points so far is ignored; points
that no frame names keep their own region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folded_points(points: DataFrame, regions: DataFrame) -> DataFrame:
    """place, id, region. points: frame, pos (from 0, in a frame), id, region; regions: frame, place, region. Frames are a
    short list; points are placed by an offset per frame, so no window spans the points."""
    sizes = points.where("frame IS NOT NULL").groupBy("frame").agg(F.count("*").alias("n"))
    sent = sizes.select("frame", "n").unionByName(regions.where("frame IS NOT NULL").select("frame").distinct().join(sizes.select("frame"), "frame", "left_anti").withColumn("n", F.lit(0).cast("bigint")))
    totals = sent.select("frame", "n", F.sum("n").over(W.orderBy("frame").rowsBetween(W.unboundedPreceding, 0)).alias("so_far"))
    placed = points.join(totals, "frame").select((F.col("so_far") - F.col("n") + F.col("pos")).alias("place"), "id", "region")
    named = regions.join(totals.select("frame", "so_far"), "frame").where("place < so_far")
    last = named.groupBy("place").agg(F.max(F.struct("frame", "region")).alias("last"))
    return placed.join(last, "place", "left").select("place", "id", F.when(F.col("last").isNotNull(), F.col("last.region")).otherwise(F.col("region")).alias("region"))


def folded_state(frames: DataFrame) -> DataFrame:
    """One row: stage of the last frame, the last placement. frames: frame, stage, placement."""
    kept = frames.where("frame IS NOT NULL")
    return kept.agg(F.max_by("stage", "frame").alias("stage"), F.max_by("placement", F.when(F.col("placement").isNotNull(), F.col("frame"))).alias("placement"))
