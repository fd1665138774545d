"""Finding prior work for a claim: candidates by similarity, one walk along references, and the list to read.

Defined results: rows with a null id or retracted rows are no candidates; a null score sorts last; ties go to the
smaller id; a reference that several seeds give counts where it comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seeds whose references are followed, references followed, and the score from which work is read: features of the walk.
SEEDS, REFERENCES, READ_SCORE = 6, 200, 0.35


def candidates(rows: DataFrame, score: Column, relation: str, key: str = "id", retracted: str | None = None) -> DataFrame:
    """id, score, relation."""
    kept = rows.where(F.col(key).isNotNull())
    if retracted is not None:
        kept = kept.where(~F.coalesce(F.col(retracted), F.lit(False)))
    return kept.select(F.col(key).alias("id"), score.alias("score"), F.lit(relation).alias("relation"))


def followed(ranked: DataFrame, references: DataFrame, seeds: int = SEEDS, limit: int = REFERENCES) -> DataFrame:
    """ref: up to `limit` works that the best seeds cite and that aren't candidates yet. references: id, place, ref."""
    best = ranked.orderBy(F.desc_nulls_last("score"), "id").limit(seeds)
    seed = best.select("id", F.row_number().over(W.orderBy(F.desc_nulls_last("score"), "id")).alias("seed"))
    cited = references.where("ref IS NOT NULL").join(F.broadcast(seed), "id").groupBy("ref").agg(F.min(F.struct("seed", "place")).alias("first"))
    return cited.join(ranked.select(F.col("id").alias("ref")), "ref", "left_anti").orderBy("first", "ref").limit(limit).select("ref")


def scanned(rows: DataFrame, found: DataFrame, references: DataFrame, score: Column, limit: int, key: str = "id", retracted: str | None = None) -> DataFrame:
    """The candidates found, joined by those one reference away, best first. found: id, score, relation; rows hold all work."""
    near = rows.join(F.broadcast(followed(found, references)), F.col(key) == F.col("ref"), "left_semi")
    return found.unionByName(candidates(near, score, "reference", key, retracted)).orderBy(F.desc_nulls_last("score"), "id").limit(limit)


def to_read(scanned_rows: DataFrame, review: Column, limit: int, least: float = READ_SCORE) -> DataFrame:
    """The best rows of at least the score that aren't reviews."""
    return scanned_rows.where((F.col("score") >= least) & ~F.coalesce(review, F.lit(False))).orderBy(F.desc("score"), "id").limit(limit)
