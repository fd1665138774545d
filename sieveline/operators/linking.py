"""Linking and set operators: alias duplicates, missing references, semi-join backfill, first links, idempotent merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def alias_duplicates(rows: DataFrame, position: str, aliases: Column) -> DataFrame:
    """position, duplicate: whether any alias occurs at an earlier position. This equals walking the rows in order with
    a set of aliases seen, as duplicates add their aliases too. Rows without aliases are no duplicates."""
    spread = rows.select(position, F.explode(aliases).alias("alias"))
    earliest = spread.groupBy("alias").agg(F.min(position).alias("first"))
    hit = spread.join(earliest, "alias").groupBy(position).agg(F.bool_or(F.col("first") < F.col(position)).alias("duplicate"))
    return rows.select(position).join(hit, position, "left").select(position, F.coalesce("duplicate", F.lit(False)).alias("duplicate"))


def missing_references(references: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return references.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def backfill(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def first_link(links: DataFrame, target: str, order: list[Column]) -> DataFrame:
    """The first row of each target in the given order."""
    return links.withColumn("_rank", F.row_number().over(W.partitionBy(target).orderBy(*order))).where("_rank = 1").drop("_rank")


def merge_rows(old: DataFrame, new: DataFrame, key: str, text: str, cached: list[str]) -> DataFrame:
    """New rows replace old ones by key; cached fields stay while the text is unchanged and go to null when it changes."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    is_new = F.col(f"n.{key}").isNotNull()
    same = F.col(f"o.{text}").eqNullSafe(F.col(f"n.{text}")) & F.col(f"o.{key}").isNotNull()
    out = []
    for c in old.columns:
        if c in cached:
            out.append(F.when(~is_new | same, F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*out)


def hash_sample(rows: DataFrame, key: str, seed: str, limit: int) -> DataFrame:
    """A sample that depends on the keys and the seed only."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(limit)


def thinned(rows: DataFrame, key: str, stride: int) -> DataFrame:
    """Rows whose key's CRC-32 is a multiple of the stride."""
    return rows.where(F.crc32(F.col(key).cast("string").cast("binary")) % stride == 0)
