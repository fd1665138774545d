"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows for costly work by row: dealt to all cores where the files' splits are fewer, as one row group is one split."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def scan(spark: SparkSession, paths: list[str], wanted: list[str], predicate: Column | None = None, limit: int | None = None) -> DataFrame:
    """The wanted columns that exist, dates as text, of the rows that pass; column pruning reaches the files."""
    rows = spark.read.parquet(*paths)
    if predicate is not None:
        rows = rows.where(predicate)
    kinds = dict(rows.dtypes)
    out = rows.select(*[F.col(c).cast("string").alias(c) if kinds[c] in ("date", "timestamp", "timestamp_ntz") else F.col(c) for c in wanted if c in kinds])
    return out.limit(limit) if limit is not None else out


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the raw text of bad ones."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad IS NULL").drop("_bad"), rows.where("_bad IS NOT NULL").select("_bad")


def plan_manifest(files: DataFrame, skip: int = 0, take: int | None = None, largest_first: bool = False) -> DataFrame:
    """files: url, size_bytes, position. The planned parts with the bytes up to each; duplicates and sizes below 1 fail.
    A manifest is a short list, so one ordered window is fine."""
    bad = files.groupBy("url").agg(F.count("*").alias("n"), F.min("size_bytes").alias("least")).where("n > 1 OR least IS NULL OR least < 1")
    if not bad.isEmpty():
        raise ValueError("manifest parts must be distinct and have a positive size")
    order = [F.desc("size_bytes"), F.col("position")] if largest_first else [F.col("position")]
    placed = files.withColumn("place", F.row_number().over(W.orderBy(*order)))
    chosen = placed.where(F.col("place") > skip)
    if take is not None:
        chosen = chosen.where(F.col("place") <= skip + take)
    return chosen.withColumn("bytes_up_to", F.sum("size_bytes").over(W.orderBy("place")))


def fingerprint(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header line, by column name: columns that the files lack are null, further ones ignored."""
    names = spark.read.option("header", True).csv(path).columns
    wanted = spark.createDataFrame([], schema).schema
    have = {c: c for c in names}
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*[(F.col(f"`{have[f.name]}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').csv(path)
