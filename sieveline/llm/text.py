"""Shared pieces of the text operators: word patterns, null handling, shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: White space as the contracts know it: the space and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"

#: Arrow batches of this many rows keep a batch of very long texts within a Python worker's memory.
BATCH_ROWS = 500


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text that isn't null, in order; [] for a blank text."""
    return F.array_remove(F.split(text, SPACE_RE), "")


def keep_columns(frame: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads; further columns, whatever their names, can't clash with its own."""
    return frame.select(*[frame[name].alias(name) for name in names])


def free_name(frame: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as a column of the frame (in any case) is called so."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for clusters that don't have it installed."""
    context = spark.sparkContext
    if context.getLocalProperty("sieveline.shipped") == context.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / "sieveline_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, os.path.join(root.name, source.relative_to(root)))
    context.addPyFile(str(target))
    context.setLocalProperty("sieveline.shipped", context.applicationId)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch: a text has no length limit, so the default of 10,000 rows is too many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def arrow_rows(frame: DataFrame, column: str, describe: Callable[..., tuple], schema: str, *more: str) -> DataFrame:
    """The frame's columns but for `column` and `more`, untouched in their Arrow form (ids beside nulls stay integers),
    and those of `schema`, which `describe` gives for each row's value of `column` and `more`."""
    kept = [c for c in frame.columns if c not in (column, *more)]
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(*values) for values in zip(*(batch.column(c).to_pylist() for c in (column, *more)), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(made)
            arrays = [pa.array(values, field.type) for values, field in zip(columns, made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + arrays, [*kept, *made.names])

    kept_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name in kept)
    return frame.mapInArrow(run, f"{kept_schema}, {schema}" if kept else schema)
