"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import settle

__all__ = ["WHITE", "ascii_lower", "running", "settle", "shared_folder", "table", "text_arrow", "slices"]

# The white space of all contracts, for regular expressions and as characters.
WHITE = r"\x20\x09-\x0D"
WHITE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share.

    Where that is unset, as in tests, a folder of our own is set, but only if the driver runs all tasks.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Global row numbers (``row_no`` from 0) and running sums without the row itself.

    ``sums`` maps new columns to summed ones. Rows are dealt by range; only one summary row per
    range is put in a single order, so no task sees more than its range.
    """
    parts = settle(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()))
    totals = parts.groupBy("range_no").agg(
        F.count(F.lit(1)).alias("row_no_0"), *[F.sum(c).alias(f"{new}_0") for new, c in sums.items()]
    )
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "range_no",
        *[F.coalesce(F.sum(f"{c}_0").over(before), F.lit(0)).alias(f"{c}_0") for c in ["row_no", *sums]],
    )
    within = Window.partitionBy("range_no").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    numbered = parts.select(
        "*",
        (F.row_number().over(within) - 1).alias("row_no_1"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{new}_1") for new, c in sums.items()],
    )
    return numbered.join(starts, "range_no").select(
        *df.columns, *[(F.col(f"{c}_0") + F.col(f"{c}_1")).cast("long").alias(c) for c in ["row_no", *sums]]
    )


def slices(batches: Iterable[pa.RecordBatch], rows: int, text_at: int | None = None, mb: int = 8) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most ``rows`` rows and about ``mb`` MB of the text column."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            if text_at is not None:
                while n > 1 and batch.column(text_at).slice(at, n).nbytes > mb << 20:
                    n = (n + 1) // 2
            yield batch.slice(at, n)
            at += n


def text_arrow(column: pa.Array) -> pa.Array:
    """The column as strings with 64-bit offsets, nulls as empty."""
    return column.cast(pa.large_string()).fill_null("")
