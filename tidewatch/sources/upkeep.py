"""Retention and compaction of the event log. Both end by publishing a manifest; readers are not disturbed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.manifest import Folder, Manifest, day_of, folded, measured, publish
from tidewatch.sources.store import read_folders

FILE_BYTES = 128 << 20


def _rewritten(rows: DataFrame, root: str, name: str, *split: str) -> list[Folder]:
    """Rows of the log written to a folder of their own, one file for each day and value of ``split``."""
    order = ["event_date", *split, "market_id", "timestamp"]
    (
        rows.repartition("event_date", *split).sortWithinPartitions(*order).drop(*split)
        .write.mode("overwrite").partitionBy("event_date").parquet(f"{root}/ingest_batch={name}")
    )
    return measured(rows.sparkSession, root, f"ingest_batch={name}")


def prune(spark: SparkSession, root: str, older_than_ms: int, rewrite: bool = True) -> Manifest:
    """Rows before a time leave the log.

    Whole days leave by the change of the manifest. Of the day on the boundary the older rows stop counting
    at once; with ``rewrite`` it is written again without them, else the next compaction does that.
    """
    old, first = folded(spark, root), day_of(older_than_ms)
    floor = max(older_than_ms, old.floor_ms or older_than_ms)
    kept = [f for f in old.folders if f.day >= first]
    cut = [f for f in kept if f.day == first] if rewrite and floor == older_than_ms and floor != old.cut_ms and floor % 86_400_000 else []
    if cut:
        rows = read_folders(spark, root, cut, floor)
        kept = [f for f in kept if f not in cut] + _rewritten(rows, root, f"pruned-{old.version + 1}")
    return publish(spark, root, old, kept, floor, floor if cut else old.cut_ms)


def packed(folders: list[Folder], file_bytes: int) -> list[list[Folder]]:
    """First-fit decreasing: folders of a day put together to about one file each."""
    bins: list[tuple[int, list[Folder]]] = []
    for folder in sorted(folders, key=lambda f: (-f.size, f.path)):
        for at, (size, held) in enumerate(bins):
            if size + folder.size <= file_bytes:
                bins[at] = (size + folder.size, [*held, folder])
                break
        else:
            bins.append((folder.size, [folder]))
    return [held for _, held in bins]


def compact(spark: SparkSession, root: str, file_bytes: int = FILE_BYTES) -> Manifest:
    """Small files of a day become a few of about ``file_bytes``.

    A day is written again where folders can be put together, a folder has files far below the size, or
    rows before the log's oldest time are left. Only the batches that were complete at the start are
    touched; those that come meanwhile are read from their own folders.
    """
    old = folded(spark, root)
    bounded = day_of(old.floor_ms) if old.floor_ms not in (None, old.cut_ms) and old.floor_ms % 86_400_000 else None
    by_day: dict[str, list[Folder]] = {}
    for folder in old.folders:
        by_day.setdefault(folder.day, []).append(folder)
    work: list[tuple[Folder, int]] = []
    for day, folders in by_day.items():
        small = folders if day == bounded else [f for f in folders if f.size < file_bytes // 2 * f.parts]
        bins = packed(small, file_bytes)
        if day == bounded or len(bins) < sum(f.parts for f in small):
            work += [(f, number) for number, held in enumerate(bins) for f in held]
    if not work:
        return publish(spark, root, old, list(old.folders), old.floor_ms, old.cut_ms) if old.upto >= 0 else old
    # one row per folder, far fewer than the rows they name
    names = spark.createDataFrame([(*f.path.replace("ingest_batch=", "").replace("event_date=", "").split("/"), n) for f, n in work],
                                  "ingest_batch string, day string, file_no int")
    rows = read_folders(spark, root, [f for f, _ in work], old.floor_ms, with_batch=True)
    placed = rows.withColumn("day", F.col("event_date").cast("string")).join(names, ["ingest_batch", "day"]).drop("ingest_batch", "day")
    fresh = _rewritten(placed, root, f"compacted-{old.version + 1}", "file_no")
    replaced = {f.path for f, _ in work}
    return publish(spark, root, old, [f for f in old.folders if f.path not in replaced] + fresh, old.floor_ms, old.floor_ms)
