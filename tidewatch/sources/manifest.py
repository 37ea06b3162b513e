"""Which folders make up the event log: micro-batches as they come, and what maintenance has put in their place.

A batch is written to ``ingest_batch=<n>/event_date=<day>`` and counts once it is complete. Maintenance
publishes manifests, ``_log/<version>.json``: the folders that hold the batches up to one number, the
oldest time kept, and the folders that the manifest before it still named. A reader takes the newest
manifest and the complete batches behind it, so it never sees a change half done; folders that left are
deleted a version later. There is one maintenance job at a time: a version cannot be published twice.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import date, timedelta

from pyspark.sql import SparkSession

from tidewatch.sources import files

_BATCH = "ingest_batch="
_DAY = "event_date="


@dataclass(frozen=True)
class Folder:
    path: str  # below the log's root
    day: str  # ISO date
    size: int  # bytes
    parts: int  # data files


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    upto: int = -1  # the last batch that the folders hold
    floor_ms: int | None = None  # older rows do not count any more
    folders: tuple[Folder, ...] = ()
    gone: tuple[str, ...] = field(default=())  # named by the version before, not by this one
    cut_ms: int | None = None  # the oldest time to which the day on the boundary has been written again


def day_of(ms: int) -> str:
    return (date(1970, 1, 1) + timedelta(days=ms // 86_400_000)).isoformat()


def measured(spark: SparkSession, root: str, folder: str) -> list[Folder]:
    """The date folders of a batch folder."""
    out = []
    for name, size in files.listing(spark, f"{root}/{folder}"):
        if size < 0 and name.startswith(_DAY):
            data = [s for n, s in files.listing(spark, f"{root}/{folder}/{name}") if s >= 0 and not n.startswith(("_", "."))]
            out.append(Folder(f"{folder}/{name}", name[len(_DAY):], sum(data), len(data)))
    return out


def published(spark: SparkSession, root: str) -> Manifest | None:
    versions = [int(n[:-5]) for n, _ in files.listing(spark, f"{root}/_log") if n.endswith(".json")]
    if not versions:
        return None
    doc = json.loads(files.read_text(spark, f"{root}/_log/{max(versions)}.json"))
    return Manifest(**{**doc, "folders": tuple(Folder(**f) for f in doc["folders"]), "gone": tuple(doc["gone"])})


def batches_after(spark: SparkSession, root: str, upto: int) -> tuple[list[int], bool]:
    """Complete batches behind ``upto``, and whether all before the last one of them are."""
    named = sorted(int(n[len(_BATCH):]) for n, s in files.listing(spark, root) if s < 0 and n.startswith(_BATCH) and n[len(_BATCH):].isdigit())
    found, whole, gap = [], True, False
    for batch in named:
        if batch <= upto:
            continue
        if any(n == "_SUCCESS" for n, _ in files.listing(spark, f"{root}/{_BATCH}{batch}")):
            found.append(batch)
            whole = whole and not gap
        else:
            gap = True
    return found, whole


def current(spark: SparkSession, root: str) -> Manifest:
    """The newest manifest with all complete batches behind it: what a reader sees."""
    base = published(spark, root) or Manifest()
    fresh = [f for b in batches_after(spark, root, base.upto)[0] for f in measured(spark, root, f"{_BATCH}{b}")]
    return Manifest(base.version, base.upto, base.floor_ms, base.folders + tuple(fresh), base.gone, base.cut_ms)


def folded(spark: SparkSession, root: str) -> Manifest:
    """The newest manifest with the batches behind it up to the first incomplete one: what maintenance may replace."""
    base = published(spark, root) or Manifest()
    fresh, whole = batches_after(spark, root, base.upto)
    if not whole:
        open_at = next(b for b in range(base.upto + 1, fresh[-1]) if b not in fresh and files.listing(spark, f"{root}/{_BATCH}{b}"))
        fresh = [b for b in fresh if b < open_at]
    more = [f for b in fresh for f in measured(spark, root, f"{_BATCH}{b}")]
    return Manifest(base.version, max([base.upto, *fresh]), base.floor_ms, base.folders + tuple(more), base.gone, base.cut_ms)


def publish(
    spark: SparkSession, root: str, old: Manifest, folders: list[Folder], floor_ms: int | None, cut_ms: int | None = None
) -> Manifest:
    """The next version; what the version before it dropped is deleted, as no reader starts from that any more."""
    kept = {f.path for f in folders}
    new = Manifest(old.version + 1, old.upto, floor_ms, tuple(folders), tuple(f.path for f in old.folders if f.path not in kept), cut_ms)
    files.publish_text(spark, f"{root}/_log/{new.version}.json", json.dumps(asdict(new)))
    for path in old.gone:
        files.delete(spark, f"{root}/{path}")
    return new
