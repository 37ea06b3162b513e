"""Per-key helpers that stay bounded when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def earliest(value: Column, ts: Column, tie: Column, when: Column | None = None) -> Column:
    """Aggregate: ``value`` of the row with the smallest (ts, tie), NULL-safe on ``when``."""
    order = F.struct(ts, tie)
    return F.min_by(value, order if when is None else F.when(when, order))


def latest(value: Column, ts: Column, tie: Column, when: Column | None = None) -> Column:
    """Aggregate: ``value`` of the row with the largest (ts, tie)."""
    order = F.struct(ts, tie)
    return F.max_by(value, order if when is None else F.when(when, order))


def top_k_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread_by: Sequence[str],
    salts: int = 64,
    rank_col: str | None = None,
) -> DataFrame:
    """The first ``k`` rows of every key in ``order``, exactly, without a hot task.

    Each key is first split over ``salts`` sub-groups by a hash of ``spread_by`` and cut to k
    rows there (Spark also applies that limit map-side), so the final per-key window sorts at
    most ``salts * k`` rows however many rows the key has.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts))
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    second = Window.partitionBy(*keys).orderBy(*order)
    rank = rank_col or "__rank"
    out = (
        df.withColumn("__salt", salt)
        .withColumn("__rank0", F.row_number().over(first))
        .filter(F.col("__rank0") <= k)
        .drop("__rank0", "__salt")
        .withColumn(rank, F.row_number().over(second))
        .filter(F.col(rank) <= k)
    )
    return out if rank_col else out.drop(rank)


def previous_by_chunk(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    value: str,
    chunk_ms: int,
    out: str,
) -> DataFrame:
    """``lag(value)`` per key in (ts, tie) order, computed in time chunks and stitched.

    A plain lag sorts all rows of a key in one task. Here a task sorts one (key, chunk); the
    last value of each chunk is a partial aggregate, and only that small table is lagged per
    key to give the first row of the next chunk its predecessor. Adds ``out`` and a boolean
    ``has_<out>`` (FALSE only for the first row of the key, so a NULL value stays visible).
    """
    chunk = F.floor(F.col(ts) / F.lit(chunk_ms)).cast("long")
    rows = df.withColumn("__chunk", chunk)
    order = F.struct(F.col(ts), F.col(tie))
    edges = rows.groupBy(*keys, "__chunk").agg(
        F.max_by(F.struct(F.col(value).alias("v")), order).alias("__last")
    )
    per_key = Window.partitionBy(*keys).orderBy("__chunk")
    edges = edges.select(
        *keys, "__chunk", F.lag("__last").over(per_key).alias("__prev_chunk_last")
    )
    inside = Window.partitionBy(*keys, "__chunk").orderBy(ts, tie)
    rows = rows.withColumn("__prev", F.lag(F.struct(F.col(value).alias("v"))).over(inside))
    joined = rows.join(edges, [*keys, "__chunk"], "inner")
    prev = F.coalesce(F.col("__prev"), F.col("__prev_chunk_last"))
    return joined.withColumns({out: prev["v"], f"has_{out}": prev.isNotNull()}).drop(
        "__chunk", "__prev", "__prev_chunk_last"
    )


def with_totals(df: DataFrame, *totals: DataFrame) -> DataFrame:
    """Add the columns of one-row aggregates to every row, as scalar subqueries."""
    out = df
    for i, one_row in enumerate(totals):
        name = f"__total{i}"
        row = one_row.select(F.struct(*one_row.columns).alias(name)).scalar()
        out = out.withColumn(name, row).select(
            *[c for c in out.columns], *[F.col(f"{name}.{c}").alias(c) for c in one_row.columns]
        )
    return out


def merge_keyed(
    current: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    columns: dict[str, Column],
) -> DataFrame:
    """Upsert as one full outer join: ``columns`` gives each output column.

    The expressions see the stored row under alias ``cur`` and the new row under ``inc``; the
    key columns are added. Both sides must be unique on ``keys``.
    """
    cur, inc = current.alias("cur"), incoming.alias("inc")
    cond = None
    for key in keys:
        same = F.col(f"cur.{key}") == F.col(f"inc.{key}")
        cond = same if cond is None else cond & same
    merged_keys = [F.coalesce(F.col(f"cur.{k}"), F.col(f"inc.{k}")).alias(k) for k in keys]
    return cur.join(inc, cond, "full_outer").select(
        *merged_keys, *[expr.alias(name) for name, expr in columns.items()]
    )


def apply_changes(
    current: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """UPDATE by key: ``columns`` of matching rows take the new value (NULL keeps the old)."""
    renamed = changes.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns])
    return (
        current.join(renamed, list(keys), "left")
        .select(
            *[
                F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
                for c in current.columns
            ]
        )
    )


def hashed_id(*parts: Column | str) -> Column:
    """Deterministic positive surrogate id from a natural key (stable across task retries)."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)
