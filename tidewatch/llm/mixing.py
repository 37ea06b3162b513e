"""Mixing sources to target weights, with DataFrame functions only.

Words are counted per document and summed per source. Each source gets a share of the mix by its
weight, at most ``limit`` times its own words; what a full source cannot take goes to the others
by weight (water filling). A document is emitted floor(rate) times, and once more if a number
hashed from its id lies below the fraction, where rate = target / words of its source.

Defined results: a null text has no words; a null source is a source of its own, last in order; a
null id is hashed as the text "null"; repeated rows are documents of their own and share the hashed
number; a source without words has target 0; an empty table gives no rows. Other columns, of
whatever name, are carried by ``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WHITE, running, settle

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
LIMIT = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number from 0 to below 1 that depends on the key and the seed only."""
    named = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT,
            limit: int = LIMIT) -> DataFrame:
    """(source, size) -> one row per source: source, source_size, weight, target.

    The water level is the largest, over all sources in order of fullness, of what is left for a
    source and those after it, divided by their weight.
    """
    if not 0 < percent <= 100 * limit:
        raise ValueError("the share must be above 0 and no more than all sources can give")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = running(totals, [F.col("source").asc_nulls_last()], {})
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = placed.select(
        "source", "source_size",
        F.element_at(cycle, (F.col("row_no") % len(weights) + 1).cast("int")).cast("long").alias("weight"),
    ).withColumn("fullness", F.col("source_size") / F.col("weight"))
    ordered = settle(running(
        weighed, [F.col("fullness"), F.col("source").asc_nulls_last()],
        {"size_before": "source_size", "weight_before": "weight"},
    ))
    whole = ordered.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    if whole.s is None:
        return ordered.select("source", "source_size", "weight", F.lit(0.0).alias("target"))
    left = F.lit(percent * whole.s) - F.lit(100 * limit) * F.col("size_before")
    level = left.cast("double") / (F.lit(100) * (F.lit(whole.w) - F.col("weight_before"))).cast("double")
    water = ordered.agg(F.max(level).alias("level")).first().level
    return ordered.select(
        "source", "source_size", "weight",
        F.least((limit * F.col("source_size")).cast("double"), F.lit(water) * F.col("weight")).alias("target"),
    )


def rates(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The documents' (doc_id, source, size), counted once, and the targets of their sources."""
    sizes = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return sizes, targets(sizes, **options)


def copies(key: Column, rate: Column, seed: str) -> Column:
    whole = F.floor(rate)
    return (whole + (uniform(key, seed) < rate - whole).cast("long")).cast("long")


def plan(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies."""
    sizes, goal = rates(docs, **options)
    goal = goal.withColumnRenamed("source", "goal_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        sizes.join(goal, sizes["source"].eqNullSafe(goal["goal_source"]))
        .select("doc_id", "source", "size", "source_size", "target", rate.alias("rate"))
        .withColumn("copies", copies(F.col("doc_id"), F.col("rate"), seed))
    )


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mixed documents themselves: every row with all its columns, as often as it is drawn."""
    _, goal = rates(docs, **options)
    goal = goal.select(
        F.col("source").alias("goal_source"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )
    # the row is one column, so that none of its columns can clash with those of the plan
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["source"].alias("row_source"), docs["doc_id"].alias("row_id"))
    drawn = rows.join(goal, F.col("row_source").eqNullSafe(F.col("goal_source")))
    times = copies(F.col("row_id"), F.col("rate"), seed).cast("int")
    return drawn.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).select("row.*")
