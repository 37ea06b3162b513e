"""Exact de-duplication by distributed radix partitioning from the first byte on.

Normalised texts are split by successive blocks of bytes, each block ``GROWTH`` times as wide as the
one before. After each block a group of one is done, and so are texts that have ended; only the rest
of what is still in a group of several goes on. Texts are equal exactly when they stay together to
their end, so equality rests on the bytes and on no digest. Groups are counted by partial
aggregation and given a number; rows learn it by a join that Spark can split when a group is hot.

Defined results: a null text counts as empty, and empty texts are equal; of a group the row with
the most code points stays, then the smallest id (null last), then the first of repeated rows, so
exactly one row of a group stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WHITE, settle

FIRST_BLOCK = 64
GROWTH = 16
_REST = 2**31 - 1


def _start(docs: DataFrame) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    bare = docs.select("doc_id", body.alias("body"), F.regexp_replace(body, f"[{WHITE}]+", "").alias("bare"))
    return bare.select(
        "doc_id", F.length("body").cast("long").alias("points"), F.xxhash64("body").alias("body_hash"),
        F.unhex(F.sha2("bare", 256)).alias("digest"), F.lit(0).cast("long").alias("group_no"),
        F.col("bare").cast("binary").alias("rest"),
    )


def radix_groups(docs: DataFrame, first_block: int = FIRST_BLOCK, growth: int = GROWTH) -> tuple[DataFrame, DataFrame]:
    """Rows alone in their group, and rows of groups of equal texts with (round_no, group_no)."""
    facts = ["doc_id", "points", "body_hash", "digest"]
    active, width, round_no, alone, ended = _start(docs), first_block, 0, [], []
    while True:
        rows = active.withColumn("block", F.substring("rest", 1, width)).withColumn(
            "rest", F.substring("rest", width + 1, _REST)
        )
        several = settle(
            rows.groupBy("group_no", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .select("group_no", "block", F.monotonically_increasing_id().alias("next_no"))
        )
        # Texts that end with this block leave the group; those that go on keep only their rest.
        split = settle(
            rows.join(several, ["group_no", "block"], "left").select(
                *facts, "next_no",
                F.when(F.col("next_no").isNotNull() & (F.length("rest") > 0), F.col("rest")).alias("rest"),
            )
        )
        alone.append(split.where("next_no is null").select(*facts))
        ended.append(split.where("next_no is not null and rest is null").select(
            *facts, F.lit(round_no).alias("round_no"), F.col("next_no").alias("group_no")))
        active = split.where("rest is not null").select(*facts, F.col("next_no").alias("group_no"), "rest")
        if active.isEmpty():
            return reduce(DataFrame.unionByName, alone), reduce(DataFrame.unionByName, ended)
        width, round_no = width * growth, round_no + 1


def assign(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, body_hash, keep_id, group_size, kept, text_sha256."""
    alone, ended = radix_groups(docs, **options)
    ended = settle(ended.withColumn("row_no", F.monotonically_increasing_id()))
    group = ["round_no", "group_no"]
    order = F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_no"))
    best = ended.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best")).select(
        *group, "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row_no").alias("keep_row")
    )
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    return alone.select(
        "doc_id", "body_hash", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), sha,
    ).unionByName(
        ended.join(best, group).select(
            "doc_id", "body_hash", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), sha
        )
    )


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def with_key(docs: DataFrame) -> DataFrame:
    """The rows as one column ``row``, whatever their columns are called, with the key of a document: its id and its text's hash."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("key_id"), text_hash(docs["text"]).alias("key_hash"))


def keep_rows(docs: DataFrame, named: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs``, all columns, whose (doc_id, body_hash) is in ``named`` (or is not, ``left_anti``); equal rows once."""
    # A null id is a key as any other: the same shuffle serves the join and the removal of equal rows.
    no_id, name = F.col("key_id").isNull(), F.coalesce(F.col("key_id").cast("string"), F.lit(""))
    rows = with_key(docs).select("row", "key_hash", no_id.alias("no_id"), name.alias("name"))
    wanted = named.select(F.col("doc_id").alias("key_id"), F.col("body_hash").alias("key_hash")).select(
        "key_hash", no_id.alias("no_id"), name.alias("name"))
    keys = ["key_hash", "no_id", "name"]
    return rows.join(wanted, keys, how).dropDuplicates(keys).select("row.*")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of equal texts, with all its columns."""
    return keep_rows(docs, assign(docs, **options).where("kept"))
