"""Line de-duplication across documents.

Every text is cut into lines; a line's key is hashed, documents are counted per hash, and lines
whose key is found in ``min_docs`` documents or more are dropped everywhere but in the document of
the largest id. Only (hash, document, position) is shuffled; each document's kept positions then
pick its lines from the text again, so no text is exploded into a shuffle.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` code points
are never dropped; equal ids count as one document, a null id counts as none and never keeps a
frequent line (unless only null ids hold it); repeated rows get equal results, row by row; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WHITE_CHARS, ascii_lower, settle

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE_CHARS)))


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, body and the hash of the body; (doc_id, hash) names a row's content."""
    body = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", body.alias("body"), F.xxhash64(body).alias("body_hash"))


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, body_hash, pos, h1, h2 of all lines with keys long enough; two seeds make 128 bits."""
    lines = _named(docs).select("doc_id", "body_hash", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    key = lines.select("doc_id", "body_hash", "pos", line_key(F.col("line")).alias("key"))
    return key.where(F.length("key") >= min_chars).select(
        "doc_id", "body_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2")
    )


def frequent_keys(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2, last_id of the keys in at least ``min_docs`` documents."""
    # A document counts once per key: distinct pairs first (no hot key there), then partial counts.
    pairs = lines.select("h1", "h2", "doc_id").distinct()
    return (
        pairs.groupBy("h1", "h2").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("last_id"))
        .where(F.col("n") >= min_docs).select("h1", "h2", "last_id")
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped, one row per input row."""
    lines = keyed_lines(docs, min_chars)
    # Written once: the join then has an exchange on either side, and Spark can split a hot line's.
    frequent = settle(frequent_keys(lines, min_docs))
    drops = (
        lines.join(frequent, ["h1", "h2"])
        .where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last_id")))
        .groupBy("doc_id", "body_hash").agg(F.collect_set("pos").alias("drop"))
        .select(F.col("doc_id").alias("drop_id"), F.col("body_hash").alias("drop_hash"), "drop")
    )
    named = _named(docs)
    joined = named.join(
        drops, named["body_hash"].eqNullSafe(drops["drop_hash"]) & named["doc_id"].eqNullSafe(drops["drop_id"]), "left"
    ).withColumn("lines", F.split("body", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    chosen = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return joined.select(
        "doc_id",
        F.when(F.col("drop").isNull(), F.col("body")).otherwise(chosen).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
