"""Side feeds: order books, news RSS and platform candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.functions.documents import with_parsed
from tidewatch.functions.pricing import first_truthy
from tidewatch.functions.text import number, unescaped

_BOOK = "orderbook struct<yes:array<array<double>>, no:array<array<double>>>"
_RSS = (
    "channel struct<item:array<struct<title:string, link:string, pubDate:string,"
    "description:string>>>"
)


def _levels(c: Column) -> Column:
    return F.filter(
        F.coalesce(c, F.array().cast("array<array<double>>")), lambda lv: F.size(lv) >= 2
    )


def _depth(levels: Column) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda acc, lv: acc + lv[1])


def orderbook_summary(raw: DataFrame) -> DataFrame:
    """(ticker, payload, received_ms) -> depth, best prices and spread; empty books vanish."""
    book = F.col("b.orderbook")
    df = with_parsed(raw, "payload", _BOOK, "b").select(
        "ticker",
        "received_ms",
        F.coalesce(book["yes"], F.array().cast("array<array<double>>")).alias("all_yes"),
        F.coalesce(book["no"], F.array().cast("array<array<double>>")).alias("all_no"),
    )
    df = df.filter((F.size("all_yes") > 0) | (F.size("all_no") > 0))
    yes, no = _levels(F.col("all_yes")), _levels(F.col("all_no"))
    bid = F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(yes, lambda lv: lv[0])), F.lit(0.0)))
    ask = F.least(
        F.lit(1.0),
        F.coalesce(F.array_min(F.transform(no, lambda lv: F.lit(1.0) - lv[0])), F.lit(1.0)),
    )
    no_asks, no_bids = F.size("all_no") == 0, F.size("all_yes") == 0
    best_ask = F.when(no_asks, F.least(F.lit(1.0), bid + fv.ONE_SIDED_SPREAD)).otherwise(ask)
    best_bid = F.when(no_bids, F.greatest(F.lit(0.0), ask - fv.ONE_SIDED_SPREAD)).otherwise(bid)
    return df.select(
        "ticker",
        F.col("received_ms").alias("timestamp"),
        _depth(yes).alias("bid_depth"),
        _depth(no).alias("ask_depth"),
        best_bid.alias("best_bid"),
        best_ask.alias("best_ask"),
        (F.size("all_yes") + F.size("all_no")).alias("levels"),
    ).withColumn(
        "spread", F.greatest(F.lit(0.0), F.col("best_ask") - F.col("best_bid"))
    )


def rss_news_items(raw: DataFrame) -> DataFrame:
    """(feed_id, payload) RSS documents -> the items of each feed.

    "Headline - Source" is split on the last " - "; snippets lose entities and tags.
    """
    items = F.from_xml(F.col("payload"), _RSS)["channel"]["item"]
    df = raw.select("feed_id", F.posexplode(items).alias("pos", "i"))
    full_title = F.coalesce(F.col("i.title"), F.lit(""))
    has_source = full_title.contains(" - ")
    title = F.when(has_source, F.regexp_extract(full_title, r"(?s)^(.*) - ", 1)).otherwise(full_title)
    source = F.when(has_source, F.substring_index(full_title, " - ", -1)).otherwise("")
    text = F.coalesce(F.col("i.description"), F.lit(""))
    text = F.regexp_replace(unescaped(text), r"<[^>]*>", "")
    return df.select(
        "feed_id",
        F.col("pos").alias("item_pos"),
        F.trim(title).alias("title"),
        F.trim(source).alias("source"),
        F.trim(F.coalesce(F.col("i.pubDate"), F.lit(""))).alias("published_at"),
        F.trim(F.coalesce(F.col("i.link"), F.lit(""))).alias("url"),
        F.trim(text).alias("snippet"),
    )


def external_candles(raw: DataFrame) -> DataFrame:
    """(ticker, payload) platform bars, with their alias field names, as chart rows."""
    names = ("period_begin", "time", "t", "open", "open_dollars", "high", "high_dollars",
             "low", "low_dollars", "close", "close_dollars", "volume", "volume_fp")
    bar = F.from_json("payload", ", ".join(f"{n} string" for n in names))
    df = raw.select("ticker", bar.alias("b"))

    def field(*aliases: str) -> Column:
        value = first_truthy(*[F.col(f"b.{a}") for a in aliases])
        return F.coalesce(number(value), F.lit(0.0))

    return df.select(
        "ticker",
        field("period_begin", "time", "t").cast("long").alias("time"),
        field("open", "open_dollars").alias("open"),
        field("high", "high_dollars").alias("high"),
        field("low", "low_dollars").alias("low"),
        field("close", "close_dollars").alias("close"),
        field("volume", "volume_fp").alias("volume"),
    )
