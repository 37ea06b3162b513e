"""Market listings: raw listing JSON -> market rows, plus the lookups built from listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.functions.documents import with_parsed
from tidewatch.functions.pricing import (
    category_from_title,
    first_truthy,
    kalshi_yes_price,
    polymarket_yes_price,
    standard_category,
)
from tidewatch.functions.text import iso_millis, number, title_case

_KALSHI_LISTING = ", ".join(
    f"{name} string"
    for name in (
        "ticker", "id", "event_ticker", "title", "status", "close_time", "category",
        "event_category", "series_category", *fv.KALSHI_DESCRIPTION_FIELDS,
        *fv.KALSHI_PRICE_FIELDS, *fv.KALSHI_VOLUME_FIELDS,
    )
)
_POLYMARKET_LISTING = (
    "conditionId string, question string, description string, outcomePrices string,"
    "clobTokenIds string, volume string, bestBid string, bestAsk string, lastTradePrice string,"
    "active boolean, closed boolean, endDate string, category string"
)


def _open_at(end_date: Column, now_ms: int) -> Column:
    """Not past its end; a missing or unparsable end date counts as open."""
    end_ms = iso_millis(end_date)
    return end_ms.isNull() | (end_ms > now_ms)


def _snapshot(df: DataFrame, platform: str, yes_price: Column, **cols: Column) -> DataFrame:
    return df.withColumn("yes_price", yes_price).select(
        F.lit(platform).alias("platform"),
        cols["external_id"].alias("external_id"),
        cols["title"].alias("title"),
        cols["description"].alias("description"),
        cols["category"].alias("category"),
        F.lit(True).alias("is_active"),
        F.col("yes_price"),
        (F.lit(1.0) - F.col("yes_price")).alias("no_price"),
        cols["volume"].alias("volume"),
        cols["end_date"].alias("end_date"),
        F.col("received_ms").alias("snapshot_ts"),
        *([cols["extra"]] if "extra" in cols else []),
    )


def normalize_kalshi_listing(raw: DataFrame, now_ms: int) -> DataFrame:
    """Raw listing JSON (``payload``, ``received_ms``) -> tradable market snapshots."""
    m = with_parsed(raw, "payload", _KALSHI_LISTING, "m").select("received_ms", "m.*")
    kept = m.filter(
        first_truthy(F.col("ticker"), F.col("id")).isNotNull()
        & (F.col("title") != "")
        & F.col("status").isin(*fv.TRADABLE_STATUSES)
        & _open_at(F.col("close_time"), now_ms)
    )
    raw_category = first_truthy(
        F.col("category"), F.col("event_category"), F.col("series_category")
    )
    volume = first_truthy(*[F.col(c) for c in fv.KALSHI_VOLUME_FIELDS])
    description = first_truthy(*[F.col(c) for c in fv.KALSHI_DESCRIPTION_FIELDS])
    return _snapshot(
        kept,
        "kalshi",
        kalshi_yes_price([F.col(c) for c in fv.KALSHI_PRICE_FIELDS]),
        external_id=first_truthy(F.col("ticker"), F.col("id")),
        title=F.col("title"),
        description=F.coalesce(description, F.lit("")),
        category=standard_category(raw_category, F.col("title"), "kalshi"),
        volume=F.coalesce(number(volume), F.lit(0.0)),
        end_date=F.col("close_time"),
        extra=F.col("event_ticker"),
    )


def normalize_polymarket_listing(raw: DataFrame, now_ms: int) -> DataFrame:
    """Raw listing JSON -> open market snapshots."""
    m = with_parsed(raw, "payload", _POLYMARKET_LISTING, "m").select("received_ms", "m.*")
    kept = m.filter(
        (F.col("conditionId") != "")
        & (F.col("question") != "")
        & F.col("active")
        & ~F.coalesce(F.col("closed"), F.lit(False))
        & _open_at(F.col("endDate"), now_ms)
    )
    return _snapshot(
        kept,
        "polymarket",
        polymarket_yes_price(
            F.col("outcomePrices"), F.col("lastTradePrice"), F.col("bestBid"), F.col("bestAsk")
        ),
        external_id=F.col("conditionId"),
        title=F.col("question"),
        description=F.coalesce(F.col("description"), F.lit("")),
        category=standard_category(F.col("category"), F.col("question"), "polymarket"),
        volume=F.coalesce(number(F.col("volume")), F.lit(0.0)),
        end_date=F.col("endDate"),
    )


def enrich_with_event_metadata(snapshots: DataFrame, event_dim: DataFrame) -> DataFrame:
    """Take category and group title from the event dimension (event_ticker, category, title).

    When the event has a title it becomes the description, and a differing non-empty old
    description becomes the market title, so outcomes of one event stay distinguishable.
    """
    dim = event_dim.select(
        "event_ticker",
        F.col("category").alias("__category"),
        F.nullif(F.col("title"), F.lit("")).alias("__event_title"),
    )
    joined = snapshots.join(dim, "event_ticker", "left")
    old = F.col("description")
    retitle = F.col("__event_title").isNotNull() & (old != "") & (old != F.col("__event_title"))
    return joined.select(
        *[
            {
                "category": F.when(
                    F.col("__category") != "",
                    F.when(F.trim("__category") != "", title_case(F.trim("__category"))).otherwise(
                        category_from_title(F.col("title"), "kalshi")
                    ),
                ).otherwise(F.col("category")),
                "description": F.coalesce(F.col("__event_title"), old),
                "title": F.when(retitle, old).otherwise(F.col("title")),
            }.get(c, F.col(c)).alias(c)
            for c in snapshots.columns
        ]
    )


def known_kalshi_categories(spark) -> DataFrame:
    return spark.createDataFrame(
        list(fv.KALSHI_CATEGORIES.items()), "keyword string, category string"
    )


def flatten_taxonomy(taxonomy: DataFrame, known: DataFrame) -> DataFrame:
    """New (keyword, category) rows from ``payload`` = {"categories": [{name, tags[]}]}.

    Keys already in ``known`` win; among new ones the first category in document order wins.
    """
    doc = "categories array<struct<name:string, category:string, tags:array<string>>>"
    cats = taxonomy.select(
        "doc_id", F.posexplode(F.from_json("payload", doc)["categories"]).alias("pos", "c")
    )
    name = first_truthy(F.col("c.name"), F.col("c.category"))
    words = F.concat(
        F.transform(F.coalesce(F.col("c.tags"), F.array().cast("array<string>")), F.lower),
        F.array(F.lower(F.trim(name))),
    )
    rows = cats.filter(name.isNotNull()).select(
        F.posexplode(words).alias("word_pos", "keyword"),
        title_case(F.trim(name)).alias("category"),
        F.struct("doc_id", "pos").alias("at"),
    )
    first = rows.groupBy("keyword").agg(
        F.min_by("category", F.struct("at", "word_pos")).alias("category")
    )
    return first.join(known.select("keyword"), "keyword", "left_anti")


def token_map(raw: DataFrame) -> DataFrame:
    """(token_id, condition_id) from listings; a token listed twice keeps its last listing."""
    m = with_parsed(raw, "payload", _POLYMARKET_LISTING, "m")
    tokens = m.filter((F.col("m.conditionId") != "") & (F.col("m.clobTokenIds") != "")).select(
        "received_ms",
        F.col("m.conditionId").alias("condition_id"),
        F.explode(F.from_json("m.clobTokenIds", "array<string>")).alias("token_id"),
    )
    return tokens.groupBy("token_id").agg(
        F.max_by("condition_id", F.struct("received_ms", "condition_id")).alias("condition_id")
    )


def tickers_to_tokens(tickers: DataFrame, tokens: DataFrame) -> DataFrame:
    """Token ids of the wanted tickers (``external_id``)."""
    wanted = tickers.select(F.col("external_id").alias("condition_id")).distinct()
    return tokens.join(wanted, "condition_id", "inner").select("condition_id", "token_id")
