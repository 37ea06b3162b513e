"""Live feed messages: raw(platform, payload, received_ms) -> normalized events.

Works on batch and streaming DataFrames alike: projections, one explode and one join with the
token map. ``market_id`` is 0 until :func:`resolve_tickers` fills it. Messages numbered in order of
arrival (:func:`with_arrival`) give events that carry the number through every shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.documents import with_parsed
from tidewatch.functions.pricing import cents_to_unit, first_truthy
from tidewatch.functions.text import number

_KALSHI_BODY = ",".join(
    f"{name}:string"
    for name in (
        "market_ticker", "event_ticker", "type", "lifecycle_type", "status", "result", "side",
        "taker_side", "yes_ask_dollars", "yes_bid_dollars", "price_dollars", "yes_price_dollars",
        "no_price_dollars", "no_price", "volume_fp", "count_fp", "count",
    )
)
_KALSHI_MESSAGE = f"type string, msg struct<{_KALSHI_BODY}>"
_POLYMARKET_MESSAGE = (
    "event_type string, type string, asset_id string, price string, size string, side string,"
    "market string, id string, price_changes array<struct<asset_id:string, best_bid:string,"
    "best_ask:string, price:string>>"
)
_MESSAGE = f"{_POLYMARKET_MESSAGE}, msg struct<{_KALSHI_BODY}>"


ARRIVAL = ["arrival", "place"]  # a message's number, and the place of an event in it


def with_arrival(raw: DataFrame) -> DataFrame:
    """Messages with a number that grows in the order in which they are read, given before any shuffle.

    Its upper bits are the partition of the source, so a partition's messages can be counted apart.
    """
    return raw.withColumn("arrival", F.monotonically_increasing_id())


def _numbered(raw: DataFrame, place: Column) -> list[Column]:
    return [F.col("arrival"), place.cast("int").alias("place")] if "arrival" in raw.columns else []


def _doc(**fields: Column) -> Column:
    return F.to_json(
        F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"}
    )


def _event(event_type: Column, value: Column, metadata: Column) -> list[Column]:
    return [
        F.lit(0).cast("long").alias("market_id"),
        event_type.alias("event_type"),
        F.lit(None).cast("double").alias("old_value"),
        value.alias("new_value"),
        metadata.alias("metadata"),
        F.col("received_ms").alias("timestamp"),
    ]


def _update(event_type: Column, asset: Column, value: Column, **doc: Column) -> Column:
    """What a message says of one market: Kalshi's with the metadata made, Polymarket's with the asset to be looked up."""
    none = F.lit(None).cast("string")
    fields = {name: doc.get(name, none) for name in ("asset_id", "size", "side", "bid", "ask", "made")}
    return F.struct(
        event_type.cast("string").alias("event_type"), asset.alias("asset"), value.cast("double").alias("value"),
        *[c.alias(name) for name, c in fields.items()],
    )


def _kalshi_updates(j: Column) -> Column:
    """ticker / trade / market lifecycle / event lifecycle messages."""
    kind, m = j["type"], j["msg"]
    ticker = F.nullif(m["market_ticker"], F.lit(""))
    event_ticker = F.nullif(m["event_ticker"], F.lit(""))
    quote = first_truthy(m["yes_ask_dollars"], m["yes_bid_dollars"], m["price_dollars"])
    traded = first_truthy(m["yes_price_dollars"], m["price_dollars"])
    is_quote = (kind == "ticker") & ticker.isNotNull()
    is_trade = (kind == "trade") & ticker.isNotNull()
    is_market = kind.isin("market_lifecycle", "market_lifecycle_v2") & ticker.isNotNull()
    is_event = (kind == "event_lifecycle") & event_ticker.isNotNull()
    event_type = (
        F.when(is_quote, "price_change")
        .when(is_trade, "trade")
        .when(is_market | is_event, "status_change")
    )
    value = (
        F.when(is_quote, cents_to_unit(number(quote)))
        .when(is_trade, cents_to_unit(number(traded)))
        .when(is_market | is_event, F.lit(0.0))
    )
    metadata = (
        F.when(
            is_quote,
            _doc(
                ticker=ticker,
                yes_ask=m["yes_ask_dollars"],
                yes_bid=m["yes_bid_dollars"],
                volume=m["volume_fp"],
            ),
        )
        .when(
            is_trade,
            _doc(
                ticker=ticker,
                count=F.coalesce(first_truthy(m["count_fp"]), m["count"]),
                side=m["side"],
                taker_side=m["taker_side"],
                no_price=F.coalesce(first_truthy(m["no_price_dollars"]), m["no_price"]),
            ),
        )
        .when(
            is_market,
            _doc(
                ticker=ticker,
                status=F.coalesce(first_truthy(m["status"]), m["result"]),
                result=m["result"],
            ),
        )
        .when(
            is_event,
            _doc(
                event_ticker=event_ticker,
                lifecycle_type=F.coalesce(
                    first_truthy(m["type"]), m["lifecycle_type"], F.lit("unknown")
                ),
                status=m["status"],
                market_ticker=m["market_ticker"],
                source=F.lit("event_lifecycle_v2"),
            ),
        )
    )
    usable = event_type.isNotNull() & value.isNotNull()
    return F.when(usable, F.array(_update(event_type, F.lit(None).cast("string"), value, made=metadata)))


def _polymarket_updates(j: Column) -> Column:
    """last_trade_price / price_change / new_market messages: one update per changed asset."""
    kind = F.coalesce(F.nullif(j["event_type"], F.lit("")), j["type"])

    def update(event_type, asset, value, **doc):
        return _update(F.lit(event_type), asset, value, **doc)

    none = F.lit(None).cast("string")
    trade = update(
        "trade", j["asset_id"], number(j["price"]), size=j["size"], side=j["side"]
    )

    def change(c: Column) -> Column:
        bid, ask = F.coalesce(first_truthy(c["best_bid"]), c["price"]), c["best_ask"]
        mid = (number(bid) + number(ask)) / 2.0
        price = F.when(ask.isNotNull(), mid).otherwise(number(bid))
        return update("price_change", c["asset_id"], F.when(bid.isNotNull(), price), bid=bid, ask=ask)

    listed = update(
        "new_market", none, F.lit(0.0), asset_id=first_truthy(j["market"], j["id"])
    )
    return (
        F.when(kind == "last_trade_price", F.array(trade))
        .when(kind == "price_change", F.transform(j["price_changes"], change))
        .when(kind == "new_market", F.array(listed))
    )


def _looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """The rows with the columns of ``table`` (one row per ``key``), both dealt by the key and merged.

    Spark takes a table made of JSON text for far less than it is, and AQE keeps a planned broadcast where merging
    takes one shuffle more: the table would pass whole through the driver. The hash beside the key has it dealt anew
    behind its aggregation, for only then does AQE split the rows of a hot key.
    """
    dealt = F.xxhash64(key)
    return (
        rows.withColumn("__dealt", dealt)
        .join(table.withColumn("__dealt", dealt).hint("merge"), ["__dealt", key], "left")
        .drop("__dealt")
    )


def _events(raw: DataFrame, schema: str, updates: Column, tokens: DataFrame | None) -> DataFrame:
    """Every message parsed once, its updates exploded once and joined once with the token map.

    Updates of unknown assets are dropped.
    """
    parsed = with_parsed(raw, "payload", schema, "j")
    u = parsed.select("received_ms", *_numbered(raw, F.lit(0))[:1], F.posexplode(updates).alias("at", "u"))
    u = u.select("received_ms", *_numbered(raw, F.col("at")), "u.*").filter(F.col("value").isNotNull())
    is_new, is_made = F.col("event_type") == "new_market", F.col("made").isNotNull()
    if tokens is None:
        u = u.withColumn("condition_id", F.lit(None).cast("string"))
    else:
        # an update without an asset (Kalshi's, new_market) gets a key of its own: it matches no token, and
        # such rows do not pile up in one partition
        spread = F.concat(F.lit("\u0000"), F.xxhash64("received_ms", "asset_id", "made").cast("string"))
        u = _looked_up(u.withColumn("token_id", F.coalesce("asset", spread)), "token_id", tokens)
    metadata = (
        F.when(
            F.col("event_type") == "trade",
            _doc(
                ticker=F.col("condition_id"),
                asset_id=F.col("asset"),
                size=F.col("size"),
                side=F.col("side"),
            ),
        )
        .when(
            F.col("event_type") == "price_change",
            _doc(
                ticker=F.col("condition_id"),
                asset_id=F.col("asset"),
                best_bid=F.col("bid"),
                best_ask=F.col("ask"),
            ),
        )
        .otherwise(_doc(ticker=F.col("asset_id"), source=F.lit("polymarket_ws")))
    )
    known = (
        F.when(is_made, True).when(is_new, F.col("asset_id").isNotNull()).otherwise(F.col("condition_id").isNotNull())
    )
    return u.filter(known).select(
        *_event(F.col("event_type"), F.col("value"), F.coalesce("made", metadata)), *_numbered(raw, F.col("place"))
    )


def normalize_kalshi_messages(raw: DataFrame) -> DataFrame:
    """Kalshi's messages alone, without the token map."""
    return _events(raw.filter(F.col("platform") == "kalshi"), _KALSHI_MESSAGE, _kalshi_updates(F.col("j")), None)


def normalize_polymarket_messages(raw: DataFrame, tokens: DataFrame) -> DataFrame:
    """Polymarket's messages alone."""
    return _events(raw.filter(F.col("platform") == "polymarket"), _POLYMARKET_MESSAGE, _polymarket_updates(F.col("j")), tokens)


def normalize_messages(raw: DataFrame, tokens: DataFrame) -> DataFrame:
    """All platforms in one pass; other message types and malformed JSON yield no event."""
    platform, j = F.col("platform"), F.col("j")
    updates = F.when(platform == "kalshi", _kalshi_updates(j)).when(platform == "polymarket", _polymarket_updates(j))
    return _events(raw.filter(platform.isin("kalshi", "polymarket")), _MESSAGE, updates, tokens)


def resolve_tickers(events: DataFrame, markets: DataFrame) -> DataFrame:
    """Fill ``market_id`` from metadata.ticker among active markets; drop unresolved events.

    Already resolved events pass through the same join with a key that matches nothing, spread
    by hash so that they do not collect in one partition.
    """
    lookup = (
        markets.filter("is_active")
        .groupBy(F.col("external_id").alias("__ticker"))
        .agg(F.max("id").alias("__found"))
    )
    spread = F.concat(F.lit("\u0000"), F.xxhash64("timestamp", "market_id").cast("string"))
    unresolved = F.col("market_id") == 0
    ticker = F.when(unresolved, F.get_json_object("metadata", "$.ticker")).otherwise(spread)
    out = _looked_up(events.withColumn("__ticker", ticker), "__ticker", lookup)
    market_id = F.when(unresolved, F.col("__found")).otherwise(F.col("market_id"))
    return (
        out.withColumn("market_id", market_id)
        .filter(F.col("market_id").isNotNull())
        .select(*events.columns)
    )
