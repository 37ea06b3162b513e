"""Declared schemas of every table and JSON document; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_KINDS = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "string": T.StringType(), "boolean": T.BooleanType(),
}


def _struct(spec: str) -> T.StructType:
    """``"id long!, title string"`` -> StructType; ``!`` marks a required column."""
    out = T.StructType()
    for part in spec.split(","):
        name, kind = part.split()
        required = kind.endswith("!")
        out.add(name, _KINDS[kind.rstrip("!")], not required)
    return out


MARKETS = _struct(
    "id long!, platform string!, external_id string!, title string!, description string,"
    "category string, end_date string, is_active boolean!, first_seen_at long!,"
    "last_updated_at long!, volume double, yes_price double, price_updated_at long"
)
EVENTS = _struct(
    "id long, market_id long!, event_type string!, old_value double, new_value double!,"
    "metadata string, timestamp long!"
)
SNAPSHOTS = _struct(
    "platform string!, external_id string!, title string!, description string, category string,"
    "is_active boolean!, yes_price double, no_price double, volume double, end_date string,"
    "snapshot_ts long!"
)
CANDLES = _struct(
    "market_id long!, interval string!, open_ts long!, close_ts long!, open double!,"
    "high double!, low double!, close double!, volume long!, trade_count int!, created_at long!"
)
CLUSTERS = _struct(
    "id long!, name string!, description string, created_at long!, updated_at long!"
)
MEMBERSHIPS = _struct(
    "market_id long!, cluster_id long!, confidence double!, assigned_at long!"
)
ANOMALIES = _struct(
    "id long!, anomaly_type string!, severity double!, topic_cluster_id long, market_count int!,"
    "window_start long!, detected_at long!, summary string, status string!, metadata string"
)
ANOMALY_MARKETS = _struct(
    "anomaly_id long!, market_id long!, price_delta double, volume_ratio double"
)
LINKS = _struct(
    "market_id_a long!, market_id_b long!, confidence double!, method string!, created_at long!"
)
RAW_MESSAGES = _struct("platform string!, payload string!, received_ms long!")
USERS = (
    T.StructType()
    .add("user_id", T.StringType(), False)
    .add("categories", T.ArrayType(T.StringType()))
    .add("platforms", T.ArrayType(T.StringType()))
    .add("alerts_enabled", T.BooleanType())
    .add("email_notifications", T.BooleanType())
)
ALERTS = _struct(
    "user_id string!, type string!, title string, message string, anomaly_id long,"
    "market_id long, is_read boolean!, created_at long!"
)

# --- fixed values: members of the string enums -------------------------------------------
PLATFORMS = ("kalshi", "polymarket")
EVENT_TYPES = ("price_change", "volume_update", "status_change", "new_market", "trade")
ANOMALY_TYPES = ("single_market", "cluster", "cross_platform")
ANOMALY_STATUSES = ("active", "expired", "acknowledged")
# -----------------------------------------------------------------------------------------

# JSON documents kept in `metadata` columns.
NARRATIVE_DOC = (
    "headline string, narrative string, catalyst_type string, confidence double,"
    "signals array<string>, source string"
)
MODEL_NARRATIVE_DOC = (
    "headline string, narrative string, attributed_catalyst string, confidence double"
)
CATALYST_DOC = (
    "direction string, magnitude_pct double, price_from double, price_to double,"
    "trade_count long, trades_per_minute double, whale_trade_pct double, taker_buy_pct double,"
    "avg_trade_size double, burst_detected boolean, burst_duration_seconds double,"
    "burst_trade_pct double, category string, series_prefix string, hours_to_expiry double,"
    "markets_in_series long, confidence double, catalyst_type string"
)

def _nested(doc: str) -> str:
    """``"a string, b double"`` -> ``"struct<a:string,b:double>"``."""
    fields = []
    for part in doc.split(","):
        name, kind = part.split()
        fields.append(f"{name}:{kind}")
    return f"struct<{','.join(fields)}>"


CATALYST_METADATA = (
    f"{CATALYST_DOC}, template_narrative {_nested(NARRATIVE_DOC)},"
    f" llm_narrative {_nested(MODEL_NARRATIVE_DOC)}"
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to a declared schema; absent nullable columns become NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def checked(col: str, allowed: tuple[str, ...]) -> Column:
    """The column itself; a value outside ``allowed`` fails the write that reads it."""
    c = F.col(col)
    return F.when(c.isin(*allowed), c).otherwise(
        F.raise_error(F.concat(F.lit(f"bad {col}: "), F.coalesce(c, F.lit("NULL"))))
    )
