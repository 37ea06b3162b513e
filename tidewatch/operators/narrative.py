"""Readable alert text from catalyst signals, prompts and replies, and the anomaly feed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions import fixed_values as fv
from tidewatch.functions.documents import with_parsed
from tidewatch.functions.keyed import apply_changes
from tidewatch.functions.text import fixed, number, percent, round_exact, strip_code_fence
from tidewatch.operators.catalyst import catalyst_analysis, events_of_anomalies

CATALYST_FIELDS = [part.split()[0] for part in schemas.CATALYST_DOC.split(",")]


def _catalyst_defaults() -> dict[str, object]:
    """What a missing metadata field stands for; prices and expiry stay unknown."""
    by_kind = {"double": 0.0, "long": 0, "boolean": False, "string": ""}
    out: dict[str, object] = {}
    for part in schemas.CATALYST_DOC.split(","):
        name, kind = part.split()
        out[name] = by_kind[kind]
    out.update({"direction": "unknown", "catalyst_type": "unknown"})
    out.update({"price_from": None, "price_to": None, "hours_to_expiry": None})
    return out


def fill(pattern: str, values: dict[str, Column]) -> Column:
    """A ``{name}`` text format as one concat expression."""
    pieces = [
        values[p[1:-1]] if p.startswith("{") else F.lit(p)
        for p in re.split(r"(\{\w+\})", pattern)
        if p
    ]
    return F.concat(*[p.cast("string") for p in pieces])


def _by_type(formats: dict[str, str], values: dict[str, Column]) -> Column:
    kind, out = F.col("catalyst_type"), None
    for name, pattern in formats.items():
        text = fill(pattern, values)
        out = F.when(kind == name, text) if out is None else out.when(kind == name, text)
    return out.otherwise(fill(formats["unknown"], values))


def direction_word(direction: Column) -> Column:
    out = None
    for name, word in fv.DIRECTION_WORDS.items():
        out = F.when(direction == name, word) if out is None else out.when(direction == name, word)
    return out.otherwise(fv.OTHER_DIRECTION_WORD)


def template_narrative(analysis: DataFrame) -> DataFrame:
    """Add ``template`` (headline, narrative, catalyst_type, confidence, signals, source)."""
    c = F.col
    price_range = F.when(
        c("price_from").isNotNull() & c("price_to").isNotNull(),
        fill(fv.RANGE_FORMAT, {"from": percent(c("price_from")), "to": percent(c("price_to"))}),
    ).otherwise("")
    seconds, tpm = fixed(c("burst_duration_seconds")), fixed(c("trades_per_minute"), 1)
    burst = F.when(
        c("burst_duration_seconds") > 0, fill(fv.BURST_FORMAT, {"seconds": seconds})
    ).otherwise("")
    expiry = F.when(
        c("hours_to_expiry").isNotNull() & (c("hours_to_expiry") != 0),
        F.concat(fixed(c("hours_to_expiry"), 1), F.lit("h")),
    ).otherwise("soon")
    values = {
        "title": c("title"),
        "word": direction_word(c("direction")),
        "magnitude": percent(c("magnitude_pct"), 1),
        "range": price_range,
        "whale": percent(c("whale_trade_pct")),
        "trades": c("trade_count"),
        "tpm": tpm,
        "burst": burst,
        "side": F.when(c("taker_buy_pct") > 0.5, "buy-side").otherwise("sell-side"),
        "taker": percent(c("taker_buy_pct")),
        "expiry": expiry,
        "activity": F.when(
            c("trade_count") > 0, fill(fv.ACTIVITY_FORMAT, {"trades": c("trade_count"), "tpm": tpm})
        ).otherwise(""),
        "category": F.when(
            c("category") != "", fill(fv.CATEGORY_FORMAT, {"category": c("category")})
        ).otherwise(""),
        "direction": c("direction"),
        "share": percent(c("burst_trade_pct")),
        "seconds": seconds,
        "hours": fixed(c("hours_to_expiry"), 1),
    }
    shown = {
        "move": c("magnitude_pct") > 0,
        "trades": c("trade_count") > 0,
        "whale": c("whale_trade_pct") > 0.1,
        "burst": c("burst_detected"),
        "taker": (c("taker_buy_pct") > 0) & (c("trade_count") > 0),
        "expiry": c("hours_to_expiry") < 12,
    }
    signals = F.array_compact(
        F.array(*[F.when(shown[k], fill(p, values)) for k, p in fv.SIGNAL_FORMATS.items()])
    )
    return analysis.withColumn(
        "template",
        F.struct(
            _by_type(fv.HEADLINE_FORMATS, values).alias("headline"),
            _by_type(fv.NARRATIVE_FORMATS, values).alias("narrative"),
            c("catalyst_type").alias("catalyst_type"),
            round_exact(F.col("confidence"), 2).alias("confidence"),
            signals.alias("signals"),
            F.lit("template").alias("source"),
        ),
    )


def enrich_anomalies(
    anomalies: DataFrame,
    found: DataFrame,
    events: DataFrame,
    markets: DataFrame,
    replies: DataFrame | None = None,
) -> DataFrame:
    """Write catalyst metadata into the stored anomalies named by ``found`` (ANOMALY_KEYS)."""
    changes = catalyst_metadata(found, events, markets, replies)
    return apply_changes(anomalies, changes, ["id"], ["metadata"])


def catalyst_metadata(
    found: DataFrame, events: DataFrame, markets: DataFrame, replies: DataFrame | None = None
) -> DataFrame:
    """(id, metadata): signals, template narrative and, where a reply exists, its narrative."""
    window_events = events_of_anomalies(found, events)
    rendered = template_narrative(catalyst_analysis(found, window_events, markets))
    if replies is None:
        told = rendered.withColumn(
            "llm_narrative", F.lit(None).cast(schemas._nested(schemas.MODEL_NARRATIVE_DOC))
        )
    else:
        told = rendered.join(
            replies.select(
                "anomaly_id",
                F.struct("headline", "narrative", "attributed_catalyst", "confidence").alias("llm_narrative"),
            ),
            "anomaly_id",
            "left",
        )
    doc = F.to_json(
        F.struct(*CATALYST_FIELDS, F.col("template").alias("template_narrative"), "llm_narrative"),
        {"ignoreNullFields": "false"},
    )
    return told.select(F.col("anomaly_id").alias("id"), doc.alias("metadata"))


def anomaly_feed(active: DataFrame) -> DataFrame:
    """Active anomalies with the narrative to show.

    A model narrative wins over the stored template, and a stored template over one rendered
    from the stored signals; anomalies without catalyst metadata have none.
    """
    title = F.trim(F.substring_index(F.coalesce("summary", F.lit("")), ":", 1))
    parsed = with_parsed(active, "metadata", schemas.CATALYST_METADATA, "doc")
    # only text that carries a catalyst_type is catalyst metadata
    doc = F.when(F.col("doc.catalyst_type").isNotNull(), F.col("doc"))
    rows = parsed.withColumns({"doc": doc, "title": title})
    flat = rows.select(
        *active.columns, "title", "doc",
        *[
            F.coalesce(F.col(f"doc.{name}"), F.lit(default)).alias(name)
            for name, default in _catalyst_defaults().items()
        ],
    )
    told = template_narrative(flat)
    model, stored = F.col("doc.llm_narrative"), F.col("doc.template_narrative")
    empty = F.lit("")

    def shown(headline, narrative, kind, confidence, signals, source, available, template):
        return F.struct(
            headline.alias("headline"), narrative.alias("narrative"), kind.alias("catalyst_type"),
            confidence.alias("confidence"), signals.alias("signals"), source.alias("source"),
            available.alias("model_available"), template.alias("template_headline"),
        )

    no_signals = F.array().cast("array<string>")
    by_model = shown(
        F.coalesce(model["headline"], empty), F.coalesce(model["narrative"], empty),
        F.col("doc.catalyst_type"), F.coalesce(model["confidence"], F.lit(0.0)),
        F.coalesce(stored["signals"], no_signals), F.lit("llm"), F.lit(True),
        F.coalesce(stored["headline"], empty),
    )
    by_template = shown(
        stored["headline"], stored["narrative"], stored["catalyst_type"], stored["confidence"],
        stored["signals"], stored["source"], F.lit(False), empty,
    )
    t = F.col("template")
    rendered = shown(
        t["headline"], t["narrative"], t["catalyst_type"], t["confidence"], t["signals"],
        t["source"], F.lit(False), empty,
    )
    catalyst = (
        F.when(F.col("doc").isNull(), F.lit(None))
        .when(model.isNotNull(), by_model)
        .when(stored.isNotNull(), by_template)
        .otherwise(rendered)
    )
    return told.select(*active.columns, catalyst.alias("catalyst"))


REPLY_FORMAT = (
    'Answer in JSON only: {"headline": "...", "narrative": "...", "attributed_catalyst": "...", "confidence": 0.0}'
)


def narrative_prompts(analysis: DataFrame, news: DataFrame) -> DataFrame:
    """Prompt text per anomaly from its signals and its news items (anomaly_id, item_pos)."""
    line = F.concat(
        F.lit("["), F.col("source"), F.lit("] "), F.col("title"),
        F.when(
            F.col("snippet") != "", F.concat(F.lit("\n   "), F.col("snippet"))
        ).otherwise(""),
    )
    items = (
        news.groupBy("anomaly_id")
        .agg(F.sort_array(F.collect_list(F.struct("item_pos", line.alias("line")))).alias("items"))
    )
    block = F.array_join(
        F.transform("items", lambda x: F.concat((x["item_pos"] + 1).cast("string"), F.lit(". "), x["line"])),
        "\n",
    )
    c = F.col
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Market: "), c("title")),
        F.concat(F.lit("Direction: "), c("direction"), F.lit(" ("), percent(c("magnitude_pct"), 1), F.lit(")")),
        F.concat(F.lit("Window: "), c("window_minutes"), F.lit(" minutes")),
        F.concat(F.lit("Trades: "), c("trade_count"), F.lit(", "), fixed(c("trades_per_minute"), 1), F.lit("/min")),
        F.concat(F.lit("Whale share: "), percent(c("whale_trade_pct"))),
        F.concat(F.lit("Taker buys: "), percent(c("taker_buy_pct"))),
        F.concat(F.lit("Burst: "), c("burst_detected"), F.lit(", "), fixed(c("burst_duration_seconds")), F.lit("s, "), percent(c("burst_trade_pct"))),
        F.concat(F.lit("Average trade size: "), fixed(c("avg_trade_size"), 1)),
        F.lit("News:"),
        F.coalesce(block, F.lit("(No recent news found)")),
        F.concat(F.lit("Category: "), F.coalesce(F.nullif(c("category"), F.lit("")), F.lit("Unknown"))),
        F.concat(F.lit("Series: "), F.coalesce(F.nullif(c("series_prefix"), F.lit("")), F.lit("N/A")),
                 F.lit(" ("), c("markets_in_series"), F.lit(" markets)")),
        F.concat(F.lit("Hours to expiry: "), F.coalesce(fixed(c("hours_to_expiry"), 1), F.lit("N/A"))),
        F.lit(REPLY_FORMAT),
    )
    return analysis.join(items, "anomaly_id", "left").select("anomaly_id", text.alias("prompt"))


def parse_narrative_replies(replies: DataFrame) -> DataFrame:
    """(anomaly_id, content) -> headline, narrative, attributed catalyst, confidence in [0, 1].

    A reply that is not JSON is the narrative itself.
    """
    doc = "headline string, narrative string, attributed_catalyst string, confidence string"
    confidence = F.coalesce(number(F.col("d.confidence")), F.lit(0.5))
    return with_parsed(replies, strip_code_fence(F.col("content")), doc, "d").select(
        "anomaly_id",
        F.coalesce("d.headline", F.lit(fv.UNPARSED_HEADLINE)).alias("headline"),
        F.coalesce("d.narrative", "content").alias("narrative"),
        F.coalesce("d.attributed_catalyst", F.lit("unknown")).alias("attributed_catalyst"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)).alias("confidence"),
    )


def narrative_pairs(anomalies: DataFrame, since_ms: int | None = None) -> DataFrame:
    """Template and model narrative side by side, for anomalies that have a template."""
    rows = anomalies if since_ms is None else anomalies.filter(F.col("detected_at") >= since_ms)
    rows = with_parsed(rows, "metadata", schemas.CATALYST_METADATA, "d").filter(
        "d.template_narrative is not null"
    )
    model, none = F.col("d.llm_narrative"), F.lit("(no LLM)")
    return rows.select(
        "id",
        "severity",
        F.coalesce("d.catalyst_type", F.lit("?")).alias("type"),
        F.coalesce("d.template_narrative.headline", F.lit("")).alias("template_headline"),
        F.when(model.isNull(), none).otherwise(F.coalesce(model["headline"], F.lit(""))).alias("llm_headline"),
        F.coalesce("d.template_narrative.narrative", F.lit("")).alias("template_narrative"),
        F.when(model.isNull(), none).otherwise(F.coalesce(model["narrative"], F.lit(""))).alias("llm_narrative"),
        model["confidence"].alias("llm_confidence"),
        F.coalesce(model["attributed_catalyst"], F.lit("")).alias("llm_catalyst"),
    )
