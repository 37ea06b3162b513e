"""Catalyst attribution, narratives and the anomaly feed. The anomalies are the stored ones,
each with the three days before it as its window."""

from pyspark.sql import functions as F

from tidewatch.operators import catalyst as c
from tidewatch.operators import detection as d
from tidewatch.operators import narrative as n
from tidewatch.session import shared_folder
from tidewatch.sources import store
from workload.registry import register

MINUTES = 4320


def found(v):
    a = v.anomalies.filter("anomaly_type = 'single_market'").select(
        F.col("id").alias("anomaly_id"), "detected_at", (F.col("detected_at") - MINUTES * 60_000).alias("window_start"),
        F.lit(MINUTES).alias("window_minutes"),
    )
    return a.join(v.anomaly_markets.select("anomaly_id", "market_id"), "anomaly_id")


def window_events(v):
    return c.events_of_anomalies(found(v), v.events)


def analysis(v):
    return c.catalyst_analysis(found(v), window_events(v), v.markets)


EV = f"""fa AS (SELECT a.id AS anomaly_id, l.market_id, detected_at, detected_at - {MINUTES * 60_000} AS window_start
    FROM mk_anomalies a JOIN mk_anomaly_markets l ON l.anomaly_id = a.id WHERE anomaly_type = 'single_market'),
  we AS (SELECT fa.anomaly_id, e.*
    FROM fa JOIN mk_events e ON e.market_id = fa.market_id AND e."timestamp" BETWEEN window_start AND detected_at)"""
PM = """pm AS (SELECT anomaly_id, arg_min(new_value, ("timestamp", id)) AS price_from, arg_max(new_value, ("timestamp", id)) AS price_to
    FROM we WHERE event_type = 'price_change' GROUP BY 1),
  pr AS (SELECT *, CASE WHEN price_from > 0 THEN abs((price_to - price_from) / price_from) ELSE 0 END AS magnitude_pct,
    CASE WHEN price_from > 0 THEN CASE WHEN price_to > price_from THEN 'up' WHEN price_to < price_from THEN 'down' ELSE 'flat' END
      ELSE 'unknown' END AS direction FROM pm)"""
TF = f"""tt AS (SELECT *, new_value * cnt AS dol FROM we WHERE event_type = 'trade'),
  tf AS (SELECT anomaly_id, count(*) AS trade_count, CAST(count(*) AS DOUBLE) / {MINUTES} AS trades_per_minute,
    coalesce(coalesce(sum(dol) FILTER (WHERE dol >= 500), 0) / nullif(sum(dol), 0), 0) AS whale_trade_pct,
    coalesce(coalesce(sum(dol) FILTER (WHERE taker = 'yes'), 0) / nullif(sum(dol), 0), 0) AS taker_buy_pct,
    avg(cnt) AS avg_trade_size FROM tt GROUP BY 1)"""
_W = MINUTES * 60_000 // 5
BD = f"""bc AS (SELECT a.anomaly_id, a."timestamp" AS s, count(DISTINCT b.id) AS n, max(b."timestamp") AS hi FROM tt a JOIN tt b
    ON a.anomaly_id = b.anomaly_id AND b."timestamp" BETWEEN a."timestamp" AND a."timestamp" + {_W} GROUP BY 1, 2),
  bb AS (SELECT anomaly_id, arg_max(n, (n, -s)) AS n, arg_max(hi - s, (n, -s)) AS dur FROM bc GROUP BY 1),
  bd AS (SELECT bb.anomaly_id, trade_count >= 5 AND CAST(n AS DOUBLE) / trade_count >= 0.6 AS burst_detected,
    CASE WHEN trade_count >= 5 AND CAST(n AS DOUBLE) / trade_count >= 0.6 THEN CAST(n AS DOUBLE) / trade_count ELSE 0 END AS burst_trade_pct,
    CASE WHEN trade_count >= 5 AND CAST(n AS DOUBLE) / trade_count >= 0.6 THEN CAST(dur AS DOUBLE) / 1000 ELSE 0 END AS burst_duration_seconds
    FROM bb JOIN tf USING (anomaly_id))"""
AN = f"""{EV}, {PM}, {TF}, {BD},
  an AS (SELECT fa.anomaly_id, k.title, k.category, split_part(k.external_id, '-', 1) AS series_prefix, price_from, price_to,
    coalesce(magnitude_pct, 0) AS magnitude_pct, coalesce(direction, 'unknown') AS direction, coalesce(trade_count, 0) AS trade_count,
    coalesce(trades_per_minute, 0) AS tpm, coalesce(whale_trade_pct, 0) AS w, coalesce(burst_detected, false) AS bd, coalesce(burst_trade_pct, 0) AS bp,
    coalesce(taker_buy_pct, 0) AS tb, coalesce(burst_duration_seconds, 0) AS bs, coalesce(avg_trade_size, 0) AS sz
    FROM fa LEFT JOIN mk_markets k ON k.id = fa.market_id LEFT JOIN pr USING (anomaly_id) LEFT JOIN tf USING (anomaly_id) LEFT JOIN bd USING (anomaly_id)),
  ct AS (SELECT *, CASE WHEN w >= 0.5 AND trade_count >= 3 THEN 'whale' WHEN bd AND bp >= 0.7 THEN 'news'
      WHEN trade_count >= 10 AND w < 0.3 AND magnitude_pct >= 0.05 THEN 'momentum' ELSE 'unknown' END AS catalyst_type,
    least(1, CASE WHEN w >= 0.5 AND trade_count >= 3 THEN 0.3 + 0.4 * w WHEN bd AND bp >= 0.7 THEN 0.4 + 0.3 * bp
      WHEN trade_count >= 10 AND w < 0.3 AND magnitude_pct >= 0.05 THEN 0.3 + 0.3 * least(1, tpm / 5) ELSE 0.1 END) AS confidence FROM an)"""



def _pct(x: str, digits: int = 0) -> str:
    return f"printf('%.{digits}f%%', CAST({x} * 100 AS DOUBLE))"


def _num(x: str, digits: int = 0) -> str:
    return f"printf('%.{digits}f', CAST({x} AS DOUBLE))"


TEXT = f"""{AN},
  tx AS (SELECT *, CASE direction WHEN 'up' THEN 'surged' WHEN 'down' THEN 'dropped' WHEN 'flat' THEN 'held steady' ELSE 'moved' END
      || ' ' || {_pct('magnitude_pct', 1)} AS moved,
    CASE WHEN price_from IS NULL THEN '' ELSE ' from ' || {_pct('price_from')} || ' to ' || {_pct('price_to')} END AS rng FROM ct),
  told AS (SELECT anomaly_id, catalyst_type,
    CASE catalyst_type WHEN 'whale' THEN 'Large trades drove ' || title || ' ' || moved
      WHEN 'news' THEN 'Activity burst hit ' || title || ' — ' || moved
      WHEN 'momentum' THEN 'Sustained pressure pushed ' || title || ' ' || moved ELSE title || ' ' || moved END AS headline,
    title || ' ' || moved || rng || CASE catalyst_type
      WHEN 'whale' THEN '. ' || {_pct('w')} || ' of volume came from large trades (over $500 each) across ' || trade_count
        || ' trades. This pattern suggests a few large participants drove the move rather than broad market sentiment.'
      WHEN 'news' THEN ' on ' || {_num('tpm', 1)} || ' trades/min' || CASE WHEN bs > 0 THEN ', concentrated in a ' || {_num('bs')} || 's burst' ELSE '' END
        || '. The concentrated activity pattern is consistent with a news-driven reaction or data release.'
      WHEN 'momentum' THEN ' over ' || trade_count || ' trades. The move was ' || CASE WHEN tb > 0.5 THEN 'buy-side' ELSE 'sell-side' END
        || '-driven (' || {_pct('tb')} || ' taker buys) with no whale dominance, suggesting broad directional conviction.'
      ELSE '.' || CASE WHEN trade_count > 0 THEN ' ' || trade_count || ' trades at ' || {_num('tpm', 1)} || '/min.' ELSE '' END
        || CASE WHEN category <> '' THEN ' Category: ' || category || '.' ELSE '' END END AS narrative,
    concat_ws('; ', CASE WHEN magnitude_pct > 0 THEN direction || ' ' || {_pct('magnitude_pct', 1)} END,
      CASE WHEN trade_count > 0 THEN trade_count || ' trades' END, CASE WHEN w > 0.1 THEN {_pct('w')} || ' whale volume' END,
      CASE WHEN bd THEN 'burst: ' || {_pct('bp')} || ' of trades in ' || {_num('bs')} || 's' END,
      CASE WHEN tb > 0 AND trade_count > 0 THEN {_pct('tb')} || ' buy-side' END) AS signals FROM tx)"""
PROMPT = f"""WITH {AN} SELECT ct.anomaly_id, concat_ws(chr(10), 'Market: ' || title, 'Direction: ' || direction || ' (' || {_pct('magnitude_pct', 1)} || ')',
    'Window: {MINUTES} minutes', 'Trades: ' || trade_count || ', ' || {_num('tpm', 1)} || '/min', 'Whale share: ' || {_pct('w')}, 'Taker buys: ' || {_pct('tb')},
    'Burst: ' || bd || ', ' || {_num('bs')} || 's, ' || {_pct('bp')}, 'Average trade size: ' || {_num('sz', 1)}, 'News:',
    '1. [Wire] News ' || market_id || ' 0' || chr(10) || '   snippet', '2. [Wire] News ' || market_id || ' 1',
    'Category: ' || category, 'Series: ' || series_prefix || ' (0 markets)', 'Hours to expiry: N/A', '{n.REPLY_FORMAT}') AS prompt
  FROM ct JOIN fa USING (anomaly_id)"""

register(
    "anomaly_window_events",
    lambda v: window_events(v).select("anomaly_id", "id"),
    f"WITH {EV} SELECT anomaly_id, id FROM we",
)
register(
    "price_move",
    lambda v: c.price_move(window_events(v)),
    f"WITH {EV}, {PM} SELECT * FROM pr",
    "price_from price_to magnitude_pct",
)
register(
    "trade_flow",
    lambda v: c.trade_flow(window_events(v)),
    f"WITH {EV}, {TF} SELECT * FROM tf",
    "trades_per_minute whale_trade_pct taker_buy_pct avg_trade_size",
)
register(
    "burst_detection",
    lambda v: c.burst_detection(window_events(v)),
    f"WITH {EV}, {TF}, {BD} SELECT * FROM bd",
    "burst_trade_pct burst_duration_seconds",
)
register(
    "market_context",
    lambda v: c.market_context(found(v), v.markets).drop("hours_to_expiry", "markets_in_series", "window_minutes"),
    f"""WITH {EV} SELECT anomaly_id, k.title, coalesce(k.category, '') AS category,
         split_part(k.external_id, '-', 1) AS series_prefix FROM fa JOIN mk_markets k ON k.id = fa.market_id""",
)
register(
    "catalyst_type",
    lambda v: analysis(v).select("anomaly_id", "catalyst_type", "confidence"),
    f"WITH {AN} SELECT anomaly_id, catalyst_type, confidence FROM ct",
    "confidence",
)
register(
    "template_narrative",
    lambda v: n.template_narrative(analysis(v)).select(
        "anomaly_id", "template.headline", "template.narrative", "template.catalyst_type",
        F.array_join("template.signals", "; ").alias("signals"),
    ),
    f"WITH {TEXT} SELECT * FROM told",
)


def _metadata(v):
    return n.catalyst_metadata(found(v), v.events, v.markets, _replies(v))


def _replies(v):
    """Stored model narratives for the stronger half of the anomalies."""
    strong = v.anomalies.filter("anomaly_type = 'single_market' and severity >= 0.2").selectExpr(
        "id as anomaly_id",
        """to_json(named_struct('headline', concat('H', id), 'narrative', 'N', 'attributed_catalyst', 'data',
             'confidence', severity * 2)) as content""",
    )
    return n.parse_narrative_replies(strong)


def _enriched(v):
    return d.update_anomalies(v.anomalies, _metadata(v))


register(
    "enrich_anomalies",
    lambda v: _metadata(v).select(
        F.col("id").alias("anomaly_id"),
        F.get_json_object("metadata", "$.catalyst_type").alias("catalyst_type"),
        F.get_json_object("metadata", "$.confidence").cast("double").alias("confidence"),
        F.get_json_object("metadata", "$.trade_count").cast("long").alias("trade_count"),
        F.get_json_object("metadata", "$.llm_narrative.headline").alias("model_headline"),
    ),
    f"""WITH {AN} SELECT anomaly_id, catalyst_type, confidence, trade_count,
         CASE WHEN severity >= 0.2 THEN 'H' || anomaly_id END AS model_headline
       FROM ct JOIN mk_anomalies a ON a.id = ct.anomaly_id""",
    "confidence",
)
register(
    "anomaly_feed",
    lambda v: n.anomaly_feed(d.active_anomalies_view(_enriched(v), v.clusters)).select(
        "anomaly_id", F.col("catalyst.catalyst_type").alias("catalyst_type"), F.col("catalyst.source").alias("source"),
        F.col("catalyst.confidence").alias("confidence"),
    ),
    f"""WITH {AN} SELECT a.id AS anomaly_id, catalyst_type,
         CASE WHEN catalyst_type IS NULL THEN NULL WHEN severity >= 0.2 THEN 'llm' ELSE 'template' END AS source,
         CASE WHEN catalyst_type IS NULL THEN NULL WHEN severity >= 0.2 THEN least(1, severity * 2) ELSE CAST(printf('%.2f', CAST(confidence AS DOUBLE)) AS DOUBLE) END AS confidence
       FROM mk_anomalies a LEFT JOIN ct ON ct.anomaly_id = a.id WHERE status = 'active'""",
    "confidence",
)


def _news(v):
    """Two news items per anomaly, written from its market's orders side (order priority)."""
    f = found(v).select("anomaly_id", "market_id")
    item = F.explode(F.sequence(F.lit(0), F.lit(1)))
    return f.select("anomaly_id", "market_id", item.alias("item_pos")).selectExpr(
        "anomaly_id", "item_pos", "concat('News ', market_id, ' ', item_pos) as title", "'Wire' as source",
        "case when item_pos = 0 then 'snippet' else '' end as snippet",
    )


register("narrative_prompts", lambda v: n.narrative_prompts(analysis(v), _news(v)), PROMPT)
register(
    "parse_narrative_responses",
    # assistant turns are replies: every third is a JSON document, the rest plain text
    lambda v: n.parse_narrative_replies(
        v.table("conversations").filter("role = 'assistant'").selectExpr(
            "conv_id * 1000 + turn as anomaly_id",
            """case when conv_id % 3 = 0 then concat('```json\\n', to_json(named_struct(
                 'headline', concat('C', conv_id), 'narrative', text, 'confidence', turn / 4D)), '\\n```') else text end as content""",
        )
    ),
    """SELECT conv_id * 1000 + turn AS anomaly_id, CASE WHEN conv_id % 3 = 0 THEN 'C' || conv_id ELSE 'Analysis unavailable' END AS headline,
         CASE WHEN conv_id % 3 = 0 THEN text ELSE text END AS narrative, 'unknown' AS attributed_catalyst,
         CASE WHEN conv_id % 3 = 0 THEN least(1, CAST(turn AS DOUBLE) / 4) ELSE 0.5 END AS confidence
       FROM conversations WHERE role = 'assistant'""",
    "confidence",
)
register(
    "llm_cost",
    lambda v: c.reply_cost(
        v.table("conversations").selectExpr(
            "case when role = 'user' then length(text) else 0 end as input_tokens",
            "case when role = 'assistant' then length(text) else 0 end as output_tokens",
        )
    ),
    """SELECT count(*) AS total_requests, CAST(sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS total_input_tokens,
         CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS total_output_tokens,
         sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) * 3.0 / 1000000
           + sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) * 15.0 / 1000000 AS total_cost_usd
       FROM conversations""",
    "total_cost_usd",
)
def _pairs_csv(v):
    """The pairs as a CSV file, read back."""
    pairs = n.narrative_pairs(_enriched(v)).select("id", "severity", "type", "llm_headline", "llm_narrative")
    root = shared_folder(v.spark, "pairs")
    store.write_csv(pairs, root)
    return v.spark.read.schema(pairs.schema).option("header", True).option("escape", '"').csv(root)


register(
    "narrative_csv",
    _pairs_csv,
    f"""WITH {AN} SELECT a.id, severity, catalyst_type AS "type", CASE WHEN severity >= 0.2 THEN 'H' || a.id ELSE '(no LLM)' END AS llm_headline,
         CASE WHEN severity >= 0.2 THEN 'N' ELSE '(no LLM)' END AS llm_narrative FROM mk_anomalies a JOIN ct ON ct.anomaly_id = a.id""",
    "severity",
)
register(
    "narrative_pairs",
    lambda v: n.narrative_pairs(_enriched(v)).select(
        "id", "severity", "type", "llm_headline", "llm_narrative", "llm_confidence", "llm_catalyst"
    ),
    f"""WITH {AN} SELECT a.id, severity, catalyst_type AS "type", CASE WHEN severity >= 0.2 THEN 'H' || a.id ELSE '(no LLM)' END AS llm_headline,
         CASE WHEN severity >= 0.2 THEN 'N' ELSE '(no LLM)' END AS llm_narrative,
         CASE WHEN severity >= 0.2 THEN least(1, severity * 2) END AS llm_confidence,
         CASE WHEN severity >= 0.2 THEN 'data' ELSE '' END AS llm_catalyst
       FROM mk_anomalies a JOIN ct ON ct.anomaly_id = a.id""",
    "severity llm_confidence",
)
