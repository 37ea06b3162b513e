"""Constants, word lists and text formats that results depend on.

Everything here is data. It is stated plainly and in its natural order so that results agree
with the feeds, stored rows and reports this library has to be compatible with.
"""

# ---- FIXED VALUES: detection defaults ----------------------------------------------------
WINDOW_MINUTES = (5, 15, 60, 1440)
PRICE_CHANGE_THRESHOLD = 0.10
VOLUME_SPIKE_MULTIPLIER = 3.0
ZSCORE_THRESHOLD = 2.5
BASELINE_HOURS = 24
ANOMALY_EXPIRY_HOURS = 24
CORRELATION_WINDOW_MINUTES = 60
CLUSTER_MIN_MARKETS = 2
CROSS_PLATFORM_BOOST = 1.2
SERIES_MIN_MOVERS = 3
SERIES_WINDOW_MINUTES = 30
SERIES_PRICE_THRESHOLD = 0.03
SEVERITY_HIGH = 0.7
SEVERITY_MEDIUM = 0.4
MAX_ALERTS_PER_DAY = 50

# ---- FIXED VALUES: market health ---------------------------------------------------------
HEALTH_WEIGHTS = {
    "trade_velocity": 0.25,
    "orderbook_imbalance": 0.20,
    "whale_activity": 0.20,
    "spread_tightness": 0.15,
    "momentum": 0.20,
}
TRADE_WINDOW_SECONDS = 900
PRICE_WINDOW_SECONDS = 3600
MAX_TRADES_PER_MINUTE = 10.0
WHALE_DOLLARS = 500.0
MAX_SPREAD = 0.10
ONE_SIDED_SPREAD = 0.02
FULL_MOMENTUM_MOVE = 0.05

# ---- FIXED VALUES: catalyst attribution --------------------------------------------------
BURST_TRADE_SHARE = 0.60
BURST_WINDOW_FRACTION = 0.20
BURST_MIN_TRADES = 5

# ---- FIXED VALUES: model reply costs, dollars per million tokens -------------------------
INPUT_TOKEN_COST = 3.0
OUTPUT_TOKEN_COST = 15.0

# ---- FIXED VALUES: market statuses -------------------------------------------------------
TERMINAL_STATUSES = ("closed", "determined", "finalized", "settled")
TRADABLE_STATUSES = ("active", "initialized")
PERSISTED_EVENT_TYPES = ("trade", "new_market", "status_change", "volume_update")

# ---- FIXED VALUES: title keywords, first matching group wins -----------------------------
KALSHI_TITLE_KEYWORDS = (
    ("Politics", (
        "election", "president", "congress", "senate", "vote", "poll", "trump", "biden",
        "governor", "mayor", "democrat", "republican", "pope", "cardinal", "conclave",
        "vatican", "papacy",
    )),
    ("Cryptocurrency", ("bitcoin", "crypto", "ethereum", "btc", "eth", "solana")),
    ("Economics", (
        "gdp", "inflation", "fed", "economy", "unemployment", "interest rate", "cpi",
        "jobs report", "payroll", "treasury",
    )),
    ("Sports", (
        "nfl", "nba", "mlb", "nhl", "super bowl", "world cup", "wins by", "points scored",
        "championship", "playoff", "arsenal", "liverpool", "lakers", "celtics",
        "march madness", "ncaa", "pga", "ufc", "boxing", "tennis", "soccer", "assists",
        "rebounds", "touchdowns", "goals", "over ", "under ", "spread", "moneyline",
    )),
    ("Weather", (
        "temperature", "weather", "hurricane", "rain", "tornado", "snowfall", "climate",
    )),
    ("Entertainment", (
        "movie", "film", "oscar", "emmy", "celebrity", "grammy", "netflix", "actor", "actress",
        "bond", "hollywood", "box office", "disney", "marvel", "tv show", "streaming",
        "perform", "role",
    )),
    ("Science", (
        "fda", "drug", "vaccine", "cure", "diabetes", "cancer", "disease", "pandemic", "virus",
        "clinical trial", "medical", "pharmaceutical", "treatment", "health", "ai ",
        "artificial intelligence", "space", "nasa", "launch", "quantum", "fusion", "nuclear",
        "erupt", "volcano", "earthquake", "asteroid", "extinction",
    )),
    ("Business", ("stock", "company", "ipo", "earnings", "s&p", "nasdaq", "dow")),
)
POLYMARKET_TITLE_KEYWORDS = (
    ("Politics", ("election", "president", "congress", "senate", "vote", "poll")),
    ("Cryptocurrency", ("bitcoin", "crypto", "ethereum", "btc", "eth")),
    ("Economics", ("gdp", "inflation", "fed", "economy", "unemployment", "interest rate")),
    ("Sports", ("nfl", "nba", "mlb", "nhl", "super bowl", "world cup")),
    ("Weather", ("temperature", "weather", "hurricane", "rain")),
    ("Entertainment", ("movie", "oscar", "emmy", "celebrity")),
    ("Business", ("stock", "company", "ipo", "earnings")),
)
DEFAULT_CATEGORY = "Other"

# ---- FIXED VALUES: raw category -> display category --------------------------------------
POLYMARKET_CATEGORIES = {
    "Politics": "Politics",
    "Crypto": "Cryptocurrency",
    "Economics": "Economics",
    "Sports": "Sports",
    "Pop Culture": "Entertainment",
    "Business": "Business",
    "Science": "Science",
    "Technology": "Technology",
    "Gaming": "Entertainment",
    "Culture": "Entertainment",
}
KALSHI_CATEGORIES = {
    "economics": "Economics",
    "politics": "Politics",
    "elections": "Politics",
    "weather": "Weather",
    "climate": "Weather",
    "climate and weather": "Weather",
    "sports": "Sports",
    "entertainment": "Entertainment",
    "entertainment - movies": "Entertainment",
    "entertainment - music": "Entertainment",
    "entertainment - tv": "Entertainment",
    "culture": "Culture",
    "technology": "Technology",
    "tech": "Technology",
    "science": "Science",
    "science and technology": "Science",
    "science & technology": "Science",
    "health": "Science",
    "business": "Business",
    "financial": "Economics",
    "finance": "Economics",
    "crypto": "Cryptocurrency",
    "cryptocurrency": "Cryptocurrency",
    "mentions": "Social Media",
    "news": "News",
}

# ---- FIXED VALUES: order in which price and volume fields are tried ----------------------
KALSHI_PRICE_FIELDS = (
    "yes_ask_dollars", "yes_bid_dollars", "last_price_dollars", "yes_ask", "yes_bid",
    "last_price",
)
KALSHI_VOLUME_FIELDS = ("volume_fp", "volume", "open_interest_fp", "open_interest")
KALSHI_DESCRIPTION_FIELDS = ("subtitle", "yes_sub_title", "description")

# ---- FIXED VALUES: anomaly type labels ---------------------------------------------------
ANOMALY_TYPE_LABELS = {
    "single_market": ("Single Market", "Unusual price or volume movement in one market"),
    "cluster": ("Cluster", "Correlated anomalies across related markets"),
    "cross_platform": ("Cross Platform", "Divergence detected between platforms"),
}
UNKNOWN_ANOMALY_DESCRIPTION = "Anomalous market activity detected"

# ---- FIXED VALUES: narrative text formats, filled by operators/narrative.py --------------
DIRECTION_WORDS = {"up": "surged", "down": "dropped", "mixed": "moved", "flat": "held steady"}
OTHER_DIRECTION_WORD = "moved"
HEADLINE_FORMATS = {
    "whale": "Large trades drove {title} {word} {magnitude}",
    "news": "Activity burst hit {title} — {word} {magnitude}",
    "momentum": "Sustained pressure pushed {title} {word} {magnitude}",
    "pre_resolution": "Pre-expiry move on {title} — {word} {magnitude}",
    "unknown": "{title} {word} {magnitude}",
}
NARRATIVE_FORMATS = {
    "whale": (
        "{title} {word} {magnitude}{range}. {whale} of volume came from large trades "
        "(over $500 each) across {trades} trades. This pattern suggests a few large "
        "participants drove the move rather than broad market sentiment."
    ),
    "news": (
        "{title} {word} {magnitude}{range} on {tpm} trades/min{burst}. The concentrated "
        "activity pattern is consistent with a news-driven reaction or data release."
    ),
    "momentum": (
        "{title} {word} {magnitude}{range} over {trades} trades. The move was {side}-driven "
        "({taker} taker buys) with no whale dominance, suggesting broad directional conviction."
    ),
    "pre_resolution": (
        "{title} {word} {magnitude}{range} with expiry in {expiry}. Pre-resolution moves of "
        "this magnitude often reflect converging expectations as the outcome approaches."
    ),
    "unknown": "{title} {word} {magnitude}{range}.{activity}{category}",
}
RANGE_FORMAT = " from {from} to {to}"
BURST_FORMAT = ", concentrated in a {seconds}s burst"
ACTIVITY_FORMAT = " {trades} trades at {tpm}/min."
CATEGORY_FORMAT = " Category: {category}."
SIGNAL_FORMATS = {
    "move": "{direction} {magnitude}",
    "trades": "{trades} trades",
    "whale": "{whale} whale volume",
    "burst": "burst: {share} of trades in {seconds}s",
    "taker": "{taker} buy-side",
    "expiry": "{hours}h to expiry",
}
UNPARSED_HEADLINE = "Analysis unavailable"
# ---- end of fixed values -----------------------------------------------------------------
