"""Topic clusters: prompt batches, reply parsing, assignments and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.keyed import hashed_id, merge_keyed, top_k_per_key, with_totals
from tidewatch.functions.text import strip_code_fence

# ---- FIXED VALUES: prompt and reply formats ----------------------------------------------
MARKET_LINE = '  [id=%s] "%s"'
CLUSTER_LINE = '- "%s"'
BATCH_REPLY = (
    "clusters array<struct<name:string, description:string,"
    "markets:array<struct<market_id:long, confidence:double>>>>"
)
INCREMENTAL_REPLY = (
    "assignments array<struct<market_id:long, cluster_name:string, cluster_description:string,"
    "is_new_cluster:boolean, confidence:double>>"
)
DEFAULT_CONFIDENCE = 0.5
DEFAULT_CLUSTER = "Unknown"
MIN_CONFIDENCE = 0.6
BATCH_SIZE = 30
CANDIDATES = 20  # clusters listed for a market
COMMON_WORD = 0.05  # share of the clusters
# ---- end of fixed values -----------------------------------------------------------------

BATCH_FORMAT = (
    'Answer with this JSON structure:\n'
    '{"clusters": [{"name": "...", "description": "...", "markets": [{"market_id": 0, "confidence": 0.0}]}]}'
)
INCREMENTAL_FORMAT = (
    'Answer with this JSON structure:\n'
    '{"assignments": [{"market_id": 0, "cluster_name": "...", "cluster_description": "...", '
    '"is_new_cluster": false, "confidence": 0.0}]}'
)
BATCH_TASK = "Sort these prediction markets into topic clusters. Answer with JSON only."
INCREMENTAL_TASK = (
    "Put each new market into one of the existing clusters, or name a new one. "
    "Answer with JSON only."
)


def unassigned_markets(markets: DataFrame, memberships: DataFrame) -> DataFrame:
    """Active markets without any cluster."""
    taken = memberships.select(F.col("market_id").alias("id"))
    return markets.filter("is_active").join(taken, "id", "left_anti")


def title_words(text: Column) -> Column:
    """The distinct words of three and more letters or digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{3,})"), F.lit(1)))


def candidate_clusters(
    unassigned: DataFrame, clusters: DataFrame, per_market: int = CANDIDATES, common: float = COMMON_WORD
) -> DataFrame:
    """Clusters that an unassigned market might belong to: (market_id, name, description, shared, weight).

    A market meets the clusters that share a word of its title in their name or description. Words of more
    than a share ``common`` of the clusters (and of more than one) tell nothing and are no key. A shared word
    weighs the logarithm of clusters per cluster that has it, in thousandths; the ``per_market`` heaviest
    clusters are a prompt's list.
    """
    named = clusters.select(
        F.col("id").alias("cluster_id"), "name", "description",
        F.explode(title_words(F.concat_ws(" ", "name", "description"))).alias("word"),
    )
    total = clusters.agg(F.count("*").alias("clusters"))
    known = with_totals(named.groupBy("word").agg(F.count("*").alias("having")), total)
    telling = known.filter((F.col("having") == 1) | (F.col("having") <= F.lit(common) * F.col("clusters"))).select(
        "word", F.floor(F.log(F.col("clusters") / F.col("having")) * 1000).cast("long").alias("points"))
    words = unassigned.select(F.col("id").alias("market_id"), F.explode(title_words(F.col("title"))).alias("word"))
    met = (
        words.join(telling, "word").join(named, "word")
        .groupBy("market_id", "cluster_id", "name", "description")
        .agg(F.count("*").alias("shared"), F.sum("points").alias("weight"))
    )
    order = [F.col("weight").desc(), F.col("name"), F.col("cluster_id")]
    return top_k_per_key(met, ["market_id"], order, per_market, spread_by=["cluster_id"]).drop("cluster_id")


def buckets_for(markets: int, batch_size: int = BATCH_SIZE) -> int:
    """So many buckets that each holds about a hundred batches."""
    return max(1, -(-markets // (100 * batch_size)))


def prompt_batches(
    unassigned: DataFrame,
    buckets: int | None = None,
    batch_size: int = BATCH_SIZE,
    clusters: DataFrame | None = None,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Prompt text per batch of markets, batches formed inside ``buckets`` id buckets.

    Without a number the buckets follow that of the markets; each bucket is numbered on its
    own, so no task sees all markets and a prompt never holds more than ``batch_size`` lines.
    With ``candidates`` (:func:`candidate_clusters`) a prompt lists the clusters that its own markets
    might belong to. With ``clusters`` it lists all existing ones, which is meant for a few.
    """
    if buckets is None:
        buckets = buckets_for(unassigned.count(), batch_size)
    bucket = F.pmod(F.col("id"), F.lit(buckets))
    order = Window.partitionBy("bucket").orderBy("id")
    line = F.concat(
        F.format_string(MARKET_LINE, F.col("id"), F.col("title")),
        F.when(F.col("description") != "", F.concat(F.lit(" -- "), F.col("description"))).otherwise(""),
    )
    numbered = unassigned.select("id", line.alias("line"), bucket.alias("bucket")).withColumn(
        "batch", F.floor((F.row_number().over(order) - 1) / F.lit(batch_size)).cast("int")
    )
    batches = numbered.groupBy("bucket", "batch").agg(
        F.count("*").alias("markets"),
        F.concat_ws(
            "\n", F.transform(F.sort_array(F.collect_list(F.struct("id", "line"))), lambda x: x["line"])
        ).alias("market_lines"),
    )
    if candidates is not None:
        return _with_candidates(batches, numbered, candidates)
    if clusters is None:
        text = F.concat(
            F.lit(BATCH_TASK + "\n\nMarkets:\n"), F.col("market_lines"), F.lit("\n\n" + BATCH_FORMAT)
        )
        return batches.withColumn("prompt", text)
    known = clusters.select(
        F.struct("name", _cluster_line().alias("line")).alias("c")
    ).agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list("c")), lambda x: x["line"])).alias("cluster_lines"))
    text = F.concat(
        F.lit(INCREMENTAL_TASK + "\n\nExisting clusters:\n"), F.col("cluster_lines"),
        F.lit("\n\nNew markets:\n"), F.col("market_lines"), F.lit("\n\n" + INCREMENTAL_FORMAT),
    )
    return with_totals(batches, known).withColumn("prompt", text).drop("cluster_lines")


def _cluster_line() -> Column:
    description = F.when(F.col("description") != "", F.concat(F.lit(": "), F.col("description"))).otherwise("")
    return F.concat(F.format_string(CLUSTER_LINE, "name"), description)


def _with_candidates(batches: DataFrame, numbered: DataFrame, candidates: DataFrame) -> DataFrame:
    """Prompts with the clusters of their own markets: each list is bounded by a batch's markets and their candidates."""
    lines = (
        numbered.select("bucket", "batch", F.col("id").alias("market_id"))
        .join(candidates, "market_id")
        .groupBy("bucket", "batch")
        .agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_set(F.struct("name", _cluster_line().alias("line")))), lambda x: x["line"]))
             .alias("cluster_lines"))
    )
    text = F.concat(
        F.lit(INCREMENTAL_TASK + "\n\nExisting clusters:\n"), F.coalesce("cluster_lines", F.lit("")),
        F.lit("\n\nNew markets:\n"), F.col("market_lines"), F.lit("\n\n" + INCREMENTAL_FORMAT),
    )
    return batches.join(lines, ["bucket", "batch"], "left").withColumn("prompt", text).drop("cluster_lines")


def _reply_json(content: Column) -> Column:
    """First "{" to last "}" of a reply, fences removed."""
    return F.nullif(F.regexp_extract(strip_code_fence(content), r"(?s)\{.*\}", 0), F.lit(""))


def parse_batch_replies(replies: DataFrame) -> DataFrame:
    """(reply_id, content) of batch clustering -> one row per proposed membership.

    A cluster without markets still yields a row (market_id NULL), since it is created anyway.
    """
    parsed = replies.select(
        "reply_id", F.posexplode(F.from_json(_reply_json(F.col("content")), BATCH_REPLY)["clusters"]).alias("pos", "c")
    )
    return parsed.select(
        "reply_id", "pos", "c.name", "c.description", F.explode_outer("c.markets").alias("m")
    ).select(
        "reply_id",
        F.coalesce("name", F.lit(DEFAULT_CLUSTER)).alias("cluster_name"),
        F.col("description").alias("cluster_description"),
        F.when(F.col("m").isNotNull(), F.coalesce("m.market_id", F.lit(0).cast("long"))).alias("market_id"),
        F.when(F.col("m").isNotNull(), F.coalesce("m.confidence", F.lit(DEFAULT_CONFIDENCE))).alias("confidence"),
        F.lit(True).alias("create_always"),
    )


def parse_incremental_replies(replies: DataFrame) -> DataFrame:
    """(reply_id, content) of incremental clustering -> one row per assignment."""
    doc = F.from_json(_reply_json(F.col("content")), INCREMENTAL_REPLY)["assignments"]
    return replies.select("reply_id", F.explode(doc).alias("a")).select(
        "reply_id",
        F.coalesce("a.cluster_name", F.lit(DEFAULT_CLUSTER)).alias("cluster_name"),
        F.col("a.cluster_description").alias("cluster_description"),
        F.coalesce("a.market_id", F.lit(0).cast("long")).alias("market_id"),
        F.coalesce("a.confidence", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        F.lit(False).alias("create_always"),
    )


def new_clusters(assignments: DataFrame, clusters: DataFrame, now_ms: int) -> DataFrame:
    """Clusters the assignments name that do not exist yet."""
    wanted = assignments.filter(
        F.col("create_always") | (F.col("confidence") >= MIN_CONFIDENCE)
    ).groupBy(F.col("cluster_name").alias("name")).agg(
        F.min_by("cluster_description", F.struct("reply_id", F.coalesce("market_id", F.lit(0).cast("long")))).alias("description")
    )
    return wanted.join(clusters.select("name"), "name", "left_anti").select(
        hashed_id("cluster", F.col("name")).alias("id"),
        "name",
        "description",
        F.lit(now_ms).cast("long").alias("created_at"),
        F.lit(now_ms).cast("long").alias("updated_at"),
    )


def apply_assignments(
    memberships: DataFrame, assignments: DataFrame, all_clusters: DataFrame, now_ms: int
) -> DataFrame:
    """Upsert memberships of confident assignments; ``all_clusters`` includes the new ones."""
    ids = all_clusters.groupBy(F.col("name").alias("cluster_name")).agg(F.min("id").alias("cluster_id"))
    incoming = (
        assignments.filter(F.col("confidence") >= MIN_CONFIDENCE)
        .join(ids, "cluster_name")
        .groupBy("market_id", "cluster_id")
        .agg(F.max_by("confidence", F.struct("reply_id", "confidence")).alias("confidence"))
    )
    return merge_keyed(
        memberships,
        incoming,
        ["market_id", "cluster_id"],
        {
            "confidence": F.coalesce("inc.confidence", "cur.confidence"),
            "assigned_at": F.when(F.col("inc.confidence").isNotNull(), F.lit(now_ms))
            .otherwise(F.col("cur.assigned_at"))
            .cast("long"),
        },
    )


def cluster_members(memberships: DataFrame, markets: DataFrame, cluster_id: int | None = None) -> DataFrame:
    """Members of one cluster or of all, with their titles."""
    rows = memberships if cluster_id is None else memberships.filter(F.col("cluster_id") == cluster_id)
    titles = markets.select(F.col("id").alias("market_id"), "title")
    return rows.join(titles, "market_id", "left").select("cluster_id", "market_id", "title", "confidence")


def market_clusters(memberships: DataFrame, clusters: DataFrame, market_id: int | None = None) -> DataFrame:
    rows = memberships if market_id is None else memberships.filter(F.col("market_id") == market_id)
    names = clusters.select(F.col("id").alias("cluster_id"), "name")
    return rows.join(names, "cluster_id").select("market_id", "cluster_id", "name", "confidence")


def list_clusters(clusters: DataFrame, memberships: DataFrame) -> DataFrame:
    sizes = memberships.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("members"))
    return clusters.join(sizes, "id", "left").select(
        "id", "name", "description", F.coalesce("members", F.lit(0).cast("long")).alias("members")
    )


def cluster_stats(markets: DataFrame, memberships: DataFrame, clusters: DataFrame) -> DataFrame:
    """Totals (assigned = all markets minus unassigned active ones) and cluster sizes."""
    total = markets.agg(F.count("*").alias("total_markets"))
    open_ = unassigned_markets(markets, memberships).agg(F.count("*").alias("unassigned"))
    sizes = list_clusters(clusters, memberships).agg(
        F.count("*").alias("clusters"),
        F.avg("members").alias("avg_size"),
        F.min("members").alias("min_size"),
        F.max("members").alias("max_size"),
    )
    return with_totals(total, open_, sizes).withColumn(
        "assigned", F.col("total_markets") - F.col("unassigned")
    )
