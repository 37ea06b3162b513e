"""Topic cluster queries."""

from pyspark.sql import functions as F

from tidewatch.operators import topics as t
from workload.registry import register

register(
    "unassigned_markets",
    lambda v: t.unassigned_markets(v.markets, v.memberships).select("id", "title"),
    "SELECT id, title FROM mk_markets WHERE is_active AND id NOT IN (SELECT market_id FROM mk_memberships)",
)
register(
    "unassigned_count",
    lambda v: t.unassigned_markets(v.markets, v.memberships).agg(F.count("*").alias("unassigned")),
    """SELECT count(*) AS unassigned FROM mk_markets
       WHERE is_active AND id NOT IN (SELECT market_id FROM mk_memberships)""",
)
_LINES = """SELECT id, '  [id=' || id || '] "' || title || '"' ||
    CASE WHEN description <> '' THEN ' -- ' || description ELSE '' END AS line, id % 8 AS bucket,
    CAST((row_number() OVER (PARTITION BY id % 8 ORDER BY id) - 1) // 30 AS INTEGER) AS batch
  FROM mk_markets WHERE is_active AND id NOT IN (SELECT market_id FROM mk_memberships)"""
register(
    "cluster_prompt_batches",
    lambda v: t.prompt_batches(t.unassigned_markets(v.markets, v.memberships), buckets=8),
    f"""SELECT *, '{t.BATCH_TASK}' || chr(10) || chr(10) || 'Markets:' || chr(10) || market_lines || chr(10) || chr(10) || '{t.BATCH_FORMAT}' AS prompt
        FROM (SELECT bucket, batch, count(*) AS markets, string_agg(line, chr(10) ORDER BY id) AS market_lines
              FROM ({_LINES}) GROUP BY 1, 2)""",
)
register(
    "incremental_prompt_batches",
    lambda v: t.prompt_batches(
        t.unassigned_markets(v.markets, v.memberships), buckets=8, clusters=v.clusters
    ).select("bucket", "batch", "prompt"),
    f"""SELECT bucket, batch, '{t.INCREMENTAL_TASK}' || chr(10) || chr(10) || 'Existing clusters:' || chr(10)
         || (SELECT string_agg('- "' || name || '": ' || description, chr(10) ORDER BY name) FROM mk_clusters)
         || chr(10) || chr(10) || 'New markets:' || chr(10) || string_agg(line, chr(10) ORDER BY id)
         || chr(10) || chr(10) || '{t.INCREMENTAL_FORMAT}' AS prompt
        FROM ({_LINES}) GROUP BY 1, 2""",
)


def _titled(v):
    """Unassigned markets whose titles name a country, and clusters of one or two countries."""
    nation = v.table("nation").selectExpr("n_nationkey", "replace(n_name, '_', '') as n_name")
    home = v.table("customer").select(F.col("c_custkey").alias("id"), "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    markets = t.unassigned_markets(v.markets, v.memberships).join(home.select("id", "n_name"), "id")
    other = nation.select((F.col("n_nationkey") + 1).alias("n_nationkey"), F.col("n_name").alias("before"))
    clusters = nation.join(other, "n_nationkey", "left").selectExpr(
        "bigint(n_nationkey) as id", "concat(n_name, ' elections') as name", "coalesce(concat('beside ', before), '') as description")
    return markets.withColumn("title", F.concat_ws(" ", "title", "n_name")), clusters


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{3,}}'))"
CANDIDATES_SQL = f"""mt AS (SELECT m.*, m.title || ' ' || replace(n_name, '_', '') AS full_title FROM mk_markets m JOIN customer ON c_custkey = m.id
      JOIN nation ON n_nationkey = c_nationkey WHERE is_active AND m.id NOT IN (SELECT market_id FROM mk_memberships)),
  cl AS (SELECT n.n_nationkey AS cluster_id, replace(n.n_name, '_', '') || ' elections' AS name, coalesce('beside ' || replace(p.n_name, '_', ''), '') AS description
      FROM nation n LEFT JOIN nation p ON p.n_nationkey + 1 = n.n_nationkey),
  cw AS (SELECT *, unnest({_WORDS.format("name || ' ' || description")}) AS word FROM cl),
  hv AS (SELECT word, count(*) AS having_n FROM cw GROUP BY 1 HAVING count(*) = 1 OR count(*) <= 0.1 * (SELECT count(*) FROM cl)),
  mw AS (SELECT id AS market_id, unnest({_WORDS.format("full_title")}) AS word FROM mt),
  me AS (SELECT market_id, cluster_id, name, description, count(*) AS shared,
      CAST(sum(floor(ln((SELECT count(*) FROM cl) / having_n) * 1000)) AS BIGINT) AS weight
    FROM mw JOIN hv USING (word) JOIN cw USING (word) GROUP BY 1, 2, 3, 4),
  cd AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY weight DESC, name, cluster_id) AS rn FROM me)"""


def _candidates(v):
    markets, clusters = _titled(v)
    return t.candidate_clusters(markets, clusters, per_market=3, common=0.1)


register("candidate_clusters", _candidates, f"WITH {CANDIDATES_SQL} SELECT market_id, name, description, shared, weight FROM cd WHERE rn <= 3")
register(
    "candidate_prompt_batches",
    lambda v: t.prompt_batches(_titled(v)[0], buckets=8, candidates=_candidates(v)).select("bucket", "batch", "prompt"),
    f"""WITH {CANDIDATES_SQL},
       ln AS (SELECT id, '  [id=' || id || '] "' || full_title || '"' || CASE WHEN description <> '' THEN ' -- ' || description ELSE '' END AS line,
           id % 8 AS bucket, CAST((row_number() OVER (PARTITION BY id % 8 ORDER BY id) - 1) // 30 AS INTEGER) AS batch FROM mt),
       cs AS (SELECT bucket, batch, string_agg(line, chr(10) ORDER BY name) AS lines FROM (
           SELECT DISTINCT bucket, batch, name, '- "' || name || '"' || CASE WHEN description <> '' THEN ': ' || description ELSE '' END AS line
           FROM ln JOIN cd ON cd.market_id = ln.id AND rn <= 3) GROUP BY 1, 2)
       SELECT bucket, batch, '{t.INCREMENTAL_TASK}' || chr(10) || chr(10) || 'Existing clusters:' || chr(10) || coalesce(min(lines), '')
         || chr(10) || chr(10) || 'New markets:' || chr(10) || string_agg(line, chr(10) ORDER BY id)
         || chr(10) || chr(10) || '{t.INCREMENTAL_FORMAT}' AS prompt
       FROM ln LEFT JOIN cs USING (bucket, batch) GROUP BY 1, 2""",
)


def _batch_replies(v):
    """A reply per cluster (fenced), one membership per market, some without confidence."""
    rows = v.table("customer").selectExpr(
        "c_nationkey", "c_custkey",
        "named_struct('market_id', c_custkey, 'confidence', case when c_custkey % 10 <> 0 then (c_custkey % 100) / 100D end) as m",
    )
    # one reply per market keeps every reply small
    return rows.selectExpr(
        "concat('r', c_custkey) as reply_id",
        """concat('```json\\n', 'Sure: ', to_json(named_struct('clusters', array(named_struct(
             'name', concat('Topic ', c_nationkey % 30), 'description', 'about', 'markets', array(m))))), '\\n```') as content""",
    )


def _incremental_replies(v):
    return v.table("customer").selectExpr(
        "concat('i', c_custkey) as reply_id",
        """case when c_nationkey = 0 then 'no json here' else to_json(named_struct('assignments', array(named_struct(
             'market_id', c_custkey, 'cluster_name', case when c_nationkey % 2 = 0 then concat('Fresh ', c_nationkey) end,
             'is_new_cluster', true, 'confidence', (c_custkey % 100) / 100D)))) end as content""",
    )


register(
    "parse_cluster_responses",
    lambda v: t.parse_batch_replies(_batch_replies(v)).drop("create_always"),
    """SELECT 'r' || c_custkey AS reply_id, 'Topic ' || (c_nationkey % 30) AS cluster_name, 'about' AS cluster_description,
         c_custkey AS market_id, CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey % 100 AS DOUBLE) / 100 ELSE 0.5 END AS confidence
       FROM customer""",
    "confidence",
)
register(
    "parse_incremental_responses",
    lambda v: t.parse_incremental_replies(_incremental_replies(v)).drop("create_always", "cluster_description"),
    """SELECT 'i' || c_custkey AS reply_id, CASE WHEN c_nationkey % 2 = 0 THEN 'Fresh ' || c_nationkey ELSE 'Unknown' END AS cluster_name,
         c_custkey AS market_id, CAST(c_custkey % 100 AS DOUBLE) / 100 AS confidence
       FROM customer WHERE c_nationkey <> 0""",
    "confidence",
)


def _assigned(v):
    rows = t.parse_incremental_replies(_incremental_replies(v))
    fresh = t.new_clusters(rows, v.clusters, v.now)
    every = v.clusters.unionByName(fresh)
    return t.apply_assignments(v.memberships, rows, every, v.now), every


def _named_memberships(v):
    merged, every = _assigned(v)
    return merged.join(every.select(F.col("id").alias("cluster_id"), "name"), "cluster_id").select(
        "market_id", "name", "confidence"
    )


register(
    "apply_assignments",
    _named_memberships,
    """SELECT m.market_id, c.name, m.confidence FROM mk_memberships m JOIN mk_clusters c ON c.id = m.cluster_id
       UNION ALL SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'Fresh ' || c_nationkey ELSE 'Unknown' END,
         CAST(c_custkey % 100 AS DOUBLE) / 100 FROM customer WHERE c_nationkey <> 0 AND CAST(c_custkey % 100 AS DOUBLE) / 100 >= 0.6""",
    "confidence",
)
register(
    "new_clusters",
    lambda v: t.new_clusters(t.parse_batch_replies(_batch_replies(v)), v.clusters, v.now).select("name", "description"),
    "SELECT DISTINCT 'Topic ' || (c_nationkey % 30) AS name, 'about' AS description FROM customer",
)
register(
    "cluster_members",
    lambda v: t.cluster_members(v.memberships, v.markets),
    """SELECT cluster_id, market_id, title, confidence FROM mk_memberships JOIN mk_markets ON id = market_id""",
    "confidence",
)
register(
    "market_clusters",
    lambda v: t.market_clusters(v.memberships, v.clusters),
    "SELECT market_id, cluster_id, name, confidence FROM mk_memberships JOIN mk_clusters ON id = cluster_id",
    "confidence",
)
register(
    "list_clusters",
    lambda v: t.list_clusters(v.clusters, v.memberships),
    """SELECT id, name, description, count(market_id) AS members
       FROM mk_clusters LEFT JOIN mk_memberships ON cluster_id = id GROUP BY 1, 2, 3""",
)
register(
    "cluster_stats",
    lambda v: t.cluster_stats(v.markets, v.memberships, v.clusters),
    """WITH s AS (SELECT id, count(market_id) AS n FROM mk_clusters LEFT JOIN mk_memberships ON cluster_id = id GROUP BY 1),
         u AS (SELECT count(*) AS unassigned FROM mk_markets WHERE is_active AND id NOT IN (SELECT market_id FROM mk_memberships)),
         tm AS (SELECT count(*) AS total_markets FROM mk_markets)
       SELECT total_markets, unassigned, total_markets - unassigned AS assigned, count(*) AS clusters, avg(n) AS avg_size,
         min(n) AS min_size, max(n) AS max_size FROM s, u, tm GROUP BY 1, 2, 3""",
    "avg_size",
)
