import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewatch import configure, schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


class Rows:
    """Builds small tables; omitted columns take the defaults below."""

    EVENT = dict(id=None, market_id=1, event_type="price_change", old_value=None, new_value=0.0,
                 metadata=None, timestamp=0)
    MARKET = dict(id=1, platform="kalshi", external_id="T-1", title="Market", description=None,
                  category=None, end_date=None, is_active=True, first_seen_at=0, last_updated_at=0,
                  volume=0.0, yes_price=None, price_updated_at=None)
    ANOMALY = dict(id=1, anomaly_type="single_market", severity=0.5, topic_cluster_id=None,
                   market_count=1, window_start=0, detected_at=0, summary="", status="active",
                   metadata=None)
    LINK = dict(anomaly_id=1, market_id=1, price_delta=None, volume_ratio=None)

    def __init__(self, spark):
        self.spark = spark

    def _frame(self, rows, defaults, schema):
        full = [tuple({**defaults, **r}[f.name] for f in schema) for r in rows]
        return self.spark.createDataFrame(full, schema)

    def events(self, *rows):
        numbered = [{"id": i, **r} for i, r in enumerate(rows, 1)]
        return self._frame(numbered, self.EVENT, schemas.EVENTS)

    def prices(self, *pairs, market_id=1):
        return self.events(*[dict(market_id=market_id, new_value=p, timestamp=t) for p, t in pairs])

    def markets(self, *rows):
        return self._frame(rows, self.MARKET, schemas.MARKETS)

    def anomalies(self, *rows):
        return self._frame(rows, self.ANOMALY, schemas.ANOMALIES)

    def links(self, *rows):
        return self._frame(rows, self.LINK, schemas.ANOMALY_MARKETS)

    def clusters(self, *pairs):
        return self.spark.createDataFrame([(i, n, None, 0, 0) for i, n in pairs], schemas.CLUSTERS)

    def memberships(self, *rows):
        return self.spark.createDataFrame([(m, c, conf, 0) for m, c, conf in rows], schemas.MEMBERSHIPS)

    def pairs(self, *rows):
        return self.spark.createDataFrame([(a, b, c, "cluster", 0) for a, b, c in rows], schemas.LINKS)

    def raw(self, platform, *payloads, at=1000):
        return self.spark.createDataFrame([(platform, p, at) for p in payloads], schemas.RAW_MESSAGES)


@pytest.fixture(scope="session")
def rows(spark):
    return Rows(spark)
