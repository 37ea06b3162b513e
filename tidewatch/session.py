"""Session settings the operators rely on, and the one way lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime-settable SQL options. Sizes are per task and do not depend on the data volume;
# the number of shuffle partitions is left to the cluster and coalesced by AQE.
_SQL_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # top-k-per-key windows keep their map-side limit for every k
    "spark.sql.optimizer.windowGroupLimitThreshold": str(2**31 - 1),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL options above to a session; safe to call repeatedly."""
    for key, value in _SQL_OPTIONS.items():
        spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the driver and all executors share.

    Where it is unset, as in tests, a folder of our own is set, but only when the driver runs all
    tasks itself; a cluster without the setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewatch-checkpoint-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared folder (a lost executor does not lose the rows) and drop its lineage."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
