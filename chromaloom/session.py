"""Session settings and the one place that resolves the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "chromaloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the library's settings; `master` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in `spark.checkpoint.dir`.

    Only a local-mode session (tests, bench) falls back to a folder of its own;
    on a cluster a missing setting is an error, never a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs")
        shared = tempfile.mkdtemp(prefix="chromaloom-checkpoint-")
    sc.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the lineage ends in files every executor can read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BROADCAST_ROWS = 200_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow lookup table, broadcast only after its size was counted.

    The table is checkpointed first, so the count and the join read the same rows.
    Above the limit it is returned as it is and the join shuffles.
    """
    kept = cut(df)
    return F.broadcast(kept) if kept.limit(max_rows + 1).count() <= max_rows else kept
