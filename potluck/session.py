"""Session helpers: a local session for tests/bench and the shared checkpoint folder.

Library functions never build their own session; they take the caller's. The only
session setting the library reads is ``spark.checkpoint.dir`` (for lineage cuts and
versioned stores). A folder is set here only when the session has none, as in tests.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


# Skewed joins are split even where that costs one more shuffle (e.g. a join whose output is
# already clustered for the following aggregation).
SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "potluck") -> SparkSession:
    """A local session configured the way the tests and bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split a hot join key even when that costs one extra shuffle (e.g. a join whose
        # output is already clustered for the following aggregation)
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("POTLUCK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; set a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared filesystem folder and is used
    as is. Only a local session without one (tests) gets a fresh scratch folder; on a
    cluster a missing setting is an error, as executors do not see each other's folders.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session has no context
        sc = None
    if not current and sc is not None:
        current = sc.getCheckpointDir()
    if not current:
        master = spark.conf.get("spark.master", "local")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="potluck-ckpt-", dir=os.environ.get("POTLUCK_SCRATCH", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # noqa: BLE001 - static conf on some builds; the context dir suffices
            pass
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path inside the shared checkpoint folder (for stores, landing zones, versions)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, *parts])
