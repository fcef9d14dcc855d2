"""Session helpers.

Everything in the library takes a SparkSession from the caller; these helpers only
fill in settings a cluster would normally provide, and never override ones that are
already set (a cluster's ``spark.checkpoint.dir`` in particular).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on. AQE is on so that shuffle partition counts are
# coalesced at run time and skewed join partitions (hot digests, hot posts) are split.
# Broadcasts are decided only at run time: the plan-time estimate (from compressed file
# sizes) is switched off, and AQE broadcasts a join side only when its measured shuffle
# output is under the adaptive threshold; beyond it the shuffle join stays.
DEFAULT_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "16MB",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "threadlake") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the provided session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("THREADLAKE_DRIVER_MEMORY", "16g"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only when none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    Only a bare local session (tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    # A bare local session (tests, the bench).
    path = tempfile.mkdtemp(prefix="threadlake-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df, eager: bool = True):
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint folder and
    reading it back (never a local checkpoint).

    Unlike ``Dataset.checkpoint`` on an unpersisted plan, this computes ``df`` once (one
    write job) and the result is a real table: later scans prune columns and give AQE
    exact sizes. Each call writes a fresh folder ``threadlake-cuts/<uuid>``; removing
    old ones is the owner's housekeeping. ``eager`` is accepted for symmetry; the write
    always happens now.
    """
    import uuid

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/threadlake-cuts/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
