"""Session settings the operators rely on, and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "comptoir", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and the time zone pinned to UTC.

    On a cluster leave ``master`` unset and pass sizes through ``conf``; nothing here fixes the number of
    executors or of shuffle partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Checkpointed rows are removed once no plan refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Plans with many expressions are built much faster without a call site recorded for each of them.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where the session may name none."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current is None:
        if not configured and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = configured or tempfile.mkdtemp(prefix="comptoir-checkpoint-")
        context.setCheckpointDir(configured)
        current = context.getCheckpointDir()
    return configured or current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage once, so that every later read sees the same rows in the same partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for files one job writes and another reads."""
    return f"{shared_folder(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"
