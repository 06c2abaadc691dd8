"""Session settings the operators count on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Batch joins leave hot keys to AQE: it splits a partition that is far larger
# than the median, and broadcasts a side only once its real size is known.
BATCH_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

STREAM_SETTINGS = {
    # event times and intervals of whole days mean the same in every zone
    "spark.sql.session.timeZone": "UTC",
    # state on disk; also what transformWithState needs
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # the slower of two inputs holds the watermark back
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
    # merge a bidder's neighbouring bids inside each map task, ahead of the shuffle
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app_name: str = "gavelstream", master: str | None = None,
                  settings: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**BATCH_SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session on the same context with ``spark``'s settings plus the streaming ones.

    The caller's session keeps its own settings. ``spark.sql.shuffle.partitions`` is the number of state
    partitions, fixed for the life of a checkpoint: set it for the cluster the query will run on.
    """
    session = spark.newSession()
    inherited = spark.conf.getAll
    for key, value in inherited.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    for key, value in STREAM_SETTINGS.items():
        session.conf.set(key, value)
    return session


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path for checkpoints and written results.

    It lies below ``spark.checkpoint.dir``, which every executor of a cluster can reach. Where that is
    not set, local mode takes a temporary folder and a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share, or give "
                             "explicit paths: a local temporary folder is only seen by one machine of a cluster")
        base = tempfile.mkdtemp(prefix="gavelstream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
