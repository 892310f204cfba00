"""Session defaults for running the library on its own (tests, bench, notebooks)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(
    app_name: str = "tidecore",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str = "8g",
) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC times.

    On a cluster leave ``master`` unset (``spark-submit`` names it) and
    let ``spark.sql.shuffle.partitions`` come from the cluster defaults.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.driver.memory", driver_memory)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for round tables; the cluster's setting always wins."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    active = sc.getCheckpointDir()
    if active:
        return active
    if not configured:
        if not is_local(spark):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor can reach"
            )
        configured = tempfile.mkdtemp(prefix="tidecore-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables an operator has to write."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}-{os.urandom(6).hex()}"
