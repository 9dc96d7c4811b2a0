"""Session and checkpoint helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "tassel", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings the operators rely on.

    ``master`` and sizing stay with the cluster unless the caller gives them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tassel-ckpt-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def let_workers_import(spark: SparkSession) -> None:
    """Workers that are started from now on can import this package from where the driver has it.

    On a cluster the package is installed or sent with the job; then the extra path does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    settings = spark.sparkContext.environment
    paths = [p for p in settings.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        settings["PYTHONPATH"] = os.pathsep.join([*paths, root])
