"""Spark session settings shared by the tests, the benchmark and interactive use."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "keyloom", **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword settings use `__` for the dots of a Spark key."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever folder they start in.

    Where it is installed, or shipped with the job, that changes nothing.
    """
    environment = spark.sparkContext.environment
    root, known = str(Path(__file__).resolve().parents[1]), environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        environment["PYTHONPATH"] = f"{root}:{known}" if known else root


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a new one where that is unset."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or _FOLDERS.get(spark.sparkContext.applicationId):
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir isn't set; it has to name a folder that driver and executors share")
    folder = "file://" + os.path.join(tempfile.gettempdir(), f"keyloom-{uuid.uuid4().hex}")
    return _FOLDERS.setdefault(spark.sparkContext.applicationId, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any store that Spark writes to, if it's there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_FOLDERS: dict[str, str] = {}
