"""Session settings and the shared work folder."""

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_local_folder: tempfile.TemporaryDirectory | None = None


def local_session(cores: str = "*", name: str = "basketlens", memory: str = "16g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, in the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only a local
    session, whose executors live in this process, may fall back to a temporary
    folder of this machine.
    """
    global _local_folder
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if _local_folder is None:
            _local_folder = tempfile.TemporaryDirectory(prefix="basketlens-")
            atexit.register(_local_folder.cleanup)
        root = _local_folder.name
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")
