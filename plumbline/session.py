"""Session settings and places that a cluster defines."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", name: str = "plumbline", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        # Plans here are built from many small expressions; noting where each was written takes longer than making it.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Checkpoints go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``), made the session's checkpoint folder once.

    Where it is unset a session in one process, as in tests, gets a temporary folder; a cluster has to name one.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    if not (sc.getCheckpointDir() or "").removeprefix("file:").startswith(at.removeprefix("file://").removeprefix("file:").rstrip("/")):
        sc.setCheckpointDir(at)
    return at


def read(spark: SparkSession, sf_dir: str, name: str):
    """One of the tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
