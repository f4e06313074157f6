"""Sessions: defaults for local work, and making the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def workers_import(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where the driver found it, whatever its working folder.

    On a cluster the package is shipped with the job (``--py-files`` or an installed wheel); a path that a
    worker does not have is harmless there.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark on one machine; cluster sessions come from spark-submit."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillon")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return workers_import(spark)


_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share; only a local session has one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN_DIR.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quillon-"))
