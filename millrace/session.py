"""Session settings used by the tests, the bench and the command-line jobs."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings a cluster should carry as well: run-time re-planning, skew splitting
# and UTC, so that time buckets do not depend on the machine.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Checkpoints that no DataFrame needs any more are deleted from the shared folder.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def cluster_session(app_name: str) -> SparkSession:
    """Session for a submitted job; master and sizing come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(
    app_name: str, cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8
) -> SparkSession:
    """Single-JVM session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Recording the Python line of every Column costs milliseconds each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once.

    Functions that run in tasks are found there by name, so workers need the package
    wherever the driver was started.
    """
    context = spark.sparkContext
    archive = f"{__package__}-{context.applicationId}.zip"
    if archive in context._python_includes:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix=f"{__package__}-")) / archive
    with zipfile.ZipFile(path, "w") as file:
        for source in sorted(root.rglob("*.py")):
            file.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
