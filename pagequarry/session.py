"""Session helper for tests, the bench and notebooks; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, app: str = "pagequarry") -> SparkSession:
    """A local session with the settings that the tests and the bench rely on.

    ``spark.checkpoint.dir`` is set here only because a local run has no cluster
    that names a shared folder.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", "0")) or (os.cpu_count() or 2)
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
