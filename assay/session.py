"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def local_session(cpus: str = "8", app: str = "assay", scratch: str | None = None) -> SparkSession:
    """A session for tests and the local benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder for an intermediate table, under the shared ``spark.checkpoint.dir``.

    The setting is only read. Where it is unset, as in tests, a local master gets one temporary folder per
    application; a cluster gets an error, since executors could not read a folder of one machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        shared = _LOCAL.setdefault(app, _LOCAL.get(app) or tempfile.mkdtemp(prefix="assay-"))
    return f"{shared.rstrip('/')}/assay-{uuid.uuid4().hex}"
