"""Session factory with the settings that the queries rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(name: str = "quillspark", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; a cluster's own master, memory and folders stay as they are set."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
    }
    for k, v in (defaults | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the one that ``spark.checkpoint.dir`` names, for driver and executors; a temporary one only in local mode without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
