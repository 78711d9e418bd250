"""The shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

OWN_DIR = "/tmp/checkpoints"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. A machine's own folder stands in only where driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = OWN_DIR
    return f"{root.rstrip('/')}/docspark-{name}-{uuid.uuid4().hex}"
