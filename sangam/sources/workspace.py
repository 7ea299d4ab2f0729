"""Where an engine may write: the cluster's shared folder.  A temporary one is
taken only by a local session that names none (as in tests on one machine)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str = "engine") -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and spark.sparkContext.getCheckpointDir():
        shared = spark.sparkContext.getCheckpointDir()
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder")
    return f"{(shared or tempfile.mkdtemp(prefix='sangam-')).rstrip('/')}/{label}-{uuid.uuid4().hex}"
