"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it has none, a temporary folder serves a master that is local, so one machine; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            root = "file://" + tempfile.mkdtemp(prefix="ebbtide-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/ebbtide/{name}-{uuid.uuid4().hex}"
