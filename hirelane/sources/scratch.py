"""The folder for tables between steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in spark.checkpoint.dir, which all executors share; a temporary folder only where all run on one machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        place = "file://" + tempfile.mkdtemp(prefix="hirelane-")
    return f"{place.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
