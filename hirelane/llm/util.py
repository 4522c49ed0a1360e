"""Tables in the cluster's shared folder, and small helpers every operator uses."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where the setting is absent and all run on one machine (tests), a temporary folder is made and set; elsewhere
    executors wouldn't see it, so that is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = jsc.get() if jsc.isDefined() else None
    if not place:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        place = "file://" + tempfile.mkdtemp(prefix="hirelane-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/hirelane/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df as Parquet into the shared folder and read it back; cuts lineage.

    Survives lost executors, since the files are in the shared folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables of materialise() that no later plan reads."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fan_out(spark: SparkSession, least: int = 1) -> int:
    """Partitions for exchanges that Spark doesn't size itself."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
