"""JSON-lines tables: strict, lenient and keyed reading; writing by split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType, _parse_datatype_string

CORRUPT = "_corrupt_record"


def _schema(schema: str) -> StructType:
    return _parse_datatype_string(schema)


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): errors has file and text of every bad line; blank lines and a leading byte-order mark are no errors."""
    raw = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"), F.input_file_name().alias("file")).where(F.trim("line") != "")
    kind = _schema(schema).add(CORRUPT, StringType())
    parsed = raw.withColumn("r", F.from_json("line", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col(f"r.{CORRUPT}").isNotNull()
    return parsed.where(~bad).select(*[f"r.{f.name}" for f in _schema(schema)]), parsed.where(bad).select("file", "line")


def read_skipping(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Bad lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the largest `order`."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def write_by_split(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).json(path)


def write_report(metrics: DataFrame, predictions: DataFrame, path: str) -> None:
    """Metrics and per-row predictions side by side."""
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    predictions.write.mode("overwrite").json(f"{path}/predictions")


def file_type(kind, name):
    """PDF or DOCX from a declared type or a file name, else the declared type in capitals."""
    up = F.upper(F.coalesce(kind, F.lit("")))
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(up.isin("PDF", "DOCX"), up).when(low.endswith(".pdf"), "PDF").when(low.endswith(".docx"), "DOCX").otherwise(up)


def slice_rows(df: DataFrame, order: str, start: int, count: int) -> DataFrame:
    """Rows start to start + count - 1 by order, from 0; only the first start + count rows are sorted."""
    w = Window.orderBy(order)
    return df.orderBy(order).limit(start + count).withColumn("_n", F.row_number().over(w)).where(F.col("_n") > start).drop("_n")
