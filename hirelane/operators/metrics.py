"""Evaluation metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import integer_label, label_bucket

#: Half-open bins.
ERROR_BINS = [0, 5, 10, 15, 20, 30, 100]
SCORE_BINS = [0, 20, 40, 60, 75, 90, 101]


def evaluate(df: DataFrame, pred: str = "pred", true: str = "true", empty_as_zero: bool = True) -> DataFrame:
    """mae, rmse, label_accuracy (same bucket), mean_pred, mean_true, n; rounded to 4."""
    err = F.col(pred) - F.col(true)
    same = (label_bucket(F.col(pred)) == label_bucket(F.col(true))).cast("double")
    parts = {"mae": F.avg(F.abs(err)), "rmse": F.sqrt(F.avg(err * err)), "label_accuracy": F.avg(same), "mean_pred": F.avg(pred), "mean_true": F.avg(true)}
    zero = (lambda c: F.coalesce(c, F.lit(0.0))) if empty_as_zero else (lambda c: c)
    return df.agg(F.count("*").alias("n"), *[zero(F.round(c, 4)).alias(k) for k, c in parts.items()])


def tolerance(df: DataFrame, by: str | None = None, pred: str = "pred", true: str = "true", within: float = 10.0) -> DataFrame:
    """Share of errors within a tolerance, bias and spread of the signed error, per class if `by` is given."""
    err = F.col(pred) - F.col(true)
    return df.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), F.round(F.avg((F.abs(err) <= within).cast("double")), 4).alias("accuracy"), F.round(F.avg(err), 4).alias("bias"), F.round(F.stddev_pop(err), 4).alias("error_std"))


def confusion(df: DataFrame, pred: str = "pred", true: str = "true") -> DataFrame:
    """(true_label, pred_label, n, row_percent) by whole-number ranges; predictions are rounded first."""
    named = df.select(integer_label(F.col(true)).alias("true_label"), integer_label(F.round(pred)).alias("pred_label"))
    n = named.groupBy("true_label", "pred_label").agg(F.count("*").alias("n"))
    return n.withColumn("row_percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("true_label")), 1))


def _bin(c: Column, edges: list[float]) -> Column:
    out = F.when((c >= edges[0]) & (c < edges[1]), f"{edges[0]}-{edges[1]}")
    for a, b in zip(edges[1:], edges[2:], strict=False):
        out = out.when((c >= a) & (c < b), f"{a}-{b}")
    return out


def error_histogram(df: DataFrame, pred: str = "pred", true: str = "true", edges: list[float] | None = None) -> DataFrame:
    """(bin, n) of absolute errors; those outside all bins have a null bin."""
    return df.groupBy(_bin(F.abs(F.col(pred) - F.col(true)), edges or ERROR_BINS).alias("bin")).agg(F.count("*").alias("n"))


def signed_error_bins(df: DataFrame, pred: str = "pred", true: str = "true", edges: list[float] | None = None) -> DataFrame:
    """(bin, n, mean_error) of the signed error by range of the true score."""
    err = F.col(pred) - F.col(true)
    return df.groupBy(_bin(F.col(true), edges or SCORE_BINS).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(err), 4).alias("mean_error"))


def worst(df: DataFrame, key: str, k: int = 20, pred: str = "pred", true: str = "true") -> DataFrame:
    """The k rows with the largest error, ties by key."""
    return df.withColumn("abs_error", F.abs(F.col(pred) - F.col(true))).orderBy(F.desc("abs_error"), key).limit(k)


def ensemble(df: DataFrame, key: str, pred: str = "pred") -> DataFrame:
    """Mean and spread of several models' predictions for each key."""
    return df.groupBy(key).agg(F.avg(pred).alias("pred"), F.stddev_pop(pred).alias("pred_std"), F.count("*").alias("models"))


def class_report(df: DataFrame, pred: str = "pred", true: str = "true") -> DataFrame:
    """(label, precision, recall, f1, support) of every label that is true or predicted; undefined ones are 0."""
    both = df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    each = both.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    s = each.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    s = s.withColumns({"p": ratio(F.col("hit"), F.col("predicted")), "r": ratio(F.col("hit"), F.col("support"))})
    f1 = F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    return s.select("label", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"), "support")


def index_percentiles(df: DataFrame, value: str, at: tuple[int, ...] = (50, 75, 90, 95, 99)) -> DataFrame:
    """(percent, value): the value at position int(n * p / 100) of the sorted values.

    Ranks come from counts per distinct value, so no task sorts all rows.
    """
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    total = counts.agg(F.sum("n").alias("total"))
    wanted = total.select("total", F.explode(F.array(*[F.lit(p) for p in at])).alias("percent")).withColumn("position", F.least(F.floor(F.col("total") * F.col("percent") / 100), F.col("total") - 1))
    return upto.join(F.broadcast(wanted), F.col("upto") > F.col("position")).groupBy("percent").agg(F.min("v").alias("value"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, n) over equal widths from the least to the largest value; the last bin is closed."""
    edge = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))
    return df.where(F.col(value).isNotNull()).join(F.broadcast(edge)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def share(df: DataFrame, by: str) -> DataFrame:
    """(by, n, percent)."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def deltas(df: DataFrame, order: str, metric: str) -> DataFrame:
    """Each model's difference to the first one by `order` and to the best."""
    every = Window.partitionBy()
    return df.withColumns({"vs_first": F.round(F.col(metric) - F.min_by(metric, order).over(every), 4), "vs_best": F.round(F.col(metric) - F.max(metric).over(every), 4)})


def boundary_loss(pred: Column, true: Column) -> Column:
    """Squared error plus 0.3 times the mean cross-entropy at the four bucket bounds, scores of 0 to 1."""
    parts = []
    for bound in (0.40, 0.60, 0.75, 0.90):
        p = F.greatest(F.least(1 / (1 + F.exp(-20 * (pred - bound))), F.lit(1 - 1e-7)), F.lit(1e-7))
        parts.append(F.when(true >= bound, -F.log(p)).otherwise(-F.log(1 - p)))
    return (pred - true) ** 2 + 0.3 * sum(parts[1:], parts[0]) / 4


def isotonic(df: DataFrame, score: str, target: str):
    """Fitted non-decreasing calibration; clips outside the range seen."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rows = VectorAssembler(inputCols=[score], outputCol="features").transform(df.select(score, F.col(target).alias("label")))
    return IsotonicRegression(featuresCol="features", labelCol="label").fit(rows)


def calibrate(df: DataFrame, model, score: str, out: str = "calibrated") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[score], outputCol="features").transform(df)
    return model.setPredictionCol(out).transform(rows).drop("features")
