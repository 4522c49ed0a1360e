"""Labelled line sequences: features, transition matrices, Viterbi decoding, boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: The smallest probabilities.
MISSING, LEAST = 1e-9, 1e-12
BULLET = r"(?U)^\s*(?:[-*•]|\d+[.)])"


def structural_features(df: DataFrame, doc: str, index: str, text: str, header: Column | None = None) -> DataFrame:
    """Rows with log_words, has_bullet, ends_colon, caps_ratio, known_header, position; position needs a document's line count."""
    t = strip(F.coalesce(F.col(text), F.lit("")))
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    n = F.count("*").over(Window.partitionBy(doc))
    place = F.row_number().over(Window.partitionBy(doc).orderBy(index)) - 1
    return df.withColumns({
        "log_words": F.log1p(words.cast("double")),
        "has_bullet": F.coalesce(F.col(text), F.lit("")).rlike(BULLET).cast("double"),
        "ends_colon": t.endswith(":").cast("double"),
        "caps_ratio": F.when(letters == 0, 0.0).otherwise(F.length(F.regexp_replace(t, "[^A-Z]", "")) / letters),
        "known_header": (header if header is not None else F.lit(False)).cast("double"),
        "position": place / F.greatest(n - 1, F.lit(1)),
    })


def align_probabilities(p: Column, classes: list[str], labels: list[str]) -> Column:
    """A classifier's probabilities in the order of labels; absent classes get the least, the rest sums to 1."""
    raw = F.array(*[F.element_at(p, classes.index(x) + 1) if x in classes else F.lit(MISSING) for x in labels])
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def log_probabilities(p: Column) -> Column:
    return F.transform(p, lambda x: F.log(F.greatest(x, F.lit(LEAST))))


def transition_matrix(df: DataFrame, doc: str, index: str, label: str, labels: list[str], alpha: float = 1.0) -> DataFrame:
    """(prev, cur, n, log_p) for the whole grid of labels: smoothed counts of neighbours within a document."""
    spark = df.sparkSession
    w = Window.partitionBy(doc).orderBy(index)
    pairs = df.select(F.col(label).alias("prev"), F.lead(label).over(w).alias("cur")).where("cur is not null").groupBy("prev", "cur").agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "prev string, cur string")
    full = grid.join(pairs, ["prev", "cur"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("log_p", F.log((F.col("n") + alpha) / F.sum(F.col("n") + alpha).over(Window.partitionBy("prev"))))


def matrix_literal(transitions: DataFrame, labels: list[str]) -> Column:
    """The K x K table of transition_matrix() as a literal."""
    got = {(r.prev, r.cur): r.log_p for r in transitions.collect()}
    return F.array(*[F.array(*[F.lit(float(got[a, b])) for b in labels]) for a in labels])


def viterbi(emissions: Column, transitions: Column, k: int) -> Column:
    """Label indices of the best path of array<array<double>> emissions; a uniform start, ties to the lower index.

    The fold carries the K best log-probabilities and their paths, so a document is decoded in one pass.
    """
    zero = F.struct(F.array().cast("array<double>").alias("d"), F.array().cast("array<array<int>>").alias("p"))

    def best(d: Column, to: int) -> Column:
        via = F.transform(d, lambda x, i: F.struct((x + F.element_at(F.element_at(transitions, i + 1), to + 1)).alias("s"), (-i).alias("i")))
        return F.array_max(via)

    def step(a: Column, e: Column) -> Column:
        first = F.struct(e.alias("d"), F.array(*[F.array(F.lit(j)) for j in range(k)]).alias("p"))
        won = F.array(*[best(a["d"], j) for j in range(k)])
        later = F.struct(F.zip_with(won, e, lambda w, x: w["s"] + x).alias("d"), F.transform(won, lambda w, j: F.array_append(F.element_at(a["p"], 1 - w["i"]), j)).alias("p"))
        return F.when(F.size(a["d"]) == 0, first).otherwise(later)

    def last(a: Column) -> Column:
        at = F.array_max(F.transform(a["d"], lambda x, i: F.struct(x.alias("s"), (-i).alias("i"))))
        return F.when(F.size(a["d"]) == 0, F.array().cast("array<int>")).otherwise(F.element_at(a["p"], 1 - at["i"]))

    return F.aggregate(emissions, zero, step, last)


def boundary_accuracy(df: DataFrame, doc: str, index: str, true: str, pred: str) -> DataFrame:
    """(n, accuracy): how often "changes against the previous line" agrees, over all documents."""
    w = Window.partitionBy(doc).orderBy(index)
    both = df.select(F.lag(true).over(w).alias("t0"), F.col(true).alias("t"), F.lag(pred).over(w).alias("p0"), F.col(pred).alias("p"), F.row_number().over(w).alias("i")).where("i > 1")
    agree = (F.col("t") == F.col("t0")) == (F.col("p") == F.col("p0"))
    return both.agg(F.count("*").alias("n"), F.round(F.avg(agree.cast("double")), 4).alias("accuracy"))
