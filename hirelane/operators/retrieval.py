"""Vector similarity, top-K retrieval and two-stage re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import py_round


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero; lengths must agree."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors of different lengths"))
    return F.when(same.isNull(), F.when(n == 0, 0.0).otherwise(dot(a, b) / n))


def clipped_dot(a: Column, b: Column) -> Column:
    return F.least(F.greatest(dot(a, b), F.lit(0.0)), F.lit(1.0))


def score_shifted(s: Column) -> Column:
    """-1..1 to whole points of 0..100."""
    return py_round((s + 1) / 2 * 100, 0).cast("int")


def score_clipped(s: Column) -> Column:
    """Clipped to 0..1, whole points."""
    return py_round(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) * 100, 0).cast("int")


def score_percent(s: Column) -> Column:
    """Clipped to 0..1, two digits."""
    return py_round(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) * 100, 2)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def top_k(candidates: DataFrame, jobs: DataFrame, k: int = 50, candidate: str = "cv_id", job: str = "jd_id", vector: str = "embedding") -> DataFrame:
    """(job, candidate, similarity, rank): the k most similar candidates of each job, ties by candidate.

    Every pair is scored, which is what exact retrieval means; the ranking keeps k rows per job and task before it shuffles.
    """
    c = candidates.select(F.col(candidate).alias("c_id"), F.col(vector).alias("c_v"))
    j = jobs.select(F.col(job).alias("j_id"), F.col(vector).alias("j_v"))
    scored = c.join(j, F.size("c_v") == F.size("j_v")).select("j_id", "c_id", cosine(F.col("j_v"), F.col("c_v")).alias("similarity"))
    w = Window.partitionBy("j_id").orderBy(F.desc("similarity"), "c_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("j_id").alias(job), F.col("c_id").alias(candidate), "similarity", "rank")


def recall_at_k(pairs: DataFrame, top: DataFrame, bounds: tuple[int, ...] = (60, 75), candidate: str = "cv_id", job: str = "jd_id", score: str = "score") -> DataFrame:
    """(min_score, hits, total, recall): share of labelled pairs found in the top lists, over all and by least score."""
    found = pairs.join(top.select(job, candidate, F.lit(1).alias("hit")).distinct(), [job, candidate], "left")
    rows = [F.struct(F.lit(b).alias("min_score"), (F.col(score) >= b if b else F.lit(True)).alias("counts")) for b in (0, *bounds)]
    each = found.select(F.explode(F.array(*rows)).alias("x"), F.coalesce("hit", F.lit(0)).alias("hit")).select("x.*", "hit").where("counts")
    return each.groupBy("min_score").agg(F.sum("hit").alias("hits"), F.count("*").alias("total"), F.round(F.avg("hit"), 4).alias("recall"))


def two_stage(pairs: DataFrame, top: DataFrame, candidate: str = "cv_id", job: str = "jd_id", first: str = "bi_score", second: str = "cross_score") -> DataFrame:
    """The second stage's score for pairs in the top lists, else the first stage's; with whether it was re-ranked."""
    got = pairs.join(top.select(job, candidate, F.lit(True).alias("in_top")).distinct(), [job, candidate], "left")
    use = F.coalesce(F.col("in_top"), F.lit(False)) & F.col(second).isNotNull()
    return got.withColumns({"score": F.when(use, F.col(second)).otherwise(F.col(first)), "reranked": use}).drop("in_top")
