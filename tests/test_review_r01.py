"""Cases of the first round's review."""

import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hirelane.functions.labels import py_round
from hirelane.functions.text import fold_ascii, fold_match
from hirelane.operators import datasets as D


def test_rounding_goes_by_the_binary_value(spark):
    rng = random.Random(2)
    values = [0.285, 0.125, 0.375, 2.675, 1.005, 17.5, 0.0, -0.285, -2.5, 99.995, 1e15, 0.5, 1.5, 2.5, float("nan"), None]
    values += [rng.randrange(20000) / 200 + 0.005 for _ in range(300)] + [rng.random() * 100 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 4, 6):
        for r in df.select("x", py_round(F.col("x"), digits).alias("y")).collect():
            want = None if r.x is None else round(r.x, digits)
            assert r.y == want or (want != want and r.y != r.y), (r.x, digits)
            if want is not None and want == want:
                assert want == float(Decimal(r.x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN))


def test_ligatures_keep_their_letters(spark):
    df = spark.createDataFrame([("ﬁnance oﬃce",), ("ĳs ½ Ǆ",), ("Đà Nẵng",)], "t string")
    got = [(r.a, r.b) for r in df.select(fold_match(F.col("t")).alias("a"), fold_ascii(F.col("t")).alias("b")).collect()]
    assert got[0] == ("finance office", "finance office") and got[1][0] == "ijs 1 2 dz" and got[2][0] == "da nang"


def test_ids_are_ranks_on_large_tables(spark, tmp_path):
    df = spark.range(400_000, numPartitions=8).select(F.xxhash64("id").alias("v"), "id")
    got = D.reassign_ids(df, [F.col("v"), F.col("id")], "x", f"file://{tmp_path}/ids", 7)
    want = df.withColumn("n", F.row_number().over(Window.orderBy("v", "id")))
    assert got.join(want, ["id", "v"]).where(F.col("new_id") != F.concat(F.lit("x"), F.lpad(F.col("n").cast("string"), 7, "0"))).count() == 0
    assert got.count() == 400_000 and D.reassign_ids(df.limit(0), [F.col("v")], "x", f"file://{tmp_path}/none").count() == 0


def test_strict_pairs_fail_on_bad_pairs(spark):
    kind = "id string, resume_id string, job_description_id string, split string, label string, overall_score int"
    r, j = spark.createDataFrame([("r1",)], "id string"), spark.createDataFrame([("j1",)], "id string")
    fine = spark.createDataFrame([("p1", "r1", "j1", "train", None, 80)], kind)
    assert [(x.id, x.label) for x in D.strict_pairs(fine, r, j).collect()] == [("p1", "strong_match")]
    for bad in [("p2", "r9", "j1", "train", None, 1), ("p3", "r1", "j9", "train", None, 1), ("p4", "r1", "j1", "other", None, 1), ("p5", "r1", "j1", None, None, 1), (None, None, None, None, None, None)]:
        for look in (lambda d: d.count(), lambda d: d.select("overall_score").collect()):
            with pytest.raises(Exception, match="bad pair"):
                look(D.strict_pairs(spark.createDataFrame([bad], kind), r, j))
    assert D.join_pairs(spark.createDataFrame([("p2", "r9", "j1", "test", None, 1), ("p6", "r1", "j1", "test", "x", 1)], kind), r, j).select("id", "label").collect() == [("p6", "x")]
