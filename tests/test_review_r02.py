"""Findings of the second review."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from hirelane.functions import extract as X
from hirelane.functions import text as T
from hirelane.operators import skills as K
from hirelane.plans import scoring_queries as SQ
from hirelane.plans.parse_jobs import parse_jobs

JD = """Senior Data Engineer
Mô tả công việc: build pipelines
- Run Spark jobs
• REQUIREMENTS — at least 3 years of experience
Requirements:
- Python and Go
- Bachelor's degree in Computer Science
Benefits: lunch
- Kafka lunches
Nice-to-have
- Docker, ㎏ and “ﬁne” REST API
Qualifications (must): SQL
"""


def test_job_texts_are_read_in_a_row_without_a_shuffle(spark):
    """lines and texts went through windows and joins, and each field's patterns over every text."""
    docs = spark.createDataFrame([(1, JD), (2, None), (3, "no heading, Kafka only")], "doc_id long, text string")
    out = parse_jobs(docs)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    r = {x.doc_id: x for x in out.collect()}
    assert r[1].responsibilities == ["build pipelines", "Run Spark jobs"]
    assert r[1].requirements == ["Python and Go", "Bachelor's degree in Computer Science", "SQL"]
    assert r[1].nice_to_have == ["Docker, ㎏ and “ﬁne” REST API"]
    assert [s.name for s in r[1].required_skills] == ["Python", "Go", "SQL"]
    assert [s.name for s in r[1].preferred_skills] == ["Docker", "REST API"]
    assert (r[1].title, r[1].min_experience_years) == ("Senior Data Engineer", 3)
    assert r[2].required_skills == [] and [s.name for s in r[3].required_skills] == ["Kafka"]


def test_a_large_catalog_finds_the_same_skills_by_a_join(spark, monkeypatch):
    docs = spark.createDataFrame([(1, JD), (2, None), (3, "node.js, go.js, c++ and ci/cd")], "doc_id long, text string")
    rows = sorted(parse_jobs(docs).collect())
    monkeypatch.setattr(K, "ROW_ALIASES", 1)
    assert sorted(parse_jobs(docs).collect()) == rows


def test_strings_of_a_pattern_lose_no_match(spark):
    texts = ["We need a mid-level lead", "Mid level", "Sr. staff, 5+ years", "a Bſ in İnformation technology", "UNıVERSITY DEGREE in arts", "Toàn thời gian", "1 year", "at least 12yrs", "nam 3", "3 nam kinh nghiem"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("f", T.fold_match(F.col("t")))

    def first(rules):
        return F.coalesce(*[F.when(F.col("f").rlike(p), v) for p, v, _ in rules])

    years = F.array_min(F.transform(F.concat(*[F.regexp_extract_all("f", F.lit(p), F.lit(1)) for p in X.EXPERIENCE_YEARS]), lambda x: x.cast("int")))
    education = F.regexp_replace(F.coalesce(*[F.nullif(F.regexp_extract("t", "(?iu)" + p, 0), F.lit("")) for p, _ in X.EDUCATION]), X._TRIM, "")
    got = d.select("t", X.seniority(F.col("f")), X.employment_type(F.col("f")), X.min_experience_years(F.col("f")), X.education_requirement(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in d.select("t", first(X.SENIORITY), first(X.EMPLOYMENT), years, education).collect()]
    assert got[3][4] and got[4][4]


def test_texts_beyond_ascii_are_folded_in_time(spark):
    """a class of single letters was gone through letter by letter for each character."""
    d = spark.createDataFrame([("語 — text ﬁ " * 200_000,)], "t string")
    d.select(T.fold_match(F.lit("語ﬁ"))).collect()
    began = time.time()
    assert d.select(T.fold_match(F.substring("t", 1, 22)).alias("x"), F.length(T.fold_match(F.regexp_replace("t", "ﬁ", "x"))).alias("n")).first() == ("text fi text fi", 1_400_000 - 1)
    assert time.time() - began < 5


def test_pairs_are_formed_without_a_shuffle_of_jobs(spark, monkeypatch):
    """each pair carried its prepared job through a shuffle, 70 % of all that was written."""
    path = "/root/testdata/sf0.001"
    monkeypatch.setattr(SQ, "BROADCAST_JOBS", 0)
    want = sorted(map(str, SQ.score_narrative(spark, path).collect()))
    for few in (5_000, 0):
        monkeypatch.setattr(SQ, "BROADCAST_JOBS", 100_000)
        monkeypatch.setattr(SQ, "PREPARED_JOBS", few)
        df = SQ.score_narrative(spark, path)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [job_id" in plan
        assert sorted(map(str, df.collect())) == want
