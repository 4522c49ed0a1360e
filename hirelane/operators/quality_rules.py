"""Rules for dataset records: each returns (key, level, rule) rows for what a record breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label_bucket
from .datasets import RUBRIC, privacy_flags, weighted_score

#: Fixed values of the rules.
LEVELS = ["intern", "junior", "middle", "senior", "unknown"]
LANGUAGES = ["en", "vi", "mixed"]
SPLITS = ["train", "validation", "test"]
LABELS = ["excellent_match", "strong_match", "moderate_match", "weak_match", "poor_match"]
RESUME_WORDS, JOB_WORDS, REQUIRED_SKILLS, NOTE_WORDS, SCORE_GAP = 250, 180, 3, 10, 2
RESUME_LINES, RESUME_LABELS, JOB_LINES, JOB_LABELS = 15, 4, 12, 3
RUBRIC_VERSION = "rubric_v0.2"


def _broken(df: DataFrame, key: str, errors: dict[str, Column], warnings: dict[str, Column] | None = None) -> DataFrame:
    rows = [F.when(F.coalesce(c, F.lit(True)), F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for level, rules in (("error", errors), ("warning", warnings or {})) for rule, c in rules.items()]
    return df.select(F.col(key).cast("string").alias("key"), F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("v")).select("key", "v.*")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def _words(c: str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def resumes(df: DataFrame, strict: bool = False) -> DataFrame:
    """strict adds the generator's minimum length and project rules."""
    text = F.concat_ws("\n", "raw_text", "summary", F.to_json("projects"))
    p = privacy_flags(text)
    rules = {f"{c} is missing": _blank(c) for c in ("id", "source", "raw_text")} | {f"{c} must be a list": F.col(c).isNull() for c in ("skills", "normalized_skills", "projects")}
    rules |= {"unknown candidate_level": ~F.col("candidate_level").isin(LEVELS), "unknown language": ~F.col("language").isin(LANGUAGES), "not anonymized": ~F.coalesce("anonymized", F.lit(False))}
    rules |= {f"text has {k}": c for k, c in p.items()}
    if strict:
        rules |= {"raw_text too short": _words("raw_text") < RESUME_WORDS, "no project": F.size("projects") < 1}
    return _broken(df, "id", rules)


def jobs(df: DataFrame, strict: bool = False) -> DataFrame:
    rules = {f"{c} is missing": _blank(c) for c in ("id", "source", "title", "raw_text")} | {f"{c} must be a list": F.col(c).isNull() for c in ("responsibilities", "requirements", "required_skills", "preferred_skills")}
    rules |= {"unknown level": ~F.col("level").isin(LEVELS), "unknown language": ~F.col("language").isin(LANGUAGES)}
    if strict:
        rules |= {"raw_text too short": _words("raw_text") < JOB_WORDS, "too few required skills": F.size("required_skills") < REQUIRED_SKILLS}
    return _broken(df, "id", rules)


def pairs(df: DataFrame, resume_ids: DataFrame, job_ids: DataFrame) -> DataFrame:
    """Pairs against their rubric and the ids of resumes and jobs (each a table of one column `id`)."""
    r = resume_ids.select(F.col("id").alias("resume_id"), F.lit(True).alias("_r")).distinct()
    j = job_ids.select(F.col("id").alias("job_description_id"), F.lit(True).alias("_j")).distinct()
    d = df.join(r, "resume_id", "left").join(j, "job_description_id", "left")
    keys = F.array_sort(F.map_keys("criterion_scores"))
    values = F.map_values("criterion_scores")
    gap = F.abs(weighted_score(F.col("criterion_scores")) - F.col("overall_score")) > SCORE_GAP
    errors = {
        "unknown resume_id": F.col("_r").isNull(),
        "unknown job_description_id": F.col("_j").isNull(),
        "unknown split": F.col("split").isNotNull() & ~F.col("split").isin(SPLITS),
        "unknown label": ~F.col("label").isin(LABELS),
        "overall_score out of range": ~F.col("overall_score").between(0, 100),
        "label doesn't match the score": F.col("label") != label_bucket(F.col("overall_score")),
        "criteria don't match the rubric": keys != F.array(*[F.lit(k) for k in sorted(RUBRIC)]),
        "criterion score out of range": F.exists(values, lambda x: ~x.between(0, 100)),
        "criteria don't add up to the score": gap,
    }
    warnings = {"label_notes too short": _words("label_notes") < NOTE_WORDS, "old label_version": F.col("label_version") != RUBRIC_VERSION}
    return _broken(d, "id", errors, warnings)


def labelled_lines(df: DataFrame, labels: list[str], for_jobs: bool = False) -> DataFrame:
    """Rules for (doc_id, line_index, text, label) lines: per line errors, per document warnings."""
    lines, kinds = (JOB_LINES, JOB_LABELS) if for_jobs else (RESUME_LINES, RESUME_LABELS)
    each = _broken(df, "doc_id", {"empty text": _blank("text"), "unknown label": ~F.col("label").isin(labels)})
    docs = df.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("label").isin(labels), F.col("label"))).alias("k"))
    return each.unionByName(_broken(docs, "doc_id", {}, {"few lines": F.col("n") < lines, "few labels": F.col("k") < kinds}))


def round_mismatch(df: DataFrame, resume_rounds: DataFrame, job_rounds: DataFrame) -> DataFrame:
    """Pairs whose resume and job come from different rounds; rounds are (id, round)."""
    r = resume_rounds.select(F.col("id").alias("resume_id"), F.col("round").alias("_a"))
    j = job_rounds.select(F.col("id").alias("job_description_id"), F.col("round").alias("_b"))
    d = df.join(r, "resume_id").join(j, "job_description_id").where("_a <> _b")
    return d.select(F.col("id").alias("key"), F.lit("error").alias("level"), F.lit("pair across rounds").alias("rule"))


def reconcile_ids(expected: DataFrame, actual: DataFrame, key: str = "id") -> DataFrame:
    """(key, state): ids that are missing or unexpected."""
    e, a = expected.select(F.col(key), F.lit(1).alias("_e")).distinct(), actual.select(F.col(key), F.lit(1).alias("_a")).distinct()
    d = e.join(a, key, "full").where(F.col("_e").isNull() | F.col("_a").isNull())
    return d.select(F.col(key).alias("key"), F.when(F.col("_e").isNull(), "unexpected").otherwise("missing").alias("state"))


def accept(df: DataFrame, expected: DataFrame, valid: Column, key: str, order: str) -> DataFrame:
    """Rows with `state`: unexpected, duplicate (all but the first by order), rejected or accepted."""
    from pyspark.sql import Window

    e = expected.select(F.col(key), F.lit(True).alias("_e")).distinct()
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    d = df.join(e, key, "left").withColumn("_n", n)
    return d.withColumn("state", F.when(F.col("_e").isNull(), "unexpected").when(F.col("_n") > 1, "duplicate").when(~F.coalesce(valid, F.lit(False)), "rejected").otherwise("accepted")).drop("_e", "_n")


def readiness(df: DataFrame, least: int = 100) -> DataFrame:
    """One row on whether pairs fit for tuning: enough, one rubric, all splits, at least three labels, no entity in two splits."""
    s = df.agg(F.count("*").alias("n"), F.count_distinct("label_version").alias("rubrics"), F.count_distinct("split").alias("splits"), F.count_distinct("label").alias("labels"))
    leaks = None
    for c in ("resume_id", "job_description_id"):
        x = df.where("split is not null").groupBy(c).agg(F.count_distinct("split").alias("k")).where("k > 1").agg(F.count("*").alias("leaks"))
        leaks = x if leaks is None else leaks.unionByName(x)
    return s.join(leaks.agg(F.sum("leaks").alias("leaks"))).withColumn("ready", (F.col("n") >= least) & (F.col("rubrics") == 1) & (F.col("splits") == 3) & (F.col("labels") >= 3) & (F.col("leaks") == 0))
