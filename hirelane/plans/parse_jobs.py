"""Job descriptions as typed records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T
from ..functions.catalog import frame
from ..operators.skills import job_skills_wanted, resolved_job_skills, with_job_skills_found


SECTIONS = ("responsibilities", "requirements", "nice_to_have")


def parse_jobs(docs: DataFrame, doc: str = "doc_id", text: str = "text", catalog: DataFrame | None = None) -> DataFrame:
    """One row per document with all fields of a job; null text gives empty fields."""
    catalog = catalog if catalog is not None else frame(docs.sparkSession)
    d = docs.select(F.col(doc), T.job_text_lines(T.sanitize(F.col(text))).alias("text"))
    d = d.withColumn("letters", T.match_letters(F.col("text")))
    d = d.withColumns({"folded": T.match_words(F.col("letters")), "sections": X.section_lines(F.col("text"), F.col("letters"), SECTIONS)})
    d = d.select(doc, "text", "folded", *[X.section_items(F.col("sections")[k]).alias(k) for k in SECTIONS])
    lines = lambda k: T.fold_match(F.array_join(k, "\n"))
    d = with_job_skills_found(d.withColumns({"required": lines("requirements"), "preferred": lines("nice_to_have")}), doc, catalog, "required", "preferred", "folded")
    return d.select(
        doc,
        X.job_title(F.col("text")).alias("title"),
        X.seniority(F.col("folded")).alias("seniority"),
        X.employment_type(F.col("folded")).alias("employment_type"),
        *SECTIONS,
        X.min_experience_years(F.col("folded")).alias("min_experience_years"),
        X.education_requirement(F.col("text")).alias("education_requirement"),
        X.domain_keywords(F.col("folded")).alias("domain_keywords"),
        *resolved_job_skills(job_skills_wanted(F.array_join("requirements", "\n"))),
    )
