"""Flat text of dataset records, JSON inside free text, and label targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(*cols: Column) -> Column:
    """Non-blank parts, joined by a space."""
    return F.array_join(F.filter(F.array(*cols), lambda x: x.isNotNull() & (F.trim(x) != "")), " ")


def _all(c: Column) -> Column:
    return F.array_join(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), " ")


def resume_plain(r: Column) -> Column:
    """Summary, skills, project names and descriptions; education is a record in these tables and isn't read."""
    projects = F.transform(r["projects"], lambda p: _parts(p["name"], p["description"]))
    return _parts(r["summary"], _all(r["skills"]), _all(projects))


def job_plain(j: Column) -> Column:
    return _parts(j["title"], j["level"], _all(j["responsibilities"]), _all(j["requirements"]), _all(j["nice_to_have"]), _all(j["domain_keywords"]))


def labelled_view(fields: list[tuple[str, Column]]) -> Column:
    """"Name: value" lines, lists joined by "; ", nulls empty."""
    return F.array_join(F.array(*[F.concat(F.lit(f"{name}: "), F.coalesce(c.cast("string"), F.lit(""))) for name, c in fields]), "\n")


def joined(c: Column) -> Column:
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), "; ")


def list_with_rest(c: Column, most: int = 5) -> Column:
    """The first items and how many more there are."""
    n = F.size(c)
    return F.concat(F.array_join(F.slice(c, 1, most), ", "), F.when(n > most, F.concat(F.lit(" (+"), (n - most).cast("string"), F.lit(" more)"))).otherwise(""))


def json_blocks(text: Column, schema: str) -> Column:
    """Records in fenced json blocks of a text, else in its brace-balanced objects with a pair_id (of up to three levels); broken ones are left out."""
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```json\s*(.*?)\s*```"), F.lit(1))
    level = r"\{[^{}]*\}"
    for _ in range(2):
        level = rf"\{{(?:[^{{}}]|{level})*\}}"
    bare = F.filter(F.regexp_extract_all(text, F.lit(f"({level})"), F.lit(1)), lambda x: x.contains('"pair_id"'))
    parse = lambda c: F.filter(F.transform(c, lambda x: F.from_json(x, schema)), lambda r: r["pair_id"].isNotNull())
    found = parse(fenced)
    return F.when(F.size(found) > 0, found).otherwise(parse(bare))


def max_numeric_id(c: Column, prefix: str) -> Column:
    """Largest number after a prefix; other ids don't count."""
    return F.max(F.when(c.startswith(prefix), F.substring(c, F.lit(len(prefix) + 1), F.length(c)).try_cast("long")))


def fill_targets(counts: dict[str, int], budget: int) -> dict[str, int]:
    """How many of each label to add so that the lowest counts rise together; ties by name.  A few labels, on the driver."""
    have, add = dict(counts), dict.fromkeys(counts, 0)
    for _ in range(budget):
        name = min(have, key=lambda k: (have[k], k))
        have[name] += 1
        add[name] += 1
    return add
