"""Dataset operators: joins, leakage-safe splits, merges, validation."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import boundary_zone, integer_label, label_bucket

SPLITS = ("train", "validation", "test")
#: Criteria weights of the relabelled rubric.
RUBRIC = {"SKILLS_MATCH": 0.35, "EXPERIENCE_RELEVANCE": 0.30, "PROJECT_RELEVANCE": 0.15, "EDUCATION_CERTIFICATION": 0.10, "KEYWORD_DOMAIN_ALIGNMENT": 0.10}
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"\+?[0-9][0-9\s().-]{6,}[0-9]"
PROFILE = r"(?i)(?:linkedin\.com/in/|github\.com/)[A-Za-z0-9_-]+"


def join_pairs(pairs: DataFrame, resumes: DataFrame, jobs: DataFrame, split: str | None = "test") -> DataFrame:
    """Pairs of a split with their resume and job; pairs that lack either are dropped, a missing label comes from the score."""
    p = pairs.where(F.col("split") == split) if split else pairs
    r = resumes.select(F.col("id").alias("resume_id"), F.struct(*resumes.columns).alias("resume"))
    j = jobs.select(F.col("id").alias("job_description_id"), F.struct(*jobs.columns).alias("job"))
    return p.join(r, "resume_id").join(j, "job_description_id").withColumn("label", F.coalesce("label", label_bucket(F.col("overall_score"))))


def strict_pairs(pairs: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """As join_pairs over all splits, but a pair without resume, job or a known split fails the job."""
    r = resumes.select(F.col("id").alias("resume_id"), F.struct(*resumes.columns).alias("resume"))
    j = jobs.select(F.col("id").alias("job_description_id"), F.struct(*jobs.columns).alias("job"))
    joined = pairs.join(r, "resume_id", "left").join(j, "job_description_id", "left")
    bad = F.col("resume").isNull() | F.col("job").isNull() | ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
    # The check is a filter, which no projection above can drop.
    fine = F.when(bad, F.raise_error(F.concat(F.lit("bad pair "), F.coalesce(F.col("id").cast("string"), F.lit("without id")))).cast("boolean")).otherwise(True)
    return joined.where(fine).withColumn("label", F.coalesce("label", label_bucket(F.col("overall_score"))))


def hash_split(key: Column, train: float = 0.70, validation: float = 0.85) -> Column:
    """Split by the first 32 bits of the key's SHA-256."""
    x = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return F.when(x < train, SPLITS[0]).when(x < validation, SPLITS[1]).otherwise(SPLITS[2])


def components(edges: DataFrame, a: str, b: str, scratch: str) -> DataFrame:
    """(node, component) of a bipartite or plain edge table; component is the smallest node.

    Large-star and small-star steps; a round needs a minimum per node and a join, and is written under `scratch`, a
    folder that all executors share.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame, n: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{scratch}/{n}")
        return spark.read.schema(df.schema).parquet(f"{scratch}/{n}")

    kind = edges.schema[a].dataType
    nodes = edges.select(F.explode(F.array(F.col(a).cast(kind), F.col(b).cast(kind))).alias("node")).distinct()
    e = kept(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), 0)
    before, n = None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        n += 1
        e = kept(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), n)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        before = now


def assign_components(sizes: list[tuple[str, int]], ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> dict[str, str]:
    """Split of each component, on the driver: shuffled, largest first, to the split with most room (then fewest rows, then order).

    The list holds one entry per component.
    """
    if abs(sum(ratios) - 1) > 1e-6 or min(ratios) < 0:
        raise ValueError("ratios must be non-negative and sum to 1")
    total = sum(n for _, n in sizes)
    target = [round(total * r) for r in ratios[:2]]
    target.append(total - sum(target))
    order = list(sizes)
    random.Random(seed).shuffle(order)
    order.sort(key=lambda x: -x[1])
    held, out = [0, 0, 0], {}
    for name, n in order:
        i = max(range(3), key=lambda k: (target[k] - held[k], -held[k], -k))
        held[i] += n
        out[name] = SPLITS[i]
    return out


def entity_leakage(pairs: DataFrame, entity: str, split: str = "split") -> DataFrame:
    """(entity, splits): entities in more than one split."""
    return pairs.groupBy(F.col(entity).alias("entity")).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1).select("entity", F.array_join("s", ",").alias("splits"))


def relabel(pairs: DataFrame, relabels: DataFrame, least_parsed: float = 0.7) -> DataFrame:
    """Pairs with the last relabel of each by file; files of which less than `least_parsed` was parsed are left out.

    relabels: (file, pair_count, pair_id, label, overall_score, criterion_scores, label_notes). Adds changed.
    """
    good = relabels.groupBy("file").agg((F.count("*") / F.max("pair_count")).alias("parsed")).where(F.col("parsed") >= least_parsed).select("file")
    cols = ["label", "overall_score", "criterion_scores", "label_notes"]
    last = relabels.join(good, "file").groupBy("pair_id").agg(F.max_by(F.struct(*cols), "file").alias("new"))
    p = pairs.join(last, pairs["id"] == last["pair_id"], "left").drop("pair_id")
    changed = F.col("new").isNotNull() & ~(F.col("new.label").eqNullSafe(F.col("label")) & F.col("new.overall_score").eqNullSafe(F.col("overall_score")))
    return p.withColumn("changed", changed).withColumns({c: F.coalesce(F.col(f"new.{c}"), F.col(c)) for c in cols}).drop("new")


def repair_relabel(label: Column, score: Column, criteria: Column, aliases: dict[str, str] | None = None) -> Column:
    """struct(label, criterion_scores): typo keys renamed, missing criteria 0, a label out of the score's range corrected."""
    names = F.create_map(*[F.lit(x) for kv in (aliases or {"SKILL_MATCH": "SKILLS_MATCH"}).items() for x in kv])
    fixed = F.map_from_entries(F.transform(F.map_entries(criteria), lambda e: F.struct(F.coalesce(F.element_at(names, e["key"]), e["key"]).alias("key"), e["value"].alias("value"))))
    absent = F.filter(F.array(*[F.lit(k) for k in RUBRIC]), lambda k: ~F.array_contains(F.map_keys(fixed), k))
    full = F.map_concat(fixed, F.map_from_arrays(absent, F.transform(absent, lambda k: F.lit(0))))
    return F.struct(F.when(label.isin("excellent_match", "strong_match", "moderate_match", "weak_match", "poor_match") & score.isNotNull(), integer_label(score)).otherwise(label).alias("label"), full.alias("criterion_scores"))


def weighted_score(criteria: Column) -> Column:
    """Whole points of the weighted criteria; absent ones count 0, halves go to even."""
    total = sum((F.coalesce(F.element_at(criteria, k), F.lit(0)) * w for k, w in RUBRIC.items()), F.lit(0.0))
    return F.rint(total).cast("int")


def zone_batches(df: DataFrame, key: str, score: str, size: int) -> DataFrame:
    """Rows near a bucket's bound with their zone and batch, by zone in order of score and key."""
    z = df.withColumn("zone", boundary_zone(F.col(score))).where("zone is not null")
    w = Window.partitionBy("zone").orderBy(score, key)
    return z.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def reassign_ids(df: DataFrame, order: list[Column], prefix: str, path: str, width: int = 4, start: int = 1) -> DataFrame:
    """Rows with new_id, numbered by a total order: ranks are counted per sorted partition and offset, no task holds all rows.

    The sorted partitions are written to path (in a folder that all executors share) and counted there: range bounds are
    sampled anew each time a plan runs, so counts of a second run need not fit the rows of the first.
    """
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    d.write.mode("overwrite").parquet(path)
    d = df.sparkSession.read.parquet(path).withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    before, total = {}, 0
    # One number a partition.
    for r in d.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():
        before[r["_p"]], total = total, total + r["n"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_p")) if before else F.lit(0)
    number = offset + F.col("_i") + start
    return d.withColumn("new_id", F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))).drop("_p", "_m", "_i")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): a row for every rule that a row breaks; a rule that is null counts as broken."""
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("duplicate id").alias("rule"))


def missing_reference(df: DataFrame, key: str, reference: str, to: DataFrame, to_key: str) -> DataFrame:
    """Rows whose reference isn't in another table."""
    return df.join(to.select(F.col(to_key).alias(reference)).distinct(), reference, "left_anti").select(F.col(key).cast("string").alias("key"), F.lit(f"unknown {reference}").alias("rule"))


def privacy_flags(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    return {"email": t.rlike(EMAIL), "phone": t.rlike(PHONE), "profile": t.rlike(PROFILE)}


def seniority_mix(current: list[int], total: int) -> tuple[int, ...]:
    """The composition of `total` over len(current) levels whose sorted resulting counts are least unequal, smallest first."""

    def parts(n: int, k: int):
        if k == 1:
            yield (n,)
            return
        for i in range(n + 1):
            for rest in parts(n - i, k - 1):
                yield (i, *rest)

    return min(parts(total, len(current)), key=lambda p: (sorted((c + x for c, x in zip(current, p, strict=True)), reverse=True), p))
