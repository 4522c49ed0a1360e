"""Secret scan with an incremental blob ledger, in DataFrame functions only.

Every text is content-addressed by SHA-256.  The ledger is a Parquet table with one row per blob
and rule version that has been scanned, and the spans found.  A run scans only the blobs that the
ledger doesn't have for the rule version, one text for all their copies, appends them, and joins the findings
back to every path (document version) that holds the blob.

Spans count code points, end exclusive, leftmost and non-overlapping within a kind.  A null text is
empty and has no spans; repeated rows and copies each get the blob's findings; ties in start go in the order of
``RULES``; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import materialise, scratch_path

_WORD = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token"))
_KEY = "".join(f"[{c.upper()}{c}]" for c in "api") + "_?" + "".join(f"[{c.upper()}{c}]" for c in "key")
_BREAK = r"(?:\s|\\[nr])"
#: A key up to its END line, or where that is missing to the end of its base64 lines; possessive, so that no text is read twice.
_PRIVATE = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]*+(?:-{1,4}+(?!-)[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    rf"|(?:{_BREAK}*+(?:Proc-Type|DEK-Info|Comment|Version):[^\r\n\\]*+)*+(?:{_BREAK}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+"
    r"(?:(?:\r?\n|\\n)[A-Za-z0-9+/]{1,15}+={0,2}+(?![^\r\n\\\x22']))?)"
)
#: kind, pattern, group whose length counts, least length.  The first three are the base kinds.
RULES = [
    ("assign", rf"""({_WORD}|{_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    ("platform", r"(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})", 0, 1),
]
#: What redact() hides: a private key whole, where RULES (and the SQL) name its first line.
HIDDEN = [(kind, _PRIVATE if kind == "private_key" else pattern, group, least) for kind, pattern, group, least in RULES]
BASE = ("assign", "access", "hex")
FINDINGS = "array<struct<start:int,kind_order:int,kind:string,end:int>>"
LEDGER = f"blob binary, rule_version string, findings {FINDINGS}"


def rule_version(rules: list[tuple]) -> str:
    """A name of these rules; other rules have another, so findings of old ones are never taken for theirs."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _matches(rules: list[tuple], order: int, gaps: Column, whole: Column, counted: Column) -> Column:
    """A struct for every match of a rule: number, length of the text before it since the last one, length, whether it counts."""
    kind, _, _, least = rules[order]
    return F.transform(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("g"), whole.alias("m"), counted.alias("c")),
        lambda x, i: F.struct(F.lit(order).alias("kind_order"), F.lit(kind).alias("kind"), i.alias("number"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), (F.length(x["c"]) >= least).alias("counts")),
    )


def _pieces(text: Column, rules: list[tuple]) -> Column:
    """The matches of all rules."""
    found = []
    for order, (_, pattern, group, _) in enumerate(rules):
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        found.append(F.when(text.rlike(pattern), _matches(rules, order, F.split(text, pattern, -1), whole, counted)))
    empty = F.array().cast("array<struct<kind_order:int,kind:string,number:int,gap:int,size:int,counts:boolean>>")
    return F.flatten(F.array(*[F.coalesce(r, empty) for r in found]))


def scan(blobs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """(blob, findings) of (blob, text); only blobs with spans."""
    from pyspark.sql import Window

    rows = blobs.select("blob", F.explode(_pieces(F.col("text"), rules)).alias("m")).select("blob", "m.*").repartition("blob").dropDuplicates(["blob", "kind_order", "number"])
    w = Window.partitionBy("blob", "kind_order").orderBy("number")
    end = F.sum(F.col("gap") + F.col("size")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    spans = rows.withColumn("end", end).where("counts").select("blob", F.struct((F.col("end") - F.col("size")).alias("start"), "kind_order", "kind", "end").alias("span"))
    return spans.groupBy("blob").agg(F.sort_array(F.collect_list("span")).alias("findings"))


def address(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, blob) of every row."""
    return docs.select(docs[key].alias("doc_id"), F.unhex(F.sha2(F.coalesce(docs[text], F.lit("")), 256)).alias("blob"))


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def update(docs: DataFrame, ledger: str, key: str = "doc_id", text: str = "text", rules: list[tuple] = RULES) -> DataFrame:
    """Scan what the ledger lacks, append it, and return (blob, findings) of the blobs that have any by these rules.

    Another writer, or a write done twice, may leave a blob's row twice; it is returned once.
    """
    spark, version = docs.sparkSession, rule_version(rules)
    known = _ledger(spark, ledger).where(F.col("rule_version") == version).select("blob")
    texts = docs.select(docs[key].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    # The smallest key stands for all copies of a blob, so no group of copies ever meets in one task.
    unseen = texts.groupBy("blob").agg(F.min("doc_id").alias("one")).join(known, "blob", "left_anti").withColumnRenamed("blob", "its")
    todo = texts.join(unseen.hint("shuffle_hash"), (F.col("blob") == F.col("its")) & F.col("doc_id").eqNullSafe(F.col("one")))
    found = scan(todo.select("blob", "text"), rules)
    new, _ = materialise(found, "findings")
    blobs = unseen.select(F.col("its").alias("blob"))
    blobs.join(new, "blob", "left").select("blob", F.lit(version).alias("rule_version"), F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings")).write.mode("append").parquet(ledger)
    now = spark.read.schema(LEDGER).parquet(ledger).where((F.col("rule_version") == version) & (F.size("findings") > 0))
    return now.dropDuplicates(["blob"]).select("blob", "findings")


def find(docs: DataFrame, ledger: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, findings) of every row, through the ledger (a new one by default)."""
    rows = update(docs, ledger or scratch_path(docs.sparkSession, "ledger"), key=key, text=text)
    return address(docs, key, text).join(rows, "blob", "left").select("doc_id", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def listed(findings: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, ledger: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mark and n_chars, if there, set anew; other rows are unchanged.

    Overlapping spans become one mark.
    """
    spark = docs.sparkSession
    rows = update(docs, ledger or scratch_path(spark, "ledger"), rules=HIDDEN)
    # The row goes as one struct, so none of its names can clash.
    own = {c: F.col(f"row.`{c}`") for c in docs.columns}
    d = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).withColumn("blob", F.unhex(F.sha2(F.coalesce(own["text"], F.lit("")), 256))).join(rows, "blob", "left")
    done = F.aggregate(
        "findings",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, x: F.struct(
            F.when(x["start"] >= a["at"], F.concat(a["out"], F.substring(own["text"], a["at"] + 1, x["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], x["end"]).alias("at"),
        ),
        lambda a: F.concat(a["out"], F.substring(own["text"], a["at"] + 1, F.length(own["text"]))),
    )
    clean = F.col("findings").isNull()
    new = own | {"text": F.when(clean, own["text"]).otherwise(F.col("hidden"))}
    if "n_chars" in own:
        new["n_chars"] = F.when(clean, own["n_chars"]).otherwise(F.length("hidden").cast(docs.schema["n_chars"].dataType))
    return d.withColumn("hidden", F.when(~clean, done)).select(*[c.alias(name) for name, c in new.items()])
