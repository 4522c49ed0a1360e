"""Metrics, dataset and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import integer_label, label_bucket
from ..operators import datasets as D
from ..operators import metrics as M
from ..operators import quality_rules as QR
from ..operators import retrieval as R
from ..operators import textviews as V
from ..sources.scratch import scratch
from .scoring_queries import _t


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as (id, pred, true) with scores of 0 to 100."""
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 37 + F.col("o_custkey")) % 101).cast("double").alias("pred"), (F.col("o_custkey") % 101).cast("double").alias("true"))


def similarity_scores(spark, sf_dir):
    """Scores of neighbouring vectors on every scale; similarities are cut to four digits, so no sum's order matters."""
    e = _t(spark, sf_dir, "embeddings")
    pairs = e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    s = pairs.select("a.vec_id", F.round(R.dot(F.col("a.embedding"), F.col("b.embedding")), 4).alias("s"), F.round(R.clipped_dot(F.col("a.embedding"), F.col("b.embedding")), 4).alias("clipped"))
    return s.select("vec_id", "clipped", R.score_shifted(F.col("s")).alias("shifted"), R.score_clipped(F.col("s")).alias("points"), F.round(R.score_percent(F.col("s")), 2).alias("percent"), F.round(R.sigmoid(F.col("s")), 6).alias("sigmoid"))


def boundary_loss(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", F.round(M.boundary_loss(F.col("pred") / 100, F.col("true") / 100), 6).alias("loss"))


def _pairs(spark, sf_dir):
    """Orders as pairs of a customer and a nation; a third of the customers and some nations are missing."""
    p = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("resume_id"), (F.col("o_custkey") % 30).alias("job_description_id"), F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("train").alias("split"), F.when(F.col("o_orderkey") % 5 != 0, "given").alias("label"), (F.col("o_orderkey") % 101).cast("int").alias("overall_score"))
    r = _t(spark, sf_dir, "customer").where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("id"), "c_name")
    return p, r, _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name")


def joined_pairs(spark, sf_dir):
    return D.join_pairs(*_pairs(spark, sf_dir)).select("id", "label", "overall_score", F.col("resume.c_name").alias("resume_name"), F.col("job.n_name").alias("job_name"))


def strict_pairs(spark, sf_dir):
    p, r, j = _pairs(spark, sf_dir)
    fine = p.where("resume_id % 3 != 0 and job_description_id < 25")
    return D.strict_pairs(fine, r, j).groupBy("split", "label").agg(F.count("*").alias("n"), F.max("resume.c_name").alias("last_name"))


def numeric_ids(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "cv_").otherwise("jd_"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.when(F.col("c_custkey") % 10 == 0, "x").otherwise("")).alias("id"))
    return c.agg(V.max_numeric_id(F.col("id"), "cv_").alias("cv"), V.max_numeric_id(F.col("id"), "jd_").alias("jd"))


def id_reconciliation(spark, sf_dir):
    said = _t(spark, sf_dir, "orders").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, 1_000_000).otherwise(0)).alias("id"))
    return QR.reconcile_ids(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), said)


def accepted_rows(spark, sf_dir):
    """First orders of every third customer and their state."""
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer").where("c_custkey % 3 != 0")
    return QR.accept(o, c.select(F.col("c_custkey").alias("o_custkey")), F.col("o_totalprice") > 50000, "o_custkey", "o_orderkey").select("o_orderkey", "state")


def rounds_mixed(spark, sf_dir):
    p = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("resume_id"), (F.col("o_custkey") % 25).cast("int").alias("job_description_id"))
    r = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).alias("round"))
    return QR.round_mismatch(p, r, _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") % 3).alias("round")))


_P = "WITH s AS (SELECT o_orderkey AS id, CAST((o_orderkey * 37 + o_custkey) % 101 AS DOUBLE) AS pred, CAST(o_custkey % 101 AS DOUBLE) AS tru FROM orders) "
_B = "CASE WHEN {0} >= 90 THEN 'excellent_match' WHEN {0} >= 75 THEN 'strong_match' WHEN {0} >= 60 THEN 'moderate_match' WHEN {0} >= 40 THEN 'weak_match' ELSE 'poor_match' END"
_I = "CASE WHEN {0} BETWEEN 90 AND 100 THEN 'excellent_match' WHEN {0} BETWEEN 75 AND 89 THEN 'strong_match' WHEN {0} BETWEEN 60 AND 74 THEN 'moderate_match' WHEN {0} BETWEEN 40 AND 59 THEN 'weak_match' WHEN {0} BETWEEN 0 AND 39 THEN 'poor_match' ELSE 'unknown' END"


def _bins(c: str, edges: list[int]) -> str:
    return "CASE " + " ".join(f"WHEN {c} >= {a} AND {c} < {b} THEN '{a}-{b}'" for a, b in zip(edges, edges[1:], strict=False)) + " END"


def eval_metrics(spark, sf_dir):
    return M.evaluate(_scored(spark, sf_dir))


def tolerance_metrics(spark, sf_dir):
    return M.tolerance(_scored(spark, sf_dir).withColumn("label", label_bucket(F.col("true"))), "label")


def confusion_matrix(spark, sf_dir):
    return M.confusion(_scored(spark, sf_dir))


def error_histogram(spark, sf_dir):
    return M.error_histogram(_scored(spark, sf_dir))


def signed_error_bins(spark, sf_dir):
    return M.signed_error_bins(_scored(spark, sf_dir))


def worst_k(spark, sf_dir):
    return M.worst(_scored(spark, sf_dir), "id").select("id", "abs_error")


def ensemble_mean(spark, sf_dir):
    e = _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("pred"))
    return M.ensemble(e, "user_id").select("user_id", F.round("pred", 6).alias("pred"), "models")


def class_report(spark, sf_dir):
    d = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents"), "doc_id")
    return M.class_report(d.select(F.col("quality").cast("string").alias("true"), F.when(F.col("n_chars") > 1000, "1").otherwise("0").alias("pred")))


def label_buckets(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy(label_bucket(F.col("true") + 0.5).alias("bucket"), integer_label(F.col("true")).alias("range_label")).agg(F.count("*").alias("n"))


def boundary_zones(spark, sf_dir):
    return D.zone_batches(_scored(spark, sf_dir), "id", "true", 25).groupBy("zone", "batch").agg(F.count("*").alias("n"), F.min("true").alias("lo"), F.max("true").alias("hi"))


def token_percentiles(spark, sf_dir):
    return M.index_percentiles(_t(spark, sf_dir, "documents").where("n_chars is not null"), "n_chars").select("percent", "value")


def length_histogram(spark, sf_dir):
    return M.histogram(_t(spark, sf_dir, "documents"), "n_chars")


def label_shares(spark, sf_dir):
    return M.share(_t(spark, sf_dir, "documents"), "lang")


def model_deltas(spark, sf_dir):
    m = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("metric"))
    return M.deltas(m, "event_type", "metric").select("event_type", "metric", "vs_first", "vs_best")


def isotonic(spark, sf_dir):
    s = _scored(spark, sf_dir)
    model = M.isotonic(s.groupBy("pred").agg(F.avg("true").alias("true")), "pred", "true")
    return M.calibrate(s, model, "pred").select("id", F.round("calibrated", 6).alias("calibrated"))


def hash_split(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", D.hash_split(F.col("doc_id")).alias("split"))


def entity_leakage(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("split", D.hash_split(F.col("o_orderkey")))
    return D.entity_leakage(o, "o_custkey")


def components(spark, sf_dir):
    e = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    e = e.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("a"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("b"))
    return D.components(e, "a", "b", scratch(spark, "components")).groupBy("component").agg(F.count("*").alias("nodes"))


def dataset_violations(spark, sf_dir):
    d, lab = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    d = d.withColumn("text", F.coalesce("text", F.lit("")))
    flags = D.privacy_flags(F.col("text"))
    bad = D.violations(d, "doc_id", {"empty text": F.trim("text") == "", "unknown language": ~F.col("lang").isin("en", "de", "fr"), "email": flags["email"], "profile": flags["profile"], "too short": F.col("n_chars") < 50})
    wrong = D.violations(lab, "doc_id", {"toxic": F.col("toxic") != 0})
    lost = D.missing_reference(d, "doc_id", "doc_id", lab.where("quality = 1"), "doc_id")
    return bad.unionByName(wrong).unionByName(lost).unionByName(D.duplicate_ids(d, "doc_id"))


def relabel_upsert(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), F.col("n_chars").cast("int").alias("overall_score"), F.lit(None).cast("map<string,int>").alias("criterion_scores"), F.col("source").alias("label_notes"))
    r = _t(spark, sf_dir, "labels").select(F.concat(F.lit("f"), F.col("doc_id") % 3).alias("file"), F.lit(1).alias("pair_count"), F.col("doc_id").alias("pair_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"), F.col("toxic").cast("int").alias("overall_score"), F.lit(None).cast("map<string,int>").alias("criterion_scores"), F.lit("relabelled").alias("label_notes"))
    return D.relabel(d, r).select("id", "label", "overall_score", "label_notes", "changed")


def rerank_ids(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return D.reassign_ids(c, [F.col("c_nationkey"), F.desc("c_acctbal"), F.col("c_custkey")], "cand_", scratch(spark, "ids"), 6).select("c_custkey", "new_id")


def seniority_mix(spark, sf_dir):
    """5 new jobs dealt over six levels, whose present counts are those of the suppliers by number modulo 6."""
    n = _t(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 6).alias("level")).agg(F.count("*").alias("n")).orderBy("level").limit(6).collect()
    mix = D.seniority_mix([r.n for r in n], 5)
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(mix)], "level int, added int")


def _jobs(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return e, e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))


def cosine_topk(spark, sf_dir):
    e, j = _jobs(spark, sf_dir)
    top = R.top_k(e, j, 10, "vec_id", "label")
    return top.select("label", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def recall_at_k(spark, sf_dir):
    e, j = _jobs(spark, sf_dir)
    pairs = e.select("vec_id", "label", (F.col("vec_id") % 101).alias("score"))
    return R.recall_at_k(pairs, R.top_k(e, j, 50, "vec_id", "label"), (60, 75), "vec_id", "label")


def two_stage(spark, sf_dir):
    e, j = _jobs(spark, sf_dir)
    pairs = e.select("vec_id", "label", (F.col("vec_id") % 100).cast("double").alias("bi_score"), F.when(F.col("vec_id") % 9 != 0, (F.col("vec_id") % 77).cast("double")).alias("cross_score"))
    return R.two_stage(pairs, R.top_k(e, j, 20, "vec_id", "label"), "vec_id", "label").select("vec_id", "label", "score", "reranked")


_COS = "list_cosine_similarity(CAST(j.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"
_TOP = f"""WITH j AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label),
t AS (SELECT j.label, e.vec_id, {_COS} AS sim, row_number() OVER (PARTITION BY j.label ORDER BY {_COS} DESC, e.vec_id) AS rk FROM j, embeddings e) """
_HASH = "(CASE WHEN CAST('0x' || substr(sha256(CAST({0} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0 < 0.70 THEN 'train' WHEN CAST('0x' || substr(sha256(CAST({0} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0 < 0.85 THEN 'validation' ELSE 'test' END)"

SQL = {
    "id_reconciliation": "WITH a AS (SELECT DISTINCT o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 1000000 ELSE 0 END AS id FROM orders) SELECT coalesce(c_custkey, id) AS key, CASE WHEN id IS NULL THEN 'missing' ELSE 'unexpected' END AS state FROM customer FULL JOIN a ON id = c_custkey WHERE id IS NULL OR c_custkey IS NULL",
    "accepted_rows": "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unexpected' WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 THEN 'duplicate' WHEN o_totalprice > 50000 THEN 'accepted' ELSE 'rejected' END AS state FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0",
    "rounds_mixed": "SELECT o_orderkey AS key, 'error' AS level, 'pair across rounds' AS rule FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = o_custkey % 25 WHERE c_nationkey % 3 <> n_regionkey % 3",
    "similarity_scores": """WITH p AS (SELECT a.vec_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), s AS (SELECT vec_id, round(d, 4) AS s, round(least(greatest(d, 0), 1), 4) AS clipped FROM p)
SELECT vec_id, clipped, CAST(round_even((s + CAST(1 AS DOUBLE)) / 2 * 100, 0) AS INT) AS shifted, CAST(round_even(least(greatest(s, 0), 1) * 100, 0) AS INT) AS points, round(least(greatest(s, 0), 1) * 100, 2) AS percent, round(1 / (1 + exp(-s)), 6) AS sigmoid FROM s""",
    "boundary_loss": _P
    + """SELECT id, round(power(pred / 100 - tru / 100, 2) + 0.3 * list_sum([CASE WHEN tru / 100 >= b THEN -ln(least(greatest(1 / (1 + exp(-20 * (pred / 100 - b))), CAST(1e-7 AS DOUBLE)), 1 - CAST(1e-7 AS DOUBLE))) ELSE -ln(1 - least(greatest(1 / (1 + exp(-20 * (pred / 100 - b))), CAST(1e-7 AS DOUBLE)), 1 - CAST(1e-7 AS DOUBLE))) END FOR b IN [CAST(0.40 AS DOUBLE), 0.60, 0.75, 0.90]]) / 4, 6) AS loss FROM s""",
    "joined_pairs": f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN 'given' ELSE {_B.format("(o_orderkey % 101)")} END AS label, CAST(o_orderkey % 101 AS INT) AS overall_score, c_name AS resume_name, n_name AS job_name
FROM orders JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0 JOIN nation ON n_nationkey = o_custkey % 30 WHERE o_orderkey % 4 = 0""",
    "strict_pairs": f"""SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN o_orderkey % 5 <> 0 THEN 'given' ELSE {_B.format("(o_orderkey % 101)")} END AS label, count(*) AS n, max(c_name) AS last_name
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 3 <> 0 AND o_custkey % 30 < 25 GROUP BY 1, 2""",
    "numeric_ids": "SELECT max(CASE WHEN c_custkey % 2 = 0 AND c_custkey % 10 <> 0 THEN c_custkey END) AS cv, max(CASE WHEN c_custkey % 2 = 1 THEN c_custkey END) AS jd FROM customer",
    # Pool adjacent violators as its closed form: the greatest over starts of the least mean over ends.
    "isotonic": _P
    + """, t AS (SELECT pred, avg(tru) AS y, row_number() OVER (ORDER BY pred) AS i FROM s GROUP BY pred), c AS (SELECT *, sum(y) OVER (ORDER BY i) AS upto FROM t),
m AS (SELECT a.i AS lo, b.i AS hi, (b.upto - a.upto + a.y) / (b.i - a.i + 1) AS mean FROM c a JOIN c b ON a.i <= b.i),
g AS (SELECT t.i, m.lo, min(m.mean) AS least FROM t JOIN m ON m.lo <= t.i AND t.i <= m.hi GROUP BY 1, 2), f AS (SELECT t.pred, max(least) AS fitted FROM g JOIN t USING (i) GROUP BY 1)
SELECT id, round(fitted, 6) AS calibrated FROM s JOIN f USING (pred)""",
    "seniority_mix": """WITH n AS (SELECT list(n ORDER BY level) AS n FROM (SELECT s_suppkey % 6 AS level, count(*) AS n FROM supplier GROUP BY 1)), r AS (SELECT range AS x FROM range(6)),
p AS (SELECT [a.x, b.x, c.x, d.x, e.x, f.x] AS p FROM r a, r b, r c, r d, r e, r f WHERE a.x + b.x + c.x + d.x + e.x + f.x = 5),
best AS (SELECT p FROM p, n ORDER BY list_reverse_sort([n.n[i] + p[i] FOR i IN range(1, 7)]), p LIMIT 1)
SELECT CAST(i - 1 AS INT) AS level, CAST(p[i] AS INT) AS added FROM best, range(1, 7) x(i)""",
    "eval_metrics": _P + f"SELECT count(*) AS n, round(avg(abs(pred - tru)), 4) AS mae, round(sqrt(avg((pred - tru) * (pred - tru))), 4) AS rmse, round(avg(CASE WHEN {_B.format('pred')} = {_B.format('tru')} THEN 1.0 ELSE 0.0 END), 4) AS label_accuracy, round(avg(pred), 4) AS mean_pred, round(avg(tru), 4) AS mean_true FROM s",
    "tolerance_metrics": _P + f"SELECT {_B.format('tru')} AS label, count(*) AS n, round(avg(CASE WHEN abs(pred - tru) <= 10 THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round(avg(pred - tru), 4) AS bias, round(stddev_pop(pred - tru), 4) AS error_std FROM s GROUP BY 1",
    "confusion_matrix": _P + f", c AS (SELECT {_I.format('tru')} AS true_label, {_I.format('round(pred)')} AS pred_label, count(*) AS n FROM s GROUP BY 1, 2) SELECT true_label, pred_label, n, round(100 * n / sum(n) OVER (PARTITION BY true_label), 1) AS row_percent FROM c",
    "error_histogram": _P + f"SELECT {_bins('abs(pred - tru)', M.ERROR_BINS)} AS bin, count(*) AS n FROM s GROUP BY 1",
    "signed_error_bins": _P + f"SELECT {_bins('tru', M.SCORE_BINS)} AS bin, count(*) AS n, round(avg(pred - tru), 4) AS mean_error FROM s GROUP BY 1",
    "worst_k": _P + "SELECT id, abs(pred - tru) AS abs_error FROM s ORDER BY 2 DESC, 1 LIMIT 20",
    "ensemble_mean": "WITH e AS (SELECT user_id, event_type, avg(value) AS p FROM events GROUP BY 1, 2) SELECT user_id, round(avg(p), 6) AS pred, count(*) AS models FROM e GROUP BY 1",
    "class_report": """WITH d AS (SELECT CAST(quality AS VARCHAR) t, CASE WHEN n_chars > 1000 THEN '1' ELSE '0' END p FROM labels JOIN documents USING (doc_id)),
s AS (SELECT l.label, count(*) FILTER (t = l.label) AS support, count(*) FILTER (p = l.label) AS predicted, count(*) FILTER (t = l.label AND p = l.label) AS hit FROM d, (SELECT t AS label FROM d UNION SELECT p FROM d) l GROUP BY 1),
r AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE hit / predicted END AS pr, CASE WHEN support = 0 THEN 0.0 ELSE hit / support END AS rc FROM s)
SELECT label, round(pr, 4) AS "precision", round(rc, 4) AS recall, round(CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END, 4) AS f1, support FROM r""",
    "label_buckets": _P + f"SELECT {_B.format('(tru + 0.5)')} AS bucket, {_I.format('tru')} AS range_label, count(*) AS n FROM s GROUP BY 1, 2",
    "boundary_zones": _P + ", z AS (SELECT *, CASE WHEN tru BETWEEN 35 AND 45 THEN '35-45' WHEN tru BETWEEN 55 AND 65 THEN '55-65' WHEN tru BETWEEN 70 AND 80 THEN '70-80' WHEN tru BETWEEN 85 AND 95 THEN '85-95' END AS zone FROM s), b AS (SELECT *, CAST((row_number() OVER (PARTITION BY zone ORDER BY tru, id) - 1) // 25 AS INT) AS batch FROM z WHERE zone IS NOT NULL) SELECT zone, batch, count(*) AS n, min(tru) AS lo, max(tru) AS hi FROM b GROUP BY 1, 2",
    "token_percentiles": "WITH d AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL) SELECT p.percent, d.n_chars AS value FROM d, (VALUES (50), (75), (90), (95), (99)) p(percent) WHERE d.i = least(CAST(floor(n * p.percent / 100.0) AS BIGINT), n - 1)",
    "length_histogram": "WITH e AS (SELECT min(n_chars) lo, max(n_chars) hi FROM documents) SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 10.0)), 9) AS INT) AS bin, count(*) AS n FROM documents, e GROUP BY 1",
    "label_shares": "SELECT lang, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM documents GROUP BY 1",
    "model_deltas": "WITH m AS (SELECT event_type, round(avg(value), 4) AS metric FROM events GROUP BY 1) SELECT event_type, metric, round(metric - first_value(metric) OVER (ORDER BY event_type), 4) AS vs_first, round(metric - max(metric) OVER (), 4) AS vs_best FROM m",
    "hash_split": f"SELECT doc_id, {_HASH.format('doc_id')} AS split FROM documents",
    "entity_leakage": f"WITH o AS (SELECT o_custkey, {_HASH.format('o_orderkey')} AS split FROM orders) SELECT o_custkey AS entity, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM o GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "components": "WITH c AS (SELECT n_regionkey, min('c' || c_custkey) AS component, count(*) + 1 AS nodes FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT component, nodes FROM c",
    "dataset_violations": r"""WITH d AS (SELECT *, coalesce(text, '') AS t FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS "key", 'empty text' AS rule FROM d WHERE trim(t) = ''
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'unknown language' FROM d WHERE lang IS NULL OR lang NOT IN ('en', 'de', 'fr')
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'email' FROM d WHERE regexp_matches(t, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'profile' FROM d WHERE regexp_matches(t, '(?i)(?:linkedin\.com/in/|github\.com/)[A-Za-z0-9_-]+')
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'too short' FROM d WHERE n_chars IS NULL OR n_chars < 50
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'toxic' FROM labels WHERE toxic IS NULL OR toxic <> 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'unknown doc_id' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'duplicate id' FROM d GROUP BY doc_id HAVING count(*) > 1""",
    "relabel_upsert": "SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN lang WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label, CAST(coalesce(toxic, n_chars) AS INT) AS overall_score, CASE WHEN l.doc_id IS NULL THEN source ELSE 'relabelled' END AS label_notes, l.doc_id IS NOT NULL AS changed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "rerank_ids": "SELECT c_custkey, 'cand_' || lpad(CAST(row_number() OVER (ORDER BY c_nationkey, c_acctbal DESC, c_custkey) AS VARCHAR), 6, '0') AS new_id FROM customer",
    "cosine_topk": _TOP + "SELECT label, vec_id, round(sim, 6) AS similarity, CAST(rk AS INT) AS rank FROM t WHERE rk <= 10",
    "recall_at_k": _TOP + ", h AS (SELECT e.vec_id, e.vec_id % 101 AS score, CASE WHEN t.rk <= 50 THEN 1 ELSE 0 END AS hit FROM embeddings e JOIN t ON t.label = e.label AND t.vec_id = e.vec_id) SELECT CAST(m AS INT) AS min_score, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS total, round(avg(hit), 4) AS recall FROM h, (VALUES (0), (60), (75)) b(m) WHERE score >= m GROUP BY 1",
    "two_stage": _TOP + "SELECT e.vec_id, e.label, CASE WHEN t.rk <= 20 AND e.vec_id % 9 <> 0 THEN CAST(e.vec_id % 77 AS DOUBLE) ELSE CAST(e.vec_id % 100 AS DOUBLE) END AS score, t.rk <= 20 AND e.vec_id % 9 <> 0 AS reranked FROM embeddings e JOIN t ON t.label = e.label AND t.vec_id = e.vec_id",
}
QUERIES = {f.__name__: f for f in (eval_metrics, tolerance_metrics, confusion_matrix, error_histogram, signed_error_bins, worst_k, ensemble_mean, class_report, label_buckets, boundary_zones, token_percentiles, length_histogram, label_shares, model_deltas, isotonic, hash_split, entity_leakage, components, dataset_violations, relabel_upsert, rerank_ids, seniority_mix, cosine_topk, recall_at_k, two_stage, similarity_scores, boundary_loss, joined_pairs, strict_pairs, numeric_ids, id_reconciliation, accepted_rows, rounds_mixed)}
