"""Text, date, section, sequence and dictionary queries over the text tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as DT
from ..functions import extract as X
from ..functions import text as T
from ..functions.catalog import entries, frame
from ..functions.extract import SHORT_ALIASES
from ..operators import sections as S
from ..operators import sequence as Q
from ..operators import skills as K
from .parse_jobs import parse_jobs
from .parse_resumes import parse_resumes
from .scoring_queries import _t

ROLES = {"people": ["the ", "and "], "places": ["ent", "ion"], "things": ["sch", "que"]}
LABELS = ["assistant", "system", "user"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def fold_ascii(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.fold_ascii(F.col("text")), 256).alias("folded"), F.length(T.fold_ascii(F.col("text"))).alias("n"))


def tokenize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.sha2(T.norm(F.col("text")), 256).alias("norm"))


def meaningful_terms(spark, sf_dir):
    m = T.meaningful_tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(m).alias("n_terms"), F.array_join(F.slice(F.array_sort(m), 1, 8), " ").alias("first_terms"))


def ordered_dedupe_lines(spark, sf_dir):
    kept = T.first_by_key(T.split_lines(F.col("text")), lambda x: F.lower(x))
    return _docs(spark, sf_dir).select("doc_id", F.size(kept).alias("n_lines"), F.sha2(F.array_join(kept, "\n"), 256).alias("lines"))


def norm_keys(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", T.norm_key(F.concat("p_name", F.lit(" & "), "p_brand")).alias("k1"), T.norm_key(F.col("p_brand"), "a-z0-9 ").alias("k2"), T.compact(T.norm(F.col("p_brand"))).alias("k3"))


def pii_scan(spark, sf_dir):
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    return _docs(spark, sf_dir).select("doc_id", listed(X.emails(F.col("text"))).alias("emails"), listed(X.phones(F.col("text"))).alias("phones"))


def link_extract(spark, sf_dir):
    found = X.links(F.coalesce("html", F.lit("")))
    return _t(spark, sf_dir, "pages").select("page_id", F.size(found).alias("n_links"), F.array_join(F.array_sort(found), " ").alias("links"))


def document_lines(spark, sf_dir):
    rows = S.lines(_docs(spark, sf_dir), "doc_id", "text")
    return rows.select("doc_id", "line_index", F.sha2("text", 256).alias("line"))


def section_carry_forward(spark, sf_dir):
    rows = S.lines(_docs(spark, sf_dir), "doc_id", "text")
    head = F.when((F.length("text") < 60) & F.col("text").endswith("."), F.lower(F.substring("text", 1, 3)))
    return S.carry_forward(rows, "doc_id", "line_index", head).groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.min("line_index").alias("first"))


def structural_features(spark, sf_dir):
    rows = Q.structural_features(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", F.round("log_words", 6).alias("log_words"), F.round("caps_ratio", 6).alias("caps_ratio"), F.round("position", 6).alias("position"), "has_bullet", "ends_colon")


def transition_matrix(spark, sf_dir):
    m = Q.transition_matrix(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "role", LABELS)
    return m.select("prev", "cur", "n", F.round("log_p", 6).alias("log_p"))


def boundary_accuracy(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").withColumn("pred", F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant"))
    return Q.boundary_accuracy(c, "conv_id", "turn", "role", "pred")


def viterbi_decode(spark, sf_dir):
    """The best label path of every conversation under emissions from the text's length."""
    c = _t(spark, sf_dir, "conversations").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    trans = Q.matrix_literal(Q.transition_matrix(c, "conv_id", "turn", "role", LABELS), LABELS)
    p = F.array(*[(F.pmod(F.col("n"), F.lit(7 + j)) + 1) / (7 + j) for j in range(3)])
    rows = c.select("conv_id", "turn", Q.log_probabilities(Q.align_probabilities(p, LABELS, LABELS)).alias("e"))
    docs = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "e"))), lambda x: x["e"]).alias("es"))
    return docs.select("conv_id", F.array_join(Q.viterbi(F.col("es"), trans, 3).cast("array<string>"), "").alias("path"))


def date_ranges(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMM yyyy").alias("a"), F.date_format(F.add_months("o_orderdate", (F.col("o_orderkey") % 40).cast("int")), "MM/yyyy").alias("b"))
    said = F.concat(F.lit("Worked from "), F.col("a"), F.lit(" - "), F.when(F.col("o_orderkey") % 11 == 0, "Present").otherwise(F.col("b")), F.lit("."))
    r = o.select("o_orderkey", DT.date_range(said, F.lit("2003-05-17").cast("date")).alias("r"))
    return r.select("o_orderkey", "r.start_date", "r.end_date", "r.duration_months")


def explicit_duration(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size"), F.when(F.col("p_partkey") % 3 == 0, " years").when(F.col("p_partkey") % 3 == 1, ".5 yrs 3 months").otherwise(" thang")).alias("said"))
    return p.select("p_partkey", DT.explicit_months(F.col("said")).alias("months"))


def role_vote(spark, sf_dir):
    return K.role_votes(_docs(spark, sf_dir), "doc_id", "text", ROLES)


def seniority_levels(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", K.seniority(F.when(F.col("c_custkey") % 5 == 0, "Senior"), F.col("c_nationkey") / 3).alias("seniority"))


def catalog_match(spark, sf_dir):
    """Skills of job texts that name a skill of the catalog by position."""
    n = len(frame(spark).collect())
    named = frame(spark).select((F.col("ord")).alias("o"), F.col("name").alias("skill"))
    p = _t(spark, sf_dir, "part").withColumn("o", (F.col("p_partkey") % n).cast("int")).join(F.broadcast(named), "o")
    d = p.select(F.col("p_partkey").alias("doc"), F.concat(F.lit("We need a "), "p_name", F.lit(" with "), "skill", F.lit(" now")).alias("text"), "skill")
    hits = K.job_skills(d, "doc", "text", frame(spark))
    return d.join(hits.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("normalized_name")), ",").alias("skills")), "doc", "left").select("doc", "skill", "skills")


def resume_skill_match(spark, sf_dir):
    return K.resume_skills(_docs(spark, sf_dir), "doc_id", "text", frame(spark)).select("doc_id", F.size("skills").alias("n_skills"), F.array_join(F.transform("skills", lambda s: s["normalized_name"]), ",").alias("skills"))


def job_records(spark, sf_dir):
    return parse_jobs(_docs(spark, sf_dir))


def resume_records(spark, sf_dir):
    return parse_resumes(_docs(spark, sf_dir))


_STOP = ", ".join(f"'{w}'" for w in T.GENERIC_TOKENS)
_LINES = r"(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS line_index, line AS text FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) x, LATERAL (SELECT trim(raw, ' ' || chr(9) || chr(13)) AS line) y WHERE line <> '')"

_ALIASES = ", ".join(
    f"({o}, '{key}', '{'(^|[^a-z0-9.])' if a in SHORT_ALIASES else '(^|[^a-z0-9])'}{re.escape(a)}($|[^a-z0-9])')" for o, _, key, _, aliases in entries() for a in aliases
)
_NAMES = ", ".join(f"({o}, '{name}')" for o, name, *_ in entries())
SQL = {
    "viterbi_decode": """WITH RECURSIVE p AS (SELECT role AS prev, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS cur FROM conversations), l AS (SELECT * FROM (VALUES ('assistant', 1), ('system', 2), ('user', 3)) v(x, k)),
g AS (SELECT a.k AS i, b.k AS j, count(p.prev) AS n FROM l a CROSS JOIN l b LEFT JOIN p ON p.prev = a.x AND p.cur = b.x GROUP BY 1, 2),
h AS (SELECT i, j, ln((n + 1.0) / sum(n + 1.0) OVER (PARTITION BY i)) AS w FROM g), t AS (SELECT list(w ORDER BY i, j) AS t FROM h),
c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, length(coalesce(text, '')) AS n FROM conversations),
q AS (SELECT conv_id, rn, [(n % 7 + 1) / 7.0::DOUBLE, (n % 8 + 1) / 8.0::DOUBLE, (n % 9 + 1) / 9.0::DOUBLE] AS q FROM c),
e AS (SELECT conv_id, rn, [ln(greatest(x / (q[1] + q[2] + q[3]), 1e-12)) FOR x IN q] AS e FROM q),
d AS (
  SELECT conv_id, rn, e AS d, ['0', '1', '2'] AS path FROM e WHERE rn = 1
  UNION ALL
  SELECT f.conv_id, e.rn, [list_max([f.d[i] + t.t[3 * i - 3 + j] FOR i IN [1, 2, 3]]) + e.e[j] FOR j IN [1, 2, 3]],
    [f.path[list_position([f.d[i] + t.t[3 * i - 3 + j] FOR i IN [1, 2, 3]], list_max([f.d[i] + t.t[3 * i - 3 + j] FOR i IN [1, 2, 3]]))] || CAST(j - 1 AS VARCHAR) FOR j IN [1, 2, 3]]
  FROM d f JOIN e ON e.conv_id = f.conv_id AND e.rn = f.rn + 1 CROSS JOIN t)
SELECT conv_id, path[list_position(d, list_max(d))] AS path FROM d QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) = 1""",
    "pii_scan": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'))), ',') AS emails,
array_to_string(list_sort(list_distinct([x FOR x IN [regexp_replace(p, '[^+0-9]', '', 'g') FOR p IN regexp_extract_all(t, '\+?\d[\d\s().-]{6,}\d')] IF length(replace(x, '+', '')) BETWEEN 10 AND 15])), ',') AS phones FROM d""",
    "link_extract": r"""WITH p AS (SELECT page_id, list_sort(list_distinct([regexp_replace(x, '[.,;:]+$', '') FOR x IN regexp_extract_all(coalesce(html, ''), '(?i)https?://[^\s"''<>)]+')])) AS l FROM pages) SELECT page_id, CAST(len(l) AS INT) AS n_links, array_to_string(l, ' ') AS links FROM p""",
    "structural_features": r"""WITH c AS (SELECT *, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations)
SELECT conv_id, turn, round(ln(1 + len(regexp_extract_all(t, '\S+'))), 6) AS log_words, round(CASE WHEN regexp_matches(t, '[A-Za-z]') THEN length(regexp_replace(t, '[^A-Z]', '', 'g')) / length(regexp_replace(t, '[^A-Za-z]', '', 'g')) ELSE 0.0 END, 6) AS caps_ratio,
round((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / greatest(count(*) OVER (PARTITION BY conv_id) - 1, 1), 6) AS position, CASE WHEN regexp_matches(coalesce(text, ''), '^\s*(?:[-*•]|\d+[.)])') THEN 1.0 ELSE 0.0 END AS has_bullet, CASE WHEN t LIKE '%:' THEN 1.0 ELSE 0.0 END AS ends_colon FROM c""",
    "catalog_match": f"""WITH a(o, k, p) AS (VALUES {_ALIASES}), n(o, skill) AS (VALUES {_NAMES}),
d AS (SELECT p_partkey AS doc, skill, trim(regexp_replace(regexp_replace(lower('We need a ' || p_name || ' with ' || skill || ' now'), '[^a-z0-9#+./-]+', ' ', 'g'), ' +', ' ', 'g')) AS t FROM part JOIN n ON n.o = p_partkey % (SELECT count(*) FROM n)),
m AS (SELECT DISTINCT t, k FROM (SELECT DISTINCT t FROM d) x, a WHERE regexp_matches(t, p))
SELECT doc, skill, (SELECT string_agg(k, ',' ORDER BY k) FROM m WHERE m.t = d.t) AS skills FROM d""",
    "tokenize": "SELECT doc_id, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9+#.]+')) AS INT) AS n_tokens, sha256(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9+#.]+'), ' ')) AS norm FROM documents",
    "fold_ascii": r"SELECT doc_id, sha256(regexp_replace(strip_accents(nfc_normalize(coalesce(text, ''))), '[^\x00-\x7F]', '', 'g')) AS folded, CAST(length(regexp_replace(strip_accents(nfc_normalize(coalesce(text, ''))), '[^\x00-\x7F]', '', 'g')) AS INT) AS n FROM documents",
    "meaningful_terms": f"WITH t AS (SELECT doc_id, [w FOR w IN list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9+#.]+')) IF length(w) > 2 AND NOT list_contains([{_STOP}], w)] AS m FROM documents) SELECT doc_id, CAST(len(m) AS INT) AS n_terms, array_to_string(list_sort(m)[1:8], ' ') AS first_terms FROM t",
    "ordered_dedupe_lines": f"WITH f AS (SELECT doc_id, line_index, text, row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY line_index) AS r FROM {_LINES} l) SELECT d.doc_id, CAST(count(f.text) AS INT) AS n_lines, sha256(coalesce(string_agg(f.text, chr(10) ORDER BY line_index), '')) AS lines FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id AND r = 1 GROUP BY 1",
    "norm_keys": "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9+#./ ]', ' ', 'g'), ' +', ' ', 'g')) AS k1, trim(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS k2, replace(replace(replace(lower(p_brand), ' ', ''), '.', ''), '+', '#') AS k3 FROM part",
    "document_lines": f"SELECT doc_id, CAST(line_index AS INT) AS line_index, sha256(text) AS line FROM {_LINES} l",
    "section_carry_forward": f"WITH l AS (SELECT doc_id, line_index, CASE WHEN length(text) < 60 AND text LIKE '%.' THEN lower(substr(text, 1, 3)) END AS h FROM {_LINES} x), s AS (SELECT doc_id, line_index, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_index ROWS UNBOUNDED PRECEDING), 'other') AS section FROM l) SELECT doc_id, section, count(*) AS n, CAST(min(line_index) AS INT) AS first FROM s GROUP BY 1, 2",
    "transition_matrix": "WITH p AS (SELECT role AS prev, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS cur FROM conversations), l AS (SELECT * FROM (VALUES ('assistant'), ('system'), ('user')) v(x)), g AS (SELECT a.x AS prev, b.x AS cur FROM l a, l b), n AS (SELECT g.prev, g.cur, count(p.prev) AS n FROM g LEFT JOIN p ON p.prev = g.prev AND p.cur = g.cur GROUP BY 1, 2) SELECT prev, cur, n, round(ln((n + 1.0) / sum(n + 1.0) OVER (PARTITION BY prev)), 6) AS log_p FROM n",
    "boundary_accuracy": "WITH c AS (SELECT lag(role) OVER w AS t0, role AS t, lag(CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END) OVER w AS p0, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS p, row_number() OVER w AS i FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT count(*) AS n, round(avg(CASE WHEN (t = t0) = (p = p0) THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM c WHERE i > 1",
    "date_ranges": "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 40 AS INT)) AS b FROM orders), e AS (SELECT o_orderkey, a, CASE WHEN o_orderkey % 11 = 0 THEN DATE '2003-05-01' ELSE CAST(b AS DATE) END AS b FROM o) SELECT o_orderkey, strftime(a, '%Y-%m') AS start_date, CASE WHEN o_orderkey % 11 = 0 THEN 'present' ELSE strftime(b, '%Y-%m') END AS end_date, CAST(greatest(0, (year(b) - year(a)) * 12 + month(b) - month(a)) AS INT) AS duration_months FROM e",
    "explicit_duration": "SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size * 12 WHEN 1 THEN p_size * 12 + 6 + 3 ELSE p_size END AS INT) AS months FROM part",
    "role_vote": "WITH v AS (SELECT doc_id, (CASE WHEN contains(lower(coalesce(text,'')), 'the ') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(coalesce(text,'')), 'and ') THEN 1 ELSE 0 END) AS a, (CASE WHEN contains(lower(coalesce(text,'')), 'ent') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(coalesce(text,'')), 'ion') THEN 1 ELSE 0 END) AS b, (CASE WHEN contains(lower(coalesce(text,'')), 'sch') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(coalesce(text,'')), 'que') THEN 1 ELSE 0 END) AS c FROM documents) SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'unknown' WHEN a >= b AND a >= c THEN 'people' WHEN b >= c THEN 'places' ELSE 'things' END AS role, CAST(greatest(a, b, c) AS INT) AS votes FROM v",
    "seniority_levels": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'senior' WHEN c_nationkey / 3.0 < 1 THEN 'intern' WHEN c_nationkey / 3.0 < 3 THEN 'junior' WHEN c_nationkey / 3.0 < 6 THEN 'middle' ELSE 'senior' END AS seniority FROM customer",
}
QUERIES = {f.__name__: f for f in (fold_ascii, tokenize, meaningful_terms, ordered_dedupe_lines, norm_keys, pii_scan, link_extract, document_lines, section_carry_forward, structural_features, transition_matrix, boundary_accuracy, viterbi_decode, date_ranges, explicit_duration, role_vote, seniority_levels, catalog_match, resume_skill_match, job_records, resume_records)}
