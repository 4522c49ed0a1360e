"""SQL (DuckDB) for the queries that SQL can express."""

from __future__ import annotations

import string

from .secrets import BASE, RULES


def _secrets() -> str:
    rules = []
    for order, (kind, pattern, group, least) in enumerate(RULES):
        p = "'" + pattern.replace("'", "''") + "'"
        whole = f"regexp_extract_all(t, {p})"
        rules.append(f"SELECT doc_id, {order} AS o, '{kind}' AS kind, {least} AS least, unnest({whole}) AS m, unnest(string_split_regex(t, {p})[1:len({whole})]) AS g, unnest(regexp_extract_all(t, {p}, {group})) AS c, unnest(range(len({whole}))) AS i FROM d")
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS ("
        + " UNION ALL ".join(rules)
        + "), e AS (SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id, o ORDER BY i) AS BIGINT) AS z FROM r), s AS (SELECT doc_id, o, kind, z - length(m) AS a, z FROM e WHERE length(c) >= least) "
        + f"SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, o) FILTER (kind IN ({base})), '')) AS base_sha256, coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, o), '') AS spans FROM d LEFT JOIN s USING (doc_id) GROUP BY 1"
    )


_WARC = """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM m"""

#: Components of links (a, b) over nodes n, by the smallest node reachable.
_REACH = "reach AS (SELECT n AS a, n AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)"

_EMBED = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), nodes AS (SELECT vec_id AS n FROM v),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93), {_REACH}
SELECT n AS vec_id, (SELECT count(*) FROM links WHERE a = n) AS n_links, component_id, n = component_id AS kept FROM nodes JOIN comp ON a = n"""

_NGRAM = (
    "WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + r"'), '[^\x20\x09-\x0D]+') AS w FROM documents), "
    "s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w), "
    "z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), nodes AS (SELECT doc_id AS n FROM documents), "
    "p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2), "
    "links AS (SELECT p.a, p.b FROM p JOIN z za ON za.doc_id = p.a JOIN z zb ON zb.doc_id = p.b WHERE 100 * c >= 80 * (za.n + zb.n - c)), " + _REACH + " "
    "SELECT nodes.n AS doc_id, coalesce(z.n, 0) AS n_shingles, component_id FROM nodes JOIN comp ON comp.a = nodes.n LEFT JOIN z ON z.doc_id = nodes.n"
)

SQL = {"op2_embedding_near_dedup": _EMBED, "op3_ngram_jaccard_join": _NGRAM, "op9_secrets": _secrets(), "op10_warc": _WARC}
