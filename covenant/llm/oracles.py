"""DuckDB statements for the queries that SQL can express; plain versions, row by row or pair by pair."""

from __future__ import annotations

import string

from covenant.llm import secrets, urlfilter
from covenant.llm.urlfilter import DAMPING, STEPS, Rule


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LOWER = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def near_duplicates(percent: int = 80) -> str:
    """All pairs with a common 2-word shingle; components by reachability."""
    return f"""
    WITH RECURSIVE w AS (
        SELECT doc_id, [x for x in string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+') if x <> ''] AS w
        FROM documents),
    s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
            ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    link AS (
        SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s
                              WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
        JOIN n na ON p.a = na.doc_id JOIN n nb ON p.b = nb.doc_id WHERE 100 * k >= {percent} * (na.n + nb.n - k)),
    reach AS (
        SELECT doc_id AS a, doc_id AS b FROM documents
        UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, min(r.b) = d.doc_id AS kept
    FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN reach r ON d.doc_id = r.a GROUP BY d.doc_id, n.n"""


def secret_scan() -> str:
    """Every rule over every text; positions from the lengths of matches and of what lies between."""
    kinds = "\nUNION ALL\n".join(
        f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, "
        f"string_split_regex(t, {_q(r.pattern)}) AS gaps, regexp_extract_all(t, {_q(r.pattern)}, 0) AS hits, "
        f"regexp_extract_all(t, {_q(r.pattern)}, {r.group}) AS parts, {r.least} AS least FROM d"
        for i, r in enumerate(secrets.RULES))
    base = ", ".join(_q(r.kind) for r in secrets.BASE)
    joined = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) {}, '')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS ({kinds}),
    s AS (SELECT doc_id, rank, kind, least, len(parts[i]) AS part, len(hits[i]) AS size,
                 list_sum([len(x) for x in gaps[1:i]]) + coalesce(list_sum([len(x) for x in hits[1:i - 1]]), 0) AS a
          FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM k)),
    f AS (SELECT doc_id, rank, kind, CAST(a AS BIGINT) AS a, CAST(a + size AS BIGINT) AS b FROM s WHERE part >= least)
    SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex,
           sha256({joined.format(f"FILTER (kind IN ({base}))")}) AS base_sha256, {joined.format("")} AS spans
    FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id"""


def url_filter(rules: list[Rule]) -> str:
    """Rules by CASE, propagation by one common table per step."""
    longest = sorted(rules, key=lambda r: (-len(str(r)), str(r)))
    fits = {r: f"((host = {_q(r.host)} OR ends_with(host, {_q('.' + r.host)})) AND starts_with(path, {_q(r.path)}))" for r in longest}
    pick = " ".join(f"WHEN {fits[r]} THEN {{}}" for r in longest)
    rule, ruled = (f"CASE {pick.format(*(_q(f(r)) for r in longest))} END" for f in (str, lambda r: r.verdict))
    host = _LOWER.format("regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1)")
    steps = [f"r0 AS (SELECT host, t * {1 - DAMPING!r} AS t, d * {1 - DAMPING!r} AS d FROM seed)"]
    for i in range(STEPS):
        steps.append(f"""r{i + 1} AS (SELECT host, sum(t) AS t, sum(d) AS d FROM (
            SELECT w.dst AS host, {DAMPING} * (w / tout) * t AS t, 0.0 AS d FROM ways w JOIN r{i} r ON w.src = r.host
            UNION ALL SELECT w.src, 0.0, {DAMPING} * (w / tin) * d FROM ways w JOIN r{i} r ON w.dst = r.host
            UNION ALL SELECT host, t, d FROM r0) GROUP BY host)""")
    return f"""
    WITH p AS (SELECT page_id, html, coalesce({host.format('url')}, '') AS host,
                      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    q AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM p),
    hosts AS (SELECT host, count(*) FILTER (ruled = 'allow') AS g, count(*) FILTER (ruled = 'block') AS b FROM q WHERE host <> '' GROUP BY host),
    seed AS (SELECT host, g / greatest((SELECT sum(g) FROM hosts), 1) AS t, b / greatest((SELECT sum(b) FROM hosts), 1) AS d FROM hosts),
    links AS (SELECT host AS src, {host.format("'x:' || regexp_replace(u, '^[a-zA-Z]*:', '')")} AS dst
              FROM (SELECT host, unnest(regexp_extract_all(html, {_q(urlfilter.LINK)}, 1)) AS u FROM q WHERE host <> '')),
    l AS (SELECT * FROM links WHERE dst <> '' AND src <> dst),
    known AS (SELECT host FROM hosts UNION SELECT dst FROM l),
    label AS (SELECT string_split(host, '.') AS x, unnest(range(1, len(string_split(host, '.')) - 1)) AS i FROM known),
    up AS (SELECT DISTINCT array_to_string(x[i:], '.') AS src, array_to_string(x[i + 1:], '.') AS dst FROM label),
    e AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT * FROM l UNION ALL SELECT * FROM up UNION ALL SELECT dst, src FROM up)
          GROUP BY src, dst),
    ways AS (SELECT *, sum(w) OVER (PARTITION BY src) AS tout, sum(w) OVER (PARTITION BY dst) AS tin FROM e),
    {", ".join(steps)},
    z AS (SELECT q.*, round(coalesce(r.t, 0), 12) AS trust, round(coalesce(r.d, 0), 12) AS distrust
          FROM q LEFT JOIN r{STEPS} r ON q.host = r.host)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust
    FROM z"""


def source_divergence(min_docs: int = 10, top_terms: int = 10, scale: int = 1_000_000_000) -> str:
    """Every kept term against every two groups of its language."""
    return f"""
    WITH d AS (
        SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
        FROM documents),
    word AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM word GROUP BY ALL HAVING count(DISTINCT row) >= {min_docs}),
    per_lang AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM kept GROUP BY lang),
    n AS (SELECT lang, source, term, count(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY ALL),
    per_group AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL),
    g AS (
        SELECT x.lang, x.source, CAST(coalesce(pg.total, 0) AS HUGEINT) AS total, CAST(coalesce(l.terms, 0) AS HUGEINT) AS terms
        FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN per_group pg USING (lang, source) LEFT JOIN per_lang l USING (lang)),
    p AS MATERIALIZED (
        SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
               1 + {scale} * CAST(coalesce(n.n, 0) + 2 AS HUGEINT) // (g.total + 2 * g.terms) AS p,
               1 + {scale} * CAST(k.n + 2 AS HUGEINT) // (CAST(l.total AS HUGEINT) + 2 * l.terms) AS q
        FROM g JOIN kept k USING (lang) JOIN per_lang l USING (lang)
        LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
    pair AS (
        SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
        LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
        GROUP BY ALL),
    part AS (
        SELECT lang, source, 'pair' AS part, item, value FROM pair
        UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM part)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
    FROM ranked WHERE part = 'pair' OR rank <= {top_terms}"""


def centroid_clusters(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """One statement per round: all distances, the nearest centroid, the floor of the mean."""
    steps = [f"""
    v AS MATERIALIZED (
        SELECT row, vec_id, d, CAST(floor({scale} * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS x
        FROM (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
              WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
             (SELECT unnest(range(1, {dims} + 1)) AS d)),
    c0 AS MATERIALIZED (
        SELECT s.k, v.d, v.x AS c FROM v JOIN (
            SELECT row, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k
            FROM v WHERE d = 1 QUALIFY k < {k}) s USING (row))"""]
    for i in range(rounds + 1):
        steps.append(f"""
    a{i} AS MATERIALIZED (
        SELECT row, k, distance FROM (
            SELECT v.row, c.k, sum((v.x - c.c) * (v.x - c.c)) AS distance FROM v JOIN c{i} c ON v.d = c.d GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, k) = 1)""")
        if i < rounds:
            steps.append(f"""
    m{i} AS (SELECT a.k, v.d, sum(v.x) AS s, CAST(count(*) AS HUGEINT) AS n FROM v JOIN a{i} a USING (row) GROUP BY ALL),
    c{i + 1} AS MATERIALIZED (
        SELECT c.k, c.d, CASE WHEN m.n IS NULL THEN c.c ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS c
        FROM c{i} c LEFT JOIN m{i} m ON c.k = m.k AND c.d = m.d)""")
    return f"""WITH {",".join(steps)},
    h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
    SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
           CAST(sum(a.distance) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
           CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, h.centroid_sha256
    FROM a{rounds} a JOIN v ON a.row = v.row AND v.d = 1 JOIN h ON a.k = h.k"""
