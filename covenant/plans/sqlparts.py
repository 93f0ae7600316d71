"""DuckDB SQL fragments for the oracle queries.

The oracle is an independent statement of each query's meaning in plain SQL
over the same input tables. Fixture derivations (FIXTURES.md §2) are CTEs here
and DataFrame code in ``covenant.sources.fixtures``.
"""

from __future__ import annotations

from covenant import schemas as S


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


RISK_IN = in_list(S.RISK_CLAUSES)


def label_sql(x: str) -> str:
    return (f"CASE WHEN {x} > -1 AND {x} <= 2 THEN 'Low' WHEN {x} > 2 AND {x} <= 4 THEN 'Medium' "
            f"WHEN {x} > 4 AND {x} <= 10 THEN 'High' END")


def label_id_sql(x: str) -> str:
    return f"CASE {x} WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END"


def clause_sql(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '\"(.*?)\"') THEN regexp_extract({x}, '\"(.*?)\"', 1) "
            f"ELSE {x} END")


def first_words_sql(x: str, n: int = S.WORDS_PER_CLAUSE) -> str:
    return f"array_to_string([w for w in regexp_split_to_array({x}, '\\s+') if w <> ''][1:{n}], ' ')"


def sanitize_sql(x: str) -> str:
    clean = f"regexp_replace(regexp_extract({x}, '([^/]*)/*$', 1), '[^A-Za-z0-9._-]', '_', 'g')"
    return f"CASE WHEN {x} IS NULL OR {clean} = '' THEN 'document' ELSE {clean} END"


def short_hash_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '' ELSE substr({x}, 1, 12) || '…' END"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def blank_sql(x: str) -> str:
    return f"coalesce({strip_sql(x)} = '', true)"


def case_sql(x: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {q(k)} THEN {q(v)}" for k, v in pairs) + " END"


_QA_CLAUSE = (f"CASE WHEN h % {S.N_CLAUSE_TYPES} < {len(S.RISK_CLAUSES)} "
              f"THEN {str_list(S.RISK_CLAUSES)}[h % {S.N_CLAUSE_TYPES} + 1] "
              f"ELSE 'Clause ' || CAST(h % {S.N_CLAUSE_TYPES} AS VARCHAR) END")

# name -> (dependencies, body)
FX: dict[str, tuple[list[str], str]] = {
    "fx_qa": ([], f"""
        SELECT doc_id, CAST(row_ord AS BIGINT) AS row_ord, CAST(doc_id AS VARCHAR) AS title,
               {q(S.QUESTION_PREFIX)} || {_QA_CLAUSE} || {q(S.QUESTION_SUFFIX)} AS question,
               context,
               {{'text': CASE WHEN (h // {S.N_CLAUSE_TYPES}) % 2 = 0 AND trim(line) <> ''
                             THEN [line] ELSE []::VARCHAR[] END}} AS answers
        FROM (SELECT doc_id, context, line, row_ord, ('0x' || substr(md5(line), 1, 4))::INTEGER AS h
              FROM (SELECT doc_id, text AS context,
                           unnest(string_split(text, chr(10))) AS line,
                           unnest(range(1, len(string_split(text, chr(10))) + 1)) AS row_ord
                    FROM documents))"""),
    "fx_flags": (["fx_qa"], f"""
        SELECT title, row_ord, coalesce(len(answers.text), 0) > 0 AS has_clause,
               {clause_sql('question')} AS clause,
               {first_words_sql('answers.text[1]')} AS snippet
        FROM fx_qa WHERE title IS NOT NULL"""),
    "fx_risk": (["fx_flags"], f"""
        SELECT title, risk_score, risk_text, {label_sql('risk_score')} AS risk_label
        FROM (SELECT title,
                     CAST(count(DISTINCT CASE WHEN has_clause AND clause IN {RISK_IN} THEN clause END)
                          AS INTEGER) AS risk_score,
                     coalesce(string_agg(CASE WHEN has_clause THEN snippet END, ' ' ORDER BY row_ord), '')
                          AS risk_text
              FROM fx_flags GROUP BY title)"""),
    "fx_documents": ([], f"""
        SELECT document_id, file_name,
               'doc-' || CAST(document_id AS VARCHAR) || '/v' || CAST(version_number AS VARCHAR) || '/'
                   || {sanitize_sql('file_name')} AS storage_key,
               'Contract' AS document_type, risk_score, {label_sql('risk_score')} AS rule_label,
               risk_label, CASE WHEN risk_label IS NOT NULL THEN CAST(document_id % 100 AS DOUBLE) / 100.0 END
                   AS risk_confidence,
               source, status, version_number, uploaded_by, uploaded_at, locked_at
        FROM (SELECT o_orderkey AS document_id,
                     'order_' || CAST(o_orderkey AS VARCHAR) || ['.pdf', '.TXT', '.docx', '.exe'][o_orderkey % 4 + 1]
                         AS file_name,
                     CASE WHEN o_orderkey % 12 <> 11 THEN CAST(o_orderkey % 12 AS DOUBLE) END AS risk_score,
                     CASE WHEN o_orderkey % 5 <> 0 THEN {str_list(S.LABELS)}[o_orderkey % 3 + 1] END AS risk_label,
                     CASE WHEN o_orderkey % 2 = 0 THEN 'CUAD' ELSE 'Manual' END AS source,
                     CASE o_orderstatus WHEN 'O' THEN 'UnderReview' WHEN 'F' THEN 'Locked'
                                        WHEN 'P' THEN 'RevisionRequested' END AS status,
                     CAST(o_orderkey % 3 + 1 AS INTEGER) AS version_number,
                     o_custkey AS uploaded_by, o_orderdate AS uploaded_at,
                     CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS locked_at
              FROM orders)"""),
    "fx_users": ([], """
        SELECT c_custkey AS user_id, c_name AS name,
               CASE WHEN c_custkey % 2 = 0 THEN upper(c_name || '@example.test')
                    ELSE c_name || '@example.test' END AS email,
               CASE c_mktsegment WHEN 'FURNITURE' THEN 'Employee' WHEN 'HOUSEHOLD' THEN 'Employee'
                    WHEN 'MACHINERY' THEN 'ReviewerCompliance' WHEN 'BUILDING' THEN 'ReviewerCompliance'
                    WHEN 'AUTOMOBILE' THEN 'TechnicalAdmin' END AS role
        FROM customer"""),
    "fx_versions": ([], """
        SELECT l_orderkey AS document_id, l_shipdate AS submitted_at, o_custkey AS submitted_by,
               l_linenumber, l_partkey, l_suppkey, l_extendedprice,
               'order_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) || '.txt' AS file_name,
               sha256(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                                CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))) AS content_hash
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"""),
    "fx_audit": ([], """
        SELECT event_id AS log_id, user_id * 100 + dayofmonth(ts) AS document_id,
               CASE WHEN event_id % 20 <> 0 THEN event_id % 20 END AS user_id,
               CASE event_type WHEN 'signup' THEN 'ReviewRequested' WHEN 'error' THEN 'RevisionRequested'
                    WHEN 'purchase' THEN 'Approved' WHEN 'click' THEN 'Locked' WHEN 'view' THEN 'Viewed' END
                   AS action,
               ts AS action_ts, props AS notes
        FROM events"""),
    "fx_objects": ([], """
        SELECT doc_id AS document_id, sha256(text) AS recorded_hash,
               CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN encode(text || 'x')
                    ELSE encode(text) END AS content
        FROM documents"""),
    "fx_first_answers": (["fx_flags"], """
        SELECT title, clause, arg_min(snippet, row_ord) AS snippet
        FROM fx_flags WHERE has_clause GROUP BY title, clause"""),
    "fx_clause_json": (["fx_risk", "fx_first_answers"], """
        SELECT doc_id, title,
               CASE WHEN doc_id % 50 = 0 THEN substr(js, 1, 5) WHEN doc_id % 50 = 1 THEN '' ELSE js END
                   AS clauses_json,
               model_input
        FROM (SELECT CAST(r.title AS BIGINT) AS doc_id, r.title, r.risk_text AS model_input,
                     coalesce(CAST(to_json(m.m) AS VARCHAR), '{}') AS js
              FROM fx_risk r LEFT JOIN
                   (SELECT title, map_from_entries(list({'k': clause, 'v': snippet} ORDER BY clause)) AS m
                    FROM fx_first_answers GROUP BY title) m ON r.title = m.title)"""),
    "fx_logits": ([], """
        SELECT vec_id, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE),
                        CAST(embedding[3] AS DOUBLE)] AS logits
        FROM embeddings"""),
    "fx_predictions": (["fx_risk"], f"""
        SELECT doc_id, title, actual,
               CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 3 <> 0 THEN actual
                    ELSE CAST((actual + doc_id // 3) % 3 AS INTEGER) END AS predicted
        FROM (SELECT CAST(title AS BIGINT) AS doc_id, title, {label_id_sql('risk_label')} AS actual
              FROM fx_risk)"""),
    "fx_pages": ([], "SELECT conv_id AS document, turn AS page, text FROM conversations"),
    "fx_names": ([], "SELECT page_id, url AS raw_name FROM pages"),
    "fx_commands": ([], """
        SELECT event_id AS cmd_id, event_id % (SELECT count(*) FROM documents) AS document_id,
               user_id AS actor_id,
               CASE event_type WHEN 'signup' THEN 'resubmit' WHEN 'error' THEN 'request_revision'
                    WHEN 'purchase' THEN 'approve' WHEN 'click' THEN 'verify' WHEN 'view' THEN 'view' END
                   AS command,
               CASE WHEN event_id % 10 = 0 THEN '' ELSE props END AS notes, ts
        FROM events"""),
}


def with_fx(needed: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the fixture CTEs it needs (dependencies first),
    followed by ``extra`` (name, sql) CTEs in the given order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in FX[n][0]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    parts = [(n, FX[n][1]) for n in order] + list(extra or [])
    if not parts:
        return body
    ctes = ",\n".join(f"{n} AS ({sql})" for n, sql in parts)
    return f"WITH {ctes}\n{body}"
