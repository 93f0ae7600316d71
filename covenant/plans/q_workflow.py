"""Workflow keys: P4–P17, A10–A12, A19, J4–J10, W1, W2, W6, W7, T1–T3, F4–F21, C1–C7, M4."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenant import schemas as S
from covenant.functions import text as X
from covenant.operators import quality as QY
from covenant.operators import workflow as W
from covenant.plans.catalog import register
from covenant.plans.sqlparts import (blank_sql, case_sql, label_sql, q, short_hash_sql, str_list, strip_sql,
                                     with_fx)
from covenant.operators import risk as R
from covenant.session import materialize
from covenant.sources import fixtures as FX
from covenant.sources.tables import table

WAIT_AS_OF = "2024-01-15 12:00:00"
_STATUS_LABEL_SQL = lambda x: case_sql(x, S.STATUSES)


def _fmt_sql(x):
    return f"coalesce(strftime({x} + INTERVAL '5 hours 30 minutes', '%-d %b %Y, %H:%M'), '')"


def _wait_sql(x, as_of):
    mins = f"((epoch_us(TIMESTAMP '{as_of}') - epoch_us({x})) // 60000000)"
    hours = f"({mins} // 60)"
    return (f"CASE WHEN {x} IS NULL THEN '' WHEN {mins} < 1 THEN 'just now' "
            f"WHEN {mins} < 60 THEN CAST({mins} AS VARCHAR) || ' min' "
            f"WHEN {hours} < 48 THEN CAST({hours} AS VARCHAR) || ' h' "
            f"ELSE CAST({hours} // 24 AS VARCHAR) || ' days' END")


def _score_text_sql(x):
    return f"CASE WHEN {x} IS NOT NULL THEN CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR) || ' of 10' ELSE 'n/a' END"


def _version_note_sql(x):
    return f"CASE WHEN {x} > 1 THEN 'Version ' || CAST({x} AS VARCHAR) || ', resubmitted' ELSE '' END"


def _move_msg_sql(a, b):
    return (f"'A document that is ' || lower({_STATUS_LABEL_SQL(a)}) || ' can''t move to ' || "
            f"lower({_STATUS_LABEL_SQL(b)}) || '.'")


def _legal_sql(a, b):
    return "(" + " OR ".join(f"({a} = {q(x)} AND {b} = {q(y)})" for x, y in S.TRANSITIONS) + ")"


def _docs(spark, sf_dir):
    return FX.fx_documents(spark, sf_dir)


def _users(spark, sf_dir):
    return FX.fx_users(spark, sf_dir)


# ---- reads -----------------------------------------------------------------

@register("my_documents", with_fx(["fx_documents"], """
    SELECT uploaded_by, document_id, file_name, status, uploaded_at FROM fx_documents"""))
def my_documents(spark, sf_dir):
    return W.my_documents(_docs(spark, sf_dir)).select("uploaded_by", "document_id", "file_name", "status",
                                                       "uploaded_at")


@register("review_queue", with_fx(["fx_documents", "fx_users"], f"""
    SELECT d.document_id, d.file_name, u.name AS submitted_by, d.uploaded_at,
           {_wait_sql('d.uploaded_at', S.AS_OF)} AS waiting,
           coalesce(d.risk_label, 'Not scored') AS model_risk, {_score_text_sql('d.risk_score')} AS risk_clauses,
           {_version_note_sql('d.version_number')} AS version_note
    FROM fx_documents d JOIN fx_users u ON d.uploaded_by = u.user_id WHERE d.status = 'UnderReview'"""))
def review_queue(spark, sf_dir):
    return W.review_queue(_docs(spark, sf_dir), _users(spark, sf_dir))


@register("visible_documents", with_fx(["fx_commands", "fx_documents", "fx_users"], """
    SELECT c.cmd_id, c.actor_id, c.document_id,
           coalesce(u.role = 'ReviewerCompliance' OR d.uploaded_by = c.actor_id, false) AS can_view
    FROM fx_commands c LEFT JOIN fx_documents d ON c.document_id = d.document_id
    LEFT JOIN fx_users u ON c.actor_id = u.user_id"""))
def visible_documents(spark, sf_dir):
    v = W.can_view(FX.fx_commands(spark, sf_dir), _docs(spark, sf_dir), _users(spark, sf_dir))
    return v.select("cmd_id", "actor_id", "document_id", "can_view")


@register("scored_flag", with_fx(["fx_documents"], """
    SELECT document_id, risk_label IS NOT NULL OR risk_score IS NOT NULL AS scored, status = 'Locked' AS locked
    FROM fx_documents"""))
def scored_flag(spark, sf_dir):
    return W.scored_flags(_docs(spark, sf_dir))


@register("status_counts", with_fx(["fx_documents"], "SELECT status, count(*) AS n FROM fx_documents GROUP BY status"))
def status_counts(spark, sf_dir):
    return W.status_counts(_docs(spark, sf_dir))


@register("owner_dashboard", with_fx(["fx_documents"], """
    SELECT uploaded_by, CAST(count_if(status = 'RevisionRequested') AS BIGINT) AS needs_revision,
           CAST(count_if(status = 'UnderReview') AS BIGINT) AS in_review,
           CAST(count_if(status = 'Locked') AS BIGINT) AS locked, count(*) AS total
    FROM fx_documents GROUP BY uploaded_by"""))
def owner_dashboard(spark, sf_dir):
    return W.owner_dashboard(_docs(spark, sf_dir))


@register("docs_with_uploader", with_fx(["fx_documents", "fx_users"], """
    SELECT d.document_id, d.file_name, u.name AS uploader_name
    FROM fx_documents d JOIN fx_users u ON d.uploaded_by = u.user_id"""))
def docs_with_uploader(spark, sf_dir):
    return W.docs_with_uploader(_docs(spark, sf_dir), _users(spark, sf_dir)) \
        .select("document_id", "file_name", "uploader_name")


_ACTION_LABEL = lambda x: case_sql(x, S.ACTIONS)


@register("audit_feed", with_fx(["fx_audit", "fx_documents", "fx_users"], f"""
    SELECT a.log_id, a.document_id, d.file_name, a.action, {_ACTION_LABEL('a.action')} AS action_label,
           coalesce(u.name, {q(S.SYSTEM_ACTOR)}) AS actor_name, a.action_ts, {_fmt_sql('a.action_ts')} AS "when",
           a.notes
    FROM fx_audit a JOIN fx_documents d ON a.document_id = d.document_id
    LEFT JOIN fx_users u ON a.user_id = u.user_id"""))
def audit_feed(spark, sf_dir):
    return W.audit_feed(FX.fx_audit(spark, sf_dir), _docs(spark, sf_dir), _users(spark, sf_dir))


@register("recent_audit", with_fx(["fx_audit", "fx_documents", "fx_users"], f"""
    SELECT t.log_id, t.action_ts, t.document_id, d.file_name, t.action,
           coalesce(u.name, {q(S.SYSTEM_ACTOR)}) AS actor_name, t.notes
    FROM (SELECT * FROM fx_audit ORDER BY action_ts DESC, log_id DESC LIMIT 300) t
    LEFT JOIN fx_documents d ON t.document_id = d.document_id LEFT JOIN fx_users u ON t.user_id = u.user_id"""))
def recent_audit(spark, sf_dir):
    return W.recent_audit(FX.fx_audit(spark, sf_dir), _docs(spark, sf_dir), _users(spark, sf_dir))


@register("document_trail", with_fx(["fx_audit"], "SELECT document_id, log_id, action_ts, action, notes FROM fx_audit"))
def document_trail(spark, sf_dir):
    return W.document_trail(FX.fx_audit(spark, sf_dir)).select("document_id", "log_id", "action_ts", "action", "notes")


@register("versions_with_submitter", with_fx(["fx_versions", "fx_users"], """
    SELECT v.document_id, v.l_linenumber, v.l_partkey, v.submitted_at, v.submitted_by, u.name AS submitter_name
    FROM fx_versions v JOIN fx_users u ON v.submitted_by = u.user_id"""))
def versions_with_submitter(spark, sf_dir):
    j = W.versions_with_submitter(FX.fx_versions(spark, sf_dir), _users(spark, sf_dir))
    return j.select("document_id", "l_linenumber", "l_partkey", "submitted_at", "submitted_by", "submitter_name")


def _email_requests(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lower(F.concat("c_name", F.lit("@example.test"))).alias("email"))
    s = table(spark, sf_dir, "supplier").select(F.lower(F.concat("s_name", F.lit("@example.test"))).alias("email"))
    return c.unionByName(s)


@register("user_by_email", with_fx(["fx_users"], """
    SELECT r.email, u.user_id, u.user_id IS NOT NULL AS matched
    FROM (SELECT lower(c_name || '@example.test') AS email FROM customer
          UNION ALL SELECT lower(s_name || '@example.test') FROM supplier) r
    LEFT JOIN fx_users u ON lower(u.email) = lower(r.email)"""))
def user_by_email(spark, sf_dir):
    return W.user_by_email(_email_requests(spark, sf_dir), _users(spark, sf_dir)).select("email", "user_id", "matched")


# ---- versions --------------------------------------------------------------

_VERSIONED = [("vv", """
    SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY submitted_at, l_linenumber, l_partkey,
                                      l_suppkey, l_extendedprice) AS INTEGER) AS version_number
    FROM fx_versions""")]


def _versioned(spark, sf_dir, dealt=False):
    return W.assign_versions(FX.fx_versions(spark, sf_dir, with_submitter=False), dealt=dealt)


@register("assign_versions", with_fx(["fx_versions"], """
    SELECT document_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, submitted_at, version_number FROM vv""",
                                     _VERSIONED))
def assign_versions(spark, sf_dir):
    return _versioned(spark, sf_dir).select("document_id", "l_linenumber", "l_partkey", "l_suppkey",
                                            "l_extendedprice", "submitted_at", "version_number")


@register("current_version", with_fx(["fx_versions"], f"""
    SELECT document_id, max(version_number) AS version_number,
           arg_max('doc-' || CAST(document_id AS VARCHAR) || '/v' || CAST(version_number AS VARCHAR) || '/' || file_name,
                   version_number) AS storage_key,
           arg_max(content_hash, version_number) AS content_hash, arg_max(file_name, version_number) AS file_name
    FROM vv GROUP BY document_id""", _VERSIONED))
def current_version(spark, sf_dir):
    return W.current_version(FX.fx_versions(spark, sf_dir, with_submitter=False))


@register("version_history", with_fx(["fx_versions"], """
    SELECT document_id, version_number, file_name, submitted_at, content_hash FROM vv""", _VERSIONED))
def version_history(spark, sf_dir):
    return W.version_history(_versioned(spark, sf_dir, dealt=True)).select("document_id", "version_number", "file_name",
                                                                           "submitted_at", "content_hash")


# ---- lifecycle ---------------------------------------------------------------

_TARGET = case_sql("action", S.STATUS_MOVES)
_FOLD = [("acts", f"""
    SELECT document_id, log_id, action, {_TARGET} AS target,
           row_number() OVER (PARTITION BY document_id ORDER BY action_ts, log_id) AS i
    FROM fx_audit WHERE {_TARGET} IS NOT NULL"""),
         ("fold", f"""
    SELECT document_id, CAST(0 AS BIGINT) AS i, 'Draft' AS state, CAST(NULL AS BIGINT) AS log_id,
           CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS from_status, CAST(NULL AS VARCHAR) AS to_status,
           CAST(NULL AS BOOLEAN) AS legal
    FROM (SELECT DISTINCT document_id FROM fx_audit)
    UNION ALL
    SELECT f.document_id, a.i,
           CASE WHEN {_legal_sql('f.state', 'a.target')} THEN a.target ELSE f.state END,
           a.log_id, a.action, f.state, a.target, {_legal_sql('f.state', 'a.target')}
    FROM fold f JOIN acts a ON a.document_id = f.document_id AND a.i = f.i + 1""")]


def _rec(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@register("lifecycle_fold", _rec(with_fx(["fx_audit"], """
    SELECT document_id, arg_max(state, i) AS status, count(log_id) AS n_tried FROM fold GROUP BY document_id""",
                                         _FOLD)))
def lifecycle_fold(spark, sf_dir):
    return W.lifecycle_fold(FX.fx_audit(spark, sf_dir))


@register("legal_transition", _rec(with_fx(["fx_audit"], f"""
    SELECT log_id, document_id, action, from_status, to_status, legal,
           CASE WHEN NOT legal THEN {_move_msg_sql('from_status', 'to_status')} END AS message
    FROM fold WHERE log_id IS NOT NULL""", _FOLD)))
def legal_transition(spark, sf_dir):
    s = W.lifecycle_steps_per_action(FX.fx_audit(spark, sf_dir))
    return s.select("log_id", "document_id", "action", "from_status", "to_status", "legal",
                    F.when(~F.col("legal"), W.move_message(F.col("from_status"), F.col("to_status")))
                    .alias("message"))


@register("illegal_moves", _rec(with_fx(["fx_audit"], f"""
    SELECT document_id, log_id, action, from_status, to_status,
           {_move_msg_sql('from_status', 'to_status')} AS message
    FROM fold WHERE log_id IS NOT NULL AND NOT legal""", _FOLD)))
def illegal_moves(spark, sf_dir):
    return W.illegal_moves(FX.fx_audit(spark, sf_dir))


# ---- documents: display and validation --------------------------------------

@register("risk_facts", with_fx(["fx_documents"], f"""
    SELECT document_id, coalesce(risk_label, 'Not scored') AS label_text, {_score_text_sql('risk_score')} AS score_text,
           CASE WHEN risk_confidence IS NOT NULL
                THEN CAST(CAST(round_even(risk_confidence * 100, 0) AS BIGINT) AS VARCHAR) || '% confidence'
                ELSE '' END AS confidence_text,
           {_version_note_sql('version_number')} AS version_text
    FROM fx_documents"""))
def risk_facts(spark, sf_dir):
    return W.risk_facts(_docs(spark, sf_dir))


def _steps_sql():
    scored = "(risk_label IS NOT NULL OR risk_score IS NOT NULL)"
    names = [q(S.STEP_UPLOADED), f"CASE WHEN {scored} THEN {q(S.STEP_SCORED)} ELSE {q(S.STEP_NOT_SCORED)} END",
             f"CASE WHEN status = 'RevisionRequested' THEN {q(S.STEP_REVISION)} ELSE {q(S.STEP_REVIEW)} END",
             q(S.STEP_APPROVED), q(S.STEP_LOCKED)]
    state = ("CASE {c} WHEN 'd' THEN 'done' WHEN 'c' THEN 'current' WHEN 'a' THEN 'attention' WHEN 's' THEN "
             f"CASE WHEN {scored} THEN 'done' ELSE 'skipped' END ELSE 'todo' END")
    code = "CASE status " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in W.STEP_STATES.items()) + " END"
    parts = [f"SELECT document_id, {i + 1} AS step_no, {nm} AS step_name, "
             f"{state.format(c=f'substr(code, {i + 1}, 1)')} AS step_state FROM b" for i, nm in enumerate(names)]
    return with_fx(["fx_documents"], "\nUNION ALL\n".join(parts), [("b", f"SELECT *, {code} AS code FROM fx_documents")])


@register("lifecycle_steps", _steps_sql())
def lifecycle_steps(spark, sf_dir):
    return W.lifecycle_steps(_docs(spark, sf_dir))


@register("display_names", with_fx(["fx_audit"], f"""
    SELECT log_id, action, {_ACTION_LABEL('action')} AS action_label FROM fx_audit"""))
def display_names(spark, sf_dir):
    a = FX.fx_audit(spark, sf_dir)
    return a.join(F.broadcast(S.action_dim(spark)), "action", "left").select("log_id", "action", "action_label")


@register("status_names", with_fx(["fx_documents"], f"""
    SELECT document_id, status, {_STATUS_LABEL_SQL('status')} AS status_label FROM fx_documents"""))
def status_names(spark, sf_dir):
    d = _docs(spark, sf_dir).select("document_id", "status")
    return d.join(F.broadcast(S.status_dim(spark)), "status", "left").select("document_id", "status", "status_label")


@register("role_names", with_fx(["fx_users"], f"""
    SELECT user_id, role, {case_sql('role', S.ROLES)} AS role_label FROM fx_users"""))
def role_names(spark, sf_dir):
    u = _users(spark, sf_dir).select("user_id", "role")
    return u.join(F.broadcast(S.role_dim(spark)), "role", "left").select("user_id", "role", "role_label")


@register("format_ts", with_fx(["fx_audit"], f"SELECT log_id, {_fmt_sql('action_ts')} AS \"when\" FROM fx_audit"))
def format_ts(spark, sf_dir):
    return FX.fx_audit(spark, sf_dir).select("log_id", X.format_ts("action_ts").alias("when"))


@register("waiting", with_fx(["fx_audit"], f"SELECT log_id, {_wait_sql('action_ts', WAIT_AS_OF)} AS waiting FROM fx_audit"))
def waiting(spark, sf_dir):
    a = FX.fx_audit(spark, sf_dir)
    return a.select("log_id", X.waiting("action_ts", F.lit(WAIT_AS_OF).cast("timestamp_ntz")).alias("waiting"))


@register("storage_key", with_fx(["fx_documents"], "SELECT document_id, storage_key FROM fx_documents"))
def storage_key(spark, sf_dir):
    return _docs(spark, sf_dir).select("document_id", "storage_key")


@register("media_type", with_fx(["fx_documents"], """
    SELECT document_id,
           CASE WHEN lower(file_name) LIKE '%.pdf' THEN 'application/pdf'
                WHEN lower(file_name) LIKE '%.txt' THEN 'text/plain;charset=UTF-8'
                ELSE 'application/octet-stream' END AS media_type,
           CASE WHEN lower(file_name) LIKE '%.pdf' OR lower(file_name) LIKE '%.txt' THEN 'inline'
                ELSE 'attachment' END AS disposition
    FROM fx_documents"""))
def media_type(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("document_id", X.media_type("file_name").alias("media_type"),
                    X.disposition("file_name").alias("disposition"))


@register("sanitize_name", with_fx(["fx_names"], f"""
    SELECT page_id, raw_name,
           CASE WHEN raw_name IS NULL OR regexp_replace(regexp_extract(raw_name, '([^/]*)/*$', 1),
                                                        '[^A-Za-z0-9._-]', '_', 'g') = '' THEN 'document'
                ELSE regexp_replace(regexp_extract(raw_name, '([^/]*)/*$', 1), '[^A-Za-z0-9._-]', '_', 'g')
           END AS safe_name
    FROM fx_names"""))
def sanitize_name(spark, sf_dir):
    return FX.fx_names(spark, sf_dir).select("page_id", "raw_name", X.sanitize_name("raw_name").alias("safe_name"))


@register("clip_note", f"""
    SELECT page_id, CAST(length(n) AS INTEGER) AS note_len, md5(n) AS note_md5
    FROM (SELECT page_id, CASE WHEN length(html) > {S.NOTE_LIMIT} THEN substr(html, 1, {S.NOTE_LIMIT - 3}) || '...'
                               ELSE html END AS n FROM pages)""")
def clip_note(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", X.clip_note("html").alias("n"))
    return p.select("page_id", F.length("n").alias("note_len"), F.md5("n").alias("note_md5"))


@register("text_preview", with_fx(["fx_documents"], f"""
    SELECT document_id, p IS NOT NULL AS has_preview, CAST(length(p) AS INTEGER) AS preview_len, md5(p) AS preview_md5
    FROM (SELECT d.document_id,
                 CASE WHEN lower(d.file_name) LIKE '%.txt' THEN
                      CASE WHEN length(t.text) > {S.PREVIEW_LIMIT}
                           THEN substr(t.text, 1, {S.PREVIEW_LIMIT}) || {q(S.PREVIEW_MARKER).replace(chr(10), "' || chr(10) || '")}
                           ELSE t.text END END AS p
          FROM fx_documents d JOIN documents t ON d.document_id = t.doc_id)"""))
def text_preview(spark, sf_dir):
    d = _docs(spark, sf_dir).select("document_id", "file_name")
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    p = d.join(t, "document_id").select("document_id", X.text_preview("file_name", "text").alias("p"))
    return p.select("document_id", F.col("p").isNotNull().alias("has_preview"), F.length("p").alias("preview_len"),
                    F.md5("p").alias("preview_md5"))


_UPLOADS = [("up", f"""
    SELECT document_id, file_name, uploaded_by, CAST((document_id * 7919) % 25000000 AS BIGINT) AS size_bytes,
           sha256('upload ' || CAST(document_id AS VARCHAR) || chr(10) || CAST(uploaded_by AS VARCHAR)) AS content_hash
    FROM fx_documents"""),
            ("vu", f"""
    SELECT *, CASE WHEN coalesce(size_bytes, 0) <= 0 THEN {q(S.MSG_EMPTY_UPLOAD)}
                   WHEN NOT (lower(file_name) LIKE '%.pdf' OR lower(file_name) LIKE '%.docx' OR lower(file_name) LIKE '%.txt')
                       THEN {q(S.MSG_BAD_EXTENSION)}
                   WHEN size_bytes > {S.MAX_UPLOAD_BYTES} THEN 'Maximum upload size exceeded' END AS error
    FROM up""")]


def _uploads(spark, sf_dir):
    d = _docs(spark, sf_dir)
    body = F.format_string("upload %d\n%d", "document_id", "uploaded_by")        # the uploaded bytes
    return W.validate_uploads(d.select("document_id", "file_name", "uploaded_by", F.encode(body, "UTF-8").alias("content"),
                                       ((F.col("document_id") * 7919) % 25000000).cast("long").alias("size_bytes")))


@register("validate_uploads", with_fx(["fx_documents"], """
    SELECT document_id, file_name, size_bytes, error, error IS NULL AS valid FROM vu""", _UPLOADS))
def validate_uploads(spark, sf_dir):
    return _uploads(spark, sf_dir).select("document_id", "file_name", "size_bytes", "error", "valid")


@register("new_document_defaults", with_fx(["fx_documents"], """
    SELECT document_id, 'Contract' AS document_type, 1 AS version_number, 'Draft' AS status, 'Manual' AS source,
           'doc-' || CAST(document_id AS VARCHAR) || '/v1/' || file_name AS storage_key
    FROM vu WHERE error IS NULL""", _UPLOADS))
def new_document_defaults(spark, sf_dir):
    u = _uploads(spark, sf_dir).where("valid")
    return W.new_document_defaults(u, "Manual").select("document_id", "document_type", "version_number", "status",
                                                       "source", "storage_key")


# ---- integrity -----------------------------------------------------------------

_INTEGRITY = [("ic", """
    SELECT document_id, recorded_hash AS expected, coalesce(sha256(content), 'file missing') AS actual,
           coalesce(sha256(content), 'file missing') = recorded_hash AS matches
    FROM fx_objects""")]


@register("integrity_check", with_fx(["fx_objects"], f"""
    SELECT document_id, {short_hash_sql('expected')} AS expected_short, {short_hash_sql('actual')} AS actual_short,
           matches FROM ic""", _INTEGRITY))
def integrity_check(spark, sf_dir):
    c = W.integrity_check(FX.fx_objects(spark, sf_dir))
    return c.select("document_id", X.short_hash("expected").alias("expected_short"),
                    X.short_hash("actual").alias("actual_short"), "matches")


@register("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.content_hash("text").alias("content_hash"))


@register("short_hash", with_fx(["fx_objects"], f"""
    SELECT document_id, {short_hash_sql('sha256(content)')} AS short_current FROM fx_objects"""))
def short_hash(spark, sf_dir):
    o = FX.fx_objects(spark, sf_dir)
    return o.select("document_id", X.short_hash(F.sha2("content", 256)).alias("short_current"))


@register("verify_integrity", with_fx(["fx_commands", "fx_objects", "fx_documents", "fx_users"], f"""
    SELECT c.cmd_id, c.document_id, c.actor_id AS user_id,
           CASE WHEN ic.matches THEN 'IntegrityVerified' ELSE 'IntegrityCheckFailed' END AS action,
           CASE WHEN ic.matches THEN 'Current file matches recorded SHA-256 ' || {short_hash_sql('ic.actual')}
                ELSE 'Expected ' || {short_hash_sql('ic.expected')} || ' but found ' || {short_hash_sql('ic.actual')}
           END AS notes
    FROM fx_commands c JOIN ic ON c.document_id = ic.document_id
    JOIN fx_documents d ON c.document_id = d.document_id LEFT JOIN fx_users u ON c.actor_id = u.user_id
    WHERE c.command = 'verify' AND coalesce(u.role = 'ReviewerCompliance' OR d.uploaded_by = c.actor_id, false)""",
                                      _INTEGRITY))
def verify_integrity(spark, sf_dir):
    cmds = FX.fx_commands(spark, sf_dir).where(F.col("command") == "verify")
    allowed = W.can_view(cmds, _docs(spark, sf_dir), _users(spark, sf_dir)).where("can_view")
    chk = W.integrity_check(FX.fx_objects(spark, sf_dir))
    j = allowed.select("cmd_id", "document_id", "actor_id").join(chk, "document_id", "inner")
    out = W.verify_integrity_log(j)
    return out.select("cmd_id", "document_id", F.col("actor_id").alias("user_id"), "action", "notes")


# ---- commands ------------------------------------------------------------------

_CMD_STATE = [("cs", """
    SELECT c.*, d.status, d.uploaded_by, d.version_number, d.storage_key, d.file_name
    FROM fx_commands c JOIN fx_documents d ON c.document_id = d.document_id""")]


def _cmds(spark, sf_dir):
    return FX.fx_commands(spark, sf_dir)


@register("duty_violations", with_fx(["fx_commands", "fx_documents"], f"""
    SELECT cmd_id, document_id, command, actor_id, uploaded_by, violation FROM (
        SELECT *, CASE WHEN command IN ('request_revision', 'approve') AND actor_id = uploaded_by
                            THEN {q(S.MSG_SELF_REVIEW)}
                       WHEN command = 'resubmit' AND actor_id <> uploaded_by THEN {q(S.MSG_NOT_OWNER)} END AS violation
        FROM cs) WHERE violation IS NOT NULL""", _CMD_STATE))
def duty_violations(spark, sf_dir):
    return W.duty_violations(_cmds(spark, sf_dir), _docs(spark, sf_dir))


@register("revision_needs_note", with_fx(["fx_commands", "fx_documents"], f"""
    SELECT cmd_id, document_id FROM cs WHERE command = 'request_revision' AND {blank_sql('notes')}""", _CMD_STATE))
def revision_needs_note(spark, sf_dir):
    known = _docs(spark, sf_dir).select("document_id")
    return W.missing_notes(_cmds(spark, sf_dir)).join(known, "document_id").select("cmd_id", "document_id")


@register("submit_manual", with_fx(["fx_documents"], f"""
    SELECT document_id, step, action, user_id, notes FROM (
        SELECT document_id, 1 AS step, 'Uploaded' AS action, uploaded_by AS user_id,
               'Version 1 stored. SHA-256 ' || {short_hash_sql("content_hash")} AS notes FROM vu WHERE error IS NULL
        UNION ALL
        SELECT document_id, 2, 'ClassificationSkipped', NULL, {q(S.NOT_SCORED)} FROM vu WHERE error IS NULL
        UNION ALL
        SELECT document_id, 3, 'ReviewRequested', uploaded_by, NULL FROM vu WHERE error IS NULL)""", _UPLOADS))
def submit_manual(spark, sf_dir):
    """Accepted uploads -> Uploaded, ClassificationSkipped (system), ReviewRequested."""
    u = _uploads(spark, sf_dir).where("valid").withColumn("cmd_id", F.col("document_id"))
    h = F.sha2("content", 256)
    rows = W.command_log_rows(u.withColumn("_h", h), [
        ("Uploaded", F.col("uploaded_by"), F.concat(F.lit("Version 1 stored. SHA-256 "), X.short_hash("_h"))),
        ("ClassificationSkipped", F.lit(None), F.lit(S.NOT_SCORED)),
        ("ReviewRequested", F.col("uploaded_by"), F.lit(None)),
    ])
    return rows.select("document_id", "step", "action", "user_id", "notes")


_MANUAL_DOCS = """
    SELECT document_id, file_name, uploaded_by, 'Contract' AS document_type, 1 AS version_number, 'UnderReview' AS status,
           'Manual' AS source, 'doc-' || CAST(document_id AS VARCHAR) || '/v1/' || file_name AS storage_key,
           content_hash, {note} AS classification_note
    FROM vu WHERE error IS NULL"""


def _manual_docs(spark, sf_dir):
    return W.manual_documents(_uploads(spark, sf_dir).where("valid"), F.sha2("content", 256))


@register("submit_manual_documents", with_fx(["fx_documents"], _MANUAL_DOCS.format(note=q(S.NOT_SCORED)), _UPLOADS))
def submit_manual_documents(spark, sf_dir):
    return _manual_docs(spark, sf_dir).select("document_id", "file_name", "uploaded_by", "document_type", "version_number",
                                              "status", "source", "storage_key", "content_hash", "classification_note")


@register("submit_manual_versions", with_fx(["fx_documents"], """
    SELECT document_id, 1 AS version_number, 'doc-' || CAST(document_id AS VARCHAR) || '/v1/' || file_name AS storage_key,
           content_hash, file_name, uploaded_by AS submitted_by
    FROM vu WHERE error IS NULL""", _UPLOADS))
def submit_manual_versions(spark, sf_dir):
    return W.first_versions(_manual_docs(spark, sf_dir))


@register("submit_manual_rejects", with_fx(["fx_documents"], """
    SELECT document_id, error AS message FROM vu WHERE error IS NOT NULL""", _UPLOADS))
def submit_manual_rejects(spark, sf_dir):
    return _uploads(spark, sf_dir).where("not valid").select("document_id", F.col("error").alias("message"))


# ---- prepared contracts: J9, A12, F13–F15, F20, P12, M4, C1 ---------------------

def _val(j, c):
    return strip_sql(f"json_extract_string({j}, '$.\"' || {c} || '\"')")


_PRESENT = [("pj", f"""
    SELECT doc_id, title, clauses_json, model_input,
           CASE WHEN {blank_sql('clauses_json')} THEN NULL ELSE TRY_CAST(clauses_json AS JSON) END AS j
    FROM fx_clause_json"""),
            ("pr", f"""
    SELECT doc_id, title, clauses_json, model_input, j,
           [c for c in {str_list(S.RISK_CLAUSES)} if coalesce({_val('j', 'c')}, '') <> ''] AS names,
           [{_val('j', 'c')} for c in {str_list(S.RISK_CLAUSES)} if coalesce({_val('j', 'c')}, '') <> ''] AS texts
    FROM pj""")]


def _prepared(spark, sf_dir):
    cj = FX.fx_clause_json(spark, sf_dir)
    m = X.parse_clauses("clauses_json")
    return cj.select("doc_id", "title", "clauses_json", "model_input", m.alias("m")) \
        .withColumn("present", X.present_clauses("m"))


@register("clause_lookup", with_fx(["fx_clause_json"], """
    SELECT doc_id, CAST(len(names) AS INTEGER) AS n_present, array_to_string(names, ', ') AS flagged,
           array_to_string(texts, ' | ') AS snippets FROM pr""", _PRESENT))
def clause_lookup(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    return p.select("doc_id", F.size("present").alias("n_present"), X.flagged_text("present").alias("flagged"),
                    F.array_join(F.transform("present", lambda e: e.getField("text")), " | ").alias("snippets"))


@register("clauses_json", with_fx(["fx_clause_json"], """
    SELECT doc_id,
           CASE WHEN len(names) = 0 THEN '{}'
                ELSE CAST(to_json(map_from_entries(list_transform(list_zip(names, texts),
                                                                  lambda e: {'k': e[1], 'v': e[2]}))) AS VARCHAR)
           END AS clauses_json
    FROM pr""", _PRESENT))
def clauses_json(spark, sf_dir):
    """present clauses re-serialised as a JSON object in the fixed clause order."""
    return _prepared(spark, sf_dir).select("doc_id", X.clauses_json("present").alias("clauses_json"))


@register("clause_count", with_fx(["fx_clause_json"], """
    SELECT doc_id, CAST(len(names) AS INTEGER) AS clause_count FROM pr""", _PRESENT))
def clause_count(spark, sf_dir):
    return _prepared(spark, sf_dir).select("doc_id", X.clause_count("m").alias("clause_count"))


@register("parse_clauses", with_fx(["fx_clause_json"], """
    SELECT doc_id, CAST(coalesce(len(json_keys(j)), 0) AS INTEGER) AS n_keys FROM pj""", _PRESENT))
def parse_clauses(spark, sf_dir):
    return _prepared(spark, sf_dir).select("doc_id", F.size(F.map_keys("m")).alias("n_keys"))


@register("flagged_list", with_fx(["fx_clause_json"], """
    SELECT doc_id, CAST(len(lst) AS INTEGER) AS n_flagged, array_to_string(lst, '|') AS rejoined FROM (
        SELECT doc_id, CASE WHEN f = '' THEN []::VARCHAR[]
                            ELSE [regexp_replace(x, '^\\s+|\\s+$', '', 'g')
                                  for x in string_split(regexp_replace(f, ',+$', ''), ',')] END AS lst
        FROM (SELECT doc_id, array_to_string(names, ', ') AS f FROM pr))""", _PRESENT))
def flagged_list(spark, sf_dir):
    p = _prepared(spark, sf_dir).select("doc_id", X.flagged_text("present").alias("f"))
    lst = X.flagged_list("f")
    return p.select("doc_id", F.size(lst).alias("n_flagged"), F.array_join(lst, "|").alias("rejoined"))


@register("reject_blank_text", with_fx(["fx_clause_json"], f"""
    SELECT doc_id, {blank_sql('model_input')} AS quarantined FROM fx_clause_json"""))
def reject_blank_text(spark, sf_dir):
    cj = FX.fx_clause_json(spark, sf_dir)
    return cj.select("doc_id", X.is_blank("model_input").alias("quarantined"))


_SCORED = _PRESENT + [("sc", f"""
    SELECT pr.doc_id, pr.title, pr.model_input, CAST(len(pr.names) AS INTEGER) AS n_present,
           {label_sql('len(pr.names)')} AS rule_label, array_to_string(pr.names, ', ') AS flagged,
           {str_list(S.LABELS)}[p.predicted + 1] AS model_label,
           CASE WHEN p.predicted IS NOT NULL THEN CAST(pr.doc_id % 100 AS DOUBLE) / 100.0 END AS confidence
    FROM pr LEFT JOIN fx_predictions p ON pr.doc_id = p.doc_id"""),
                      ("sn", f"""
    SELECT *, CAST(n_present AS VARCHAR) || ' of 10 risk clauses present (rule label ' || rule_label || ')' AS rule,
           CASE WHEN {blank_sql('model_input')} THEN 'ClassificationSkipped'
                WHEN model_label IS NULL THEN 'ClassificationSkipped' ELSE 'Classified' END AS action
    FROM sc"""),
                      ("nt", f"""
    SELECT *, CASE WHEN {blank_sql('model_input')} THEN {q(S.MSG_NO_MODEL_INPUT)} || rule || '.'
                   WHEN model_label IS NULL THEN {q(S.MSG_NO_CLASSIFIER)} || rule || '.'
                   ELSE 'Model predicted ' || model_label || ' ('
                        || CAST(CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% confidence). '
                        || rule || '.' END AS note
    FROM sn""")]


def _predictions(spark, sf_dir, risk=None):
    p = FX.fx_predictions(spark, sf_dir, risk)
    return p.select("doc_id", "predicted", ((F.col("doc_id") % 100) / 100.0).alias("confidence"))


def _scored(spark, sf_dir):
    # The per-contract risk rows feed both the prepared files and the
    # predictions: computed once (checkpoint) instead of twice.
    risk = materialize(R.contract_risk_with_firsts(FX.fx_qa(spark, sf_dir, with_context=False)))
    return W.score_prepared(FX.fx_clause_json(spark, sf_dir, risk), _predictions(spark, sf_dir, risk))


@register("score_or_skip", with_fx(["fx_clause_json", "fx_predictions"], """
    SELECT doc_id, n_present, rule_label, model_label, confidence, action, note FROM nt""", _SCORED))
def score_or_skip(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "n_present", "rule_label", "model_label", "confidence", "action",
                                         "note")


@register("classification_note", with_fx(["fx_clause_json", "fx_predictions"], """
    SELECT doc_id, note FROM nt""", _SCORED))
def classification_note(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "note")


@register("submit_prepared", with_fx(["fx_clause_json", "fx_predictions", "fx_objects"], f"""
    SELECT doc_id AS document_id, step, action, user_id, notes FROM (
        SELECT nt.doc_id, 1 AS step, 'Uploaded' AS action, nt.doc_id % 100 AS user_id,
               'Version 1 stored. SHA-256 ' || {short_hash_sql('o.recorded_hash')} AS notes
        FROM nt JOIN fx_objects o ON nt.doc_id = o.document_id
        UNION ALL
        SELECT nt.doc_id, 2, action, NULL, CASE WHEN length(note) > 500 THEN substr(note, 1, 497) || '...' ELSE note END
        FROM nt JOIN fx_objects o ON nt.doc_id = o.document_id
        UNION ALL
        SELECT nt.doc_id, 3, 'ReviewRequested', nt.doc_id % 100, NULL
        FROM nt JOIN fx_objects o ON nt.doc_id = o.document_id)""", _SCORED))
def submit_prepared(spark, sf_dir):
    """Per prepared contract: Uploaded; Classified or ClassificationSkipped (system); ReviewRequested."""
    return W.prepared_log_rows(_scored(spark, sf_dir), FX.fx_objects(spark, sf_dir))


_PREPARED_DOCS = """
    SELECT nt.doc_id AS document_id, nt.title || '.txt' AS file_name,
           'doc-' || CAST(nt.doc_id AS VARCHAR) || '/v1/' || nt.title || '.txt' AS storage_key,
           'Contract' AS document_type, CAST(n_present AS DOUBLE) AS risk_score, rule_label,
           CASE WHEN action = 'Classified' THEN model_label END AS risk_label,
           CASE WHEN action = 'Classified' THEN confidence END AS risk_confidence, flagged AS flagged_clauses,
           CASE WHEN len(pr.names) = 0 THEN '{}'
                ELSE CAST(to_json(map_from_entries(list_transform(list_zip(pr.names, pr.texts),
                                                                  lambda e: {'k': e[1], 'v': e[2]}))) AS VARCHAR)
           END AS clause_snippets,
           CASE WHEN action <> 'Classified' THEN note END AS classification_note, 'CUAD' AS source,
           o.recorded_hash AS content_hash, 'UnderReview' AS status, 1 AS version_number,
           nt.doc_id % 100 AS uploaded_by
    FROM nt JOIN pr ON nt.doc_id = pr.doc_id JOIN fx_objects o ON nt.doc_id = o.document_id"""


@register("submit_prepared_documents", with_fx(["fx_clause_json", "fx_predictions", "fx_objects"], _PREPARED_DOCS, _SCORED))
def submit_prepared_documents(spark, sf_dir):
    return W.prepared_documents(_scored(spark, sf_dir), FX.fx_objects(spark, sf_dir))


@register("submit_prepared_versions", with_fx(["fx_clause_json", "fx_predictions", "fx_objects"], """
    SELECT doc_id AS document_id, 1 AS version_number, 'doc-' || CAST(doc_id AS VARCHAR) || '/v1/' || title || '.txt'
           AS storage_key, o.recorded_hash AS content_hash, title || '.txt' AS file_name, doc_id % 100 AS submitted_by
    FROM nt JOIN fx_objects o ON nt.doc_id = o.document_id""", _SCORED))
def submit_prepared_versions(spark, sf_dir):
    return W.first_versions(W.prepared_documents(_scored(spark, sf_dir), FX.fx_objects(spark, sf_dir)))


@register("submit_prepared_rejects", with_fx(["fx_clause_json", "fx_predictions", "fx_objects"], f"""
    SELECT doc_id AS document_id, {q(S.MSG_UNREADABLE)} || title AS message FROM nt
    WHERE doc_id NOT IN (SELECT document_id FROM fx_objects)""", _SCORED))
def submit_prepared_rejects(spark, sf_dir):
    return W.prepared_rejects(_scored(spark, sf_dir), FX.fx_objects(spark, sf_dir))


# ---- data rules: P13, J10, A19 ------------------------------------------------

@register("domain_checks", with_fx(["fx_documents", "fx_audit", "fx_users", "fx_versions"], QY.DOMAIN_SQL,
                                   _VERSIONED + [("vk", """
    SELECT *, 'doc-' || CAST(document_id AS VARCHAR) || '/v' || CAST(version_number AS VARCHAR) || '/' || file_name
           AS storage_key FROM vv""")]))
def domain_checks(spark, sf_dir):
    v = W.assign_versions(FX.fx_versions(spark, sf_dir))
    v = v.withColumn("storage_key", X.storage_key("document_id", "version_number", "file_name"))
    return QY.domain_checks(_docs(spark, sf_dir), FX.fx_audit(spark, sf_dir), _users(spark, sf_dir), v)


@register("fk_orphans", with_fx(["fx_documents", "fx_audit", "fx_users", "fx_versions"], QY.FK_SQL))
def fk_orphans(spark, sf_dir):
    return QY.fk_orphans(_docs(spark, sf_dir), FX.fx_versions(spark, sf_dir), FX.fx_audit(spark, sf_dir),
                         _users(spark, sf_dir))


@register("unique_checks", with_fx(["fx_documents", "fx_audit", "fx_users", "fx_versions"], QY.UNIQUE_SQL))
def unique_checks(spark, sf_dir):
    return QY.unique_checks(_docs(spark, sf_dir), FX.fx_versions(spark, sf_dir), FX.fx_audit(spark, sf_dir),
                            _users(spark, sf_dir))


# ---- sequential command replay ------------------------------------------------

def _reason_sql(st, hok):
    return f"""CASE
        WHEN c.command = 'resubmit' THEN CASE WHEN NOT c.owner THEN 'not_owner'
                                              WHEN {st} <> 'RevisionRequested' THEN 'bad_state' END
        WHEN c.command = 'request_revision' THEN CASE WHEN NOT c.note_ok THEN 'no_note' WHEN c.owner THEN 'self'
                                                      WHEN {st} <> 'UnderReview' THEN 'illegal_move' END
        WHEN c.command = 'approve' THEN CASE WHEN c.owner THEN 'self' WHEN {st} <> 'UnderReview' THEN 'illegal_move'
                                             WHEN NOT {hok} THEN 'hash' END
        WHEN c.command = 'verify' THEN CASE WHEN NOT c.viewer THEN 'not_viewer' END
        WHEN c.command = 'view' THEN CASE WHEN {st} <> 'UnderReview' THEN 'not_reviewable' END
    END"""


_REPLAY = _INTEGRITY + [
    ("c", f"""
    SELECT x.cmd_id, x.document_id, x.actor_id, x.command, x.notes, x.ts,
           x.actor_id = d.uploaded_by AS owner, NOT {blank_sql('x.notes')} AS note_ok,
           coalesce(u.role = 'ReviewerCompliance' OR x.actor_id = d.uploaded_by, false) AS viewer,
           sha256(coalesce(x.notes, '')) AS new_hash,
           row_number() OVER (PARTITION BY x.document_id ORDER BY x.ts, x.cmd_id) AS i
    FROM fx_commands x JOIN fx_documents d ON x.document_id = d.document_id
    JOIN ic ON x.document_id = ic.document_id LEFT JOIN fx_users u ON x.actor_id = u.user_id"""),
    ("rp", f"""
    SELECT d.document_id, CAST(0 AS BIGINT) AS i, d.status AS st, ic.matches AS hok, 0 AS nres,
           CAST(NULL AS VARCHAR) AS h, CAST(NULL AS BIGINT) AS cid, CAST(NULL AS VARCHAR) AS reason,
           CAST(NULL AS VARCHAR) AS st_before, CAST(NULL AS INTEGER) AS nres_before, CAST(NULL AS VARCHAR) AS h_before
    FROM fx_documents d JOIN ic ON d.document_id = ic.document_id
    WHERE d.document_id IN (SELECT document_id FROM c)
    UNION ALL
    SELECT document_id, i,
           CASE WHEN reason IS NULL AND command = 'resubmit' THEN 'UnderReview'
                WHEN reason IS NULL AND command = 'request_revision' THEN 'RevisionRequested'
                WHEN reason IS NULL AND command = 'approve' THEN 'Locked' ELSE st END,
           CASE WHEN reason IS NULL AND command = 'resubmit' THEN true ELSE hok END,
           nres + CASE WHEN reason IS NULL AND command = 'resubmit' THEN 1 ELSE 0 END,
           CASE WHEN reason IS NULL AND command = 'resubmit' THEN new_hash ELSE h END,
           cmd_id, reason, st, nres, h
    FROM (SELECT r.document_id, c.i, r.st, r.hok, r.nres, r.h, c.cmd_id, c.command, c.new_hash,
                 {_reason_sql('r.st', 'r.hok')} AS reason
          FROM rp r JOIN c ON c.document_id = r.document_id AND c.i = r.i + 1)"""),
    ("rx", """
    SELECT c.cmd_id, c.document_id, c.actor_id, c.command, c.notes, c.new_hash, rp.reason, rp.reason IS NULL AS accepted,
           rp.st_before AS status_before, rp.st AS status_after,
           CAST(d.version_number + rp.nres_before AS INTEGER) AS version_before,
           coalesce(rp.h_before, ic.actual) AS hash_before, coalesce(rp.h_before, ic.expected) AS recorded_before
    FROM rp JOIN c ON rp.cid = c.cmd_id JOIN fx_documents d ON c.document_id = d.document_id
    JOIN ic ON c.document_id = ic.document_id""")]


def _replay(spark, sf_dir):
    return W.command_replay(_cmds(spark, sf_dir), _docs(spark, sf_dir), FX.fx_objects(spark, sf_dir),
                            _users(spark, sf_dir))


@register("command_replay", _rec(with_fx(["fx_commands", "fx_documents", "fx_objects", "fx_users"], """
    SELECT cmd_id, document_id, command, accepted, reason, status_before, status_after, version_before FROM rx""",
                                         _REPLAY)))
def command_replay(spark, sf_dir):
    r = _replay(spark, sf_dir)
    return r.select("cmd_id", "document_id", "command", "accepted", "reason", "status_before", "status_after",
                    "version_before")


_CLIP = "CASE WHEN length({0}) > 500 THEN substr({0}, 1, 497) || '...' ELSE {0} END"


@register("command_log", _rec(with_fx(["fx_commands", "fx_documents", "fx_objects", "fx_users"], f"""
    SELECT cmd_id, document_id, actor_id AS user_id, step, action, {_CLIP.format('notes')} AS notes FROM (
        SELECT cmd_id, document_id, actor_id, 1 AS step, 'Resubmitted' AS action,
               'Version ' || CAST(version_before + 1 AS VARCHAR) || ' stored. SHA-256 ' || {short_hash_sql('new_hash')}
                   AS notes FROM rx WHERE accepted AND command = 'resubmit'
        UNION ALL SELECT cmd_id, document_id, actor_id, 2, 'ReviewRequested', NULL
            FROM rx WHERE accepted AND command = 'resubmit'
        UNION ALL SELECT cmd_id, document_id, actor_id, 1, 'RevisionRequested', {strip_sql('notes')}
            FROM rx WHERE accepted AND command = 'request_revision'
        UNION ALL SELECT cmd_id, document_id, actor_id, 1, 'Approved',
                         CASE WHEN {blank_sql('notes')} THEN NULL ELSE {strip_sql('notes')} END
            FROM rx WHERE accepted AND command = 'approve'
        UNION ALL SELECT cmd_id, document_id, actor_id, 2, 'Locked',
                         'Version ' || CAST(version_before AS VARCHAR) || ' set read-only in local storage, SHA-256 '
                         || {short_hash_sql('hash_before')} || {q(S.LOCK_NOTE_TAIL)}
            FROM rx WHERE accepted AND command = 'approve'
        UNION ALL SELECT cmd_id, document_id, actor_id, 1,
                         CASE WHEN hash_before = recorded_before THEN 'IntegrityVerified' ELSE 'IntegrityCheckFailed' END,
                         CASE WHEN hash_before = recorded_before
                              THEN 'Current file matches recorded SHA-256 ' || {short_hash_sql('hash_before')}
                              ELSE 'Expected ' || {short_hash_sql('recorded_before')} || ' but found '
                                   || {short_hash_sql('hash_before')} END
            FROM rx WHERE accepted AND command = 'verify'
        UNION ALL SELECT cmd_id, document_id, actor_id, 1, 'Viewed', NULL
            FROM rx WHERE accepted AND command = 'view')""", _REPLAY)))
def command_log(spark, sf_dir):
    return W.command_log(_replay(spark, sf_dir)).select("cmd_id", "document_id", "user_id", "step", "action", "notes")


_MESSAGE = f"""CASE reason
        WHEN 'not_owner' THEN {q(S.MSG_NOT_OWNER)} WHEN 'bad_state' THEN {q(S.MSG_RESUBMIT_STATE)}
        WHEN 'no_note' THEN {q(S.MSG_REVISION_NOTE)} WHEN 'self' THEN {q(S.MSG_SELF_REVIEW)}
        WHEN 'illegal_move' THEN {_move_msg_sql('status_before',
                                                "CASE WHEN command = 'approve' THEN 'Approved' ELSE 'RevisionRequested' END")}
        WHEN 'hash' THEN CASE WHEN hash_before = 'file missing'
                              THEN {q(S.MSG_UNREADABLE)} || 'doc-' || CAST(document_id AS VARCHAR) || '/v'
                                   || CAST(version_before AS VARCHAR) || '/' || fn
                              ELSE {q(S.MSG_HASH_MISMATCH)} END
        WHEN 'not_viewer' THEN 'Not your document' END"""
_RX_NAMED = "(SELECT rx.*, d.file_name AS fn FROM rx JOIN fx_documents d ON rx.document_id = d.document_id)"
_REPLAY_FX = ["fx_commands", "fx_documents", "fx_objects", "fx_users"]


@register("command_rejects", _rec(with_fx(_REPLAY_FX, f"""
    SELECT cmd_id, document_id, command, {_MESSAGE} AS message FROM {_RX_NAMED}
    WHERE NOT accepted AND reason <> 'not_reviewable'""", _REPLAY)))
def command_rejects(spark, sf_dir):
    r = _replay(spark, sf_dir)
    rej = r.where(~F.col("accepted") & (F.col("reason") != "not_reviewable"))
    return rej.select("cmd_id", "document_id", "command", W.command_reason_text(rej).alias("message"))


def _command_job(name: str, command: str) -> None:
    """The commands of one kind, judged in request order among all commands."""
    @register(name, _rec(with_fx(_REPLAY_FX, f"""
        SELECT cmd_id, document_id, actor_id, accepted, {_MESSAGE} AS message, status_before, status_after
        FROM {_RX_NAMED} WHERE command = {q(command)}""", _REPLAY)))
    def job(spark, sf_dir):
        return W.command_job(_replay(spark, sf_dir), command)


for _name, _command in (("resubmit", "resubmit"), ("request_revision", "request_revision"),
                        ("approve_and_lock", "approve"), ("record_views", "view")):
    _command_job(_name, _command)


_RESUBMIT_NOTE = [q(x) for x in S.RESUBMIT_NOTE.split("{}")]


#: Commands of documents that do not exist are not in the replayed ones.
_GUARDED = _REPLAY + [("gx", """
    SELECT cmd_id, document_id, command, status_before AS status FROM rx
    UNION ALL SELECT cmd_id, document_id, command, NULL FROM fx_commands
    WHERE document_id IS NULL OR document_id NOT IN (SELECT document_id FROM fx_documents)""")]


@register("resubmit_needs_revision", _rec(with_fx(_REPLAY_FX, """
    SELECT cmd_id, document_id, status FROM gx
    WHERE command = 'resubmit' AND status IS DISTINCT FROM 'RevisionRequested'""", _GUARDED)))
def resubmit_needs_revision(spark, sf_dir):
    """P11 in request order: a document may have been sent back, or resubmitted, by the commands before."""
    r = W.guarded(_replay(spark, sf_dir), "resubmit", "RevisionRequested")
    return r.where("not allowed").select("cmd_id", "document_id", "status")


@register("reviewable_only", _rec(with_fx(_REPLAY_FX, """
    SELECT cmd_id, document_id, coalesce(status = 'UnderReview', false) AS reviewable FROM gx
    WHERE command = 'view'""", _GUARDED)))
def reviewable_only(spark, sf_dir):
    """P14 in request order."""
    return W.guarded(_replay(spark, sf_dir), "view", "UnderReview").select("cmd_id", "document_id", F.col("allowed").alias("reviewable"))


@register("command_documents", _rec(with_fx(_REPLAY_FX, f"""
    SELECT d.document_id, d.file_name,
           CASE WHEN n > 0 THEN 'doc-' || CAST(d.document_id AS VARCHAR) || '/v' || CAST(version_number + n AS VARCHAR)
                                || '/' || file_name ELSE storage_key END AS storage_key,
           CASE WHEN n = 0 THEN risk_score END AS risk_score, CASE WHEN n = 0 THEN rule_label END AS rule_label,
           CASE WHEN n = 0 THEN risk_label END AS risk_label,
           CASE WHEN n = 0 THEN risk_confidence END AS risk_confidence,
           CASE WHEN n > 0 THEN {_RESUBMIT_NOTE[0]} || CAST(version_number + n AS VARCHAR) || {_RESUBMIT_NOTE[1]} END
               AS classification_note,
           coalesce(h, recorded) AS content_hash, coalesce(st, status) AS status, CAST(version_number + n AS INTEGER) AS version_number,
           uploaded_by, note AS reviewer_notes, coalesce(CAST(locked AS TIMESTAMP), locked_at) AS locked_at
    FROM (SELECT d.*, coalesce(a.n, 0) AS n, a.h, a.st, a.note, a.locked, o.recorded_hash AS recorded
          FROM fx_documents d LEFT JOIN fx_objects o ON d.document_id = o.document_id LEFT JOIN
          (SELECT document_id, count_if(command = 'resubmit') AS n,
                  arg_max(new_hash, (ts, cmd_id)) FILTER (command = 'resubmit') AS h,
                  arg_max(status_after, (ts, cmd_id)) FILTER (command IN ('resubmit', 'request_revision', 'approve')) AS st,
                  arg_max({strip_sql('notes')}, (ts, cmd_id))
                      FILTER (command IN ('request_revision', 'approve') AND NOT {blank_sql('notes')}) AS note,
                  max(ts) FILTER (command = 'approve') AS locked
           FROM rt WHERE accepted GROUP BY document_id) a ON d.document_id = a.document_id) d""",
                                            _REPLAY + [("rt", """
    SELECT rx.*, c.ts FROM rx JOIN c ON rx.cmd_id = c.cmd_id""")])))
def command_documents(spark, sf_dir):
    return W.command_documents(_replay(spark, sf_dir), _docs(spark, sf_dir), FX.fx_objects(spark, sf_dir))


@register("command_versions", _rec(with_fx(_REPLAY_FX, """
    SELECT document_id, CAST(version_before + 1 AS INTEGER) AS version_number,
           'doc-' || CAST(document_id AS VARCHAR) || '/v' || CAST(version_before + 1 AS VARCHAR) || '/' || fn AS storage_key,
           new_hash AS content_hash, fn AS file_name, actor_id AS submitted_by, CAST(ts AS TIMESTAMP) AS submitted_at
    FROM (SELECT rx.*, c.ts, d.file_name AS fn FROM rx JOIN c ON rx.cmd_id = c.cmd_id
          JOIN fx_documents d ON rx.document_id = d.document_id)
    WHERE accepted AND command = 'resubmit'""", _REPLAY)))
def command_versions(spark, sf_dir):
    return W.command_versions(_replay(spark, sf_dir))
