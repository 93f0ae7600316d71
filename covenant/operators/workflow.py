"""Document review workflow as bulk DataFrame jobs.

Reads (queue, dashboard, trail, feeds), the lifecycle replay, integrity
checks and the command jobs C1–C7. Each request handler of the reference is
re-aimed as a job: a table of commands in, log rows / accepted / rejected out.

Scale notes
- Every per-document computation is an aggregate or a window keyed by the
  document; dimensions (statuses, actions, roles: a handful of rows) are the
  only broadcasts. Users and documents are joined with ordinary equi-joins
  so Catalyst/AQE choose the strategy by measured size.
- Replays (W6, W7, P8, C3–C7) are order dependent. An event is a function on
  a few states, so bounded blocks of events are folded side by side and their
  functions composed (see ``replay``); no list grows with a hot document.
- Version numbering ranks submissions per document. The rank is computed as
  (rows in earlier minute buckets of the document) + (rank within the
  minute), so no task sorts all versions of a hot document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant import schemas as S
from covenant.functions import text as X
from covenant.operators.replay import Replay, dealt_rank, exact_rank, minute_bucket
from covenant.session import materialize

STATUS_NAMES = [s for s, _ in S.STATUSES]
_STATUS_LABEL = dict(S.STATUSES)
_MOVE_TARGET = dict(S.STATUS_MOVES)


def _case(col, mapping: dict) -> F.Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out


def status_label(col) -> F.Column:
    return _case(F.col(col) if isinstance(col, str) else col, _STATUS_LABEL)


# ---- reads: P4, P5, P6, P15, A10, A11, J4–J7, T1–T3 ------------------------

def my_documents(docs: DataFrame, user_id=None) -> DataFrame:
    """Documents by uploader, newest first (id tie-break). All users when ``user_id`` is None."""
    d = docs if user_id is None else docs.where(F.col("uploaded_by") == user_id)
    return d.orderBy("uploaded_by", F.desc("uploaded_at"), F.desc("document_id"))


def review_queue(docs: DataFrame, users: DataFrame, as_of: str = S.AS_OF) -> DataFrame:
    """P5 + J4 + F12: UnderReview documents, oldest first, with submitter and waiting time."""
    q = docs.where(F.col("status") == "UnderReview")
    j = q.join(users.select(F.col("user_id").alias("uploaded_by"), F.col("name").alias("submitted_by")),
               "uploaded_by", "inner")
    return j.select("document_id", "file_name", "submitted_by", "uploaded_at",
                    X.waiting("uploaded_at", F.lit(as_of).cast("timestamp_ntz")).alias("waiting"),
                    F.coalesce(F.col("risk_label"), F.lit("Not scored")).alias("model_risk"),
                    risk_score_text("risk_score").alias("risk_clauses"),
                    version_note("version_number").alias("version_note")) \
        .orderBy("uploaded_at", "document_id")


def can_view(requests: DataFrame, docs: DataFrame, users: DataFrame,
             actor: str = "actor_id") -> DataFrame:
    """Row-level visibility of (actor, document) requests: reviewers see all, others their own."""
    d = docs.select("document_id", "uploaded_by")
    u = users.select(F.col("user_id").alias(actor), "role")
    j = requests.join(d, "document_id", "left").join(u, actor, "left")
    return j.withColumn("can_view", F.coalesce((F.col("role") == "ReviewerCompliance")
                                               | (F.col("uploaded_by") == F.col(actor)), F.lit(False)))


def scored_flags(docs: DataFrame) -> DataFrame:
    """Scored (label or score present) and locked flags."""
    return docs.select("document_id",
                       (F.col("risk_label").isNotNull() | F.col("risk_score").isNotNull()).alias("scored"),
                       (F.col("status") == "Locked").alias("locked"))


def status_counts(docs: DataFrame) -> DataFrame:
    """A10: documents per status, one grouped count."""
    return docs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def owner_dashboard(docs: DataFrame) -> DataFrame:
    """Per owner needs-revision, in-review and locked counts in one aggregate."""
    return docs.groupBy("uploaded_by").agg(
        F.count_if(F.col("status") == "RevisionRequested").alias("needs_revision"),
        F.count_if(F.col("status") == "UnderReview").alias("in_review"),
        F.count_if(F.col("status") == "Locked").alias("locked"),
        F.count(F.lit(1)).alias("total"))


def docs_with_uploader(docs: DataFrame, users: DataFrame) -> DataFrame:
    """Document -> uploader (mandatory, inner join)."""
    u = users.select(F.col("user_id").alias("uploaded_by"), F.col("name").alias("uploader_name"))
    return docs.join(u, "uploaded_by", "inner")


def audit_feed(log: DataFrame, docs: DataFrame, users: DataFrame,
               system_actor: str = S.SYSTEM_ACTOR) -> DataFrame:
    """J5 + F11 + F19: log -> document (mandatory) and actor (optional; null is the system)."""
    d = docs.select("document_id", "file_name")
    u = users.select("user_id", F.col("name").alias("_actor"), F.lit(0).alias("_salt"))
    # rows without an actor match nothing; the salt keeps them from meeting in one task
    salt = F.when(F.col("user_id").isNull(), F.pmod(F.xxhash64("log_id"), F.lit(1024)).cast("int")).otherwise(0)
    j = log.join(d, "document_id", "inner").withColumn("_salt", salt).join(u, ["user_id", "_salt"], "left")
    a = F.broadcast(S.action_dim(log.sparkSession))
    j = j.join(a, "action", "left")
    return j.select("log_id", "document_id", "file_name", "action", "action_label",
                    F.coalesce(F.col("_actor"), F.lit(system_actor)).alias("actor_name"),
                    "action_ts", X.format_ts("action_ts").alias("when"), "notes")


def recent_audit(log: DataFrame, docs: DataFrame, users: DataFrame, n: int = 300,
                 system_actor: str = S.SYSTEM_ACTOR) -> DataFrame:
    """The latest ``n`` log rows (timestamp desc, id desc) with document and actor.

    Top-k first (TakeOrderedAndProject: per-partition top-n, then a merge of
    n rows per partition). Documents and users are cut to the keys of these n
    rows by a broadcast before anything is shuffled, and the rows sorted again.
    """
    newest = [F.desc("action_ts"), F.desc("log_id")]
    top = materialize(log.orderBy(*newest).limit(n))             # n rows, used three times

    def of_top(dim, key, name):
        keys = F.broadcast(top.select(key).where(F.col(key).isNotNull()).distinct())
        return F.broadcast(dim.select(key, name).join(keys, key, "left_semi"))

    u = of_top(users, "user_id", "name").select("user_id", F.col("name").alias("_actor"))
    j = top.join(of_top(docs, "document_id", "file_name"), "document_id", "left").join(u, "user_id", "left")
    return j.select("log_id", "action_ts", "document_id", "file_name", "action",
                    F.coalesce(F.col("_actor"), F.lit(system_actor)).alias("actor_name"), "notes").orderBy(*newest)


def document_trail(log: DataFrame, document_id=None) -> DataFrame:
    """Log rows of a document (all documents when None), timestamp asc, id asc."""
    d = log if document_id is None else log.where(F.col("document_id") == document_id)
    return d.orderBy("document_id", "action_ts", "log_id")


def versions_with_submitter(versions: DataFrame, users: DataFrame) -> DataFrame:
    """Version -> submitter (inner join)."""
    u = users.select(F.col("user_id").alias("submitted_by"), F.col("name").alias("submitter_name"))
    return versions.join(u, "submitted_by", "inner")


def user_by_email(requests: DataFrame, users: DataFrame, col: str = "email") -> DataFrame:
    """Case-insensitive lookup; unmatched requests keep a null user_id."""
    u = users.select(F.lower("email").alias("_key"), "user_id")
    r = requests.withColumn("_key", F.lower(col))
    return r.join(u, "_key", "left").drop("_key").withColumn("matched", F.col("user_id").isNotNull())


# ---- versions: W1, W2, T3 --------------------------------------------------

VERSION_ORDER = ["submitted_at", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def assign_versions(versions: DataFrame, order: list | None = None, start: DataFrame | None = None,
                    dealt: bool = False) -> DataFrame:
    """First submission is version 1, each later one +1 (per document, in time order); with ``start``
    (document_id, start) numbers go on from there. ``dealt``, if there is no ``start``: rows are left in ranges
    of the document, for ``version_history`` or for one who writes them, and may have the column ``_slice``."""
    order = order or VERSION_ORDER
    if dealt and start is None:
        digests = [c for c in ("content_hash",) if c in versions.columns]
        return dealt_rank(versions, "document_id", order, minute_bucket(order[0]), "version_number", digests)
    # Minute buckets: the running count over buckets is linear, so fine buckets
    # cost little and bound the rows ranked together.
    return exact_rank(versions, "document_id", order, minute_bucket(order[0]), "version_number", start)


def current_version(versions: DataFrame, order: list | None = None) -> DataFrame:
    """Per document the newest submission's key, hash and name.

    The newest version number is the number of submissions, and the newest
    row is the max by the ordering columns, so this is one partial/final
    aggregate (map-side combine) and needs no ranking of all versions.
    """
    order = order or VERSION_ORDER
    g = versions.groupBy("document_id").agg(
        F.count(F.lit(1)).cast("int").alias("version_number"),
        F.max_by(F.struct("content_hash", "file_name"), F.struct(*order)).alias("cur"))
    return g.select("document_id", "version_number",
                    X.storage_key("document_id", "version_number", "cur.file_name").alias("storage_key"),
                    "cur.content_hash", "cur.file_name")


def version_history(versioned: DataFrame) -> DataFrame:
    """Versions newest first (per document). Rows that ``assign_versions`` has dealt by ranges are not shuffled."""
    if "_slice" not in versioned.columns:
        return versioned.orderBy("document_id", F.desc("version_number"))
    return versioned.orderBy("document_id", F.desc("_slice"), F.desc("version_number")).drop("_slice")


# ---- lifecycle: W6, W7, P8 -------------------------------------------------

def _sid(name_col) -> F.Column:
    """Status name -> index 0..4."""
    return F.array_position(F.array(*[F.lit(s) for s in STATUS_NAMES]), name_col).cast("int") - 1


def _sname(idx_col) -> F.Column:
    return F.try_element_at(F.array(*[F.lit(s) for s in STATUS_NAMES]), idx_col + 1)


_LEGAL = {(STATUS_NAMES.index(a), STATUS_NAMES.index(b)) for a, b in S.TRANSITIONS}


def _legal(s, t) -> F.Column:
    cond = F.lit(False)
    for a, b in sorted(_LEGAL):
        cond = cond | ((s == a) & (t == b))
    return cond


def _step(s, t) -> F.Column:
    return F.when(_legal(s, t), t).otherwise(s)       # a null target moves nothing


def _apply_status(s, fn) -> F.Column:
    return F.element_at(fn, s + 1)


def _status_replay(log: DataFrame, fields: list[str]) -> Replay:
    """Replay of log rows on the five statuses; rows that move nothing have a null target."""
    events = log.select("document_id", "log_id", "action", "action_ts",
                        _sid(_case(F.col("action"), _MOVE_TARGET)).alias("target"))
    identity = F.array(*[F.lit(i) for i in range(len(STATUS_NAMES))])
    return Replay(events, "document_id", ["action_ts", "log_id"], minute_bucket("action_ts"), fields, identity,
                  lambda s, x: _step(s, x.getField("target")), _apply_status,
                  counted=lambda x: x.getField("target").isNotNull())


def lifecycle_steps_per_action(log: DataFrame) -> DataFrame:
    """W6/W7 core: every tried move with the status before it and whether it was legal."""
    r = _status_replay(log, ["log_id", "action", "target"]).states("int", F.lit(0))
    x, before = F.col("x"), F.col("enter")
    to = x.getField("target")
    return r.where(to.isNotNull()).select(
        "document_id", x.getField("log_id").cast("bigint").alias("log_id"), x.getField("action").alias("action"),
        _sname(before).alias("from_status"), _sname(to).alias("to_status"), _legal(before, to).alias("legal"))


def move_message(from_status, to_status) -> F.Column:
    """P8 refusal text: "A document that is <from> can't move to <to>." (labels lower-cased)."""
    return F.concat(F.lit("A document that is "), F.lower(status_label(from_status)),
                    F.lit(" can't move to "), F.lower(status_label(to_status)), F.lit("."))


def lifecycle_fold(log: DataFrame) -> DataFrame:
    """Current status per document and the number of moves tried, from one scan of the log.

    Every document in the log appears; documents without a legal move stay Draft.
    """
    end = _status_replay(log, ["target"]).final(F.lit(0))
    return end.select("document_id", _sname(F.col("state")).alias("status"), F.col("n").alias("n_tried"))


def illegal_moves(log: DataFrame) -> DataFrame:
    """Log rows that broke the transition rules, with the refusal text."""
    s = lifecycle_steps_per_action(log).where(~F.col("legal"))
    return s.select("document_id", "log_id", "action", "from_status", "to_status",
                    move_message(F.col("from_status"), F.col("to_status")).alias("message"))


# ---- documents: F7, F18, F21, P7, P17 --------------------------------------

def risk_score_text(col) -> F.Column:
    """'n of 10' or 'n/a'."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNotNull(), F.concat(F.bround(c, 0).cast("long").cast("string"),
                                          F.lit(f" of {len(S.RISK_CLAUSES)}"))).otherwise(F.lit("n/a"))


def version_note(col) -> F.Column:
    """'Version n, resubmitted' when n > 1, else ''."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c > 1, F.concat(F.lit("Version "), c.cast("string"), F.lit(", resubmitted"))).otherwise(F.lit(""))


def risk_facts(docs: DataFrame) -> DataFrame:
    """display facts per document."""
    conf = F.when(F.col("risk_confidence").isNotNull(),
                  F.concat(F.bround(F.col("risk_confidence") * 100, 0).cast("long").cast("string"),
                           F.lit("% confidence"))).otherwise(F.lit(""))
    return docs.select("document_id",
                       F.coalesce(F.col("risk_label"), F.lit("Not scored")).alias("label_text"),
                       risk_score_text("risk_score").alias("score_text"),
                       conf.alias("confidence_text"),
                       version_note("version_number").alias("version_text"))


#: State of each of the five steps by status (d done, c current, t todo, a attention, s skipped when unscored).
STEP_STATES = {"Draft": "ctttt", "UnderReview": "dsctt", "RevisionRequested": "dsatt", "Approved": "dsdct",
               "Locked": "dsddd"}
_STATE_NAME = {"d": "done", "c": "current", "t": "todo", "a": "attention"}


def lifecycle_steps(docs: DataFrame) -> DataFrame:
    """five named steps per document with their states, looked up by status."""
    scored = F.col("risk_label").isNotNull() | F.col("risk_score").isNotNull()
    states = {k: [F.when(scored, "done").otherwise("skipped") if c == "s" else F.lit(_STATE_NAME[c]) for c in v]
              for k, v in STEP_STATES.items()}
    status = F.col("status")
    names = [F.lit(S.STEP_UPLOADED), F.when(scored, S.STEP_SCORED).otherwise(S.STEP_NOT_SCORED),
             F.when(status == "RevisionRequested", S.STEP_REVISION).otherwise(S.STEP_REVIEW),
             F.lit(S.STEP_APPROVED), F.lit(S.STEP_LOCKED)]
    rows = [F.struct(F.lit(n + 1).alias("step_no"), name.alias("step_name"),
                     F.coalesce(*(F.when(status == k, v[n]) for k, v in states.items()), F.lit("todo"))
                     .alias("step_state"))
            for n, name in enumerate(names)]
    return docs.select("document_id", F.inline(F.array(*rows)))


def validate_uploads(uploads: DataFrame, name: str = "file_name", size: str = "size_bytes") -> DataFrame:
    """Error text per upload (null when valid): empty, bad extension, over 20 MB."""
    lower = F.lower(F.coalesce(F.col(name), F.lit("")))
    ext_ok = F.lit(False)
    for e in S.UPLOAD_EXTENSIONS:
        ext_ok = ext_ok | lower.endswith(e)
    err = (F.when(F.coalesce(F.col(size), F.lit(0)) <= 0, F.lit(S.MSG_EMPTY_UPLOAD))
           .when(~ext_ok, F.lit(S.MSG_BAD_EXTENSION))
           .when(F.col(size) > S.MAX_UPLOAD_BYTES, F.lit("Maximum upload size exceeded")))
    return uploads.withColumn("error", err).withColumn("valid", F.col("error").isNull())


def new_document_defaults(uploads: DataFrame, source: str, keep: list[str] | None = None) -> DataFrame:
    """Defaults of a created document (type Contract, version 1, Draft, source, v1 key)."""
    return uploads.select(
        *(keep or []),
        "document_id", "file_name", "uploaded_by",
        F.lit("Contract").alias("document_type"), F.lit(1).alias("version_number"),
        F.lit("Draft").alias("status"), F.lit(source).alias("source"),
        X.storage_key("document_id", F.lit(1), "file_name").alias("storage_key"))


# ---- integrity: J8, F4, F5, C6 ---------------------------------------------

MISSING = "file missing"


def integrity_check(objects: DataFrame) -> DataFrame:
    """Recorded hash vs hash of the current bytes; a missing object reads 'file missing'."""
    actual = F.coalesce(F.sha2(F.col("content"), 256), F.lit(MISSING))
    return objects.select("document_id", F.col("recorded_hash").alias("expected"), actual.alias("actual"),
                          (actual == F.col("recorded_hash")).alias("matches"))


def verify_integrity_log(checked: DataFrame) -> DataFrame:
    """C6 log row per check: IntegrityVerified or IntegrityCheckFailed with the notes text."""
    notes = F.when(F.col("matches"), F.concat(F.lit("Current file matches recorded SHA-256 "),
                                              X.short_hash("actual"))) \
        .otherwise(F.concat(F.lit("Expected "), X.short_hash("expected"), F.lit(" but found "),
                            X.short_hash("actual")))
    return checked.withColumn("action", F.when(F.col("matches"), F.lit("IntegrityVerified"))
                              .otherwise(F.lit("IntegrityCheckFailed"))) \
        .withColumn("notes", X.clip_note(notes))


# ---- commands: P9–P11, P14, C2–C7 ------------------------------------------

def duty_violations(cmds: DataFrame, docs: DataFrame) -> DataFrame:
    """reviewer = uploader on review actions; resubmitter != uploader."""
    j = cmds.join(docs.select("document_id", "uploaded_by"), "document_id")
    msg = (F.when(F.col("command").isin("request_revision", "approve") & (F.col("actor_id") == F.col("uploaded_by")),
                  F.lit(S.MSG_SELF_REVIEW))
           .when((F.col("command") == "resubmit") & (F.col("actor_id") != F.col("uploaded_by")),
                 F.lit(S.MSG_NOT_OWNER)))
    return j.where(msg.isNotNull()).select("cmd_id", "document_id", "command", "actor_id", "uploaded_by",
                                           msg.alias("violation"))


def missing_notes(cmds: DataFrame) -> DataFrame:
    """P10: revision requests without a note."""
    return cmds.where((F.col("command") == "request_revision") & X.is_blank("notes")).select("cmd_id", "document_id")


def command_log_rows(accepted: DataFrame, steps: list[tuple[str, F.Column, F.Column]]) -> DataFrame:
    """Explode one accepted command into its ordered log rows (UDTF-shaped, ``inline``)."""
    arr = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(a).alias("action"), actor.cast("bigint").alias("user_id"),
                             notes.cast("string").alias("notes"))
                    for i, (a, actor, notes) in enumerate(steps)])
    return accepted.select("cmd_id", "document_id", F.inline(arr))


# ---- prepared contracts: J9, F13, F20, M4, C1 --------------------------------

def score_prepared(prepared: DataFrame, predictions: DataFrame) -> DataFrame:
    """M4 + J9 + F20: rule score from the clause JSON, model label if any, note and action.

    ``prepared``: doc_id, title, clauses_json, model_input. ``predictions``:
    doc_id, predicted (label id, null when the model gave nothing), confidence.
    A missing prediction downgrades to rule-only with a reason (left join).
    Stateless per row, so it runs unchanged on a stream.
    """
    m = X.parse_clauses("clauses_json")
    p = prepared.select("doc_id", "title", "model_input", X.present_clauses(m).alias("present"))
    j = p.join(predictions.select("doc_id", "predicted", "confidence"), "doc_id", "left")
    n = F.size("present")
    return judged(j.select("doc_id", "title", "model_input", "present", n.alias("n_present"), X.risk_label(n).alias("rule_label"),
                           X.flagged_text("present").alias("flagged"), "predicted", "confidence"))


def rule_scored(prepared: DataFrame) -> DataFrame:
    """Rule score of prepared contracts that wait for a prediction (doc_id, title, arrived_at), without their
    texts: of the model's input one character is kept, which tells whether it is blank."""
    n = F.size(X.present_clauses(X.parse_clauses("clauses_json")))
    return prepared.select("doc_id", "title", F.when(~X.is_blank("model_input"), F.lit("x")).alias("model_input"),
                           n.alias("n_present"), X.risk_label(n).alias("rule_label"), "arrived_at")


def judged(j: DataFrame) -> DataFrame:
    """label, action and note of scored contracts with ``predicted`` and ``confidence``, null where none came."""
    j = j.withColumn("model_label", X.id_label("predicted")) \
        .withColumn("confidence", F.when(F.col("predicted").isNotNull(), F.col("confidence"))).drop("predicted")
    action = F.when(X.is_blank("model_input") | F.col("model_label").isNull(), F.lit("ClassificationSkipped")) \
        .otherwise(F.lit("Classified"))
    note = X.classification_note("n_present", "rule_label", "model_input", "model_label", "confidence")
    return j.withColumn("action", action).withColumn("note", note)


def _stored(scored: DataFrame, objects: DataFrame, uploader: F.Column | None = None) -> DataFrame:
    """Scored contracts whose text is stored, with its hash and the submitter."""
    o = objects.select(F.col("document_id").alias("doc_id"), "recorded_hash")
    up = uploader if uploader is not None else F.col("doc_id") % 100
    return scored.join(o, "doc_id").withColumn("uploader", up.cast("bigint"))


def prepared_rejects(scored: DataFrame, objects: DataFrame) -> DataFrame:
    """C1 rejects: contracts without a stored text."""
    o = objects.select(F.col("document_id").alias("doc_id"))
    return scored.join(o, "doc_id", "left_anti").select(
        F.col("doc_id").alias("document_id"), F.concat(F.lit(S.MSG_UNREADABLE), F.col("title")).alias("message"))


def prepared_documents(scored: DataFrame, objects: DataFrame, uploader: F.Column | None = None) -> DataFrame:
    """C1 documents: created, scored by rule, classified or not, and sent for review."""
    j = _stored(scored, objects, uploader)
    name = F.concat("title", F.lit(".txt"))
    model = F.col("action") == "Classified"
    return j.select(
        F.col("doc_id").alias("document_id"), name.alias("file_name"),
        X.storage_key("doc_id", F.lit(1), name).alias("storage_key"), F.lit("Contract").alias("document_type"),
        F.col("n_present").cast("double").alias("risk_score"), "rule_label",
        F.when(model, F.col("model_label")).alias("risk_label"), F.when(model, F.col("confidence")).alias("risk_confidence"),
        F.col("flagged").alias("flagged_clauses"), X.clauses_json("present").alias("clause_snippets"),
        F.when(~model, F.col("note")).alias("classification_note"), F.lit("CUAD").alias("source"),
        F.col("recorded_hash").alias("content_hash"), F.lit("UnderReview").alias("status"),
        F.lit(1).alias("version_number"), F.col("uploader").alias("uploaded_by"))


def manual_documents(uploads: DataFrame, content_hash: F.Column) -> DataFrame:
    """C2 documents: accepted uploads, not scored, sent for review."""
    d = new_document_defaults(uploads.withColumn("_hash", content_hash), "Manual", keep=["_hash"])
    return d.withColumn("status", F.lit("UnderReview")).withColumn("classification_note", F.lit(S.NOT_SCORED)) \
        .withColumnRenamed("_hash", "content_hash")


def first_versions(docs: DataFrame) -> DataFrame:
    """C1, C2 versions: version 1 of every created document."""
    return docs.select("document_id", F.lit(1).alias("version_number"), "storage_key", "content_hash", "file_name",
                       F.col("uploaded_by").cast("bigint").alias("submitted_by"))


def prepared_log_rows(scored: DataFrame, objects: DataFrame, uploader: F.Column | None = None) -> DataFrame:
    """C1 log rows: Uploaded; Classified or ClassificationSkipped (system, no actor); ReviewRequested."""
    j = _stored(scored, objects, uploader).select(
        F.col("doc_id").alias("document_id"), "uploader", "recorded_hash", "action", "note")
    steps = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("Uploaded").alias("action"), F.col("uploader").cast("bigint").alias("user_id"),
                 F.concat(F.lit("Version 1 stored. SHA-256 "), X.short_hash("recorded_hash")).alias("notes")),
        F.struct(F.lit(2).alias("step"), F.col("action").alias("action"), F.lit(None).cast("bigint").alias("user_id"),
                 X.clip_note("note").alias("notes")),
        F.struct(F.lit(3).alias("step"), F.lit("ReviewRequested").alias("action"),
                 F.col("uploader").cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("notes")),
    )
    return j.select("document_id", F.inline(steps))


# ---- sequential command replay (C3–C7 in request order) ----------------------
#
# State per document: (status, stored bytes match the recorded hash), encoded
# s = status_index * 2 + hash_ok, ten states. Each command is a function on
# the ten states (its guards on actor, owner, note and role are fixed per
# command). Alongside the state, a function carries the number of accepted
# resubmissions (version increments) and the hash of the last one.

_UR, _RR, _LK = STATUS_NAMES.index("UnderReview"), STATUS_NAMES.index("RevisionRequested"), \
    STATUS_NAMES.index("Locked")


def _cmd_reason(s, x) -> F.Column:
    st = F.shiftright(s, 1)
    h = s.bitwiseAND(F.lit(1))
    c = x.getField("command")
    own, note, viewer = x.getField("owner"), x.getField("note_ok"), x.getField("viewer")
    return (F.when(c == "resubmit", F.when(~own, F.lit("not_owner")).when(st != _RR, F.lit("bad_state")))
            .when(c == "request_revision", F.when(~note, F.lit("no_note")).when(own, F.lit("self"))
                  .when(st != _UR, F.lit("illegal_move")))
            .when(c == "approve", F.when(own, F.lit("self")).when(st != _UR, F.lit("illegal_move"))
                  .when(h == 0, F.lit("hash")))
            .when(c == "verify", F.when(~viewer, F.lit("not_viewer")))
            .when(c == "view", F.when(st != _UR, F.lit("not_reviewable"))))


def _cmd_next(s, x) -> F.Column:
    ok = _cmd_reason(s, x).isNull()
    c = x.getField("command")
    h = s.bitwiseAND(F.lit(1))
    return (F.when(ok & (c == "resubmit"), F.lit(_UR * 2 + 1))
            .when(ok & (c == "request_revision"), F.lit(_RR * 2) + h)
            .when(ok & (c == "approve"), F.lit(_LK * 2) + h)
            .otherwise(s))


def _cmd_apply(e, x) -> F.Column:
    """One command on one (s, r, h) triple."""
    s = e.getField("s")
    res = (x.getField("command") == "resubmit") & _cmd_reason(s, x).isNull()
    return F.struct(_cmd_next(s, x).alias("s"), (e.getField("r") + F.when(res, 1).otherwise(0)).alias("r"),
                    F.when(res, x.getField("new_hash")).otherwise(e.getField("h")).alias("h"))


def _apply_cmd_fn(e, fn) -> F.Column:
    """Run a chunk function (10 entries of (s, r, h)) on an entering (s, r, h)."""
    f = F.element_at(fn, e.getField("s") + 1)
    return F.struct(f.getField("s").alias("s"), (e.getField("r") + f.getField("r")).alias("r"),
                    F.coalesce(f.getField("h"), e.getField("h")).alias("h"))


_TRIPLE = "struct<s:int,r:int,h:string>"


def command_replay(cmds: DataFrame, docs: DataFrame, objects: DataFrame, users: DataFrame) -> DataFrame:
    """C3–C7 replayed per document in (ts, cmd_id) order against the evolving state.

    One row per command: accepted, reason code, status before/after, version
    and current hash before. Documents start from ``docs`` (status, version)
    and ``objects`` (whether the stored bytes match, current hash); a document
    without a stored object reads 'file missing'. Commands for documents that
    do not exist are refused with reason ``unknown``.
    """
    # One row per document; hashing every stored object is the costly part,
    # so the state table is computed once and read three times.
    chk = integrity_check(objects).select("document_id", "expected", "actual", "matches")
    state = materialize(docs.select("document_id", "status", "uploaded_by", "version_number", "file_name")
                        .join(chk, "document_id", "left")
                        .withColumn("actual", F.coalesce("actual", F.lit(MISSING)))
                        .withColumn("matches", F.coalesce("matches", F.lit(False)))
                        .withColumn("s0", _sid(F.col("status")) * 2 + F.col("matches").cast("int")))
    u = users.select(F.col("user_id").alias("actor_id"), "role")
    c = (cmds.join(state.select("document_id", "uploaded_by", F.lit(True).alias("known")), "document_id", "left")
         .join(u, "actor_id", "left")
         .select("cmd_id", "document_id", "actor_id", "command", "notes", "ts", "known",
                 F.coalesce(F.col("actor_id") == F.col("uploaded_by"), F.lit(False)).alias("owner"),
                 (~X.is_blank("notes")).alias("note_ok"),
                 F.coalesce((F.col("role") == "ReviewerCompliance") | (F.col("actor_id") == F.col("uploaded_by")),
                            F.lit(False)).alias("viewer"),
                 F.sha2(F.coalesce(F.col("notes"), F.lit("")), 256).alias("new_hash")))
    none = F.lit(None).cast("string")
    identity = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(0).alias("r"), none.alias("h"))
                         for i in range(2 * len(STATUS_NAMES))])
    fields = ["cmd_id", "command", "owner", "note_ok", "viewer", "new_hash", "actor_id", "notes", "ts"]
    replay = Replay(c.where("known"), "document_id", ["ts", "cmd_id"], minute_bucket("ts"), fields, identity,
                    _cmd_apply, _apply_cmd_fn)
    start = F.struct(F.col("s0").alias("s"), F.lit(0).alias("r"), none.alias("h"))
    r = replay.states(_TRIPLE, start, state.select("document_id", "s0"))
    x, s = F.col("x"), F.col("enter.s")
    j = (r.select("document_id", *(x.getField(f).alias(f) for f in ("cmd_id", "actor_id", "command", "notes", "new_hash", "ts")),
                  "enter", _cmd_reason(s, x).alias("reason"), _cmd_next(s, x).alias("s_after"))
         .join(state.select("document_id", "version_number", "file_name", "expected", "actual"), "document_id"))
    known = j.select(
        "cmd_id", "document_id", "actor_id", "command", "notes", "new_hash", "ts", "reason",
        F.col("reason").isNull().alias("accepted"),
        _sname(F.shiftright("enter.s", 1)).alias("status_before"),
        _sname(F.shiftright("s_after", 1)).alias("status_after"),
        (F.col("version_number") + F.col("enter.r")).alias("version_before"),
        F.coalesce("enter.h", "actual").alias("hash_before"),
        F.coalesce("enter.h", "expected").alias("recorded_before"),
        "file_name")
    unknown = c.where("known is null").select(
        "cmd_id", "document_id", "actor_id", "command", "notes", "new_hash", "ts", F.lit("unknown").alias("reason"),
        F.lit(False).alias("accepted"), none.alias("status_before"), none.alias("status_after"),
        F.lit(None).cast("int").alias("version_before"), none.alias("hash_before"), none.alias("recorded_before"),
        none.alias("file_name"))
    return known.unionByName(unknown)


def command_documents(replay: DataFrame, docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """C3–C7 documents: every document as it is after the accepted commands.

    A resubmission sets version, key and hash and clears the scores; other documents keep the
    recorded hash of ``hashes`` (document_id, recorded_hash). The last accepted note
    of a review becomes the reviewer notes; approval sets the lock time.
    """
    when = F.struct("ts", "cmd_id")
    c = F.col("command")
    note = F.when(~X.is_blank("notes") & c.isin("request_revision", "approve"), X.strip("notes"))
    moves = c.isin("resubmit", "request_revision", "approve")
    per = (replay.where("accepted").groupBy("document_id").agg(
        F.max_by("status_after", F.when(moves, when)).alias("_status"),
        F.count_if(c == "resubmit").cast("int").alias("_n"),
        F.max_by("new_hash", F.when(c == "resubmit", when)).alias("_hash"),
        F.max_by(note, F.when(note.isNotNull(), when)).alias("reviewer_notes"),
        F.max(F.when(c == "approve", F.col("ts"))).alias("_locked")))
    j = docs.join(per, "document_id", "left").join(hashes.select("document_id", "recorded_hash"), "document_id", "left")
    n = F.coalesce("_n", F.lit(0))
    again = n > 0
    version = (F.col("version_number") + n).cast("int")
    key = X.storage_key("document_id", version, "file_name")
    return j.select(
        "document_id", "file_name", F.when(again, key).otherwise(F.col("storage_key")).alias("storage_key"),
        *(F.when(~again, F.col(k)).alias(k) for k in ("risk_score", "rule_label", "risk_label", "risk_confidence")),
        F.when(again, F.format_string(S.RESUBMIT_NOTE.replace("{}", "%d"), version)).alias("classification_note"),
        F.coalesce("_hash", "recorded_hash").alias("content_hash"), F.coalesce("_status", "status").alias("status"),
        version.alias("version_number"), "uploaded_by", "reviewer_notes",
        F.coalesce(F.col("_locked").cast("timestamp_ntz"), F.col("locked_at")).alias("locked_at"))


def guarded(replay: DataFrame, command: str, status: str) -> DataFrame:
    """Commands of a kind against the status that they need, as it is when their turn comes;
    a command for a document that does not exist has no status."""
    return (replay.where(F.col("command") == command)
            .select("cmd_id", "document_id", F.col("status_before").alias("status"),
                    F.coalesce(F.col("status_before") == status, F.lit(False)).alias("allowed")))


def command_versions(replay: DataFrame) -> DataFrame:
    """C3 versions: one row per accepted resubmission."""
    v = (F.col("version_before") + 1).cast("int")
    return replay.where("accepted and command = 'resubmit'").select(
        "document_id", v.alias("version_number"), X.storage_key("document_id", v, "file_name").alias("storage_key"),
        F.col("new_hash").alias("content_hash"), "file_name", F.col("actor_id").alias("submitted_by"),
        F.col("ts").alias("submitted_at"))


def command_job(replay: DataFrame, command: str) -> DataFrame:
    """One row per command of a kind, judged in request order: accepted or refused with the message.

    A view of a document that is not under review is neither: it is not logged.
    """
    r = replay.where(F.col("command") == command)
    return r.select("cmd_id", "document_id", "actor_id", "accepted", command_reason_text(r).alias("message"),
                    "status_before", "status_after")


def command_reason_text(replay: DataFrame) -> F.Column:
    """Reason code -> the reference's message."""
    key = F.concat(F.lit("doc-"), F.col("document_id").cast("string"), F.lit("/v"),
                   F.col("version_before").cast("string"), F.lit("/"), X.sanitize_name("file_name"))
    target = F.when(F.col("command") == "approve", F.lit("Approved")).otherwise(F.lit("RevisionRequested"))
    r = F.col("reason")
    return (F.when(r == "not_owner", F.lit(S.MSG_NOT_OWNER))
            .when(r == "bad_state", F.lit(S.MSG_RESUBMIT_STATE))
            .when(r == "no_note", F.lit(S.MSG_REVISION_NOTE))
            .when(r == "self", F.lit(S.MSG_SELF_REVIEW))
            .when(r == "illegal_move", move_message(F.col("status_before"), target))
            .when((r == "hash") & (F.col("hash_before") == MISSING), F.concat(F.lit(S.MSG_UNREADABLE), key))
            .when(r == "hash", F.lit(S.MSG_HASH_MISMATCH))
            .when(r == "not_viewer", F.lit("Not your document"))
            .when(r == "unknown", F.format_string(S.MSG_UNKNOWN_DOCUMENT.replace("{}", "%d"), F.col("document_id"))))


def command_log(replay: DataFrame) -> DataFrame:
    """Log rows emitted by the accepted commands of a replay, in order per command."""
    ok = replay.where("accepted")
    v1 = F.col("version_before") + 1
    stripped = F.when(X.is_blank("notes"), F.lit(None).cast("string")).otherwise(X.strip("notes"))
    matches = F.col("hash_before") == F.col("recorded_before")
    verify_note = F.when(matches, F.concat(F.lit("Current file matches recorded SHA-256 "), X.short_hash("hash_before"))) \
        .otherwise(F.concat(F.lit("Expected "), X.short_hash("recorded_before"), F.lit(" but found "),
                            X.short_hash("hash_before")))
    lock_note = F.concat(F.lit("Version "), F.col("version_before").cast("string"),
                         F.lit(" set read-only in local storage, SHA-256 "), X.short_hash("hash_before"),
                         F.lit(S.LOCK_NOTE_TAIL))
    none = F.lit(None).cast("string")

    def row(step, action, notes):
        return F.struct(F.lit(step).alias("step"), action.alias("action"), X.clip_note(notes).alias("notes"))

    c = F.col("command")
    rows = (F.when(c == "resubmit", F.array(
                row(1, F.lit("Resubmitted"), F.concat(F.lit("Version "), v1.cast("string"),
                                                      F.lit(" stored. SHA-256 "), X.short_hash("new_hash"))),
                row(2, F.lit("ReviewRequested"), none)))
            .when(c == "request_revision", F.array(row(1, F.lit("RevisionRequested"), X.strip("notes"))))
            .when(c == "approve", F.array(row(1, F.lit("Approved"), stripped), row(2, F.lit("Locked"), lock_note)))
            .when(c == "verify", F.array(row(1, F.when(matches, F.lit("IntegrityVerified"))
                                             .otherwise(F.lit("IntegrityCheckFailed")), verify_note)))
            .when(c == "view", F.array(row(1, F.lit("Viewed"), none))))
    return ok.select("cmd_id", "document_id", F.col("actor_id").alias("user_id"), F.inline(rows))
