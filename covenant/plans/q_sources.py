"""Source / sink keys: S2–S9, S11, S12, T4, T5."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenant.functions import text as X
from covenant.operators import risk as R
from covenant.operators import split as SP
from covenant.operators import workflow as W
from covenant.plans.catalog import ORACLE, _qa, register
from covenant.plans.q_split import _CTES, _split
from covenant.plans.q_workflow import _REPLAY, _REPLAY_FX, _rec, _replay, _scored
from covenant.plans.sqlparts import RISK_IN, with_fx
from covenant.sources import files as FS
from covenant.sources import fixtures as FX
from covenant.sources import objects as OB
from covenant.streaming.jobs import run_dir


@register("take_subset", with_fx(["fx_qa"], """
    SELECT doc_id, row_ord, title, question FROM fx_qa ORDER BY doc_id, row_ord LIMIT 2000"""))
def take_subset(spark, sf_dir):
    qa = _qa(spark, sf_dir).select("doc_id", "row_ord", "title", "question")
    return FS.take_subset(qa, 2000, ["doc_id", "row_ord"])


@register("save_dataset", with_fx(["fx_qa"], """
    SELECT doc_id, row_ord, title, question, answers.text[1] AS answer FROM fx_qa"""))
def save_dataset(spark, sf_dir):
    qa = _qa(spark, sf_dir).select("doc_id", "row_ord", "title", "question",
                                   F.try_element_at("answers.text", F.lit(1)).alias("answer"))
    path = run_dir(spark, "dataset")
    FS.save_dataset(qa, path)
    again = FS.save_dataset(qa.limit(0), path)   # target exists: skipped, data unchanged
    return again


_DOC_COLS = [("document_id", "bigint"), ("file_name", "string"), ("storage_key", "string"),
             ("document_type", "string"), ("risk_score", "double"), ("rule_label", "string"),
             ("risk_label", "string"), ("risk_confidence", "double"), ("source", "string"), ("status", "string"),
             ("version_number", "int"), ("uploaded_by", "bigint"), ("uploaded_at", "timestamp_ntz"),
             ("locked_at", "timestamp_ntz")]


@register("profile_dataset", with_fx(["fx_documents"], "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS data_type, count({c}) AS non_null, "
    + (f"CAST(arg_min({c}, document_id) FILTER (document_id = (SELECT min(document_id) FROM fx_documents)) AS VARCHAR)"
       if t in ("bigint", "string", "int") else "CAST(NULL AS VARCHAR)")
    + " AS first_value, count(*) AS n_rows FROM fx_documents" for c, t in _DOC_COLS)))
def profile_dataset(spark, sf_dir):
    p = FS.profile_dataset(FX.fx_documents(spark, sf_dir), first_by=["document_id"])
    # the text form of floating and time values differs between engines
    return p.withColumn("first_value", F.when(F.col("data_type").isin("bigint", "string", "int"), F.col("first_value")))


@register("profile_splits", with_fx(["fx_risk"], """
    SELECT split, count(*) AS n_rows FROM split_all GROUP BY split""", _CTES))
def profile_splits(spark, sf_dir):
    return FS.profile_splits(_split(spark, sf_dir), "split")


@register("page_text_join", with_fx(["fx_pages"], """
    SELECT document, count(*) AS n_pages, CAST(length(t) AS INTEGER) AS text_len, left(t, 2000) AS head, md5(t) AS text_md5
    FROM (SELECT document, string_agg(coalesce(text, ''), chr(10) ORDER BY page) OVER (PARTITION BY document) AS t
          FROM fx_pages)
    GROUP BY document, t"""))
def page_text_join(spark, sf_dir):
    return FS.page_text_join(FX.fx_pages(spark, sf_dir))


# ---- export, snippets, listing, texts -----------------------------------------

def _export(spark, sf_dir) -> str:
    """All contracts exported; every fifth record broken, every third text missing."""
    risk = R.contract_risk(_qa(spark, sf_dir))
    split = _split(spark, sf_dir).select("title", "split")
    rec = SP.export_records(risk.join(split, "title"), _qa(spark, sf_dir, context=True), sampled=False)
    rec = SP.safe_ids(rec, "title", "title")
    base = run_dir(spark, "export")
    k = F.col("title").cast("long")
    FS.export_contracts(rec, base, corrupt=(k % 5 == 0), with_text=(k % 3 != 0))
    return base


_EXPORT_FX = ["fx_risk", "fx_first_answers", "fx_qa"]
_EXPORTED = _CTES + [("ex", f"""
    SELECT p.title, p.split, p.risk_score, p.risk_label, p.risk_text, CAST(p.title AS BIGINT) AS k,
           CAST(coalesce(n.n_clauses, 0) AS INTEGER) AS n_clauses, x.context
    FROM split_all p
    LEFT JOIN (SELECT title, count(*) AS n_clauses FROM fx_first_answers WHERE clause IN {RISK_IN} GROUP BY title) n
         ON p.title = n.title
    LEFT JOIN (SELECT title, arg_min(context, row_ord) AS context FROM fx_qa GROUP BY title) x ON p.title = x.title""")]


@register("read_snippets", with_fx(_EXPORT_FX, """
    SELECT title AS safe_id, k % 5 = 0 AS is_corrupt,
           CASE WHEN k % 5 <> 0 THEN title END AS title, CASE WHEN k % 5 <> 0 THEN split END AS split,
           CASE WHEN k % 5 <> 0 THEN risk_score END AS risk_score,
           CASE WHEN k % 5 <> 0 THEN risk_label END AS risk_label,
           CASE WHEN k % 5 <> 0 THEN n_clauses END AS n_clauses,
           CASE WHEN k % 5 <> 0 THEN risk_text END AS model_input
    FROM ex""", _EXPORTED))
def read_snippets(spark, sf_dir):
    s = FS.read_snippets(spark, f"{_export(spark, sf_dir)}/snippets")
    return s.select("safe_id", F.col("_corrupt").isNotNull().alias("is_corrupt"),
                    "title", "split", "risk_score", "risk_label", F.size("clauses").alias("n_clauses"),
                    "model_input")


_LISTING = """
    SELECT title AS id, title, n_clauses AS clause_count FROM ex WHERE k % 5 <> 0 AND k % 3 <> 0"""


def _listing(spark, sf_dir):
    base = _export(spark, sf_dir)
    return FS.list_contracts(FS.read_snippets(spark, f"{base}/snippets"), FS.read_contract_text(spark, f"{base}/texts"))


@register("list_contracts", with_fx(_EXPORT_FX, _LISTING, _EXPORTED))
def list_contracts(spark, sf_dir):
    return _listing(spark, sf_dir)


@register("contracts_by_title", with_fx(_EXPORT_FX, f"""
    SELECT row_number() OVER (ORDER BY lower(title), id) AS place, id, title FROM ({_LISTING})""", _EXPORTED))
def contracts_by_title(spark, sf_dir):
    """T4: the listing in case-insensitive title order, with each contract's place."""
    from covenant.operators.replay import range_rank

    listed = _listing(spark, sf_dir).withColumn("k", F.lower("title"))
    return range_rank(listed, [], ["k", "id"], "place").select("place", "id", "title")


@register("read_contract_text", with_fx(_EXPORT_FX, """
    SELECT title AS safe_id, CAST(length(context) AS INTEGER) AS n_chars, md5(context) AS text_md5 FROM ex WHERE k % 3 <> 0""",
                                        _EXPORTED))
def read_contract_text(spark, sf_dir):
    t = FS.read_contract_text(spark, f"{_export(spark, sf_dir)}/texts")
    return t.select("safe_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


_OBJECT_NAME = "'part ' || CAST(document_id % 7 AS VARCHAR) || '.txt'"


def _stored_objects(spark, sf_dir) -> str:
    """The objects of the fixture, each as one file; every fifth document has an empty second version."""
    base = run_dir(spark, "objects")
    o = FX.fx_objects(spark, sf_dir).where("content is not null") \
        .select("document_id", F.concat(F.lit("part "), (F.col("document_id") % 7).cast("string"), F.lit(".txt")).alias("name"), "content")
    first = o.withColumn("version", F.lit(1))
    second = o.where("document_id % 5 = 0").withColumns({"version": F.lit(2), "content": F.lit(b"")})
    made = OB.store_objects(first.unionByName(second), base)
    if not made.where("outcome != 'stored'").isEmpty():
        raise ValueError("an object was not stored")
    return base


_OBJECTS = ("ob", f"""
    SELECT document_id, v AS version, replace({_OBJECT_NAME}, ' ', '_') AS name,
           CASE WHEN v = 1 THEN content ELSE encode('') END AS content
    FROM fx_objects, (VALUES (1), (2)) t(v) WHERE content IS NOT NULL AND (v = 1 OR document_id % 5 = 0)""")


@register("read_objects", with_fx(["fx_objects"], """
    SELECT document_id, version, name, 'doc-' || document_id || '/v' || version || '/' || name AS key,
           CAST(octet_length(content) AS BIGINT) AS length, sha256(content) AS content_sha256
    FROM ob""", [_OBJECTS]))
def read_objects(spark, sf_dir):
    """Every object below the base, listed in tasks and read back byte for byte."""
    base = _stored_objects(spark, sf_dir)
    o = OB.read_tree(OB.list_objects(spark, base), base)
    return o.select("document_id", "version", "name", "key", "length", F.sha2("content", 256).alias("content_sha256"))


@register("read_object_keys", with_fx(["fx_objects"], """
    SELECT f.document_id, ob.content IS NOT NULL AS found, CAST(octet_length(ob.content) AS BIGINT) AS length,
           sha256(ob.content) AS content_sha256
    FROM fx_objects f LEFT JOIN ob ON f.document_id = ob.document_id AND ob.version = 1""", [_OBJECTS]))
def read_object_keys(spark, sf_dir):
    """S9 by key: the first version of each document; without an object there is nothing to find."""
    base = _stored_objects(spark, sf_dir)
    name = F.concat(F.lit("part "), (F.col("document_id") % 7).cast("string"), F.lit(".txt"))
    keys = FX.fx_objects(spark, sf_dir).select("document_id", X.storage_key("document_id", F.lit(1), name).alias("key"))
    o = OB.read_keys(keys, base)
    return o.select("document_id", F.col("content").isNotNull().alias("found"), "length", F.sha2("content", 256).alias("content_sha256"))


# ---- append-only audit log (S12) -----------------------------------------------

@register("append_audit")
def append_audit(spark, sf_dir):
    """C1 rows and C7 view rows appended to one insert-only log, read back."""
    sink = run_dir(spark, "audit")
    c1 = W.prepared_log_rows(_scored(spark, sf_dir), FX.fx_objects(spark, sf_dir))
    c7 = W.command_log(_replay(spark, sf_dir)).where("action = 'Viewed'") \
        .select("document_id", "step", "action", "user_id", "notes")
    FS.append_log(c1.select("document_id", "step", "action", "user_id", "notes"), sink)
    return FS.append_log(c7, sink)


def _append_oracle():
    views = _rec(with_fx(_REPLAY_FX, """
        SELECT document_id, 1 AS step, 'Viewed' AS action, actor_id AS user_id, CAST(NULL AS VARCHAR) AS notes
        FROM rx WHERE accepted AND command = 'view'""", _REPLAY))
    c1 = ORACLE["submit_prepared"]
    # Both statements are complete queries; compose them as subqueries.
    ORACLE["append_audit"] = f"SELECT * FROM ({c1}) UNION ALL SELECT * FROM ({views})"


_append_oracle()


# ---- previews (T5) -----------------------------------------------------------

@register("preview_rows", with_fx(["fx_risk"], """
    SELECT title, risk_score, risk_label FROM fx_risk ORDER BY title LIMIT 2"""))
def preview_rows(spark, sf_dir):
    r = R.contract_risk(_qa(spark, sf_dir))
    return r.orderBy("title").limit(2).select("title", "risk_score", "risk_label")


@register("preview_names", with_fx(["fx_qa"], """
    SELECT question FROM (SELECT DISTINCT question FROM fx_qa) ORDER BY question LIMIT 5"""))
def preview_names(spark, sf_dir):
    """T5: the first five clause-column names (questions sorted, as the pivot orders them)."""
    return _qa(spark, sf_dir).select("question").distinct().orderBy("question").limit(5)



# ---- partitioned workflow tables --

@register("partitioned_queue", with_fx(["fx_documents"], """
    SELECT document_id, file_name, uploaded_by, uploaded_at FROM fx_documents WHERE status = 'UnderReview'"""))
def partitioned_queue(spark, sf_dir):
    """P5 over the status-partitioned layout: the status filter prunes whole partitions."""
    docs_path, _ = FS.write_workflow_tables(FX.fx_documents(spark, sf_dir), FX.fx_audit(spark, sf_dir),
                                            run_dir(spark, "tables"))
    d = spark.read.parquet(docs_path)
    return d.where(F.col("status") == "UnderReview").select("document_id", "file_name", "uploaded_by", "uploaded_at")


@register("partitioned_audit_day", with_fx(["fx_audit"], """
    SELECT log_id, document_id, action, action_ts FROM fx_audit
    WHERE CAST(action_ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'"""))
def partitioned_audit_day(spark, sf_dir):
    """Audit rows of a date range over the date-partitioned log: a partition filter."""
    _, log_path = FS.write_workflow_tables(FX.fx_documents(spark, sf_dir), FX.fx_audit(spark, sf_dir),
                                           run_dir(spark, "tables"))
    a = spark.read.parquet(log_path)
    return a.where(F.col("log_date").between("2024-01-10", "2024-01-12")) \
        .select("log_id", "document_id", "action", "action_ts")
