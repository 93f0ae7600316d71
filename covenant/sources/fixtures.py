"""Reference-shaped tables derived from the driver's Parquet data (FIXTURES.md §2).

Each derivation is a narrow, partition-local projection of one input table
(plus, for versions and commands, one equi-join), so it scales with the input
and adds no shuffle of its own. Only deterministic functions are used
(md5, sha2, integer arithmetic), which DuckDB reproduces exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant import schemas as S
from covenant.functions import text as X
from covenant.session import short_shuffles
from covenant.sources.tables import table


def _clause_by_number(n) -> F.Column:
    """Clause number 0–9 are the ten risk clauses in order, 10–40 ``Clause n``."""
    named = F.array(*[F.lit(c) for c in S.RISK_CLAUSES])
    return F.when(n < len(S.RISK_CLAUSES), F.try_element_at(named, (n + 1).cast("int"))) \
        .otherwise(F.concat(F.lit("Clause "), n.cast("string")))


def fx_qa(spark: SparkSession, sf_dir: str, with_context: bool = True) -> DataFrame:
    """One QA row per line of ``documents.text``.

    ``row_ord`` is the 1-based line position inside its document; ``title`` is
    the doc_id. The explode is partition-local: a document's rows are produced
    by the task that read it.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select(
        "doc_id",
        *( [F.col("text").alias("context")] if with_context else [] ),
        F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"),
    )
    h = F.conv(F.substring(F.md5(F.col("line")), 1, 4), 16, 10).cast("int")
    clause_no = h % S.N_CLAUSE_TYPES
    answered = (F.floor(h / S.N_CLAUSE_TYPES) % 2 == 0) & (F.trim(F.col("line")) != "")
    out = lines.select(
        F.col("doc_id"),
        (F.col("pos") + 1).cast("long").alias("row_ord"),
        F.col("doc_id").cast("string").alias("title"),
        F.concat(F.lit(S.QUESTION_PREFIX), _clause_by_number(clause_no), F.lit(S.QUESTION_SUFFIX)).alias("question"),
        *( [F.col("context")] if with_context else [] ),
        F.struct(F.when(answered, F.array(F.col("line"))).otherwise(F.array().cast("array<string>")).alias("text"))
        .alias("answers"),
    )
    return out


def fx_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rows from ``orders``."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    k = F.col("o_orderkey")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".pdf", ".TXT", ".docx", ".exe")]), (k % 4 + 1).cast("int"))
    file_name = F.concat(F.lit("order_"), k.cast("string"), ext)
    status = (F.when(F.col("o_orderstatus") == "O", F.lit("UnderReview"))
              .when(F.col("o_orderstatus") == "F", F.lit("Locked"))
              .when(F.col("o_orderstatus") == "P", F.lit("RevisionRequested")))
    score = F.when(k % 12 != 11, (k % 12).cast("double"))
    version = (k % 3 + 1).cast("int")
    model_label = F.when(k % 5 != 0, X.id_label(k % 3))
    return o.select(
        k.alias("document_id"),
        file_name.alias("file_name"),
        X.storage_key(k, version, file_name).alias("storage_key"),
        F.lit("Contract").alias("document_type"),
        score.alias("risk_score"),
        X.risk_label(score).alias("rule_label"),
        model_label.alias("risk_label"),
        F.when(model_label.isNotNull(), ((k % 100) / 100.0)).alias("risk_confidence"),
        F.when(k % 2 == 0, F.lit("CUAD")).otherwise(F.lit("Manual")).alias("source"),
        status.alias("status"),
        version.alias("version_number"),
        F.col("o_custkey").alias("uploaded_by"),
        F.col("o_orderdate").alias("uploaded_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("locked_at"),
    )


_ROLE_BY_SEGMENT = [
    ("FURNITURE", "Employee"),
    ("HOUSEHOLD", "Employee"),
    ("MACHINERY", "ReviewerCompliance"),
    ("BUILDING", "ReviewerCompliance"),
    ("AUTOMOBILE", "TechnicalAdmin"),
]


def fx_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users from ``customer``: email case flipped (upper) for even keys."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    email = F.concat(F.col("c_name"), F.lit("@example.test"))
    role = None
    for seg, r in _ROLE_BY_SEGMENT:
        cond = F.col("c_mktsegment") == seg
        role = F.when(cond, F.lit(r)) if role is None else role.when(cond, F.lit(r))
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, F.upper(email)).otherwise(email).alias("email"),
        role.alias("role"),
    )


def fx_versions(spark: SparkSession, sf_dir: str, with_submitter: bool = True) -> DataFrame:
    """Version submissions from ``lineitem``, with the order's customer as the submitter (null if there
    is no order). Without the submitter only ``lineitem`` is read."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    if with_submitter:
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        j = li.join(o, li.l_orderkey == o.o_orderkey, "left")
    else:
        j = li.withColumn("o_custkey", F.lit(None).cast("bigint"))
    return j.select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_shipdate").alias("submitted_at"),
        F.col("o_custkey").alias("submitted_by"),
        F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"),
        F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"), F.lit("_"),
                 F.col("l_linenumber").cast("string"), F.lit(".txt")).alias("file_name"),
        F.sha2(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                           F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")), 256)
        .alias("content_hash"),
    )


def fx_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``fx_versions`` without the submitter. Orders only tell how often a row comes, so they are joined
    only if an order key repeats."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey").where("o_orderkey is not null")
    with short_shuffles(spark):
        repeated = not keys.groupBy("o_orderkey").count().where("count > 1").isEmpty()
    return fx_versions(spark, sf_dir, with_submitter=repeated).drop("submitted_by")


_ACTION_BY_EVENT = [
    ("signup", "ReviewRequested"),
    ("error", "RevisionRequested"),
    ("purchase", "Approved"),
    ("click", "Locked"),
    ("view", "Viewed"),
]
_COMMAND_BY_EVENT = [
    ("signup", "resubmit"),
    ("error", "request_revision"),
    ("purchase", "approve"),
    ("click", "verify"),
    ("view", "view"),
]


def _case(col, pairs) -> F.Column:
    out = None
    for k, v in pairs:
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out


def fx_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit-log rows from ``events``."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    return e.select(
        F.col("event_id").alias("log_id"),
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("document_id"),
        F.when(F.col("event_id") % 20 != 0, F.col("event_id") % 20).alias("user_id"),
        _case(F.col("event_type"), _ACTION_BY_EVENT).alias("action"),
        F.col("ts").alias("action_ts"),
        F.col("props").alias("notes"),
    )


def fx_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored objects from ``documents``: recorded hash vs current bytes."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    current = (F.when(k % 23 == 0, F.lit(None).cast("binary"))
               .when(k % 17 == 0, F.encode(F.concat(F.col("text"), F.lit("x")), "UTF-8"))
               .otherwise(F.encode(F.col("text"), "UTF-8")))
    return d.select(
        k.alias("document_id"),
        F.sha2(F.col("text"), 256).alias("recorded_hash"),
        current.alias("content"),
    )


def fx_clause_json(spark: SparkSession, sf_dir: str, risk: DataFrame | None = None) -> DataFrame:
    """Per contract: JSON map clause -> first 20 words of its first answered row.

    Broken (cut to 5 chars) when doc_id % 50 = 0, blank when doc_id % 50 = 1.
    Also carries ``model_input`` (the contract's risk text).
    """
    from covenant.operators.risk import contract_risk_with_firsts

    if risk is None:        # one pass gives the risk text and the first answer per clause (sorted by clause)
        risk = contract_risk_with_firsts(fx_qa(spark, sf_dir, with_context=False))
    j = risk.select("title", F.col("risk_text").alias("model_input"),
                    F.when(F.size("firsts") > 0, F.map_from_entries("firsts")).alias("m"))
    k = F.col("title").cast("long")
    js = F.coalesce(F.to_json(F.col("m")), F.lit("{}"))
    return j.select(
        k.alias("doc_id"),
        F.col("title"),
        (F.when(k % 50 == 0, F.substring(js, 1, 5)).when(k % 50 == 1, F.lit("")).otherwise(js)).alias("clauses_json"),
        F.col("model_input"),
    )


def fx_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three logits per row from ``embeddings`` elements 1–3."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.select(
        F.col("vec_id"),
        F.array(*[F.element_at("embedding", i).cast("double") for i in (1, 2, 3)]).alias("logits"),
    )


def fx_predictions(spark: SparkSession, sf_dir: str, risk: DataFrame | None = None) -> DataFrame:
    """Actual vs predicted label ids per contract; null prediction when doc_id % 29 = 0."""
    from covenant.operators.risk import contract_risk

    r = risk if risk is not None else contract_risk(fx_qa(spark, sf_dir, with_context=False))
    k = F.col("title").cast("long")
    actual = X.label_id(F.col("risk_label"))
    pred = (F.when(k % 29 == 0, F.lit(None).cast("int"))
            .when(k % 3 != 0, actual)
            .otherwise(((actual + F.floor(k / 3)) % 3).cast("int")))
    return r.select(k.alias("doc_id"), F.col("title"), actual.alias("actual"), pred.alias("predicted"))


def fx_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return c.select(F.col("conv_id").alias("document"), F.col("turn").alias("page"), F.col("text"))


def fx_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select(F.col("page_id"), F.col("url").alias("raw_name"))


def fx_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands from ``events``; document ids fall in [0, rows of documents)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    # Scalar subquery: evaluated once, then used as a literal in the projection.
    n_docs = table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    return e.select(
        F.col("event_id").alias("cmd_id"),
        F.pmod(F.col("event_id"), n_docs).alias("document_id"),
        F.col("user_id").alias("actor_id"),
        _case(F.col("event_type"), _COMMAND_BY_EVENT).alias("command"),
        F.when(F.col("event_id") % 10 == 0, F.lit("")).otherwise(F.col("props")).alias("notes"),
        F.col("ts"),
    )
