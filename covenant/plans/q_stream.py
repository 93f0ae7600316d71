"""Streaming keys R1–R3 and the write-once sink S10.

Each stages its input (derived from the driver tables) as files, runs the
stream to completion with ``availableNow`` and returns the sink as a batch
DataFrame. The oracle is the batch query's SQL: stream = batch.
"""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from covenant.operators import risk as R
from covenant.operators import workflow as W
from covenant.plans.catalog import ORACLE, register
from covenant.plans.q_workflow import _predictions
from covenant.session import materialize
from covenant.sources import fixtures as FX
from covenant.operators import increments as I
from covenant.streaming import buffered as B
from covenant.streaming import commits as C
from covenant.streaming import intake as IN
from covenant.streaming import jobs as J


@register("stream_intake")
def stream_intake(spark, sf_dir):
    d = J.run_dir(spark, "intake")
    risk = materialize(R.contract_risk_with_firsts(FX.fx_qa(spark, sf_dir, with_context=False)))    # for both sides
    J.stage(FX.fx_clause_json(spark, sf_dir, risk).select("doc_id", "title", "clauses_json", "model_input"), f"{d}/src")
    schema = spark.read.parquet(f"{d}/src").schema
    predictions, objects = J.stored_sides(spark, d, predictions=_predictions(spark, sf_dir, risk),
                                          objects=FX.fx_objects(spark, sf_dir).select("document_id", "recorded_hash"))
    out = J.stream_intake(spark, f"{d}/src", schema, predictions, objects, f"{d}/sink", f"{d}/ckpt")
    return out.select("document_id", "step", "action", "user_id", "notes")


#: Contracts wait this many hours for a prediction; every SLOWth prediction comes with the run after its contract's.
WAIT_HOURS, SLOW = 3, 7


@register("stream_intake_waiting")
def stream_intake_waiting(spark, sf_dir):
    """R1 with predictions on a stream of their own: contracts and predictions arrive in runs, some predictions a run
    later, some made too long after the contract, which is then logged as skipped."""
    d = J.run_dir(spark, "intake-waiting")
    hour = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") % 48 * 3600)
    risk = materialize(R.contract_risk_with_firsts(FX.fx_qa(spark, sf_dir, with_context=False)))    # for both sides
    contracts = (FX.fx_clause_json(spark, sf_dir, risk).select("doc_id", "title", "clauses_json", "model_input")
                 .withColumn("arrived_at", hour))
    predictions = _predictions(spark, sf_dir, risk).withColumn(
        "predicted_at", F.timestamp_seconds(F.unix_seconds(hour) + F.col("doc_id") % 5 * 3600))
    contracts, predictions, objects = J.stored_sides(
        spark, d, contracts=contracts, predictions=predictions,
        objects=FX.fx_objects(spark, sf_dir).select("document_id", "recorded_hash"))
    run = F.floor(F.col("doc_id") % 48 / 24)
    later = run + F.when(F.col("doc_id") % SLOW == 0, 1).otherwise(0)
    for n in range(3):
        for name, df, at in (("c", contracts, run), ("p", predictions, later)):
            J.stage(df.where(at == n), f"{d}/{name}")
            if n == 2:          # nothing more comes: whoever still waits is due
                J.stage(IN.heartbeat(spark, df.schema, datetime.datetime(2024, 2, 1)), f"{d}/{name}")
        table = IN.run(spark, f"{d}/c", f"{d}/p", (contracts.schema, predictions.schema), objects, f"{d}/sink", f"{d}/ckpt",
                       wait=f"{WAIT_HOURS} hours", late="3 days")
    return table.rows().select("document_id", "step", "action", "user_id", "notes")


def _lifecycle_sink(spark, sf_dir, order: list[int]) -> str:
    """The log arrives in four parts by time of day, in the given order; the stream runs after each one."""
    d = J.run_dir(spark, "lifecycle")
    log = FX.fx_audit(spark, sf_dir)
    part = F.floor(F.hour("action_ts") / 6)
    buckets = B.buckets_for(log.count())
    for n in order:
        J.stage(log.where(part == n), f"{d}/src")
        J.stream_lifecycle(spark, f"{d}/src", log.schema, f"{d}/sink", f"{d}/ckpt", buckets=buckets)
    return f"{d}/sink"


@register("stream_lifecycle")
def stream_lifecycle(spark, sf_dir):
    """R2 over four runs in order of time: documents continue from stored state, nothing is late."""
    out = J.lifecycle_status(spark, _lifecycle_sink(spark, sf_dir, [0, 1, 2, 3]))
    return out.select("document_id", "status", "n_tried")


LATE_ORDER = [2, 0, 3, 1]


@register("stream_lifecycle_rejects")
def stream_lifecycle_rejects(spark, sf_dir):
    """R2 over the same parts out of order: the events that cannot be put in order any more."""
    return J.lifecycle_rejects(spark, _lifecycle_sink(spark, sf_dir, LATE_ORDER)).select("document_id", "log_id", "action")


def _versioned_keys(spark, sf_dir):
    v = W.assign_versions(FX.fx_submissions(spark, sf_dir), dealt=True)
    return v.select("document_id", "version_number",
                    F.concat(F.lit("doc-"), F.col("document_id").cast("string"), F.lit("/v"),
                             F.col("version_number").cast("string"), F.lit("/"), F.col("file_name"))
                    .alias("storage_key"))


#: The buffered stream gets the log in this many runs, by parts of equal time span.
ARRIVALS, NEXT_RUN, LAST_RUN = 4, 4, 50


def _buffered(spark, sf_dir) -> str:
    """The sink of a stream that gets the log in runs: an event's run is the part of the time span that it lies in;
    every NEXT_RUNth event comes one run later, every LAST_RUNth with the last run. The bound is two parts."""
    d, log = J.run_dir(spark, "buffered"), FX.fx_audit(spark, sf_dir)
    log = log.select("document_id", "log_id", "action", F.col("action_ts").cast("timestamp_ntz").alias("action_ts"),
                     B.micros("action_ts").alias("_us"))
    n, lo, hi, end = log.agg(F.count("*"), F.min("_us"), F.max("_us"), F.max("action_ts")).first()
    bound = ((hi or 0) - (lo or 0)) * 2 // ARRIVALS // 1_000_000 + 1
    part = F.expr(f"(_us - {lo or 0}) * {ARRIVALS} div {(hi or 0) - (lo or 0) + 1}")
    run = (F.when(F.col("log_id") % LAST_RUN == 1, ARRIVALS - 1)
           .otherwise(F.least(part + F.when(F.col("log_id") % NEXT_RUN == 0, 1).otherwise(0), F.lit(ARRIVALS - 1))))
    log, schema = log.withColumn("run", run), log.drop("_us").schema
    # a partition of the state for every 100,000 events, as far as the session has so many
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, n // 100_000))
    for i in range(ARRIVALS):
        J.stage(log.where(F.col("run") == i).select(*schema.fieldNames()), f"{d}/src")
        if i == ARRIVALS - 1 and end is not None:           # nothing more comes: the rest is due after this run
            J.stage(B.heartbeat(spark, end + datetime.timedelta(seconds=bound + 1)), f"{d}/src")
        B.run(spark, f"{d}/src", schema, f"{d}/sink", f"{d}/ckpt", f"{bound} seconds", partitions=partitions,
              buckets=B.buckets_for(n))
    return f"{d}/sink"


@register("stream_lifecycle_buffered")
def stream_lifecycle_buffered(spark, sf_dir):
    """R2 with a buffer: statuses of a log that arrives out of order, less the events that came too late."""
    return B.statuses(spark, _buffered(spark, sf_dir)).select("document_id", "status", "n_tried")


@register("stream_lifecycle_buffered_rejects")
def stream_lifecycle_buffered_rejects(spark, sf_dir):
    """R2 with a buffer: the events behind the watermark when they arrived."""
    return B.rejects(spark, _buffered(spark, sf_dir)).select("document_id", "log_id", "action")


def _in_parts(df, order: str, parts: int = 3):
    """A base and deltas: rows by equal parts of the span of a time column."""
    us = df.withColumn("_us", B.micros(order))
    lo, hi = us.agg(F.min("_us"), F.max("_us")).first()
    part = F.expr(f"(_us - {lo or 0}) * {parts} div {(hi or 0) - (lo or 0) + 1}")
    return [us.where(part == n).drop("_us") for n in range(parts)]


@register("assign_versions_increments")
def assign_versions_increments(spark, sf_dir):
    """W1 as a base and two deltas: each numbered on from the stored state of the ones before."""
    d = J.run_dir(spark, "version-increments")
    state = spark.createDataFrame([], "document_id long, max_version int")
    for n, delta in enumerate(_in_parts(FX.fx_versions(spark, sf_dir), W.VERSION_ORDER[0])):
        I.next_versions(delta, state).write.parquet(f"{d}/versions/part={n}")
        numbered = spark.read.parquet(f"{d}/versions/part={n}")
        I.merge_versions(state, numbered).write.parquet(f"{d}/state-{n}")
        state = spark.read.parquet(f"{d}/state-{n}")
    return spark.read.parquet(f"{d}/versions").select("document_id", "l_linenumber", "l_partkey", "l_suppkey",
                                                      "l_extendedprice", "submitted_at", "version_number")


@register("lifecycle_increments")
def lifecycle_increments(spark, sf_dir):
    """W6 as a base and two deltas: stored status functions merged, old log rows not read."""
    d, state = J.run_dir(spark, "status-increments"), None
    for n, delta in enumerate(_in_parts(FX.fx_audit(spark, sf_dir), "action_ts")):
        now = I.status_state(delta)
        (now if state is None else I.merge_statuses(state, now)).write.parquet(f"{d}/state-{n}")
        state = spark.read.parquet(f"{d}/state-{n}")
    return I.statuses(state)


def _write_once_table(spark, d, df):
    return C.WriteOnce(spark, f"{d}/sink", df.schema)


@register("stream_versions")
def stream_versions(spark, sf_dir):
    d = J.run_dir(spark, "versions")
    v = _versioned_keys(spark, sf_dir)
    J.stage(v, f"{d}/src")
    table = _write_once_table(spark, d, v)
    C.stream(spark, f"{d}/src", table, f"{d}/ckpt1", "first")
    # Replay everything with a fresh checkpoint: write-once keeps the table unchanged.
    C.stream(spark, f"{d}/src", table, f"{d}/ckpt2", "second")
    return table.rows().select("document_id", "version_number", "storage_key")


@register("append_versions")
def append_versions(spark, sf_dir):
    """Two overlapping batch appends and a repeated one; existing keys are never written again."""
    d = J.run_dir(spark, "append")
    v = _versioned_keys(spark, sf_dir)
    table = _write_once_table(spark, d, v)
    even = v.where(F.col("document_id") % 2 == 0)
    table.write(even, "even")
    table.write(even, "even")
    table.write(v, "all")
    return table.rows().select("document_id", "version_number", "storage_key")


def _oracles():
    from covenant.plans.q_workflow import _FOLD, _VERSIONED, _rec
    from covenant.plans.sqlparts import with_fx
    ORACLE["stream_intake"] = ORACLE["submit_prepared"]
    ORACLE["stream_intake_waiting"] = ORACLE["submit_prepared"].replace(
        "LEFT JOIN fx_predictions p ON pr.doc_id = p.doc_id", f"LEFT JOIN fx_predictions p ON pr.doc_id = p.doc_id AND p.doc_id % 5 <= {WAIT_HOURS}")
    ORACLE["stream_lifecycle"] = ORACLE["lifecycle_fold"]
    vsql = with_fx(["fx_versions"], """
        SELECT document_id, version_number,
               'doc-' || CAST(document_id AS VARCHAR) || '/v' || CAST(version_number AS VARCHAR) || '/' || file_name
                   AS storage_key
        FROM vv""", _VERSIONED)
    run = " ".join(f"WHEN {part} THEN {i}" for i, part in enumerate(LATE_ORDER))
    ORACLE["stream_lifecycle_rejects"] = with_fx(["fx_audit"], """
        SELECT s.document_id, s.log_id, s.action FROM runs s
        WHERE EXISTS (SELECT 1 FROM runs e WHERE e.document_id = s.document_id AND e.run < s.run
                      AND (e.action_ts > s.action_ts OR (e.action_ts = s.action_ts AND e.log_id >= s.log_id)))""",
        [("runs", f"SELECT *, CASE hour(action_ts) // 6 {run} END AS run FROM fx_audit")])
    us = "epoch_us(CAST(action_ts AS TIMESTAMP))"
    arrivals = [("span", f"SELECT min({us}) AS lo, max({us}) AS hi FROM fx_audit"),
                ("parted", f"""SELECT a.*, {us} AS us, lo, hi, ({us} - lo) * {ARRIVALS} // (hi - lo + 1) AS part
                    FROM fx_audit a, span"""),
                ("arrived", f"""SELECT *, CASE WHEN log_id % {LAST_RUN} = 1 THEN {ARRIVALS - 1}
                    ELSE least(part + CASE WHEN log_id % {NEXT_RUN} = 0 THEN 1 ELSE 0 END, {ARRIVALS - 1}) END AS run FROM parted"""),
                ("behind", f"""SELECT e.document_id, e.log_id, e.action FROM arrived e
                    JOIN (SELECT r.run, max(b.us) // 1000 AS latest FROM (SELECT DISTINCT run FROM arrived) r
                          JOIN arrived b ON b.run < r.run GROUP BY r.run) w ON e.run = w.run
                    WHERE e.us // 1000 <= w.latest - 1000 * ((hi - lo) * 2 // {ARRIVALS} // 1000000 + 1)""")]
    ORACLE["stream_lifecycle_buffered_rejects"] = with_fx(["fx_audit"], "SELECT * FROM behind", arrivals)
    kept = [("kept", "SELECT a.* FROM fx_audit a ANTI JOIN behind b ON a.log_id = b.log_id")]
    fold = ORACLE["lifecycle_fold"]
    ORACLE["stream_lifecycle_buffered"] = _rec(with_fx(["fx_audit"], """
        SELECT document_id, arg_max(state, i) AS status, count(log_id) AS n_tried FROM fold GROUP BY document_id""",
        arrivals + kept + [(n, sql.replace("fx_audit", "kept")) for n, sql in _FOLD]))
    ORACLE["lifecycle_increments"] = fold
    ORACLE["assign_versions_increments"] = ORACLE["assign_versions"]
    ORACLE["stream_versions"] = vsql
    ORACLE["append_versions"] = vsql


_oracles()
