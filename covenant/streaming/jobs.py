"""Structured Streaming jobs.

The reference serialises work through database transactions; here the same
logic runs as streaming queries with ``trigger(availableNow=True)`` so each
run processes what is there and ends.

- R1 intake: file source of prepared contracts -> the stateless C1 scoring
  (stream-static left joins to predictions and stored objects) -> append sink.
- R2 lifecycle: audit events grouped by hash bucket of the document through
  ``applyInPandasWithState``; state = (status, last event seen, moves tried) of
  the bucket's documents, so that a call into Python serves many of them.
  Events at or before the last one seen in an earlier micro-batch cannot be
  put in order any more and go to a rejects output; the rest is folded.
- R3 versions: ``foreachBatch`` write-once append. The sink is partitioned by
  a hash bucket of the key, and only the batch's buckets are read. A row equal
  to the stored one is a replay and ignored; another row for a stored key, or
  a second one for a new key, goes to a rejects output, as does a null key.

Sources, sinks and checkpoints live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from covenant import schemas as S
from covenant.operators import workflow as W
from covenant.session import materialize, run_dir  # noqa: F401
from covenant.streaming.buffered import NONE, bucket_of


def stage(df: DataFrame, path: str) -> None:
    """Write a batch DataFrame as the next files a file-source stream will pick up."""
    df.write.mode("append").parquet(path)


def stored_sides(spark: SparkSession, base: str, **sides: DataFrame) -> list[DataFrame]:
    """Static sides of stream joins, written once, so that no micro-batch computes them again."""
    out = []
    for name, df in sides.items():
        df.write.parquet(f"{base}/{name}")
        out.append(spark.read.schema(df.schema).parquet(f"{base}/{name}"))
    return out


def _await(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


# ---- R1 --------------------------------------------------------------------

def stream_intake(spark: SparkSession, src: str, schema, predictions: DataFrame, objects: DataFrame,
                  sink: str, checkpoint: str, files_per_trigger: int = 1000) -> DataFrame:
    """Prepared contracts arriving as files -> C1 log rows, appended to ``sink``.

    ``predictions`` and ``objects`` should be stored tables (``stored_sides``).
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)
    rows = W.prepared_log_rows(W.score_prepared(stream, predictions), objects)
    q = (rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    _await(q)
    return spark.read.parquet(sink)


# ---- R2 --------------------------------------------------------------------

_STATUS = [s for s, _ in S.STATUSES]
_LEGAL = set(S.TRANSITIONS)
_TARGET = dict(S.STATUS_MOVES)

LIFECYCLE_OUT = ("kind string, document_id long, seq long, status string, n_tried long, n_refused long, "
                 "log_id long, action string, action_ts timestamp_ntz")
#: Of a bucket's documents: status, last event seen, moves tried and refused, number of the last output.
LIFECYCLE_STATE = ("document_id array<long>, status array<string>, last_us array<long>, last_id array<long>, "
                   "n_tried array<long>, n_refused array<long>, seq array<long>")
_LIFECYCLE_COLUMNS = [c.split()[0] for c in LIFECYCLE_OUT.split(", ")]


def _numbers(values) -> pd.Series:
    """Whole numbers, null where ``NONE`` or None stands."""
    return pd.Series(pd.array([None if v is None or v == NONE else v for v in values], "Int64"))


def _lifecycle_update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per bucket of documents: fold this micro-batch's events onto the stored statuses; give late ones back."""
    stored = {d: tuple(s) for d, *s in zip(*state.get)} if state.exists else {}
    events = pd.concat(list(batches), ignore_index=True)
    doc, log_id = events["document_id"].to_numpy(np.int64), events["log_id"].to_numpy(np.int64)
    at = events["action_ts"].to_numpy("datetime64[us]").astype(np.int64)
    timed = at != NONE
    order = np.lexsort((log_id, log_id == NONE, at, ~timed, doc))       # what has no time or id comes last
    actions, now, late = events["action"].tolist(), {}, []
    for i, d, us, log, known in zip(*(x.tolist() for x in (order, doc[order], at[order], log_id[order], timed[order]))):
        if d not in now:
            before = stored.get(d, ("Draft", NONE, NONE, 0, 0, 0))
            now[d] = s = [*before[:5], before[5] + 1]
        if known and (us < before[1] or us == before[1] and NONE < log <= before[2]):
            late.append((i, "late", d, s[5], before[0], before[3], before[4], log))
            continue
        target = _TARGET.get(actions[i])
        if target is not None:
            s[3] += 1
            if (s[0], target) in _LEGAL:
                s[0] = target
            else:
                s[4] += 1
        if known:
            s[1], s[2] = us, max(log, s[2]) if us == s[1] else log
    stored.update(now)
    state.update((list(stored), *map(list, zip(*stored.values()))))
    if late:
        at_row, kind, d, seq, status, tried, refused, log = zip(*late)
        yield pd.DataFrame({"kind": kind, "document_id": _numbers(d), "seq": seq, "status": status, "n_tried": tried,
                            "n_refused": refused, "log_id": _numbers(log), "action": [actions[i] for i in at_row],
                            "action_ts": events["action_ts"].take(list(at_row)).array})[_LIFECYCLE_COLUMNS]
    status, _, _, tried, refused, seq = zip(*now.values())
    yield pd.DataFrame({"kind": "status", "document_id": _numbers(now), "seq": seq, "status": status, "n_tried": tried,
                        "n_refused": refused, "log_id": _numbers([None] * len(now)), "action": None,
                        "action_ts": pd.NaT})[_LIFECYCLE_COLUMNS]


def stream_lifecycle(spark: SparkSession, src: str, schema, sink: str, checkpoint: str,
                     files_per_trigger: int = 1000, buckets: int = 1024) -> None:
    """R2: process the files that have arrived; statuses and rejects are appended to ``sink`` by kind.
    ``buckets`` must stay as they are in the first run."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)
    ev = stream.select(*(F.coalesce(c, F.lit(NONE)).alias(c) for c in ("document_id", "log_id")), "action",
                       F.col("action_ts").cast("timestamp_ntz"))
    out = ev.withColumn("bucket", bucket_of("document_id", buckets)).groupBy("bucket").applyInPandasWithState(
        _lifecycle_update, outputStructType=LIFECYCLE_OUT, stateStructType=LIFECYCLE_STATE,
        outputMode="append", timeoutConf=GroupStateTimeout.NoTimeout)
    q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .partitionBy("kind").outputMode("append").trigger(availableNow=True).start())
    _await(q)


def lifecycle_status(spark: SparkSession, sink: str) -> DataFrame:
    """The latest status of each document in a ``stream_lifecycle`` sink."""
    res = spark.read.parquet(sink).where("kind = 'status'")
    latest = res.groupBy("document_id").agg(F.max_by(F.struct("status", "n_tried", "n_refused"), "seq").alias("s"))
    return latest.select("document_id", "s.status", "s.n_tried", "s.n_refused")


def lifecycle_rejects(spark: SparkSession, sink: str) -> DataFrame:
    """The events that came too late to be put in order."""
    return spark.read.parquet(sink).where("kind = 'late'").select("document_id", "log_id", "action", "action_ts")


# ---- R3 --------------------------------------------------------------------

BUCKETS = 64


def _table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:      # nothing written there yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_once(batch: DataFrame, sink: str, key: str = "storage_key") -> None:
    """Append rows whose key ``sink`` does not have; never overwrite.

    Of several rows for a new key the smallest by content is written. Rows that differ from
    the stored or written one, and rows without a key, are appended to ``<sink>_rejects``.
    """
    spark, rest = batch.sparkSession, [c for c in batch.columns if c != key]
    rows = materialize(batch.select(key, F.struct(*rest).alias("_row"))
                       .withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")))
    first = rows.where(F.col(key).isNotNull()).groupBy("_bucket", key).agg(F.min("_row").alias("_kept"))
    stored = _table_or_none(spark, sink)
    if stored is not None:
        mine = [r[0] for r in rows.select("_bucket").distinct().collect()]          # at most BUCKETS numbers
        old = stored.where(F.col("_bucket").isin(mine)).select(key, F.struct(*rest).alias("_old"), "_bucket")
        first = first.join(old, ["_bucket", key], "left")
    else:
        first = first.withColumn("_old", F.lit(None).cast(first.schema["_kept"].dataType))
    first = materialize(first)
    held = first.select("_bucket", key, F.coalesce("_old", "_kept").alias("_held"))
    bad = rows.join(held, ["_bucket", key], "left").where(F.col("_held").isNull() | ~F.col("_row").eqNullSafe(F.col("_held")))
    bad.select(key, "_row.*").write.mode("append").parquet(f"{sink}_rejects")
    first.where("_old is null").select(key, "_kept.*", "_bucket").write.mode("append").partitionBy("_bucket").parquet(sink)


def stream_versions(spark: SparkSession, src: str, schema, sink: str, checkpoint: str,
                    files_per_trigger: int = 1000) -> None:
    """Versions arriving as files, appended write-once by storage key."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)
    q = (stream.writeStream.foreachBatch(lambda b, _id: write_once(b, sink))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    _await(q)
