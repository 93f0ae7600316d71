"""R2 with events out of order: an event-time buffer per document.

Events wait in list state until the watermark (latest event time seen, less a
bound) has passed them; a timer then folds those that are due, in order of time
and log id, onto the stored status. So a log that is out of order by no more
than the bound gives the statuses of the batch job, whatever the order of its
files. Only events at or before the watermark come too late; they are given
back as rejects.

Documents are dealt into hash buckets, and a bucket is a key of the stateful
operator: a call into Python, a timer and an access to the state serve all
documents of a bucket, not one. More events want more buckets (``buckets_for``),
so a bucket stays small. State is kept as arrays, one entry a document or event.

The watermark column runs ``AHEAD`` of the event time, and the delay is longer
by as much. The watermark is the same, but Spark, which drops rows behind it
before a stateful operator sees them, hands over late events, too.

Defined cases: rows without a document only move the watermark on (heartbeats);
rows without a time are rejects; equal times go by log id; repeated rows are
events of their own, as in the batch job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from covenant import schemas as S

AHEAD_DAYS = 200 * 365
OUT = "kind string, document_id long, seq long, status string, n_tried long, n_refused long, log_id long, action string, at long"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]
#: Stands for null in the numbers that go to Python: one null would turn the numbers of its whole Arrow
#: batch into floating point, keys included.
NONE = -(1 << 63)
_LEGAL, _TARGET = set(S.TRANSITIONS), dict(S.STATUS_MOVES)


#: Events that wait are stored in lists of at most this many, and a bucket gets about as many documents or events.
CHUNK = BUCKET_EVENTS = 2000


def buckets_for(events: int) -> int:
    """Buckets for a stream that gets so many events before it begins anew."""
    return max(64, events // BUCKET_EVENTS)


def bucket_of(column: str, buckets: int):
    return F.pmod(F.xxhash64(column), F.lit(buckets)).alias("bucket")


def _arrays(**kinds) -> StructType:
    return StructType([StructField(k, ArrayType(v())) for k, v in kinds.items()])


class Lifecycle(StatefulProcessor):
    """Of a bucket's documents, ``waiting``: events that the watermark has not passed; ``folded``: status, counts,
    number of the last output."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState(
            "waiting", _arrays(document_id=LongType, at=LongType, log_id=LongType, action=StringType))
        self.folded = handle.getValueState(
            "folded", _arrays(document_id=LongType, status=StringType, n_tried=LongType, n_refused=LongType, seq=LongType))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for events in rows:
            events = events[events["document_id"] != NONE]       # the rest are heartbeats
            late = events["at"] // 1000 <= passed                # as are events without a time
            if late.any():
                yield events[late].assign(kind="late", seq=None, status=None, n_tried=None, n_refused=None)[_COLUMNS]
            on_time = events[~late]
            if len(on_time):
                self.waiting.appendList(self._chunks(*(on_time[c].tolist() for c in ("document_id", "at", "log_id")),
                                                     [None if pd.isna(x) else x for x in on_time["action"]]))
                self.handle.registerTimer(int(on_time["at"].min()) // 1000)

    @staticmethod
    def _chunks(*columns: list) -> list[tuple]:
        return [tuple(c[i:i + CHUNK] for c in columns) for i in range(0, len(columns[0]), CHUNK)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        docs, ats, ids, actions = [], [], [], []
        for chunk in self.waiting.get() if self.waiting.exists() else ():
            for column, part in zip((docs, ats, ids, actions), chunk):
                column.extend(part)
        doc, at, log_id = (np.array(c, np.int64) for c in (docs, ats, ids))
        due = at // 1000 <= passed
        if not due.any():
            return
        rest = np.flatnonzero(~due)
        if len(rest):
            self.waiting.put(self._chunks(doc[rest].tolist(), at[rest].tolist(), log_id[rest].tolist(), [actions[i] for i in rest]))
            self.handle.registerTimer(int(at[rest].min()) // 1000)
        else:
            self.waiting.clear()
        folded = {d: tuple(s) for d, *s in zip(*self.folded.get())} if self.folded.exists() else {}
        now = np.flatnonzero(due)
        now, out = now[np.lexsort((log_id[now], at[now], doc[now]))], {}
        for d, i in zip(doc[now].tolist(), now.tolist()):
            if d not in out:
                out[d] = list(folded.get(d, ("Draft", 0, 0, 0)))
                out[d][3] += 1
            target = _TARGET.get(actions[i])
            if target is not None:
                state = out[d]
                state[1] += 1
                if (state[0], target) in _LEGAL:
                    state[0] = target
                else:
                    state[2] += 1
        folded.update(out)
        self.folded.update((list(folded), *map(list, zip(*folded.values()))))
        yield pd.DataFrame([("status", d, seq, status, tried, refused, None, None, None)
                            for d, (status, tried, refused, seq) in out.items()], columns=_COLUMNS)

    def close(self) -> None:
        pass


def run(spark: SparkSession, src: str, schema, sink: str, checkpoint: str, bound: str = "1 day",
        files_per_trigger: int = 1000, partitions: int | None = None, buckets: int = 1024) -> None:
    """Process the files that have arrived; statuses and late events are appended to ``sink`` by kind.
    ``partitions`` of the state (else the session's shuffle partitions) stay as they are in the first run, and
    ``buckets`` must stay as they are."""
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)
        events = (stream.select("document_id", "log_id", "action", micros("action_ts").alias("at"))
                  .withColumn("ahead", F.timestamp_micros(F.col("at") + AHEAD_DAYS * 86_400_000_000))
                  .withWatermark("ahead", f"interval {AHEAD_DAYS} days {bound}")
                  .withColumns({c: F.coalesce(c, F.lit(NONE)) for c in ("document_id", "log_id", "at")}))
        out = events.withColumn("bucket", bucket_of("document_id", buckets)).groupBy("bucket").transformWithStateInPandas(
            Lifecycle(), outputStructType=OUT, outputMode="append", timeMode="eventTime")
        q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
             .partitionBy("kind").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def micros(col: str):
    """Microseconds of a wall-clock time since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(col).cast("timestamp_ntz"))


def heartbeat(spark: SparkSession, at) -> DataFrame:
    """A row that belongs to no document and moves the watermark to ``at`` less the bound."""
    return spark.createDataFrame([(None, None, None, at)], "document_id long, log_id long, action string, action_ts timestamp_ntz")


def statuses(spark: SparkSession, sink: str) -> DataFrame:
    """The latest folded status of each document."""
    rows = spark.read.parquet(sink).where("kind = 'status'")
    latest = rows.groupBy("document_id").agg(F.max_by(F.struct("status", "n_tried", "n_refused"), "seq").alias("s"))
    return latest.select("document_id", "s.status", "s.n_tried", "s.n_refused")


def rejects(spark: SparkSession, sink: str) -> DataFrame:
    """Events behind the watermark when they arrived, and events without a time."""
    return spark.read.parquet(sink).where("kind = 'late'").select(
        "document_id", F.nullif("log_id", F.lit(NONE)).alias("log_id"), "action", F.nullif("at", F.lit(NONE)).alias("at"))


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The events that wait in the stored state of the last run: document_id, at, log_id, action."""
    state = (spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "waiting").load())
    return state.select(F.inline(F.arrays_zip(*(F.col(f"list_element.{c}").alias(c) for c in ("document_id", "at", "log_id", "action")))))
