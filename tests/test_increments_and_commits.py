"""Buffered lifecycle stream, write-once commits, and increments of versions and statuses."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from covenant import schemas as S
from covenant import session
from covenant.operators import increments as I
from covenant.operators import workflow as W
from covenant.streaming import buffered as B
from covenant.streaming import commits as C
from covenant.streaming import jobs as J

LOG = "document_id long, log_id long, action string, action_ts timestamp_ntz"
ACTIONS = [a for a, _ in S.STATUS_MOVES] + ["Viewed"]


def log_rows(rng, n, docs=9):
    t = dt.datetime(2024, 3, 1)
    out = []
    for i in range(n):
        t += dt.timedelta(minutes=rng.choice([0, 1, 37]))
        out.append((rng.randrange(docs), i, rng.choice(ACTIONS), t))
    return out


def lifecycle(spark, d, parts, bound):
    schema = spark.createDataFrame([], LOG).schema
    for p in parts:
        J.stage(p if not isinstance(p, list) else spark.createDataFrame(p, LOG), f"{d}/src")
        B.run(spark, f"{d}/src", schema, f"{d}/sink", f"{d}/ckpt", bound)


def test_events_out_of_order_within_the_bound_give_the_batch_status(spark):
    rng, d = random.Random(2), session.run_dir(spark, "buffered")
    rows = log_rows(rng, 240)
    end = rows[-1][3]
    third = [rows[:80], rows[80:160], rows[160:]]
    held = [[r for r in p if r[1] % 4 == 0] for p in third]            # a quarter of each part comes with the next one
    parts = [[r for r in third[0] if r not in held[0]], [r for r in third[1] if r not in held[1]] + held[0], third[2] + held[1]]
    for p in parts:
        rng.shuffle(p)
    lifecycle(spark, d, parts, "3 days")
    assert B.waiting(spark, f"{d}/ckpt").count() == sum(r[3] > end - dt.timedelta(days=3) for r in rows) > 0
    lifecycle(spark, d, [B.heartbeat(spark, end + dt.timedelta(days=30))], "3 days")
    batch = {tuple(r) for r in W.lifecycle_fold(spark.createDataFrame(rows, LOG)).collect()}
    assert {(r.document_id, r.status, r.n_tried) for r in B.statuses(spark, f"{d}/sink").collect()} == batch
    assert B.rejects(spark, f"{d}/sink").count() == 0 and B.waiting(spark, f"{d}/ckpt").collect() == []


def test_only_events_behind_the_watermark_are_rejects(spark):
    d, day = session.run_dir(spark, "behind"), lambda n, h=0: dt.datetime(2024, 1, n, h)
    first = [(1, 1, "ReviewRequested", day(10)), (2, 2, "Viewed", day(2))]
    second = [(1, 3, "RevisionRequested", day(9)), (1, 4, "Viewed", day(8)), (2, 5, "ReviewRequested", day(7)), (3, 6, "Viewed", None),
              (4, None, "ReviewRequested", day(12)), (None, 7, "Viewed", day(10)), (2**60 + 1, 2**60 + 3, "ReviewRequested", day(9))]
    lifecycle(spark, d, [first, second], "2 days")                     # the watermark stands at the 8th
    assert {(r.document_id, r.log_id) for r in B.rejects(spark, f"{d}/sink").collect()} == {(1, 4), (2, 5), (3, 6)}
    lifecycle(spark, d, [B.heartbeat(spark, day(20))], "2 days")
    got = {r.document_id: (r.status, r.n_tried, r.n_refused) for r in B.statuses(spark, f"{d}/sink").collect()}
    assert got == {1: ("UnderReview", 2, 1), 2: ("Draft", 0, 0), 4: ("UnderReview", 1, 0), 2**60 + 1: ("UnderReview", 1, 0)}


SCHEMA = "storage_key string, n int, h string"


def table(spark, name):
    return C.WriteOnce(spark, session.run_dir(spark, name), spark.createDataFrame([], SCHEMA).schema)


def seen(rows):
    return sorted(map(str, map(tuple, rows.collect())))


def test_data_and_rejects_become_visible_together(spark, monkeypatch):
    t = table(spark, "commits")
    batch = spark.createDataFrame([("k1", 1, "b"), ("k1", 1, "a"), ("k2", 2, None), ("k2", 2, None), (None, 3, "x")], SCHEMA)
    real = C.WriteOnce._commit

    def fails(self, number, record):
        raise OSError("lost before the commit")

    monkeypatch.setattr(C.WriteOnce, "_commit", fails)
    with pytest.raises(OSError):
        t.write(batch, "s/0")
    assert t.rows().count() == t.rejects().count() == 0                # both were written, neither shows
    monkeypatch.setattr(C.WriteOnce, "_commit", real)
    assert t.write(batch, "s/0") and not t.write(batch, "s/0")         # the retry writes, a second one does not
    assert seen(t.rows()) == ["('k1', 1, 'a')", "('k2', 2, None)"]
    assert seen(t.rejects()) == ["('k1', 1, 'b')", "(None, 3, 'x')"]
    assert t.write(batch, "other/0")                                   # the same rows from elsewhere: replays and the same rejects
    assert t.rows().count() == 2 and t.rejects().count() == 4
    assert t.remove_uncommitted() == 2 and t.rows().count() == 2


def test_a_batch_is_judged_again_after_another_writer(spark, monkeypatch):
    t, late = table(spark, "race"), []
    real = C.WriteOnce._commit

    def overtaken(self, number, record):
        if not late:
            late.append(True)
            assert t.write(spark.createDataFrame([("k1", 9, "first")], SCHEMA), "b/0")
        return real(self, number, record)

    monkeypatch.setattr(C.WriteOnce, "_commit", overtaken)
    assert t.write(spark.createDataFrame([("k1", 1, "second"), ("k2", 2, "x")], SCHEMA), "a/0")
    assert seen(t.rows()) == ["('k1', 9, 'first')", "('k2', 2, 'x')"] and seen(t.rejects()) == ["('k1', 1, 'second')"]
    assert [c["batch"] for c in t.commits()] == ["b/0", "a/0"]


def test_a_stream_that_dies_after_the_commit_writes_nothing_twice(spark, monkeypatch):
    t, d = table(spark, "replayed"), session.run_dir(spark, "replayed-src")
    J.stage(spark.createDataFrame([("k1", 1, "a"), ("k1", 2, "b")], SCHEMA), f"{d}/src")
    real, died = C.WriteOnce.write, []

    def dies(self, batch, batch_id):
        real(self, batch, batch_id)
        if not died:
            died.append(True)
            raise RuntimeError("lost after the commit")

    monkeypatch.setattr(C.WriteOnce, "write", dies)
    with pytest.raises(Exception):
        C.stream(spark, f"{d}/src", t, f"{d}/ckpt", "s")
    C.stream(spark, f"{d}/src", t, f"{d}/ckpt", "s")
    assert died and seen(t.rows()) == ["('k1', 1, 'a')"] and seen(t.rejects()) == ["('k1', 2, 'b')"]


def test_base_and_deltas_equal_one_run(spark):
    rng = random.Random(3)
    t0 = dt.datetime(2023, 1, 1)
    rows = [(rng.choice([1, 2, 3, 3, 3, None]), t0 + dt.timedelta(minutes=7 * i), i) for i in range(300)]
    versions = spark.createDataFrame(rows, "document_id long, submitted_at timestamp_ntz, l_linenumber int")
    order = ["submitted_at", "l_linenumber"]
    want = {tuple(r) for r in W.assign_versions(versions, order).collect()}
    state, got, read = None, set(), []
    for lo, hi in ((0, 150), (150, 151), (151, 300)):
        delta = versions.where(f"l_linenumber >= {lo} and l_linenumber < {hi}")
        path = session.run_dir(spark, "increment")
        delta.write.parquet(path)
        delta = spark.read.parquet(path)
        state = state if state is not None else I.version_state(delta.where("false").withColumn("version_number", F.lit(1)))
        numbered = I.next_versions(delta, state, order)
        read.append({f.split("/runs/")[1].split("/")[0] for f in numbered.inputFiles()})
        got |= {tuple(r) for r in numbered.collect()}
        kept = session.run_dir(spark, "state")
        I.merge_versions(state, numbered).write.parquet(kept)
        state = spark.read.parquet(kept)
    assert got == want
    assert all(sum("increment" in f for f in files) == 1 for files in read)       # the delta and the state, no old rows
    assert {tuple(r) for r in state.collect()} == {tuple(r) for r in versions.groupBy("document_id").count().collect()}


def test_statuses_of_base_and_deltas_equal_one_run(spark):
    rows = log_rows(random.Random(8), 700, docs=5) + [(77, 701, "Viewed", dt.datetime(2025, 1, 1)), (None, 702, "ReviewRequested", dt.datetime(2025, 1, 1))]
    log = spark.createDataFrame(rows, LOG)
    state = I.status_state(log.where("log_id < 300"))
    for lo, hi in ((300, 600), (600, 601), (601, 9999), (9999, 9999)):
        state = I.merge_statuses(state, I.status_state(log.where(f"log_id >= {lo} and log_id < {hi}")))
    assert {tuple(r) for r in I.statuses(state).collect()} == {tuple(r) for r in W.lifecycle_fold(log).collect()}


def test_a_call_into_python_serves_a_bucket_of_documents(spark):
    """Equal results for one bucket and many; of documents with large, missing and late ids, too."""
    def rows(part):
        base = 2**60 + 1
        return [(base + d, 1000 * d + part, ACTIONS[(d + part) % len(ACTIONS)], dt.datetime(2024, 1, 1 + part, d % 24)) for d in range(60)] \
            + [(None, 900_000 + part, "ReviewRequested", dt.datetime(2024, 1, 1 + part)), (base, None, "Viewed", dt.datetime(2024, 1, 1 + part, 1))]

    parts = [rows(0), rows(2), rows(1), rows(3)]                    # the third comes late
    schema, found = spark.createDataFrame([], LOG).schema, []
    for buckets in (1, 64):
        d = session.run_dir(spark, "buckets")
        for p in parts:
            J.stage(spark.createDataFrame(p, LOG), f"{d}/src")
            J.stream_lifecycle(spark, f"{d}/src", schema, f"{d}/sink", f"{d}/ckpt", buckets=buckets)
        found.append((sorted(map(str, J.lifecycle_status(spark, f"{d}/sink").collect())),
                      sorted(map(str, J.lifecycle_rejects(spark, f"{d}/sink").collect()))))
    assert found[0] == found[1] and len(found[0][0]) == 61 and len(found[0][1]) == len(parts[2])
    kept = [r for p in (parts[0], parts[1], parts[3]) for r in p]
    assert {(r.document_id, r.status, r.n_tried) for r in J.lifecycle_status(spark, f"{d}/sink").collect()} \
        == {tuple(r) for r in W.lifecycle_fold(spark.createDataFrame(kept, LOG)).collect()}


def test_lifecycle_streams_call_python_once_a_bucket():
    """The work of a call does not grow with the documents: one update gives the statuses of all of its bucket."""
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    n, state = 5000, State()
    events = pd.DataFrame({"document_id": range(n), "log_id": range(n), "action": "ReviewRequested", "action_ts": pd.Timestamp("2024-01-01")})
    (out,) = J._lifecycle_update((0,), iter([events]), state)
    assert len(out) == n == len(state.get[0]) and set(out["status"]) == {"UnderReview"} and B.buckets_for(36_000_000) == 18_000
    late, out = J._lifecycle_update((0,), iter([events.head(3)]), state)
    assert late["log_id"].tolist() == [0, 1, 2] and set(out["seq"]) == {2} and len(state.get[0]) == n


def test_ranked_rows_are_shuffled_once(spark, monkeypatch):
    """Window and join of a rank meet on the same columns; null keys, null times and stored numbers count as ever."""
    rows = [(k, t, n) for n, (k, t) in enumerate([(None, "2024-01-01 00:00:00"), (0, "1970-01-01 00:00:05"), (0, None), (None, None), (7, "2024-01-01 00:00:30"),
                                                  (7, "2024-01-01 00:00:10"), (0, "1970-01-01 00:01:05"), (7, "2024-02-01 00:00:00")])]
    df = spark.createDataFrame(rows, "document_id long, s string, n long").withColumn("at", F.col("s").cast("timestamp_ntz")).drop("s")
    state = spark.createDataFrame([(None, 10), (7, 4), (9, 1)], "document_id long, max_version int")
    monkeypatch.setattr(W, "VERSION_ORDER", ["at", "n"])
    assert {r.n: r.version_number for r in W.assign_versions(df).collect()} == {3: 1, 0: 2, 2: 1, 1: 2, 6: 3, 5: 1, 4: 2, 7: 3}
    assert {r.n: r.version_number for r in I.next_versions(df, state).collect()} == {3: 11, 0: 12, 2: 1, 1: 2, 6: 3, 5: 5, 4: 6, 7: 7}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = I.next_versions(df, state)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    window = plan[:plan.index("Window [row_number()")]
    assert "Exchange" not in window, window                         # nothing shuffles the rows after their window
