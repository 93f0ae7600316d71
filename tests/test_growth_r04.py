"""Disk of the version jobs: rows are shuffled once for their rank and order, batches are judged in one shuffle."""

import collections
import datetime as dt
import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from covenant import session
from covenant.operators import replay as RP
from covenant.operators import workflow as W
from covenant.plans.catalog import QUERIES
from covenant.sources import fixtures as FX
from covenant.streaming import commits as C

SF_SMALL = "/root/testdata/sf0.001"

VERSIONS = ("document_id long, submitted_at timestamp_ntz, l_linenumber int, l_partkey long, l_suppkey long, "
            "l_extendedprice double, file_name string, content_hash string")
SHOWN = ["document_id", "version_number", "file_name", "submitted_at", "content_hash"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _versions(rng, n=400):
    """Documents of a few rows, two with many (one of them null), null times, and hashes of all kinds."""
    hashes = ["ab" * 32, "0f", "", None, "AB" * 32, "abc", "no digits", "é", "00ff00"]
    day = dt.datetime(2024, 3, 1)
    return [(rng.choice([None, None, 7, 7, *range(20, 80)]),
             rng.choice([None, *(day + dt.timedelta(minutes=m, seconds=rng.randrange(60)) for m in range(6))]),
             i, rng.choice([None, 1, 2]), i % 5, rng.choice([None, 1.5]), f"f{i}.txt", rng.choice(hashes)) for i in range(n)]


def test_version_history_shuffles_its_rows_once(spark):
    p = _plan(QUERIES["version_history"](spark, SF_SMALL))
    assert p.count("Exchange") == 1 and "Exchange rangepartitioning(document_id" in p


@pytest.mark.parametrize("heavy, sent", [(10**6, 10**6), (30, 10**6), (30, 0), (1, 10**6)])
def test_version_history_is_exact_with_heavy_documents(spark, monkeypatch, heavy, sent):
    monkeypatch.setattr(RP, "HEAVY", heavy)
    monkeypatch.setattr(RP, "SENT", sent)
    rows = spark.createDataFrame(_versions(random.Random(4)), VERSIONS).repartition(5)
    number = F.row_number().over(Window.partitionBy("document_id").orderBy(*W.VERSION_ORDER))
    want = [tuple(r) for r in rows.withColumn("version_number", number).select(SHOWN).collect()]
    out = W.version_history(W.assign_versions(rows, dealt=True)).select(SHOWN)
    assert not sent or _plan(out).count("Exchange rangepartitioning") == 1
    assert [tuple(r) for r in out.collect()] == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))


def test_rows_of_a_heavy_document_lie_in_several_ranges(spark, monkeypatch):
    day = dt.datetime(2024, 3, 1)
    rows = spark.createDataFrame([(1, day + dt.timedelta(minutes=i), i, 1, 1, 1.0, "f", "ab") for i in range(2000)], VERSIONS)
    assert "_slice" not in W.assign_versions(rows, dealt=True).columns
    monkeypatch.setattr(RP, "HEAVY", 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = W.version_history(W.assign_versions(rows, dealt=True)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.version_number for r in out] == list(range(2000, 0, -1)) and len({r.task for r in out}) > 3


def _scratch(spark):
    """Shuffle files of the block manager and files of checkpoints."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = env.blockManager().diskBlockManager().getAllFiles()
    blocks = {files.apply(i).getName() for i in range(files.size())}
    kept = Path(urlparse(spark.sparkContext.getCheckpointDir()).path).glob("rdd-*/part-*")
    return {b for b in blocks if b.startswith("shuffle")} | set(map(str, kept))


def test_a_write_leaves_no_scratch(spark):
    d, key = session.run_dir(spark, "scratch"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    session.materialize(spark.range(1))                             # makes the folder of checkpoints
    batch = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("storage_key"), F.col("id").alias("n"))
    table, before, was = C.WriteOnce(spark, d, batch.schema), _scratch(spark), spark.conf.get(key)
    assert table.write(batch.repartition(4, "n"), "one") and table.write(batch.repartition(4, "n"), "two")
    assert not _scratch(spark) - before and spark.conf.get(key) == was
    assert {p.name for p in Path(urlparse(d).path).iterdir()} == {"_commits", "_staged", "_attempts", "data"}
    assert not [p for x in ("_staged", "_attempts") for p in (Path(urlparse(d).path) / x).iterdir()]
    table.remove_uncommitted()
    assert table.rows().count() == 4000 and {p.name for p in Path(urlparse(d).path).iterdir()} == {"_commits", "data"}


@pytest.mark.parametrize("file_rows", [10**6, 7])
def test_batches_are_judged_as_one_by_one(spark, monkeypatch, file_rows):
    """Against a plain replay: repeated, differing, stored and missing keys, in three batches."""
    monkeypatch.setattr(C, "FILE_ROWS", file_rows)
    schema, rng = "n int, storage_key string, h string", random.Random(file_rows)
    table = C.WriteOnce(spark, session.run_dir(spark, "judged"), spark.createDataFrame([], schema).schema)
    stored, rejects = {}, collections.Counter()
    for b in range(3):
        rows = [(rng.choice([None, 1, 2]), rng.choice([None, *(f"k{i}" for i in range(60 * (b + 1)))]), rng.choice([None, "a", "b"])) for _ in range(200)]
        rows += [(1, None, None)] * 3
        table.write(spark.createDataFrame(rows, schema).repartition(3), f"b{b}")
        content = lambda r: ((r[0] is not None, r[0] or 0), (r[2] is not None, r[2] or ""))  # noqa: E731 - nulls come first
        first = {}
        for r in sorted(rows, key=content):
            first.setdefault(r[1], r)
        held = {**first, **stored}
        rejects.update(r for r in rows if r[1] is None or r != held[r[1]])
        stored.update({k: r for k, r in held.items() if k is not None})
        assert sorted(map(str, map(tuple, table.rows().collect()))) == sorted(map(str, stored.values()))
        assert collections.Counter(map(tuple, table.rejects().collect())) == rejects


@pytest.mark.parametrize("repeated", [False, True])
def test_submissions_come_as_often_as_their_orders(spark, tmp_path, repeated):
    day = dt.datetime(2024, 3, 1)
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate timestamp_ntz"
    spark.createDataFrame([(k, i, 1, 1, 2.0, day) for i, k in enumerate([1, 1, 2, 3, None, 9])], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 5) for k in [1, 2, 3, None, None, *[1, 3, 3] * repeated]], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got, want = FX.fx_submissions(spark, str(tmp_path)), FX.fx_versions(spark, str(tmp_path)).drop("submitted_by")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == (11 if repeated else 6) - repeated
    assert ("o_orderkey" in _plan(got)) == repeated
    keys = QUERIES["append_versions"](spark, str(tmp_path)).collect()
    assert len({r.storage_key for r in keys}) == len(keys) == (9 if repeated else 5)
