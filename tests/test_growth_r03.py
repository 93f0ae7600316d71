"""What grows with the data: files of a committed batch, passes over the texts, tasks that read objects."""

from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from covenant import session
from covenant.functions import text as X
from covenant.operators import risk as R
from covenant.plans import q_ml
from covenant.sources import fixtures as FX
from covenant.sources import objects as OB
from covenant.streaming import commits as C

SF_SMALL = "/root/testdata/sf0.001"


def _files(spark, d, batch):
    table = C.WriteOnce(spark, d, batch.schema)
    table.write(batch, "one")
    files = sorted(Path(urlparse(f"{d}/data").path).rglob("*.parquet"))
    assert {(r.storage_key, r.n) for r in table.rows().collect()} == {(r.storage_key, r.n) for r in batch.collect()}
    assert table.rejects().count() == 0
    return files


def test_a_batch_writes_a_file_a_bucket_however_many_tasks(spark, monkeypatch):
    batch = spark.range(4000).repartition(16).select(F.concat(F.lit("k"), "id").alias("storage_key"), F.col("id").alias("n"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")           # as in the batches of a stream
    try:
        files = _files(spark, session.run_dir(spark, "files"), batch)
        assert len(files) == len({f.parent for f in files}) <= C.BUCKETS
        monkeypatch.setattr(C, "FILE_ROWS", 40)                     # large buckets are cut
        cut = _files(spark, session.run_dir(spark, "files"), batch)
        assert len(cut) > len(files)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_an_empty_batch_is_committed(spark):
    d = session.run_dir(spark, "files")
    table = C.WriteOnce(spark, d, spark.createDataFrame([], "storage_key string, n long").schema)
    assert table.write(spark.createDataFrame([], "storage_key string, n long"), "none")
    assert table.rows().count() == 0 and not table.write(spark.createDataFrame([("a", 1)], "storage_key string, n long"), "none")


def test_white_space_is_told_as_before(spark):
    """Every character that Python or Java takes for white space, alone, inside and around others."""
    some = [chr(c) for c in range(0x3100)] + [chr(0xfeff), chr(0xffff), "\U0001f600", "\U0010ffff"]
    texts = [t for c in some for t in (c, f"a{c}b", f"{c}{c}a {c} b{c}")] + ["", None, " \t\n", "x\n", " x\r\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    strip = rf"^[{X._JAVA_WS}]+|[{X._JAVA_WS}]+$"
    got = df.select("t", X.first_words("t", 2).alias("w"), X.is_blank("t").alias("blank"), X.strip("t").alias("s"),
                    F.regexp_replace("t", strip, "").alias("plain")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.s == r.plain and r.blank == (not r.plain)
        assert r.w == (None if r.t is None else " ".join(r.t.split()[:2]))


def test_a_blank_text_is_told_without_rewriting_it(spark):
    df = spark.createDataFrame([("x",)], "t string").select(X.is_blank("t"))
    assert "regexp_replace" not in df._jdf.queryExecution().analyzed().toString()


def test_model_frames_read_the_texts_once(spark, monkeypatch):
    calls, build = [], R.contract_risk
    monkeypatch.setattr(R, "contract_risk", lambda qa, *a, **k: (calls.append(1), build(qa, *a, **k))[1])
    train, test = q_ml._frames(spark, SF_SMALL)
    assert len(calls) == 1
    risk = {r.title: r for r in q_ml.ML.model_frame(build(FX.fx_qa(spark, SF_SMALL))).collect()}
    made = train.collect() + test.collect()
    assert len(made) == len(risk) and all(risk[r.title] == r for r in made)


@pytest.mark.parametrize("query", ["train_weighted", "select_model_columns"])
def test_model_queries_build_the_texts_once(spark, monkeypatch, query):
    calls, build = [], R.contract_risk
    monkeypatch.setattr(R, "contract_risk", lambda qa, *a, **k: (calls.append(1), build(qa, *a, **k))[1])
    monkeypatch.setattr(q_ml.ML, "train_weighted", lambda train, **k: None)
    monkeypatch.setattr(q_ml.ML, "score_batch", lambda model, frame: frame)
    monkeypatch.setattr(q_ml.ML, "evaluate_split", lambda scored: {"metrics": scored})
    getattr(q_ml, query)(spark, SF_SMALL)
    assert len(calls) == 1


def test_contents_are_read_by_many_tasks(spark, tmp_path):
    """A listing is a few bytes a row, which adaptive execution would put into one task."""
    rows = [(i, 1, "a", bytes([i % 256]) * i) for i in range(300)]
    made = spark.createDataFrame(rows, "document_id long, version int, name string, content binary")
    assert OB.store_objects(made, str(tmp_path)).where("outcome = 'stored'").count() == 300
    got = OB.read_tree(OB.list_objects(spark, str(tmp_path)), str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.document_id, bytes(r.content)) for r in got} == {(i, c) for i, _, _, c in rows} and len(got) == 300
    assert len({r.task for r in got}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
