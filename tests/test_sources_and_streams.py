"""File layouts, write-once sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from covenant import session
from covenant.sources import files as FS
from covenant.streaming import jobs as J


def test_single_files_indented_broken_and_empty(spark, tmp_path):
    record = {"title": "A", "split": "test", "risk_score": 2, "risk_label": "Low", "clauses": {"Audit Rights": "x"}, "model_input": "m", "more": 1}
    (tmp_path / "one.snippets.json").write_text(json.dumps(record, indent=2))
    (tmp_path / "two.snippets.json").write_text('{"title": ')
    (tmp_path / "bad id.snippets.json").write_text(json.dumps(record))
    (tmp_path / "blank.snippets.json").write_text(json.dumps(record | {"title": " "}))
    for name in ("one", "two", "blank", "four"):
        (tmp_path / f"{name}.txt").write_text("" if name == "blank" else "text\n")
    s = {r.safe_id: r for r in FS.read_snippet_files(spark, str(tmp_path)).collect()}
    assert set(s) == {"one", "two", "blank"} and s["one"].title == "A" and s["one"].clauses == record["clauses"]
    assert s["two"]._corrupt and s["one"]._corrupt is None
    t = {r.safe_id: r.text for r in FS.read_text_files(spark, str(tmp_path)).collect()}
    assert t == {"one": "text\n", "two": "text\n", "blank": "", "four": "text\n"}
    listed = FS.list_contracts(FS.read_snippet_files(spark, str(tmp_path)), FS.read_text_files(spark, str(tmp_path)))
    assert [(r.id, r.title, r.clause_count) for r in FS.contracts_by_title(listed).collect()] == [("one", "A", 1), ("blank", "blank", 1)]
    assert FS.read_objects(spark, str(tmp_path / "blank.txt")).first().length == 0


def test_export_lists_folders_not_contracts(spark):
    rec = spark.createDataFrame([(f"id{i}", f"t{i}", "test", i % 11, "Low", {"c": "v"}, "m", "" if i == 1 else "x\ny") for i in range(50)],
                                "safe_id string, title string, split string, risk_score int, risk_label string, clauses map<string,string>, "
                                "model_input string, text string")
    base = session.run_dir(spark, "export-test")
    FS.export_contracts(rec, base)
    assert FS.read_snippets(spark, f"{base}/snippets").where("_corrupt is null").count() == 50
    assert {r.text for r in FS.read_contract_text(spark, f"{base}/texts").collect()} == {"", "x\ny"}
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/snippets").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert sum(x.isDirectory() for x in fs.listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/snippets"))) == 1
    assert session.remove(spark, base)


def test_write_once_gives_every_row_a_place(spark):
    sink = session.run_dir(spark, "once")
    schema = "storage_key string, n int, h string"
    J.write_once(spark.createDataFrame([("k1", 1, "b"), ("k1", 1, "a"), ("k2", 2, None), ("k2", 2, None), (None, 3, "x")], schema), sink)
    J.write_once(spark.createDataFrame([("k1", 1, "a"), ("k2", 9, None), ("k3", 3, "c")], schema), sink)
    kept = sorted(map(tuple, spark.read.parquet(sink).select("storage_key", "n", "h").collect()))
    assert kept == [("k1", 1, "a"), ("k2", 2, None), ("k3", 3, "c")]
    bad = sorted(map(str, map(tuple, spark.read.parquet(f"{sink}_rejects").collect())))
    assert bad == ["('k1', 1, 'b')", "('k2', 9, None)", "(None, 3, 'x')"]


def test_late_events_are_rejected_and_the_rest_folds(spark):
    d = session.run_dir(spark, "late")
    schema = "document_id long, log_id long, action string, action_ts timestamp"
    parts = [[(1, 2, "RevisionRequested", "2024-01-01 11:00:00")], [(1, 1, "ReviewRequested", "2024-01-01 10:00:00")],
             [(1, 3, "ReviewRequested", "2024-01-01 12:00:00"), (2, 4, "Viewed", "2024-01-01 09:00:00")]]
    for p in parts:
        J.stage(spark.createDataFrame(p, "document_id long, log_id long, action string, t string")
                .select("document_id", "log_id", "action", F.col("t").cast("timestamp").alias("action_ts")), f"{d}/src")
        J.stream_lifecycle(spark, f"{d}/src", spark.createDataFrame([], schema).schema, f"{d}/sink", f"{d}/ckpt")
    assert [(r.document_id, r.log_id) for r in J.lifecycle_rejects(spark, f"{d}/sink").collect()] == [(1, 1)]
    got = {r.document_id: (r.status, r.n_tried, r.n_refused) for r in J.lifecycle_status(spark, f"{d}/sink").collect()}
    assert got == {1: ("UnderReview", 2, 1), 2: ("Draft", 0, 0)}


def test_shared_folder_is_demanded_off_local_mode():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
