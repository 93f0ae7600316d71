"""The pipeline and its contract on the smallest tables, against plain versions of the stages."""

import __spark_entry__ as E
import corpus_pipeline as C
import pytest

from covenant.llm import secrets as S
from covenant.llm.common import drop_stored
from test_minhash import brute
from test_secrets import _blank, plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in C.STAGES:
        docs = stage(spark, docs, SF).cache()
        out[name] = docs
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_every_stage_keeps_the_columns(stages):
    for name, _ in C.STAGES[:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes


def test_quality_rejects_marked_documents(spark, stages):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids(stages["quality"]))
    right = sum((i in kept) == bool(q) for i, q in marks.items())
    assert right > 0.95 * len(marks)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["quality"].collect()]
    want = brute(rows, 5)
    assert ids(stages["near_dedup"]) == sorted({c for c in want.values()})


def test_no_benchmark_item_stays(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in stages["near_dedup"].collect()}
    assert ids(stages["decontamination"]) == sorted(i for i, t in before.items() if not any(x in t for x in items))


def test_secrets_are_blanked_and_all_tokens_decode(stages):
    before = {r.doc_id: r.text for r in stages["decontamination"].collect()}
    after = {r.doc_id: r for r in stages["secrets"].collect()}
    assert {i: r.text for i, r in after.items()} == {i: _blank(t) for i, t in before.items()}
    assert not any(plain(r.text, S.BASE) for r in after.values())
    assert all(r.n_chars == len(r.text) for r in after.values())
    last = stages["byte_bpe"].collect()
    assert len(last) == len(after) and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_registered_and_rows_equal(spark, stages):
    got = E.queries()["pipeline"](spark, SF)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((r.doc_id, r.n_tokens) for r in stages["byte_bpe"].collect())
    assert drop_stored(spark) > 0


def test_stages_on_empty_tables_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (None, "x", None, None, 1), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in C.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        assert "ids" in docs.columns


def test_arrow_batches_are_bounded_and_smaller_bounds_stay(spark):
    from covenant.llm.common import small_batches

    session = spark.newSession()
    rows, size = (f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    small_batches(session)
    assert session.conf.get(rows) == "1024" and session.conf.get(size).removesuffix("b") == str(8 << 20)
    session.conf.set(rows, "10")
    session.conf.set(size, "1000")
    small_batches(session)
    assert session.conf.get(rows) == "10" and session.conf.get(size).removesuffix("b") == "1000"
