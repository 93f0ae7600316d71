"""Operator properties and golden numbers."""

import collections
import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from covenant import schemas as S
from covenant.operators import metrics as M
from covenant.operators import replay as RP
from covenant.operators import risk as R
from covenant.operators import split as SP
from covenant.operators import workflow as W
from covenant.sources import fixtures as FX

from conftest import SF_SMALL

GOLDEN_MATRIX = [[17, 13, 6], [5, 5, 15], [2, 1, 18]]


def test_golden_metrics(spark):
    pairs = M.golden_pairs(spark, GOLDEN_MATRIX)
    m = M.eval_metrics(pairs).first()
    assert m["accuracy"] == 0.4878048780487805
    assert m["f1"] == 0.4717294900221729
    assert m["precision"] == 0.5094055495210823
    assert m["recall"] == 0.4878048780487805
    cm = {(r["actual"], r["predicted"]): r["n"] for r in M.confusion_matrix(pairs).collect()}
    assert cm[("Low", "Low")] == 17 and cm[("High", "Medium")] == 1 and len(cm) == 9


def test_golden_report(spark):
    rep = {r["row"]: r for r in M.classification_report(M.golden_pairs(spark, GOLDEN_MATRIX)).collect()}
    assert round(rep["Low"]["precision"], 2) == 0.71 and round(rep["Low"]["recall"], 2) == 0.47
    assert round(rep["High"]["recall"], 2) == 0.86 and round(rep["Medium"]["f1"], 2) == 0.23
    assert round(rep["macro avg"]["f1"], 2) == 0.46 and rep["weighted avg"]["support"] == 82


def test_golden_quotas(spark):
    rows = [(f"t{i}", lab) for lab, n in (("Low", 179), ("Medium", 126), ("High", 103)) for i in range(n)]
    risk = spark.createDataFrame([(f"{lab}{t}", lab) for t, lab in rows], "title string, risk_label string")
    q = {r["risk_label"]: r["quota"] for r in SP.split_quotas(risk).collect()}
    assert q == {"Low": 36, "Medium": 25, "High": 21}
    split = SP.stratified_split(risk)
    got = collections.Counter((r["risk_label"], r["split"]) for r in split.collect())
    assert got[("Low", "test")] == 36 and got[("Medium", "test")] == 25 and got[("High", "test")] == 21
    d = SP.split_disjoint(split, risk).first()
    assert d["n_overlap"] == 0 and d["n_missing"] == 0 and d["n_train"] + d["n_test"] == 408


def test_split_is_deterministic_and_exact_on_fixture(spark):
    risk = R.contract_risk(FX.fx_qa(spark, SF_SMALL, with_context=False))
    a = {r["title"]: r["split"] for r in SP.stratified_split(risk).collect()}
    b = {r["title"]: r["split"] for r in SP.stratified_split(risk).collect()}
    assert a == b
    counts = collections.Counter(v for v in a.values())
    assert counts["test"] == (len(a) + 4) // 5  # ceil(N/5): 36/4/0 at sf0.001
    q = {r["risk_label"]: r["quota"] for r in SP.split_quotas(risk).collect()}
    assert q == {"Low": 36, "Medium": 4, "High": 0}


def test_smallest_per_group_matches_bruteforce(spark):
    rows = [(f"id{i}", ["a", "b", "c"][i % 3]) for i in range(500)]
    df = spark.createDataFrame(rows, "title string, g string")
    quotas = spark.createDataFrame([("a", 10), ("b", 0), ("c", 1000)], "g string, quota int")
    keyed = df.withColumn("k", SP.seeded_key(5))
    got = {r["title"] for r in SP.smallest_per_group(keyed, "g", "k", "title", quotas, "p").where("p").collect()}
    import hashlib
    want = set()
    for g, q in (("a", 10), ("b", 0), ("c", 1000)):
        members = sorted((hashlib.md5(f"5|{t}".encode()).hexdigest(), t) for t, gg in rows if gg == g)
        want |= {t for _, t in members[:q]}
    assert got == want


def test_contract_risk_block_size_invariant(spark):
    qa = FX.fx_qa(spark, SF_SMALL, with_context=False)
    a = {r["title"]: (r["risk_score"], r["risk_text"]) for r in R.contract_risk(qa).collect()}
    b = {r["title"]: (r["risk_score"], r["risk_text"]) for r in R.contract_risk(qa, block_rows=3).collect()}
    assert a == b
    assert all(v[1] is not None for v in a.values())  # no-answer contracts get ''


def _python_replay(rows):
    legal = set(S.TRANSITIONS)
    target = dict(S.STATUS_MOVES)
    state, tried, refused = {}, 0, 0
    for doc, ts, lid, action in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        state.setdefault(doc, "Draft")
        t = target.get(action)
        if t is None:
            continue
        tried += 1
        if (state[doc], t) in legal:
            state[doc] = t
        else:
            refused += 1
    return state, tried, refused


def test_lifecycle_fold_matches_python_replay(spark):
    log = FX.fx_audit(spark, SF_SMALL)
    rows = [(r["document_id"], r["action_ts"], r["log_id"], r["action"]) for r in log.collect()]
    want, tried, refused = _python_replay(rows)
    got = {r["document_id"]: r["status"] for r in W.lifecycle_fold(log).collect()}
    assert got == want
    counts = collections.Counter(got.values())
    assert counts == {"Draft": 241, "UnderReview": 102, "RevisionRequested": 27, "Approved": 25, "Locked": 2}
    steps = W.lifecycle_steps_per_action(log)
    assert steps.count() == tried == 812 and steps.where(~F.col("legal")).count() == refused == 592


def test_lifecycle_block_size_does_not_matter(spark, monkeypatch):
    log = FX.fx_audit(spark, SF_SMALL)
    want, final = sorted(map(tuple, W.lifecycle_steps_per_action(log).collect())), sorted(map(tuple, W.lifecycle_fold(log).collect()))
    monkeypatch.setattr(RP, "BLOCK", 2)
    assert sorted(map(tuple, W.lifecycle_steps_per_action(log).collect())) == want
    assert sorted(map(tuple, W.lifecycle_fold(log).collect())) == final


def test_exact_rank_keeps_null_keys_and_null_order(spark):
    rows = [(None, 3, 1), (None, None, 2), (1, None, 3), (1, 5, 4), (1, 5000, 5)]
    df = spark.createDataFrame(rows, "k long, o long, id long")
    got = {r.id: r.n for r in RP.exact_rank(df, "k", ["o", "id"], F.floor(F.col("o") / 4096), "n").collect()}
    assert got == {2: 1, 1: 2, 3: 1, 4: 2, 5: 3}


def test_exact_rank_matches_row_number(spark):
    from pyspark.sql import Window
    v = FX.fx_versions(spark, SF_SMALL)
    got = W.assign_versions(v)
    want = v.withColumn("version_number", F.row_number().over(
        Window.partitionBy("document_id").orderBy(*W.VERSION_ORDER)))
    cols = ["document_id", "l_linenumber", "l_partkey", "l_suppkey", "submitted_at", "version_number"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


DOCS = ("document_id long, file_name string, storage_key string, risk_score double, rule_label string, risk_label string, "
        "risk_confidence double, status string, version_number int, uploaded_by long, locked_at timestamp_ntz")
CMDS = "cmd_id long, document_id long, actor_id long, command string, notes string, ts timestamp_ntz"


def _batch(spark, commands):
    """Documents 1 (stored), 2 (stored, altered), 3 (no object); owner 5, reviewer 9."""
    docs = spark.createDataFrame([(i, f"f{i}.txt", f"doc-{i}/v1/f{i}.txt", 2.0, "Low", "Low", 0.9, "UnderReview", 1, 5, None)
                                  for i in (1, 2, 3)], DOCS)
    objects = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, t string").select(
        "document_id", F.sha2("t", 256).alias("recorded_hash"),
        F.encode(F.when(F.col("document_id") == 2, "changed").otherwise(F.col("t")), "UTF-8").alias("content"))
    users = spark.createDataFrame([(5, "Employee"), (9, "ReviewerCompliance")], "user_id long, role string")
    base = dt.datetime(2024, 1, 1)
    cmds = spark.createDataFrame([(n, d, a, c, note, base + dt.timedelta(minutes=n)) for n, (d, a, c, note) in enumerate(commands)], CMDS)
    return W.command_replay(cmds, docs, objects, users), docs, objects


def test_commands_are_judged_in_order(spark):
    replay, docs, objects = _batch(spark, [
        (1, 9, "approve", " ok "), (1, 9, "approve", "again"), (1, 9, "request_revision", "late"),     # the second is too late
        (2, 9, "approve", "x"), (2, 9, "request_revision", " fix it "), (2, 5, "resubmit", "new text"), (2, 9, "approve", ""),
        (3, 9, "approve", "x"), (3, 5, "approve", "x"), (3, 9, "view", None), (77, 9, "approve", "x"), (77, 9, "view", None)])
    got = {r.cmd_id: r for r in replay.collect()}
    assert len(got) == 12
    assert {i: r.reason for i, r in got.items()} == {
        0: None, 1: "illegal_move", 2: "illegal_move", 3: "hash", 4: None, 5: None, 6: None, 7: "hash", 8: "self", 9: None,
        10: "unknown", 11: "unknown"}
    text = {r.cmd_id: r.message for c in ("approve", "view") for r in W.command_job(replay, c).collect()}
    assert text[1] == "A document that is locked can't move to approved." and text[3] == S.MSG_HASH_MISMATCH
    assert text[7] == "Could not read doc-3/v1/f3.txt" and text[8] == S.MSG_SELF_REVIEW and text[10] == "Document 77 not found"
    after = {r.document_id: r for r in W.command_documents(replay, docs, objects).collect()}
    assert (after[1].status, after[1].reviewer_notes, after[1].risk_score) == ("Locked", "ok", 2.0) and after[1].locked_at
    assert (after[2].status, after[2].version_number, after[2].storage_key) == ("Locked", 2, "doc-2/v2/f2.txt")
    assert after[2].risk_score is None and after[2].reviewer_notes == "fix it" and after[2].classification_note.startswith("Version 2 was")
    assert after[3].status == "UnderReview" and after[3].locked_at is None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()                              # noqa: E731
    assert [after[i].content_hash for i in (1, 2, 3)] == [sha("a"), sha("new text"), None]
    views = {r.cmd_id: (r.status, r.allowed) for r in W.guarded(replay, "view", "UnderReview").collect()}
    assert views == {9: ("UnderReview", True), 11: (None, False)}
    assert [tuple(r) for r in W.guarded(replay, "resubmit", "RevisionRequested").collect()] == [(5, 2, "RevisionRequested", True)]
    versions = W.command_versions(replay).collect()
    assert [(v.document_id, v.version_number, v.submitted_by) for v in versions] == [(2, 2, 5)]
    log = [(r.cmd_id, r.action) for r in W.command_log(replay).orderBy("cmd_id", "step").collect()]
    assert log == [(0, "Approved"), (0, "Locked"), (4, "RevisionRequested"), (5, "Resubmitted"), (5, "ReviewRequested"),
                   (6, "Approved"), (6, "Locked"), (9, "Viewed")]


def test_command_blocks_do_not_matter(spark, monkeypatch):
    args = (FX.fx_commands(spark, SF_SMALL), FX.fx_documents(spark, SF_SMALL), FX.fx_objects(spark, SF_SMALL),
            FX.fx_users(spark, SF_SMALL))
    a = sorted(map(tuple, W.command_replay(*args).drop("ts").collect()), key=str)
    monkeypatch.setattr(RP, "BLOCK", 2)
    assert sorted(map(tuple, W.command_replay(*args).drop("ts").collect()), key=str) == a
    assert len(a) == args[0].count()


def _first_free(titles):
    import re
    used, out = set(), []
    for t in titles:
        base = re.sub(r"[^A-Za-z0-9._-]+", "_", t).strip("._-")[:80] or "contract"
        k = 1
        while (base if k == 1 else f"{base}_{k}") in used:
            k += 1
        out.append(base if k == 1 else f"{base}_{k}")
        used.add(out[-1])
    return out


def test_safe_ids_are_unique_and_in_order(spark):
    import random
    rnd = random.Random(8)
    cases = [["a", "a", "a_2"], ["a_2", "a", "a"], ["a", "a_2", "a", "a_2", "a_2_2", "a"], ["", "?", "contract_2", "contract"],
             ["a_02", "a", "a_1", "a_0", "a"], ["x" * 90, "x" * 80]]
    cases += [[rnd.choice(["a", "a_2", "a_3", "a_2_2", "a_2_2_2", "b", "a_3_2", "a_4", " ", "a b"]) for _ in range(rnd.randint(2, 25))]
              for _ in range(6)]
    for titles in cases:
        df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "n long, title string")
        got = {r.n: r.safe_id for r in SP.safe_ids(df, "title", "n").collect()}
        assert [got[i] for i in range(len(titles))] == _first_free(titles), titles
    words = spark.createDataFrame([("Agreement B",), ("agreement a",), ("Agreement B!",)], "title string")
    assert sorted(r.safe_id for r in SP.safe_ids(words, "title", "title").collect()) == ["Agreement_B", "Agreement_B_2", "agreement_a"]


def test_chains_of_names_end_in_few_rounds(spark, monkeypatch):
    rounds = []
    real = SP.materialize
    monkeypatch.setattr(SP, "materialize", lambda df: rounds.append(0) or real(df))
    names = [f"n{i}" for i in range(1000)]
    rnd = __import__("random").Random(6)
    rows = [(n, names[i - 1] if i else "root", *rnd.choice([(0, 1), (1, 0), (0, 1), (1, 0), (1, 1)])) for i, n in enumerate(names)]
    value, want = 0, {}
    for n, _, f0, f1 in rows:
        value = f1 if value else f0
        want[n] = value
    rnd.shuffle(rows)
    got = SP.settle(spark.createDataFrame(rows, "name string, up string, f0 int, f1 int")).collect()
    assert {r.name: r.value for r in got} == want and len(rounds) <= 12
    rounds.clear()
    titles = ["a"] + ["a" + "_2" * i for i in range(39)] + ["b_2", "b", "b"]      # names hold 80 characters
    df = spark.createDataFrame(list(enumerate(titles)), "n long, title string")
    got = {r.n: r.safe_id for r in SP.safe_ids(df, "title", "n").collect()}
    assert [got[i] for i in range(len(titles))] == _first_free(titles) and len(rounds) <= 12


def test_ranks_over_sampled_ranges(spark):
    from covenant.operators.replay import range_rank
    rnd = __import__("random").Random(9)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), rnd.choice(["same prefix " + str(rnd.randrange(10**6)), None]), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "p string, t string, n long").repartition(7)
    key = lambda r: (r[1] is not None, r[1] or "", r[2])
    got = {r.n: r.k for r in range_rank(df, ["p"], ["t", "n"], "k").collect()}
    for p in ("hot", "a", None):
        assert [got[r[2]] for r in sorted((r for r in rows if r[0] == p), key=key)] == list(range(1, sum(r[0] == p for r in rows) + 1))
    got = {r.n: r.k for r in range_rank(df.where("t is not null"), [], ["t", "n"], "k").collect()}
    assert [got[r[2]] for r in sorted((r for r in rows if r[1]), key=key)] == list(range(1, len(got) + 1))
    assert range_rank(df.limit(0), ["p"], ["t"], "k").collect() == []
    plan = range_rank(df, [], ["t", "n"], "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange rangepartitioning" not in plan and plan.count("Window [") <= 1       # over counts of ranges only


def test_gate_stops_on_other_counts(spark):
    split = spark.createDataFrame([("a", "Low", "test"), ("b", "Low", "train")], "title string, risk_label string, split string")
    assert SP.gated_split(split, {"Low": 1}).count() == 2
    with pytest.raises(ValueError, match="High 0 instead of 2"):
        SP.gated_split(split, {"Low": 1, "High": 2})


def test_hot_document_matches_replay(spark):
    """One document with thousands of moves inside one hour: many blocks."""
    import random
    rnd = random.Random(3)
    actions = ["ReviewRequested", "RevisionRequested", "Approved", "Locked", "Viewed"]
    rows = [(i, 7 if i % 10 else 8, f"2024-01-01 10:{(i // 100) % 60:02d}:{i % 60:02d}", rnd.choice(actions))
            for i in range(4000)]
    log = spark.createDataFrame(rows, "log_id long, document_id long, ts string, action string") \
        .select("log_id", "document_id", F.col("ts").cast("timestamp_ntz").alias("action_ts"), "action")
    py = [(r[1], r[2], r[0], r[3]) for r in rows]
    want, tried, refused = _python_replay(py)
    got = {r["document_id"]: r["status"] for r in W.lifecycle_fold(log).collect()}
    assert got == want
    steps = W.lifecycle_steps_per_action(log)
    assert steps.count() == tried and steps.where(~F.col("legal")).count() == refused


def test_score_with_external_model_hook(spark):
    """M3 hook: a pandas function over Arrow batches supplies logits; softmax/argmax stay in the JVM."""
    from covenant.operators import ml as ML
    risk = R.contract_risk(FX.fx_qa(spark, SF_SMALL, with_context=False))

    def logits(texts):
        return [[0.0, float(len(t) % 3), 1.0] for t in texts]

    out = ML.score_with(risk, logits).select("title", "prediction.risk_label", "prediction.confidence").collect()
    assert len(out) == 200
    assert {r["risk_label"] for r in out} <= {"Medium", "High"}
    assert all(0.0 < r["confidence"] <= 1.0 for r in out)


def test_long_history_matches_replay(spark):
    """A document spanning 200 days; results equal the replay."""
    import random
    rnd = random.Random(5)
    actions = ["ReviewRequested", "RevisionRequested", "Approved", "Locked", "Viewed"]
    rows = []
    for i in range(3000):
        day = i % 200
        ts = f"2023-{1 + day // 28:02d}-{1 + day % 28:02d} {i % 24:02d}:{(i * 7) % 60:02d}:{i % 60:02d}"
        rows.append((i, 9 if i % 7 else 10, ts, rnd.choice(actions)))
    log = spark.createDataFrame(rows, "log_id long, document_id long, ts string, action string") \
        .select("log_id", "document_id", F.col("ts").cast("timestamp_ntz").alias("action_ts"), "action")
    want, tried, refused = _python_replay([(r[1], r[2], r[0], r[3]) for r in rows])
    steps = W.lifecycle_steps_per_action(log)
    assert steps.count() == tried and steps.where(~F.col("legal")).count() == refused
    assert {r["document_id"]: r["status"] for r in W.lifecycle_fold(log).collect()} == want


def test_single_pass_firsts_match_first_answers(spark):
    qa = FX.fx_qa(spark, SF_SMALL, with_context=False)
    one = R.contract_risk_with_firsts(qa, block_rows=3)
    got = {(r["title"], f["clause"]): f["snippet"] for r in one.collect() for f in r["firsts"]}
    want = {(r["title"], r["clause"]): r["snippet"] for r in R.first_answers(qa).collect()}
    assert got == want
    base = {r["title"]: (r["risk_score"], r["risk_text"]) for r in R.contract_risk(qa).collect()}
    assert {r["title"]: (r["risk_score"], r["risk_text"]) for r in one.collect()} == base


def test_describe_against_pandas(spark):
    import pandas as pd
    for values in ([], [3], [2, 2, 2], [1, 9], [0, 1, 5, 5, 100000, -7, 3, 3], list(range(5000))):
        r = R.describe(spark.createDataFrame([(v,) for v in [*values, None]], "x long"), "x").first()
        want = pd.Series(values, dtype="float64").describe()
        got = dict(zip(["count", "mean", "std", "min", "25%", "50%", "75%", "max"],
                       (r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"])))
        for k, v in want.items():
            assert (got[k] is None and pd.isna(v)) or abs(got[k] - v) < 1e-9, (values[:3], k)


# ---- models ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def made(spark):
    """Three classes told apart by their words, one of them rare and noisy."""
    import random
    rnd = random.Random(4)
    rows = []
    for i in range(600):
        label = rnd.choices(["Low", "Medium", "High"], [0.6, 0.3, 0.1])[0]
        own = {"Low": "calm safe plain", "Medium": "some risk clause", "High": "severe risk penalty"}[label].split()
        words = rnd.choices(own, k=4) + rnd.choices("calm safe plain some risk clause severe penalty the of".split(), k=8)
        rows.append((f"t{i}", " ".join(words), label, i % 4))
    return spark.createDataFrame(rows, "title string, risk_text string, risk_label string, fold int")


def test_training_and_scores(made):
    from covenant.operators import ml as ML
    frame = ML.model_frame(made.where("fold != 0"))
    model = ML.train_weighted(frame)
    scored = ML.score_batch(model, ML.model_frame(made.where("fold = 0"))).collect()
    assert len(scored) == made.where("fold = 0").count()
    for r in scored:
        assert set(r.probabilities) == set(S.LABELS) and abs(sum(r.probabilities.values()) - 1) < 2e-4
        assert r.risk_label in S.LABELS and 0 <= r.predicted <= 2 and 0 < r.confidence <= 1
    right = sum(r.predicted == int(r.labels) for r in scored) / len(scored)
    assert right > 0.55
    parts = ML.evaluate_split(ML.score_batch(model, frame))
    assert abs(parts["metrics"].first()["accuracy"] - sum(r["n"] for r in parts["confusion"].collect() if r["actual"] == r["predicted"])
               / frame.count()) < 1e-9


def test_weights_raise_recall_of_the_rare_class(made):
    from covenant.operators import ml as ML
    grid = [(1.0, 1.0, 1.0), (1.0, 3.0, 9.0)]
    rows = ML.weight_sweep(ML.model_frame(made.where("fold != 0")), ML.model_frame(made.where("fold = 0")), grid).orderBy("setting").collect()
    assert len(rows) == 2 and rows[1].high_recall >= rows[0].high_recall and sum(r.best for r in rows) == 1


def test_quartiles_of_values_of_very_different_size(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    for x in (np.append(rng.normal(size=5_000), 1e300), np.append(-np.exp(rng.normal(0, 80, 3_001)), [0.0, -0.0, 5e-324, 1e-320]),
              np.append(np.full(4_000, 7.0), rng.integers(-9, 9, 3)), np.array([1.0, 1.0 + 2**-52, 1.0 + 2**-51, np.inf])):
        got = R.describe(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
        assert [got.p25, got.p50, got.p75] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.75]), rel=1e-12, abs=0)
        assert (got["count"], got.min, got.max) == (len(x), x.min(), x.max())


def test_a_pass_of_the_selection_returns_few_counts(spark):
    values = spark.range(200_000).selectExpr("double(id) x", "2L n").withColumn(
        "k", F.expr("cast(java_method('java.lang.Double', 'doubleToLongBits', x) as bigint)"))
    assert R.values_at(values, [0, 1, 2, 199_999, 399_999]) == {0: 0.0, 1: 0.0, 2: 1.0, 199_999: 99_999.0, 399_999: 199_999.0}
    assert all(a - b <= 13 for a, b in zip((64, *R.RADIX_SHIFTS), R.RADIX_SHIFTS))
