"""Subwords against a plain version, and the intake stream that waits for predictions."""

import datetime as dt
import random
from pathlib import Path
from urllib.parse import urlparse

from covenant import session
from covenant.functions import text as X
from covenant.operators import subwords as SW
from covenant.operators import workflow as W
from covenant.streaming import intake as IN
from covenant.streaming import jobs as J


def plain_cut(word, vocabulary, max_word=100):
    ids, at = [], 0
    while at < len(word) <= max_word:
        ends = [e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary]
        if not ends:
            return [SW.UNKNOWN]
        ids.append(vocabulary[("##" if at else "") + word[at:ends[0]]])
        at = ends[0]
    return ids if len(word) <= max_word else [SW.UNKNOWN]


def test_subwords_against_a_plain_version(spark):
    rng = random.Random(4)
    pieces = {p + "".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for p in ("", "##") for _ in range(30)}
    vocabulary = {t: i for i, t in enumerate(sorted(pieces | {"a", "##a", ",", "x" * 100}), 1000)}
    texts = {n: " ".join("".join(rng.choice("abÉ") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(40))) for n in range(60)}
    texts |= {100: None, 101: "", 102: "a, a", 103: "x" * 100, 104: "x" * 101, 105: "ab " * 5_000, 106: "a, a"}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "k long, t string, n_tokens int")
    table = spark.createDataFrame([*vocabulary.items(), ("a", 9_999), (None, 5), ("", 6)], "token string, id int")
    words = {k: r.w for k, r in ((r.k, r) for r in df.select("k", X.tokens("t").alias("w")).collect())}
    got = {r.k: r for r in SW.subword_budget(df, "k", "t", table, max_len=20).collect()}
    assert len(got) == len(texts)
    for k in texts:
        ids = [i for w in words[k] or [] for i in plain_cut(w, vocabulary)]
        body = [101] + ids[:18] + [102]
        assert got[k].n_tokens == len(ids) + 2 and got[k].truncated == (len(ids) + 2 >= 20)
        assert got[k].input_ids == body + [0] * (20 - len(body))
        assert got[k].attention_mask == [1] * len(body) + [0] * (20 - len(body))
    none = SW.subword_budget(df.where("k = 102"), "k", "t", table.limit(0), max_len=8).first()
    assert none.input_ids == [101, 100, 100, 100, 102, 0, 0, 0]
    twice = SW.subword_budget(df.where("k = 102").unionAll(df.where("k = 102")), "k", "t", table)
    assert twice.count() == 2 and SW.subword_budget(df.limit(0), "k", "t", table).count() == 0


CONTRACT = "doc_id long, title string, clauses_json string, model_input string, arrived_at timestamp"
PREDICTION = "doc_id long, predicted int, confidence double, predicted_at timestamp"


def at(hour, day=1):
    return dt.datetime(2024, 5, day, hour)


def test_contracts_wait_for_their_predictions(spark):
    d = session.run_dir(spark, "waiting")
    contracts = [(i, f"t{i}", "{}", None if i == 5 else "text", None if i == 9 else at(i)) for i in range(1, 10)]
    first = [(1, 0, 0.5, at(2)), (2, None, None, at(2)), (5, 1, 0.5, at(5))]
    second = [(3, 2, 0.75, at(4)), (4, 1, 0.5, at(9)), (1, 1, 0.25, at(2)), (77, 1, 0.5, at(3)), (6, 1, 0.5, None)]
    objects = spark.createDataFrame([(i, f"h{i}") for i in range(1, 10) if i != 8], "document_id long, recorded_hash string")
    schemas = tuple(spark.createDataFrame([], s).schema for s in (CONTRACT, PREDICTION))

    def go(c, p):
        for name, rows, s in (("c", c, schemas[0]), ("p", p, schemas[1])):
            J.stage(rows if hasattr(rows, "columns") else spark.createDataFrame(rows, s), f"{d}/{name}")
        table = IN.run(spark, f"{d}/c", f"{d}/p", schemas, objects, f"{d}/sink", f"{d}/ckpt", wait="2 hours", late="12 hours")
        return table, {r.document_id: r.action for r in table.rows().where("step = 2").collect()}

    _, early = go(contracts, first)
    assert early == {1: "Classified", 2: "ClassificationSkipped", 5: "ClassificationSkipped", 9: "ClassificationSkipped"}
    _, now = go([], second)                                     # 3 is late by a run, 4 was predicted too long after
    assert now == early | {3: "Classified"}
    table, end = go(*(IN.heartbeat(spark, s, at(0, 9)) for s in schemas))
    assert end == now | {4: "ClassificationSkipped", 6: "ClassificationSkipped", 7: "ClassificationSkipped"}
    assert [(r.document_id, r.step) for r in table.rejects().collect()] == [(1, 2)]      # its second prediction
    in_time = spark.createDataFrame([first[0], first[1], first[2], second[0]], schemas[1])
    batch = W.prepared_log_rows(W.score_prepared(spark.createDataFrame(contracts, schemas[0]), in_time), objects)
    assert sorted(map(str, batch.collect())) == sorted(map(str, table.rows().select(batch.columns).collect()))
    n = table.rows().count()
    options = {"wait": "2 hours", "late": "12 hours"}
    IN.run(spark, f"{d}/c", f"{d}/p", schemas, objects, f"{d}/sink", f"{d}/ckpt2", **options, source="again")
    assert table.rows().count() == n                            # the whole input again: nothing twice
    # a batch that reached the table, but not the stream's own log, before the driver was lost
    noted = Path(urlparse(f"{d}/ckpt/commits").path)
    last = max((p for p in noted.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (noted / f".{last.name}.crc").unlink(missing_ok=True)
    commits, rejects = len(table.commits()), table.rejects().count()
    IN.run(spark, f"{d}/c", f"{d}/p", schemas, objects, f"{d}/sink", f"{d}/ckpt", **options)
    assert (table.rows().count(), table.rejects().count(), len(table.commits())) == (n, rejects, commits)
