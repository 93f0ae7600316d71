"""Language identification and line quality: exact parts by brute force, the rest by held-out accuracy."""

import itertools
import zlib

import numpy as np
import pyarrow as pa

from covenant.llm import langid, quality
from covenant.llm.common import utf8
from covenant.llm.queries import op8_language_id, op9_quality_crf

SF = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op8_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0.0 <= r.score <= 1.0 for r in rows)


def test_language_edge_cases(spark):
    rows = [(1, None, None), (2, "", "x"), (3, "123 !?", "x"), (4, "the cat and the dog", "en"), (5, "le chat et le chien", "fr")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in langid.predict(df, langid.fit(df)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0.0
    assert got[4].lang_pred == "en" and got[5].lang_pred == "fr"
    one = langid.fit(df.where("lang = 'fr'"))
    assert {r.lang_pred for r in langid.predict(df.where("doc_id > 3"), one).collect()} == {"fr"}
    none = langid.fit(df.limit(0))
    assert langid.predict(df.where("doc_id = 4"), none).first().lang_pred == "und"
    assert langid.predict(df.limit(0), one).count() == 0


def test_features_do_not_cross_texts():
    both, apart = langid.features(["ab cd", "Éf 9"]), [langid.features([t]) for t in ("ab cd", "Éf 9")]
    assert np.allclose(both, np.vstack(apart)) and langid.features(["", "a"]).shape == (2, langid.BUCKETS + 1)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    stay = rng.normal(size=(2, 2))
    counts = np.array([3, 1, 0, 5])
    score = rng.normal(size=9)
    p, pairs, log_z = quality.marginals(score, counts, stay)
    at, want_p, want_pairs = 0, [], np.zeros((2, 2))
    for k, n in enumerate(counts):
        z, sums, trans = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(score[at + t] for t in range(n) if y[t]) + sum(stay[a, b] for a, b in zip(y, y[1:])))
            z += w
            sums += w * np.array(y)
            for a, b in zip(y, y[1:]):
                trans[a, b] += w
        want_p += list(sums / z)
        want_pairs += trans / z
        if n:
            assert abs(log_z[k] - np.log(z)) < 1e-9
        at += n
    assert np.allclose(p, want_p) and np.allclose(pairs, want_pairs)


def test_lines_of_texts():
    texts = ["a\nB 1", "", None, "\n\n", "x" * 1000]
    x, size, counts = quality.line_features(*utf8(pa.array(texts, pa.string())))
    assert counts.tolist() == [2, 1, 1, 3, 1] and size.tolist() == [1, 3, 0, 0, 0, 0, 0, 1000]
    assert x.shape == (8, quality.FEATURES) and np.isfinite(x).all()


def test_quality_held_out(spark):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op9_quality_crf(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in marks]
    assert sum(r.predicted == marks[r.doc_id] for r in held) > 0.95 * len(held)


def test_quality_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "Good text here.", 9), (3, "Good text here.", 9)], "doc_id long, text string, score int")
    for marks, want in (([], 0.5), ([(3, 1, 0)], 1.0), ([(3, 0, 0), (9, None, 1)], 0.0)):
        labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
        assert {r.score for r in quality.score(df, quality.fit(df, labels)).collect()} == {want}
    labels = spark.createDataFrame([(2, 0, 0), (3, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert got[3] > got[2] == got[1]
    kept = quality.keep(df, model, 0.5)
    assert kept.columns == df.columns and kept.count() == 2
    assert quality.score(df.limit(0), model).count() == 0


def test_language_sample_is_bounded_with_copies(spark):
    df = spark.range(5_000).selectExpr("if(id < 3000, 'the same words', concat('text ', id)) text", "if(id % 50 = 0, 'fr', 'en') lang")
    drawn = langid.sample(df, per_language=100).collect()
    by = {k: [r.text for r in drawn if r.lang == k] for k in ("en", "fr")}
    assert len(by["en"]) == 100 and len(by["fr"]) == 41 and all(len(set(v)) == len(v) for v in by.values())
    assert langid.sample(df, per_language=100, most=60).groupBy("lang").count().where("count > 30").count() == 0


def test_quality_fit_takes_one_text_of_a_repeated_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_crf", lambda x, counts, marks: seen.append((len(counts), sorted(marks.tolist()))))
    docs = spark.range(4_000).selectExpr("if(id < 2000, 7, id) doc_id", "concat('line ', id % 3) text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality").distinct()
    quality.fit(docs, labels, per_class=50)
    quality.fit(docs.where("doc_id = 7"), labels, per_class=50_000)
    assert seen[0] == (100, [0] * 50 + [1] * 50) and seen[1] == (1, [1])


def test_very_long_texts_of_both_models(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog \n" * 60_000, "en"), (2, "le chat et le chien \n" * 60_000, "fr")],
                                 "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()} == {1: "en", 2: "fr"}
    model = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
