"""Scalar function edge cases and golden cases (FIXTURES §4)."""

from pyspark.sql import functions as F

from covenant.functions import text as X


def _one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("out")).first()["out"]


def test_risk_label_buckets(spark):
    df = spark.createDataFrame([(s,) for s in (0, 2, 3, 4, 5, 10, 11, -1)], "s int")
    got = [r["l"] for r in df.select(X.risk_label("s").alias("l")).collect()]
    assert got == ["Low", "Low", "Medium", "Medium", "High", "High", None, None]


def test_label_id_roundtrip(spark):
    df = spark.createDataFrame([("Low",), ("Medium",), ("High",), ("Other",)], "l string")
    rows = df.select(X.label_id("l").alias("i"), X.id_label(X.label_id("l")).alias("back")).collect()
    assert [r["i"] for r in rows] == [0, 1, 2, None]
    assert [r["back"] for r in rows] == ["Low", "Medium", "High", None]


def test_first_words_unicode_whitespace(spark):
    text = "a b  c\td " + " ".join(f"w{i}" for i in range(30))
    got = _one(spark, X.first_words("v", 5), text)
    assert got == " ".join(text.split()[:5])


def test_clause_name(spark):
    df = spark.createDataFrame([('Find "Audit Rights" here',), ("no quotes",), ('empty "" q',),
                                ('two "A" and "B"',)], "q string")
    got = [r["c"] for r in df.select(X.clause_name("q").alias("c")).collect()]
    assert got == ["Audit Rights", "no quotes", "", "A"]


def test_short_hash(spark):
    h = "a" * 64
    assert _one(spark, X.short_hash("v"), None) == ""
    assert _one(spark, X.short_hash("v"), h) == "a" * 12 + "…"


def test_waiting_golden(spark):
    cases = [(30, "just now"), (59 * 60, "59 min"), (60 * 60, "1 h"), ((47 * 60 + 59) * 60, "47 h"),
             (48 * 3600, "2 days"), (-600, "just now")]
    rows = [(f"2024-02-01 00:00:00", s) for s, _ in cases]
    df = spark.createDataFrame(rows, "as_of string, secs int").select(
        F.col("as_of").cast("timestamp_ntz").alias("as_of"), "secs")
    df = df.withColumn("since", F.col("as_of") - F.make_dt_interval(secs=F.col("secs")))
    got = [r["w"] for r in df.select(X.waiting("since", "as_of").alias("w")).collect()]
    assert got == [w for _, w in cases]


def test_format_ts(spark):
    df = spark.createDataFrame([("2024-01-05 03:04:00",), (None,)], "t string") \
        .select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = [r["f"] for r in df.select(X.format_ts("t").alias("f")).collect()]
    assert got == ["5 Jan 2024, 08:34", ""]


def test_clip_note(spark):
    assert _one(spark, X.clip_note("v"), "x" * 500) == "x" * 500
    out = _one(spark, X.clip_note("v"), "y" * 501)
    assert len(out) == 500 and out.endswith("...")


def test_sanitize_and_storage_key(spark):
    df = spark.createDataFrame([("dir/My File (1).pdf",), ("",), (None,), ("a/b/",), ("ünï.txt",)], "n string")
    got = [r["s"] for r in df.select(X.sanitize_name("n").alias("s")).collect()]
    assert got == ["My_File__1_.pdf", "document", "document", "b", "_n_.txt"]
    k = _one(spark, X.storage_key(F.lit(7), F.lit(2), F.col("v")), "a b.txt")
    assert k == "doc-7/v2/a_b.txt"


def test_strip_and_blank_unicode(spark):
    # the em space is white space, the no-break space is not
    assert _one(spark, X.strip("v"), "\u2003 x\u3000") == "x" and _one(spark, X.strip("v"), "\u00a0x") == "\u00a0x"
    assert _one(spark, X.is_blank("v"), "\u2003 ") is True and _one(spark, X.is_blank("v"), "\u00a0") is False
    assert _one(spark, X.is_blank("v"), None) is True


def test_parse_clauses(spark):
    df = spark.createDataFrame([('{"Audit Rights": " yes ", "Other": "z"}',), ("{\"Ant",), ("",), (None,)], "j string")
    rows = df.select(X.clause_count(X.parse_clauses("j")).alias("n"),
                     F.size(X.parse_clauses("j")).alias("k")).collect()
    assert [(r["n"], r["k"]) for r in rows] == [(1, 2), (0, 0), (0, 0), (0, 0)]


def test_flagged_list(spark):
    df = spark.createDataFrame([("Audit Rights, Non-Compete",), ("",), (None,), (" a ,b,",)], "f string")
    got = [r["l"] for r in df.select(X.flagged_list("f").alias("l")).collect()]
    assert got[0] == ["Audit Rights", "Non-Compete"] and got[1] == [] and got[2] == []
    assert got[3][:2] == ["a", "b"]


def test_softmax_label(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.0, 0.0, 0.0],)], "l array<double>")
    rows = df.select(X.softmax_label("l").alias("p")).collect()
    p0 = rows[0]["p"]
    assert p0["risk_label"] == "High"
    assert abs(sum(p0["probabilities"].values()) - 1.0) < 2e-4
    assert rows[1]["p"]["risk_label"] == "Low"  # first argmax wins on ties


def test_token_budget(spark):
    long_text = " ".join(["word"] * 600)
    df = spark.createDataFrame([("Hello, world!",), (long_text,)], "t string")
    rows = df.select(X.token_budget("t").alias("b")).collect()
    assert rows[0]["b"]["n_tokens"] == 4 + 2 and rows[0]["b"]["truncated"] is False
    b = rows[1]["b"]
    assert b["truncated"] is True and len(b["input_ids"]) == 512 and sum(b["attention_mask"]) == 512
    assert b["input_ids"][0] == 101 and b["input_ids"][-1] == 102


def test_classification_note(spark):
    df = spark.createDataFrame([(3, "Medium", "text", "High", 0.735), (0, "Low", " ", None, None),
                                (2, "Low", "t", None, None)],
                               "n int, r string, mi string, pl string, pc double")
    notes = [r["x"] for r in df.select(X.classification_note("n", "r", "mi", "pl", "pc").alias("x")).collect()]
    assert notes[0] == ("Model predicted High (74% confidence). 3 of 10 risk clauses present "
                        "(rule label Medium).")
    assert notes[1].startswith("No model input in the prepared CUAD file")
    assert notes[2].startswith("The classifier service did not respond")


def test_white_space_of_java_and_python(spark):
    df = spark.createDataFrame([("a\x1cb c",), ("\u00a0a\u00a0b",), ("\u2007x\u3000",), ("\u00a0",), ("\x1f \t",)], "t string")
    got = df.select(X.first_words("t").alias("w"), X.strip("t").alias("s"), X.is_blank("t").alias("b")).collect()
    assert [r.w for r in got] == [" ".join(v.split()[:20]) for v in ("a\x1cb c", "\u00a0a\u00a0b", "\u2007x\u3000", "\u00a0", "\x1f \t")]
    assert [r.s for r in got] == ["a\x1cb c", "\u00a0a\u00a0b", "\u2007x", "\u00a0", ""]
    assert [r.b for r in got] == [False, False, False, False, True]


def test_lengths_in_utf16_units(spark):
    smile = "\U0001f600"
    df = spark.createDataFrame([(smile * 250,), (smile * 251,), ("a" + smile * 249 + "b" * 20,), ("x" * 500,), (None,)], "t string")
    got = [r[0] for r in df.select(X.clip_note("t")).collect()]
    assert got[0] == smile * 250 and got[3] == "x" * 500 and got[4] is None
    assert got[1] == smile * 248 + "?..." and got[2] == "a" + smile * 248 + "..."


def test_flagged_list_drops_empty_parts_at_the_end(spark):
    df = spark.createDataFrame([("A, B,",), ("A,,B",), (",,",), (" ",), (None,), ("A, ,",)], "t string")
    assert [r[0] for r in df.select(X.flagged_list("t")).collect()] == [["A", "B"], ["A", "", "B"], [], [], [], ["A", ""]]


def test_token_ids_from_a_vocabulary(spark):
    v = F.create_map(F.lit("a"), F.lit(7), F.lit("."), F.lit(8))
    r = spark.createDataFrame([("A b.",)], "t string").select(X.token_budget("t", max_len=8, vocabulary=v).alias("b")).first().b
    assert r.input_ids == [101, 7, 100, 8, 102, 0, 0, 0] and r.attention_mask == [1] * 5 + [0] * 3 and not r.truncated
