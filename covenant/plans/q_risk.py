"""Risk-build keys: S1, P1–P3, A1–A9, J1–J2, F1–F3, F17, F22."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from covenant import schemas as S
from covenant.functions import text as X
from covenant.operators import risk as R
from covenant.operators import subwords
from covenant.plans.catalog import _qa, register
from covenant.plans.sqlparts import label_id_sql, label_sql, q, str_list, with_fx
from covenant.sources import fixtures as FX
from covenant.session import materialize, run_dir
from covenant.sources.tables import scan_qa as scan_table
from covenant.sources.tables import table

ALL_CLAUSES = S.RISK_CLAUSES + [f"Clause {i}" for i in range(len(S.RISK_CLAUSES), S.N_CLAUSE_TYPES)]


@register("scan_qa", with_fx(["fx_qa"], """
    SELECT row_ord, title, question, answers.text[1] AS answer, CAST(len(answers.text) AS INTEGER) AS n_answers,
           md5(context) AS context_md5
    FROM fx_qa"""))
def scan_qa(spark, sf_dir):
    path = run_dir(spark, "qa")
    _qa(spark, sf_dir, context=True).write.parquet(path)
    qa = scan_table(spark, path)
    return qa.select("row_ord", "title", "question",
                     F.try_element_at("answers.text", F.lit(1)).alias("answer"),
                     F.size("answers.text").alias("n_answers"),
                     F.md5("context").alias("context_md5"))


@register("has_clause", with_fx(["fx_flags"], "SELECT title, row_ord, has_clause FROM fx_flags"))
def has_clause(spark, sf_dir):
    return R.flag_rows(_qa(spark, sf_dir)).select("title", "row_ord", "has_clause")


@register("clause_name", with_fx(["fx_flags"], "SELECT title, row_ord, clause FROM fx_flags"))
def clause_name(spark, sf_dir):
    return R.flag_rows(_qa(spark, sf_dir)).select("title", "row_ord", "clause")


@register("risk_clause_filter", with_fx(["fx_flags"], f"""
    SELECT title, row_ord, clause, has_clause FROM fx_flags
    WHERE clause IN ({', '.join(q(c) for c in S.RISK_CLAUSES)})"""))
def risk_clause_filter(spark, sf_dir):
    return R.risk_clause_filter(R.flag_rows(_qa(spark, sf_dir))).select("title", "row_ord", "clause", "has_clause")


def _matrix_sql() -> str:
    cols = ",\n".join(f"coalesce(max(has_clause) FILTER (WHERE clause = {q(c)}), false) AS \"{c}\""
                      for c in ALL_CLAUSES)
    return with_fx(["fx_flags"], f"SELECT title,\n{cols}\nFROM fx_flags GROUP BY title")


@register("clause_matrix", _matrix_sql())
def clause_matrix(spark, sf_dir):
    return R.clause_matrix(_qa(spark, sf_dir), ALL_CLAUSES)


@register("matrix_shape", with_fx(["fx_flags"], """
    SELECT count(DISTINCT title) AS n_contracts, count(DISTINCT clause) AS n_clauses FROM fx_flags"""))
def matrix_shape(spark, sf_dir):
    return R.matrix_shape(_qa(spark, sf_dir))


@register("risk_score", with_fx(["fx_risk"], "SELECT title, risk_score FROM fx_risk"))
def risk_score(spark, sf_dir):
    return R.contract_risk(_qa(spark, sf_dir)).select("title", "risk_score")


@register("risk_text", with_fx(["fx_risk"], "SELECT title, risk_text FROM fx_risk"))
def risk_text(spark, sf_dir):
    return R.contract_risk(_qa(spark, sf_dir)).select("title", "risk_text")


@register("score_join_text", with_fx(["fx_risk"], "SELECT title, risk_score, risk_text FROM fx_risk"))
def score_join_text(spark, sf_dir):
    return R.score_join_text(_qa(spark, sf_dir))


@register("first_context", with_fx(["fx_qa"], """
    SELECT title, md5(arg_min(context, row_ord)) AS context_md5, CAST(length(arg_min(context, row_ord)) AS INTEGER) AS context_len
    FROM fx_qa WHERE title IS NOT NULL AND context IS NOT NULL GROUP BY title"""))
def first_context(spark, sf_dir):
    c = R.first_context(_qa(spark, sf_dir, context=True))
    return c.select("title", F.md5("context").alias("context_md5"), F.length("context").alias("context_len"))


@register("score_join_context", with_fx(["fx_risk", "fx_qa"], """
    SELECT r.title, r.risk_score, md5(c.context) AS context_md5
    FROM fx_risk r LEFT JOIN (SELECT title, arg_min(context, row_ord) AS context FROM fx_qa
                              WHERE title IS NOT NULL AND context IS NOT NULL GROUP BY title) c
      ON r.title = c.title"""))
def score_join_context(spark, sf_dir):
    j = R.score_join_context(_qa(spark, sf_dir, context=True))
    return j.select("title", "risk_score", F.md5("context").alias("context_md5"))


@register("score_distribution", with_fx(["fx_risk"], """
    SELECT risk_score, count(*) AS n FROM fx_risk GROUP BY risk_score"""))
def score_distribution(spark, sf_dir):
    return R.score_distribution(R.contract_risk(_qa(spark, sf_dir)))


@register("label_distribution", with_fx(["fx_risk"], """
    SELECT risk_label, count(*) AS n FROM fx_risk GROUP BY risk_label"""))
def label_distribution(spark, sf_dir):
    return R.label_distribution(R.contract_risk(_qa(spark, sf_dir)))


def _describe_sql(expr: str, name: str, src: str) -> str:
    return f"""
    SELECT {q(name)} AS "column", count(x) AS "count", round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS std,
           min(x) AS "min", qs[1] AS p25, qs[2] AS p50, qs[3] AS p75, max(x) AS "max"
    FROM (SELECT x, quantile_cont(x, [0.25, 0.5, 0.75]) OVER () AS qs
          FROM (SELECT CAST({expr} AS DOUBLE) AS x FROM {src}))
    GROUP BY qs"""


def _rounded_describe(df, col):
    d = R.describe(df, col)
    return d.select("column", "count", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"),
                    "min", "p25", "p50", "p75", "max")


@register("describe_score", with_fx(["fx_risk"], _describe_sql("risk_score", "risk_score", "fx_risk")))
def describe_score(spark, sf_dir):
    return _rounded_describe(R.contract_risk(_qa(spark, sf_dir)), "risk_score")


@register("describe_text_len", with_fx(["fx_risk"], _describe_sql("length(risk_text)", "text_len", "fx_risk")))
def describe_text_len(spark, sf_dir):
    r = R.contract_risk(_qa(spark, sf_dir)).select(X.text_length("risk_text").alias("text_len"))
    return _rounded_describe(r, "text_len")


_TOKENS_SQL = f"(len(regexp_extract_all(lower(risk_text), {q(X.TOKEN_PATTERN)})) + {X.SPECIAL_TOKENS})"


@register("describe_tokens", with_fx(["fx_risk"], _describe_sql(_TOKENS_SQL, "n_tokens", "fx_risk")))
def describe_tokens(spark, sf_dir):
    return _rounded_describe(R.token_lengths(R.contract_risk(_qa(spark, sf_dir))), "n_tokens")


@register("over_budget_count", with_fx(["fx_risk"], f"""
    SELECT CAST(count_if({_TOKENS_SQL} > {S.MAX_TOKENS}) AS BIGINT) AS n_over_budget, count(*) AS n_contracts FROM fx_risk"""))
def over_budget_count(spark, sf_dir):
    return R.over_budget_count(R.contract_risk(_qa(spark, sf_dir)))


# A small vocabulary for the key: frequent words get ids from 1000 on, others the unknown id.
_VOCABULARY = "the of and to in is it on that de la que el der die und le les et des . ,".split()
_IDS_SQL = (f"[101] || [coalesce(list_position({str_list(_VOCABULARY)}, t) + 999, 100) for t in "
            f"regexp_extract_all(lower(risk_text), {q(X.TOKEN_PATTERN)})[1:{S.MAX_TOKENS - X.SPECIAL_TOKENS}]] || [102]")


@register("token_budget", with_fx(["fx_risk"], f"""
    SELECT title, CAST({_TOKENS_SQL} AS INTEGER) AS n_tokens, {_TOKENS_SQL} >= {S.MAX_TOKENS} AS truncated,
           CAST(least({_TOKENS_SQL}, {S.MAX_TOKENS}) AS INTEGER) AS n_kept,
           md5(array_to_string(ids || [0 for i in range({S.MAX_TOKENS} - len(ids))], ',')) AS ids_md5,
           md5(array_to_string([1 for i in ids] || [0 for i in range({S.MAX_TOKENS} - len(ids))], ',')) AS mask_md5
    FROM (SELECT *, {_IDS_SQL} AS ids FROM fx_risk)"""))
def token_budget(spark, sf_dir):
    v = F.create_map(*[F.lit(x) for i, w in enumerate(_VOCABULARY) for x in (w, 1000 + i)])
    r = R.contract_risk(_qa(spark, sf_dir)).select("title", X.token_budget("risk_text", vocabulary=v).alias("tb"))

    def digest(c):
        return F.md5(F.array_join(F.col(c).cast("array<string>"), ","))

    return r.select("title", F.col("tb.n_tokens").alias("n_tokens"), F.col("tb.truncated").alias("truncated"),
                    F.aggregate("tb.attention_mask", F.lit(0), lambda a, x: a + x).alias("n_kept"),
                    digest("tb.input_ids").alias("ids_md5"), digest("tb.attention_mask").alias("mask_md5"))


#: The key's vocabulary comes from the words themselves: beginnings of three letters, two kinds of inner pieces, and
#: single characters but a few, so that some words stay unknown.
_SUBWORDS = [
    ("tk", f"SELECT title, regexp_extract_all(lower(risk_text), {q(X.TOKEN_PATTERN)}) AS toks FROM fx_risk"),
    ("pos", "SELECT title, unnest(toks) AS word, generate_subscripts(toks, 1) AS place FROM tk"),
    ("words", "SELECT DISTINCT word FROM pos"),
    ("chars", "SELECT DISTINCT unnest(string_split(word, '')) AS c FROM words"),
    ("vocab", """
    SELECT token, CAST('0x' || substr(md5(token), 1, 7) AS INTEGER) AS id FROM (
        SELECT substr(word, 1, 3) AS token FROM words WHERE length(word) >= 3
        UNION SELECT '##' || substr(word, 4, 2) FROM words WHERE length(word) >= 5
        UNION SELECT '##' || substr(word, 5, 3) FROM words WHERE length(word) >= 7
        UNION SELECT p || c FROM chars, (VALUES (''), ('##')) v(p) WHERE NOT regexp_matches(c, '[qx0-9]'))"""),
    ("cut", """
    SELECT word, CAST(1 AS BIGINT) AS place, CAST([] AS INTEGER[]) AS ids FROM words WHERE length(word) <= 100
    UNION ALL
    SELECT word, place + n, list_append(ids, id) FROM (
        SELECT c.word, c.place, c.ids, l.n, v.id, row_number() OVER (PARTITION BY c.word ORDER BY l.n DESC) AS k
        FROM cut c CROSS JOIN range(1, 10) l(n)
        JOIN vocab v ON v.token = (CASE WHEN c.place = 1 THEN '' ELSE '##' END) || substr(c.word, c.place, l.n)
        WHERE c.place + l.n <= length(c.word) + 1) WHERE k = 1"""),
    ("done", """
    SELECT w.word, coalesce(c.ids, [100]) AS ids FROM words w LEFT JOIN cut c ON c.word = w.word AND c.place = length(w.word) + 1"""),
    ("body", """
    SELECT tk.title, coalesce(b.ids, []) AS ids FROM tk LEFT JOIN
        (SELECT title, flatten(list(ids ORDER BY place)) AS ids FROM pos JOIN done USING (word) GROUP BY title) b ON b.title = tk.title"""),
]


def _subword_vocabulary(words):
    n = F.length("word")
    char = words.select(F.explode(F.split("word", "")).alias("c")).where("c != '' and not c rlike '[qx0-9]'").distinct()
    parts = [words.where(n >= least).select(F.expr(piece).alias("token")) for least, piece in (
        (3, "substr(word, 1, 3)"), (5, "concat('##', substr(word, 4, 2))"), (7, "concat('##', substr(word, 5, 3))"))]
    parts += [char.select(F.concat(F.lit(p), "c").alias("token")) for p in ("", "##")]
    tokens = reduce(lambda a, b: a.unionByName(b), parts).distinct()
    return tokens.select("token", F.conv(F.substring(F.md5("token"), 1, 7), 16, 10).cast("int").alias("id"))


@register("subword_budget", with_fx(["fx_risk"], f"""
    SELECT title, CAST(len(ids) + 2 AS INTEGER) AS n_tokens, len(ids) + 2 >= {S.MAX_TOKENS} AS truncated,
           CAST(least(len(ids) + 2, {S.MAX_TOKENS}) AS INTEGER) AS n_kept,
           md5(array_to_string(framed || [0 for i in range({S.MAX_TOKENS} - len(framed))], ',')) AS ids_md5,
           md5(array_to_string([1 for i in framed] || [0 for i in range({S.MAX_TOKENS} - len(framed))], ',')) AS mask_md5
    FROM (SELECT *, [101] || ids[1:{S.MAX_TOKENS - X.SPECIAL_TOKENS}] || [102] AS framed FROM body)""",
                                    _SUBWORDS).replace("WITH ", "WITH RECURSIVE ", 1))
def subword_budget(spark, sf_dir):
    """F17 with subwords: greedy longest match over a vocabulary table."""
    risk = materialize(R.contract_risk(_qa(spark, sf_dir)).select("title", "risk_text"))
    words = risk.select(F.explode(X.tokens("risk_text")).alias("word")).distinct()
    vocabulary = materialize(_subword_vocabulary(words))
    b = subwords.subword_budget(risk, "title", "risk_text", vocabulary)

    def digest(c):
        return F.md5(F.array_join(F.col(c).cast("array<string>"), ","))

    return b.select("title", "n_tokens", "truncated", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_kept"),
                    digest("input_ids").alias("ids_md5"), digest("attention_mask").alias("mask_md5"))


@register("first_words", with_fx(["fx_flags"], """
    SELECT title, row_ord, snippet FROM fx_flags WHERE has_clause"""))
def first_words(spark, sf_dir):
    return R.flag_rows(_qa(spark, sf_dir)).where("has_clause").select("title", "row_ord", "snippet")


@register("risk_label", with_fx(["fx_documents"], f"""
    SELECT document_id, risk_score, {label_sql('risk_score')} AS label FROM fx_documents"""))
def risk_label(spark, sf_dir):
    d = FX.fx_documents(spark, sf_dir)
    return d.select("document_id", "risk_score", X.risk_label("risk_score").alias("label"))


@register("label_id", with_fx(["fx_risk"], f"""
    SELECT title, risk_label, {label_id_sql('risk_label')} AS label_id FROM fx_risk"""))
def label_id(spark, sf_dir):
    r = R.contract_risk(_qa(spark, sf_dir))
    return r.select("title", "risk_label", X.label_id("risk_label").alias("label_id"))


@register("text_length", """
    SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, n_chars AS n_chars_recorded FROM documents""")
def text_length(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.text_length("text").alias("n_chars"), F.col("n_chars").alias("n_chars_recorded"))
