"""Split, sample and export keys: W3–W5, U1, U2, A7 (by split), A17, A18, S11, J3."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenant import schemas as S
from covenant.operators import risk as R
from covenant.operators import split as SP
from covenant.plans.catalog import _qa, register
from covenant.plans.sqlparts import RISK_IN, label_id_sql, str_list, with_fx
from covenant.session import materialize
from covenant.sources import fixtures as FX

PER_CLASS = 4

_QUOTAS = f"""
    SELECT risk_label, n_label, CAST(base + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS BIGINT) AS quota
    FROM (SELECT *, row_number() OVER (ORDER BY rem DESC, lid) AS rk, n_test - sum(base) OVER () AS lft
          FROM (SELECT *, n_label * n_test - base * n_all AS rem
                FROM (SELECT *, (n_label * n_test) // n_all AS base
                      FROM (SELECT risk_label, {label_id_sql('risk_label')} AS lid, n_label,
                                   sum(n_label) OVER () AS n_all, (sum(n_label) OVER () + 4) // 5 AS n_test
                            FROM (SELECT risk_label, count(*) AS n_label FROM fx_risk GROUP BY risk_label)))))"""
_SPLIT = """
    SELECT r.title, r.risk_score, r.risk_text, r.risk_label,
           CASE WHEN row_number() OVER (PARTITION BY r.risk_label ORDER BY md5('42|' || r.title), r.title)
                     <= q.quota THEN 'test' ELSE 'train' END AS split
    FROM fx_risk r JOIN quotas q ON r.risk_label = q.risk_label"""
_SAMPLE = f"""
    SELECT title, risk_score, risk_text, risk_label, split FROM (
        SELECT *, row_number() OVER (PARTITION BY risk_label ORDER BY md5('7|' || title), title) AS rn
        FROM split_all WHERE split = 'test') WHERE rn <= {PER_CLASS}"""
_CTES = [("quotas", _QUOTAS), ("split_all", _SPLIT)]
_CTES_SAMPLE = _CTES + [("picked", _SAMPLE)]


def _risk(spark, sf_dir, text=False):
    # Title, score and label of each contract, read three times by the split
    # (counts, histogram, flags). The split needs no text; the model jobs carry it along.
    columns = ["title", "risk_score", *(["risk_text"] if text else []), "risk_label"]
    return materialize(R.contract_risk(_qa(spark, sf_dir)).select(columns))


def _split(spark, sf_dir, text=False):
    return SP.stratified_split(_risk(spark, sf_dir, text))


def _picked(spark, sf_dir):
    # At most PER_CLASS x labels rows, consumed by several joins. Only their texts are built.
    test = _split(spark, sf_dir).where(F.col("split") == "test")
    sample = materialize(SP.class_balanced_sample(test, PER_CLASS))
    texts = R.contract_risk(SP.of_picked(_qa(spark, sf_dir), sample)).select("title", "risk_text")
    return materialize(sample.join(texts, "title"))


@register("split_quotas", with_fx(["fx_risk"], "SELECT risk_label, n_label, quota FROM quotas", _CTES[:1]))
def split_quotas(spark, sf_dir):
    counted = R.contract_risk(_qa(spark, sf_dir)).select("risk_label")        # read once: nothing to keep
    return SP.split_quotas(counted).select("risk_label", "n_label", F.col("quota").cast("long"))


@register("stratified_split", with_fx(["fx_risk"], "SELECT title, risk_label, split FROM split_all", _CTES))
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("title", "risk_label", "split")


@register("label_split_distribution", with_fx(["fx_risk"], """
    SELECT split, risk_label, count(*) AS n FROM split_all GROUP BY split, risk_label""", _CTES))
def label_split_distribution(spark, sf_dir):
    return R.label_distribution(_split(spark, sf_dir), by=["split"])


@register("split_gate", with_fx(["fx_risk"], """
    SELECT q.risk_label, q.quota AS expected, coalesce(a.actual, 0) AS actual, q.quota = coalesce(a.actual, 0) AS ok
    FROM quotas q LEFT JOIN (SELECT risk_label, count(*) AS actual FROM split_all WHERE split = 'test'
                             GROUP BY risk_label) a ON q.risk_label = a.risk_label""", _CTES))
def split_gate(spark, sf_dir):
    """A17 against the largest-remainder quotas."""
    risk = _risk(spark, sf_dir)
    g = SP.split_gate(SP.stratified_split(risk), SP.split_quotas(risk))
    return g.select("risk_label", F.col("expected").cast("long"), "actual", "ok")


@register("split_gate_refuses", with_fx(["fx_risk"], """
    SELECT q.risk_label, q.quota + CASE WHEN q.risk_label = 'Low' THEN 1 ELSE 0 END AS expected,
           coalesce(a.actual, 0) AS actual, q.quota + CASE WHEN q.risk_label = 'Low' THEN 1 ELSE 0 END = coalesce(a.actual, 0) AS ok
    FROM quotas q LEFT JOIN (SELECT risk_label, count(*) AS actual FROM split_all WHERE split = 'test'
                             GROUP BY risk_label) a ON q.risk_label = a.risk_label""", _CTES))
def split_gate_refuses(spark, sf_dir):
    """A17 against an expectation that is handed in and asks for one row too many of a label."""
    risk = _risk(spark, sf_dir)
    asked = SP.split_quotas(risk).withColumn("quota", F.col("quota") + F.when(F.col("risk_label") == "Low", 1).otherwise(0))
    g = SP.split_gate(SP.stratified_split(risk), asked)
    return g.select("risk_label", F.col("expected").cast("long"), "actual", "ok")


@register("split_disjoint", with_fx(["fx_risk"], """
    SELECT CAST(count_if(split = 'train') AS BIGINT) AS n_train, CAST(count_if(split = 'test') AS BIGINT) AS n_test,
           (SELECT count(*) FROM (SELECT title FROM split_all WHERE split = 'train'
                                  INTERSECT SELECT title FROM split_all WHERE split = 'test')) AS n_overlap,
           (SELECT count(*) FROM (SELECT title FROM fx_risk EXCEPT ALL SELECT title FROM split_all)) AS n_missing
    FROM split_all""", _CTES))
def split_disjoint(spark, sf_dir):
    risk = _risk(spark, sf_dir)
    return SP.split_disjoint(SP.stratified_split(risk), risk)


@register("class_balanced_sample", with_fx(["fx_risk"], "SELECT title, risk_label, risk_score FROM picked",
                                           _CTES_SAMPLE))
def class_balanced_sample(spark, sf_dir):
    return _picked(spark, sf_dir).select("title", "risk_label", "risk_score")


@register("sample_union", with_fx(["fx_risk"], "SELECT title, risk_label FROM picked", _CTES_SAMPLE))
def sample_union(spark, sf_dir):
    """Per-label samples drawn separately, then concatenated."""
    test = materialize(_split(spark, sf_dir).where(F.col("split") == "test"))
    parts = [SP.class_balanced_sample(test.where(F.col("risk_label") == lab), PER_CLASS) for lab in S.LABELS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("title", "risk_label")


@register("clause_gate", with_fx(["fx_risk", "fx_first_answers"], f"""
    SELECT r.title, r.risk_score, CAST(coalesce(n.n_clauses, 0) AS INTEGER) AS n_clauses,
           r.risk_score = coalesce(n.n_clauses, 0) AS ok
    FROM fx_risk r LEFT JOIN (SELECT title, count(*) AS n_clauses FROM fx_first_answers
                              WHERE clause IN {RISK_IN} GROUP BY title) n ON r.title = n.title"""))
def clause_gate(spark, sf_dir):
    qa = _qa(spark, sf_dir)
    return SP.clause_gate(R.contract_risk(qa), R.first_answers(qa, risk_only=True))


@register("picked_rows", with_fx(["fx_risk"], """
    SELECT f.title, f.row_ord, f.clause, f.has_clause FROM fx_flags f
    WHERE f.title IN (SELECT title FROM picked)""", _CTES_SAMPLE))
def picked_rows(spark, sf_dir):
    flags = R.flag_rows(_qa(spark, sf_dir))
    return SP.picked_rows(flags, _picked(spark, sf_dir)).select("title", "row_ord", "clause", "has_clause")


_SAFE = """regexp_replace(regexp_replace(raw_name, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')"""
# Row by row, as a job over one sorted list would do it: the first free name.
_SAFE_SQL = f"""
    WITH RECURSIVE {{fx}}, nb AS (
        SELECT page_id, raw_name, row_number() OVER (ORDER BY page_id) AS i,
               CASE WHEN substr({_SAFE}, 1, {S.SAFE_ID_MAX}) = '' THEN 'contract'
                    ELSE substr({_SAFE}, 1, {S.SAFE_ID_MAX}) END AS base
        FROM fx_names),
    walk AS (
        SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS safe_id, CAST([] AS VARCHAR[]) AS used
        UNION ALL
        SELECT n.i, c.id, list_append(w.used, c.id)
        FROM walk w JOIN nb n ON n.i = w.i + 1,
             LATERAL (SELECT [x for x in list_transform(range(1, n.i + 1), lambda k:
                              CASE WHEN k = 1 THEN n.base ELSE n.base || '_' || CAST(k AS VARCHAR) END)
                              if NOT list_contains(w.used, x)][1] AS id) c)
    SELECT nb.page_id, nb.raw_name, walk.safe_id FROM nb JOIN walk ON nb.i = walk.i"""


def _safe_ids_sql() -> str:
    fx = with_fx(["fx_names"], "SELECT 1")
    return _SAFE_SQL.format(fx=fx[fx.index("WITH ") + 5:fx.rindex("SELECT 1")].strip().rstrip(","))


@register("safe_ids", _safe_ids_sql())
def safe_ids(spark, sf_dir):
    return SP.safe_ids(FX.fx_names(spark, sf_dir), "raw_name", "page_id").select("page_id", "raw_name", "safe_id")


@register("export_demo", with_fx(["fx_risk", "fx_first_answers", "fx_qa"], f"""
    SELECT p.title, p.split, p.risk_score, p.risk_label,
           coalesce(array_to_string(list(c.clause ORDER BY list_position({str_list(S.RISK_CLAUSES)}, c.clause)), ', '), '')
               AS flagged,
           coalesce(array_to_string(list(c.snippet ORDER BY list_position({str_list(S.RISK_CLAUSES)}, c.clause)), ' | '), '')
               AS snippets,
           p.risk_text AS model_input, md5(any_value(x.context)) AS text_md5
    FROM picked p
    LEFT JOIN (SELECT * FROM fx_first_answers WHERE clause IN {RISK_IN}) c ON p.title = c.title
    LEFT JOIN (SELECT title, arg_min(context, row_ord) AS context FROM fx_qa GROUP BY title) x ON p.title = x.title
    GROUP BY p.title, p.split, p.risk_score, p.risk_label, p.risk_text""", _CTES_SAMPLE))
def export_demo(spark, sf_dir):
    rec = SP.export_records(_picked(spark, sf_dir), _qa(spark, sf_dir, context=True))
    return rec.select("title", "split", "risk_score", "risk_label",
                      F.array_join(F.map_keys("clauses"), ", ").alias("flagged"),
                      F.array_join(F.map_values("clauses"), " | ").alias("snippets"),
                      "model_input", F.md5("text").alias("text_md5"))
