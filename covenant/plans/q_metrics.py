"""Evaluation keys: A13–A16, F16, F3 (inverse), M4."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenant import schemas as S
from covenant.functions import text as X
from covenant.operators import metrics as M
from covenant.plans.catalog import register
from covenant.plans.sqlparts import str_list, with_fx
from covenant.sources import fixtures as FX
from covenant.sources.tables import table

_PAIRS = [("pairs", "SELECT actual, predicted FROM fx_predictions WHERE actual IS NOT NULL AND predicted IS NOT NULL"),
          ("pc", """
    SELECT cls, support, n_pred, tp,
           coalesce(CAST(tp AS DOUBLE) / nullif(n_pred, 0), 0.0) AS precision,
           coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0) AS recall,
           coalesce(CAST(2 * tp AS DOUBLE) / nullif(support + n_pred, 0), 0.0) AS f1
    FROM (SELECT c.cls,
                 (SELECT count(*) FROM pairs WHERE actual = c.cls) AS support,
                 (SELECT count(*) FROM pairs WHERE predicted = c.cls) AS n_pred,
                 (SELECT count(*) FROM pairs WHERE actual = c.cls AND predicted = c.cls) AS tp
          FROM (SELECT unnest([0, 1, 2]) AS cls) c)"""),
          ("agg", """
    SELECT CAST(sum(support) AS BIGINT) AS total, CAST(sum(tp) AS BIGINT) AS tps,
           list_reduce(list(precision * support ORDER BY cls), lambda a, b: a + b) AS wp,
           list_reduce(list(recall * support ORDER BY cls), lambda a, b: a + b) AS wr,
           list_reduce(list(f1 * support ORDER BY cls), lambda a, b: a + b) AS wf,
           list_reduce(list(precision ORDER BY cls), lambda a, b: a + b) AS mp,
           list_reduce(list(recall ORDER BY cls), lambda a, b: a + b) AS mr,
           list_reduce(list(f1 ORDER BY cls), lambda a, b: a + b) AS mf
    FROM pc""")]
_LAB = str_list(S.LABELS)


def _pairs(spark, sf_dir):
    return FX.fx_predictions(spark, sf_dir)


@register("confusion_matrix", with_fx(["fx_predictions"], f"""
    SELECT {_LAB}[g.a + 1] AS actual, {_LAB}[g.p + 1] AS predicted, count(x.actual) AS n
    FROM (SELECT a, p FROM (SELECT unnest([0, 1, 2]) AS a) CROSS JOIN (SELECT unnest([0, 1, 2]) AS p)) g
    LEFT JOIN pairs x ON x.actual = g.a AND x.predicted = g.p
    GROUP BY g.a, g.p""", _PAIRS[:1]))
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(_pairs(spark, sf_dir))


@register("eval_metrics", with_fx(["fx_predictions"], """
    SELECT coalesce(CAST(tps AS DOUBLE) / nullif(total, 0), 0.0) AS accuracy,
           coalesce(wf / nullif(total, 0), 0.0) AS f1, coalesce(wp / nullif(total, 0), 0.0) AS precision,
           coalesce(wr / nullif(total, 0), 0.0) AS recall, total AS n_scored
    FROM agg""", _PAIRS))
def eval_metrics(spark, sf_dir):
    return M.eval_metrics(_pairs(spark, sf_dir))


@register("classification_report", with_fx(["fx_predictions"], f"""
    SELECT {_LAB}[cls + 1] AS "row", CAST(cls AS INTEGER) AS pos, precision, recall, f1, support FROM pc
    UNION ALL
    SELECT 'accuracy', 3, NULL, NULL, coalesce(CAST(tps AS DOUBLE) / nullif(total, 0), 0.0), total FROM agg
    UNION ALL
    SELECT 'macro avg', 4, mp / 3.0, mr / 3.0, mf / 3.0, total FROM agg
    UNION ALL
    SELECT 'weighted avg', 5, coalesce(wp / nullif(total, 0), 0.0), coalesce(wr / nullif(total, 0), 0.0),
           coalesce(wf / nullif(total, 0), 0.0), total FROM agg""", _PAIRS))
def classification_report(spark, sf_dir):
    return M.classification_report(_pairs(spark, sf_dir))


_SOFTMAX = [("sm", """
    SELECT vec_id, actual, [x / list_sum(e) for x in e] AS probs
    FROM (SELECT l.vec_id, CAST(b.label % 3 AS INTEGER) AS actual,
                 [exp(x - list_max(l.logits)) for x in l.logits] AS e
          FROM fx_logits l JOIN embeddings b ON l.vec_id = b.vec_id)""")]


def _scored(spark, sf_dir):
    lg = FX.fx_logits(spark, sf_dir)
    lab = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).cast("int").alias("actual"))
    return lg.join(lab, "vec_id").select("vec_id", "actual", X.softmax("logits").alias("probs"))


@register("softmax_label", with_fx(["fx_logits"], f"""
    SELECT vec_id, {_LAB}[list_position(probs, list_max(probs))] AS risk_label,
           round_even(probs[list_position(probs, list_max(probs))], 4) AS confidence,
           round_even(probs[1], 4) AS p_low, round_even(probs[2], 4) AS p_medium, round_even(probs[3], 4) AS p_high
    FROM sm""", _SOFTMAX))
def softmax_label(spark, sf_dir):
    s = FX.fx_logits(spark, sf_dir).select("vec_id", X.softmax_label("logits").alias("p"))
    pr = F.col("p.probabilities")
    return s.select("vec_id", F.col("p.risk_label").alias("risk_label"), F.col("p.confidence").alias("confidence"),
                    pr["Low"].alias("p_low"), pr["Medium"].alias("p_medium"), pr["High"].alias("p_high"))


@register("weighted_log_loss", with_fx(["fx_logits"], f"""
    SELECT round(sum(w * -ln(probs[actual + 1])) / sum(w), 9) AS loss, count(*) AS n_rows
    FROM (SELECT probs, actual, {str_list([str(w) for w in S.CLASS_WEIGHTS]).replace("'", "")}[actual + 1] AS w
          FROM sm)""", _SOFTMAX))
def weighted_log_loss(spark, sf_dir):
    r = M.weighted_log_loss(_scored(spark, sf_dir))
    return r.select(F.round("loss", 9).alias("loss"), "n_rows")
