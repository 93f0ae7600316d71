"""Model keys: P16 (oracle) and M1, M2, M3, M5 (iterative training: rows-only checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenant import schemas as S
from covenant.functions import text as X
from covenant.operators import ml as ML
from covenant.operators import split as SP
from covenant.plans.catalog import register
from covenant.plans.q_split import _CTES, _split
from covenant.plans.sqlparts import label_id_sql, q, with_fx
from covenant.session import materialize

_NTOK = f"len(regexp_extract_all(lower(risk_text), {q(X.TOKEN_PATTERN)}))"


@register("select_model_columns", with_fx(["fx_risk"], f"""
    SELECT title, CAST({label_id_sql('risk_label')} AS DOUBLE) AS labels,
           CAST(least({_NTOK}, {S.MAX_TOKENS - X.SPECIAL_TOKENS}) AS INTEGER) AS n_tokens_kept,
           {_NTOK} + {X.SPECIAL_TOKENS} >= {S.MAX_TOKENS} AS truncated
    FROM split_all WHERE split = 'train'""", _CTES))
def select_model_columns(spark, sf_dir):
    f = ML.model_frame(_split(spark, sf_dir, text=True).where(F.col("split") == "train"))
    return f.select("title", "labels", F.size("tokens").alias("n_tokens_kept"), "truncated")


def _frames(spark, sf_dir):
    s = _split(spark, sf_dir, text=True)
    train = materialize(ML.model_frame(s.where(F.col("split") == "train")))
    test = materialize(ML.model_frame(s.where(F.col("split") == "test")))
    return train, test


@register("train_weighted")
def train_weighted(spark, sf_dir):
    """M1: fit on the train split; report train-set metrics."""
    train, _ = _frames(spark, sf_dir)
    model = ML.train_weighted(train)
    return ML.evaluate_split(ML.score_batch(model, train))["metrics"]


@register("score_batch")
def score_batch(spark, sf_dir):
    """M3: score the test split."""
    train, test = _frames(spark, sf_dir)
    s = ML.score_batch(ML.train_weighted(train), test)
    p = F.col("probabilities")
    return s.select("title", "risk_label", "confidence", p["Low"].alias("p_low"), p["Medium"].alias("p_medium"),
                    p["High"].alias("p_high"), "truncated")


@register("evaluate_split")
def evaluate_split(spark, sf_dir):
    """M5: classification report of the test split."""
    train, test = _frames(spark, sf_dir)
    return ML.evaluate_split(ML.score_batch(ML.train_weighted(train), test))["report"]


@register("weight_sweep")
def weight_sweep(spark, sf_dir):
    """M2: class-weight grid tuned on a validation fold carved from train (not on test)."""
    s = _split(spark, sf_dir, text=True).where(F.col("split") == "train").drop("split")
    fold = materialize(SP.stratified_split(s, 0.2, seed=S.SPLIT_SEED + 1))
    tr = ML.model_frame(fold.where(F.col("split") == "train"))
    va = ML.model_frame(fold.where(F.col("split") == "test"))
    return ML.weight_sweep(tr, va)
