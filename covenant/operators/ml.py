"""Model jobs (M1–M3, M5, M2) with Spark ML.

The reference fine-tunes a transformer on one machine. Here the 3-class
text classifier is a Spark ML pipeline: word/punctuation tokens (the F17
tokenizer, truncated to the 512-token budget) -> HashingTF -> IDF ->
multinomial LogisticRegression with a per-row class weight (the weighted loss)
and L2 regularisation (the weight decay). Training is distributed
(treeAggregate of gradients); scoring is ``transform`` plus the F16
post-processing in JVM expressions. An external model can be plugged in
through ``score_with`` (``mapInPandas`` over Arrow batches).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant import schemas as S
from covenant.functions import text as X
from covenant.operators import metrics as M
from covenant.session import materialize

NUM_FEATURES = 1 << 18


def model_frame(risk: DataFrame, weights=S.CLASS_WEIGHTS, max_len: int = S.MAX_TOKENS) -> DataFrame:
    """P16 + F3 + F17: title, tokens (truncated), label id, class weight, truncated flag."""
    toks = X.tokens("risk_text")
    w = F.try_element_at(F.array(*[F.lit(float(x)) for x in weights]), X.label_id("risk_label") + 1)
    return risk.select(
        "title",
        F.slice(toks, 1, max_len - X.SPECIAL_TOKENS).alias("tokens"),
        X.label_id("risk_label").cast("double").alias("labels"),
        w.alias("weight"),
        (F.size(toks) + X.SPECIAL_TOKENS >= max_len).alias("truncated"),
    )


def feature_stages() -> list:
    return [HashingTF(inputCol="tokens", outputCol="tf", numFeatures=NUM_FEATURES),
            IDF(inputCol="tf", outputCol="features")]


def classifier(reg: float, max_iter: int, weight: str = "weight") -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="labels", weightCol=weight, family="multinomial",
                              regParam=reg, elasticNetParam=0.0, maxIter=max_iter, standardization=True)


def train_weighted(train: DataFrame, reg: float = 0.01, max_iter: int = 50) -> PipelineModel:
    """M1: fit the weighted multinomial classifier on a model frame."""
    return Pipeline(stages=[*feature_stages(), classifier(reg, max_iter)]).fit(train)


def score_batch(model: Transformer, frame: DataFrame) -> DataFrame:
    """M3: risk_label, confidence, probabilities, truncated per row (F16 rounding)."""
    p = model.transform(frame).withColumn("probs", vector_to_array("probability"))
    best = F.array_position("probs", F.array_max("probs"))
    lab = F.array(*[F.lit(x) for x in S.LABELS])
    return p.select(
        "title", "labels", "truncated", "probs",
        F.element_at(lab, best.cast("int")).alias("risk_label"),
        F.bround(F.element_at("probs", best.cast("int")), 4).alias("confidence"),
        F.map_from_arrays(lab, F.transform("probs", lambda v: F.bround(v, 4))).alias("probabilities"),
        (best - 1).cast("int").alias("predicted"),
    )


def evaluate_split(scored: DataFrame) -> dict[str, DataFrame]:
    """M5: confusion matrix, report and weighted loss of scored rows."""
    pairs = scored.select(F.col("labels").cast("int").alias("actual"), "predicted", "probs")
    return {
        "confusion": M.confusion_matrix(pairs),
        "report": M.classification_report(pairs),
        "metrics": M.eval_metrics(pairs),
        "loss": M.weighted_log_loss(pairs),
    }


def score_with(frame: DataFrame, logits_fn: Callable[[pd.Series], list], text_col: str = "risk_text") -> DataFrame:
    """M3 hook: an external model as a pandas function over Arrow batches.

    ``logits_fn`` maps a Series of texts to a list of 3-element logit lists;
    it runs inside executor tasks via ``mapInPandas``. Softmax, argmax and
    rounding stay in JVM expressions (F16).
    """
    keep = list(frame.columns)
    schema = frame.select(*keep).schema.add("logits", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            b["logits"] = logits_fn(b[text_col])
            yield b

    out = frame.select(*keep).mapInPandas(run, schema)
    return out.withColumn("prediction", X.softmax_label("logits"))


WEIGHT_GRID = [
    (1.0, 1.0, 1.0),
    (1.0, 1.6, 1.6),
    (1.0, 2.0, 2.0),
    (1.0, 3.0, 3.0),
]


def weight_sweep(train_frame: DataFrame, valid_frame: DataFrame, grid=WEIGHT_GRID,
                 reg: float = 0.01, max_iter: int = 30) -> DataFrame:
    """M2: one model per class-weight setting, compared on a validation fold.

    Returns one row per setting with macro F1 and High recall; ``best`` marks
    the setting with the highest macro F1 (ties: higher High recall, then grid
    order). Each fit is a distributed job; the grid itself is a short list.
    """
    features = Pipeline(stages=feature_stages()).fit(train_frame)        # once for all settings
    train = materialize(features.transform(train_frame).select("features", "labels"))
    valid = materialize(features.transform(valid_frame).select("title", "features", "labels", "truncated"))
    found = []
    for i, w in enumerate(grid):
        wcol = F.try_element_at(F.array(*[F.lit(x) for x in w]), F.col("labels").cast("int") + 1)
        model = classifier(reg, max_iter).fit(train.withColumn("weight", wcol))
        rep = M.classification_report(
            score_batch(model, valid).select(F.col("labels").cast("int").alias("actual"), "predicted"))
        r = rep.agg(F.max(F.when(F.col("row") == "macro avg", F.col("f1"))).alias("f1"),
                    F.max(F.when(F.col("row") == "High", F.col("recall"))).alias("recall")).first()
        found.append((i, ",".join(str(x) for x in w), r.f1, r.recall))
    best = max(found, key=lambda r: (r[2] or 0.0, r[3] or 0.0, -r[0]))[0]
    return train_frame.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in found], "setting int, weights string, macro_f1 double, high_recall double, best boolean")
