"""Evaluation: confusion matrix, weighted metrics, report, weighted loss.

The only data-sized step is one grouped count of (actual, predicted); every
metric is then computed from the 3x3 counts. Per-class values are combined
in class order with ``aggregate`` over a sorted 3-element array, so the
floating-point sums are deterministic regardless of partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant import schemas as S
from covenant.functions import text as X


def label_grid(spark: SparkSession, labels=S.LABELS) -> DataFrame:
    """All (actual, predicted) id pairs: a fixed k x k dimension."""
    k = len(labels)
    rows = [(a, p) for a in range(k) for p in range(k)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("actual", T.IntegerType()),
                                                     T.StructField("predicted", T.IntegerType())]))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Grouped counts of scored rows (rows without a prediction are left out)."""
    p = pairs.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
    return p.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pairs: DataFrame, labels=S.LABELS) -> DataFrame:
    """K x k counts, rows actual, columns predicted, zero cells kept."""
    grid = label_grid(pairs.sparkSession, labels)
    c = grid.join(F.broadcast(pair_counts(pairs)), ["actual", "predicted"], "left")
    return c.select(X.id_label("actual").alias("actual"), X.id_label("predicted").alias("predicted"),
                    F.coalesce("n", F.lit(0)).alias("n"))


def per_class(pairs: DataFrame, labels=S.LABELS) -> DataFrame:
    """Per class: support, predicted count, true positives, precision, recall, F1 (0 on 0/0)."""
    c = pair_counts(pairs)
    cls = label_grid(pairs.sparkSession, labels).where("actual = predicted").select(F.col("actual").alias("cls"))
    stats = c.select(
        F.explode(F.array(
            F.struct(F.col("actual").alias("cls"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("prd"),
                     F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")),
            F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("prd"),
                     F.lit(0).cast("long").alias("tp")),
        )).alias("s")).select("s.*")
    agg = stats.groupBy("cls").agg(F.sum("sup").alias("support"), F.sum("prd").alias("n_pred"),
                                   F.sum("tp").alias("tp"))
    j = cls.join(agg, "cls", "left").fillna(0, subset=["support", "n_pred", "tp"])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_pred").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"), (F.col("support") + F.col("n_pred")).cast("double")),
                    F.lit(0.0))
    return j.select("cls", "support", "n_pred", "tp", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def _ordered(pc: DataFrame) -> DataFrame:
    """One row: the per-class rows as an array sorted by class id."""
    return pc.agg(F.array_sort(F.collect_list(F.struct("cls", "support", "tp", "precision", "recall", "f1")))
                  .alias("c"))


def _fold(arr, fn):
    return F.aggregate(arr, F.lit(0.0), lambda a, e: a + fn(e))


def eval_metrics(pairs: DataFrame, labels=S.LABELS) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    o = _ordered(per_class(pairs, labels))
    c = F.col("c")
    total = F.aggregate(c, F.lit(0).cast("long"), lambda a, e: a + e.getField("support"))
    tps = F.aggregate(c, F.lit(0).cast("long"), lambda a, e: a + e.getField("tp"))

    def wavg(name):
        return F.coalesce(F.try_divide(_fold(c, lambda e: e.getField(name) * e.getField("support")),
                                       total.cast("double")), F.lit(0.0))

    return o.select(F.coalesce(F.try_divide(tps.cast("double"), total.cast("double")), F.lit(0.0)).alias("accuracy"),
                    wavg("f1").alias("f1"), wavg("precision").alias("precision"), wavg("recall").alias("recall"),
                    total.alias("n_scored"))


def classification_report(pairs: DataFrame, labels=S.LABELS) -> DataFrame:
    """Per class P/R/F1/support, then accuracy, macro avg and weighted avg rows."""
    pc = per_class(pairs, labels)
    rows = pc.select(X.id_label("cls").alias("row"), F.col("cls").alias("pos"), "precision", "recall", "f1",
                     "support")
    o = _ordered(pc)
    c = F.col("c")
    k = len(labels)
    total = F.aggregate(c, F.lit(0).cast("long"), lambda a, e: a + e.getField("support"))
    tps = F.aggregate(c, F.lit(0).cast("long"), lambda a, e: a + e.getField("tp"))
    acc = F.coalesce(F.try_divide(tps.cast("double"), total.cast("double")), F.lit(0.0))

    def macro(name):
        return _fold(c, lambda e: e.getField(name)) / F.lit(float(k))

    def wavg(name):
        return F.coalesce(F.try_divide(_fold(c, lambda e: e.getField(name) * e.getField("support")),
                                       total.cast("double")), F.lit(0.0))

    nul = F.lit(None).cast("double")
    summary = o.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("row"), F.lit(k).alias("pos"), nul.alias("precision"),
                 nul.alias("recall"), acc.alias("f1"), total.alias("support")),
        F.struct(F.lit("macro avg").alias("row"), F.lit(k + 1).alias("pos"), macro("precision").alias("precision"),
                 macro("recall").alias("recall"), macro("f1").alias("f1"), total.alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), F.lit(k + 2).alias("pos"), wavg("precision").alias("precision"),
                 wavg("recall").alias("recall"), wavg("f1").alias("f1"), total.alias("support")),
    )).alias("s")).select("s.*")
    return rows.unionByName(summary)


def weighted_log_loss(scored: DataFrame, weights=S.CLASS_WEIGHTS) -> DataFrame:
    """sum(w * -ln p_true) / sum(w) over rows with a probability array and a true id."""
    w = F.try_element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("actual") + 1)
    p = F.try_element_at(F.col("probs"), F.col("actual") + 1)
    s = scored.where(F.col("actual").isNotNull()).select(w.alias("w"), (-F.log(p)).alias("nll"))
    return s.agg((F.sum(F.col("w") * F.col("nll")) / F.sum("w")).alias("loss"),
                 F.count(F.lit(1)).alias("n_rows"))


def golden_pairs(spark: SparkSession, matrix) -> DataFrame:
    """Expand a confusion matrix into (actual, predicted) rows (unit tests)."""
    rows = [(a, p) for a, r in enumerate(matrix) for p, n in enumerate(r) for _ in range(n)]
    return spark.createDataFrame(rows, "actual int, predicted int")
