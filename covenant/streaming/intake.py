"""R1 with predictions that arrive on their own, by a stream-stream outer join.

Prepared contracts and model predictions are two streams. A contract waits in
state for a prediction made at most ``wait`` before or after its arrival. It is
logged as classified when that comes, or as ``ClassificationSkipped`` once the
watermarks of both streams say that it cannot come any more. Contracts are
scored by the rules before the join, so that their texts are not kept in state.
Log rows go to a write-once table, one commit per micro-batch, by contract and
step: a batch that is tried again writes nothing twice, and the rows of a second
prediction, or a second copy of the contract that differs, are rejects.

Defined cases: rows with a null id only move the watermark on (heartbeats); a
contract without an arrival time is logged at once, as skipped; a prediction
without a time or label matches nothing or gives no label; contracts without a
stored object are left out, as in the batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from covenant.operators import workflow as W
from covenant.streaming.buffered import NONE
from covenant.streaming.commits import WriteOnce

LOG = "storage_key string, document_id long, step int, action string, user_id long, notes string"


def log_table(spark: SparkSession, path: str) -> WriteOnce:
    return WriteOnce(spark, path, spark.createDataFrame([], LOG).schema)


def scored(contracts: DataFrame, predictions: DataFrame, wait: str, late: str) -> DataFrame:
    """Contracts with rule score, prediction if one comes in time, action and note.

    ``contracts``: doc_id, title, clauses_json, model_input, arrived_at; ``predictions``: doc_id,
    predicted, confidence, predicted_at. ``late`` bounds how far each stream is out of order.
    """
    # Heartbeats must reach the watermarks: a condition on the id alone, or one that Spark infers for a nullable
    # key of the join, would be moved below them; one that names the event time is not.
    key = F.coalesce("doc_id", F.lit(NONE))
    ruled = W.rule_scored(contracts).withColumn("doc_id", key)
    c = ruled.withWatermark("arrived_at", late).where(f"doc_id >= {NONE + 1}L or arrived_at < timestamp '0001-01-01'")
    p = (predictions.select(key.alias("p_id"), "predicted", "confidence", "predicted_at")
         .withWatermark("predicted_at", late))
    near = F.expr(f"doc_id = p_id and predicted_at >= arrived_at - interval {wait} and predicted_at <= arrived_at + interval {wait}")
    waited = c.where("arrived_at is not null").join(p, near, "leftOuter")
    at_once = (ruled.where(f"arrived_at is null and doc_id >= {NONE + 1}L")
               .withColumns({"predicted": F.lit(None).cast("int"), "confidence": F.lit(None).cast("double")}))
    columns = [*ruled.columns, "predicted", "confidence"]
    return W.judged(waited.select(columns).unionByName(at_once.select(columns)).drop("arrived_at"))


def run(spark: SparkSession, contracts: str, predictions: str, schemas: tuple[StructType, StructType], objects: DataFrame,
        sink: str, checkpoint: str, wait: str = "1 hour", late: str = "1 hour", files_per_trigger: int = 1000,
        source: str = "intake") -> WriteOnce:
    """Process the files that have arrived below the two folders; returns the table of log rows.
    ``source`` names the batches of this checkpoint in the table's commits.
    ``objects`` should be a stored table, as each micro-batch reads it."""
    sides = [spark.readStream.schema(s).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
             for path, s in zip((contracts, predictions), schemas)]
    rows = W.prepared_log_rows(scored(*sides, wait, late), objects)
    table = log_table(spark, sink)
    keyed = rows.select(F.concat_ws("/", F.lit("log"), "document_id", "step").alias("storage_key"), "*")

    def write(batch: DataFrame, n: int) -> None:
        if not table.write(batch, f"{source}/{n}"):
            # written before the stream could note it: the state must still be brought up to this batch
            batch.write.format("noop").mode("overwrite").save()

    q = (keyed.writeStream.foreachBatch(write)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return table


def heartbeat(spark: SparkSession, schema: StructType, at) -> DataFrame:
    """A row without an id that moves the watermark of a stream to ``at`` less the bound."""
    return spark.createDataFrame([tuple(at if f.name in ("arrived_at", "predicted_at") else None for f in schema)], schema)
