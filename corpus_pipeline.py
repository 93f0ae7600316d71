"""A corpus pipeline of five stages over ``documents``.

Every stage is (spark, docs, sf_dir) -> DataFrame and works on all that its
predecessor kept; ``run`` writes each result as Parquet below the shared
folder and reads it back as the next stage's input. Stages carry whole rows,
so they lower the session's bound on Arrow batches (``small_batches``).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.llm import bpe, decontaminate, minhash, quality, secrets
from covenant.llm.common import read_table, small_batches, stored
from covenant.llm.queries import QUALITY_CUT

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The line CRF and the component search have no SQL form.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose line marginals average to the cut or more; rows keep their columns."""
    small_batches(spark)
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.keep(docs, model, QUALITY_CUT).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, similarity 0.8)."""
    small_batches(spark)
    return minhash.deduplicated(docs, k=5, percent=80).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, credentials blanked out."""
    return secrets.redact(docs).select(*COLUMNS)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a check that they decode to its text."""
    small_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")),
                     path, pattern, keep_text=False)
    back = bpe.decode(ids, path, pattern)
    return back.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                       (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"))


STAGES = [("quality", good_quality), ("near_dedup", without_near_copies), ("decontamination", without_benchmark),
          ("secrets", without_secrets), ("byte_bpe", tokenised)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
