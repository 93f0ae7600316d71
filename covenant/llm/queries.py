"""The thin ``opN_`` queries: each applies its operator, with production
parameters, to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.llm import (bpe, centroids, decontaminate, divergence, fingerprint, langid, minhash, oracles, packing, quality,
                          secrets, sharding, tokencount, urlfilter)
from covenant.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOKEN_LIMIT, QUALITY_CUT = 1024, 0.3
URL_RULES = [urlfilter.Rule.parse(v, r) for v, r in (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def held_out(parts: int, part: int):
    """Rows that no model may learn from: crc32 of the id as text, modulo ``parts``."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == part, F.lit(True))


@register
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), k=2, percent=80)


@register
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, pattern, keep_text=False).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"))
    return (bpe.decode(ids, path, pattern, keep_ids=False)
            .select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")))


@register
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


@register
def op4_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sharding.shard(read_table(spark, sf_dir, "documents"))
            .withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}))


@register
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register
def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_fingerprints(read_table(spark, sf_dir, "documents"))


@register
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return (tokencount.token_counts(docs.select("doc_id", "text", size.alias("n_bytes")),
                                    public_tokenizers.path("byte_bpe_50k.json"), keep_text=False)
            .withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT))


@register
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(4, 2)).select("text", "lang"))
    return langid.predict(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


@register
def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs.where(~held_out(5, 0)), read_table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    return quality.score(docs, model).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


@register
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin([r.kind for r in secrets.BASE]))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in secrets.BASE]
    return found.select("doc_id", *counts,
                        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@register
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


@register
def op12_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


ORACLE["op1_minhash_dedup"] = oracles.near_duplicates()
ORACLE["op3_url_filter"] = oracles.url_filter(URL_RULES)
ORACLE["op10_secret_scan"] = oracles.secret_scan()
ORACLE["op11_source_divergence"] = oracles.source_divergence()
ORACLE["op13_centroids"] = oracles.centroid_clusters()
