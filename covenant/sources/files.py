"""File sources and sinks.

Writes are partitioned DataFrame writes; reads use the built-in parquet,
JSON, text and ``binaryFile`` sources. Contracts are stored as tables of
records and texts; folders with one file per contract can be read, too.
"""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant import schemas as S
from covenant.functions import text as X

SAFE_ID = r"^[A-Za-z0-9._-]+$"


def take_subset(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows; with ``order`` a deterministic top-n (TakeOrderedAndProject)."""
    return (df.orderBy(*order) if order else df).limit(n)


def save_dataset(df: DataFrame, path: str) -> DataFrame:
    """S3: write unless the target exists (mode 'ignore'), then read the stored table."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def profile_dataset(df: DataFrame, first_by: list[str] | None = None) -> DataFrame:
    """One row per column: type, non-null count, row count and, with ``first_by``, the value
    in the first row by these columns as text (one aggregate pass)."""
    cols = df.columns
    first = F.min_by(F.struct(*[F.col(c).cast("string").alias(c) for c in cols]), F.struct(*first_by)) if first_by \
        else F.lit(None)
    agg = df.agg(F.count(F.lit(1)).alias("_rows"), first.alias("_first"),
                 *[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(cols)])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("data_type"),
                              F.col(f"_c{i}").alias("non_null"),
                              (F.col(f"_first.{c}") if first_by else F.lit(None)).cast("string").alias("first_value"))
                     for i, c in enumerate(cols)])
    return agg.select(F.explode(rows).alias("r"), F.col("_rows").alias("n_rows")).select("r.*", "n_rows")


def profile_splits(df: DataFrame, split: str) -> DataFrame:
    """S4 by split: rows of each part of a dataset."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))


def ordered_concat(df: DataFrame, key: str, order: str, value: str, sep: str, block_rows: int = 4096) -> DataFrame:
    """Concatenate ``value`` per ``key`` in ``order`` (two phases: bounded blocks, then blocks in order)."""
    blocks = (df.groupBy(key, F.floor(F.col(order) / block_rows).alias("_blk"))
              .agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_p"))
              .select(key, "_blk", F.array_join(F.transform("_p", lambda p: p.getField(value)), sep).alias("_t"),
                      F.size("_p").alias("_n")))
    return (blocks.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("_blk", "_t"))).alias("_b"), F.sum("_n").alias("n_parts"))
            .select(key, F.array_join(F.transform("_b", lambda b: b.getField("_t")), sep).alias(value), "n_parts"))


def page_text_join(pages: DataFrame, head: int = 2000) -> DataFrame:
    """Page texts joined by newline in page order (null page -> ''), length and first chars."""
    p = pages.select("document", "page", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    j = ordered_concat(p, "document", "page", "text", "\n")
    return j.select("document", F.col("n_parts").alias("n_pages"), F.length("text").alias("text_len"),
                    F.substring("text", 1, head).alias("head"), F.md5("text").alias("text_md5"))


def export_contracts(records: DataFrame, base: str, corrupt: F.Column | None = None,
                     with_text: F.Column | None = None) -> None:
    """JSON records (``snippets``, one line each) and texts (``texts``) by ``safe_id``.

    Files are partitioned by risk label, so a reader lists a few folders, whatever the number
    of contracts. ``corrupt`` / ``with_text`` are optional row predicates used to exercise the
    readers (broken JSON, missing text).
    """
    js = F.to_json(F.struct("title", "split", "risk_score", "risk_label", "clauses", "model_input"))
    if corrupt is not None:
        js = F.when(corrupt, F.substring(js, 1, 10)).otherwise(js)
    records.select("safe_id", js.alias("record"), F.col("risk_label").alias("label")) \
        .write.mode("overwrite").partitionBy("label").json(f"{base}/snippets")
    t = records if with_text is None else records.where(with_text)
    t.select("safe_id", F.encode("text", "UTF-8").alias("content"), F.col("risk_label").alias("label")) \
        .write.mode("overwrite").partitionBy("label").parquet(f"{base}/texts")


def _parsed(df: DataFrame, record: str) -> DataFrame:
    """Columns of the record schema and ``_corrupt`` (the record, where it is no JSON object)."""
    schema = T.StructType([*S.SNIPPETS_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    r = F.from_json(record, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return df.select("safe_id", r.alias("r")).select("safe_id", "r.*")


def read_snippets(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per contract, fixed schema, unknown fields ignored, bad JSON kept aside."""
    return _parsed(spark.read.schema("safe_id string, record string").json(path), "record")


def read_snippet_files(spark: SparkSession, folder: str) -> DataFrame:
    """S6 over single files: ``<id>.snippets.json``, each one JSON object over any number of lines."""
    files = spark.read.option("pathGlobFilter", "*.snippets.json").text(folder, wholetext=True)
    sid = F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), r"^(.*)\.snippets\.json$", 1)
    return _parsed(files.select(sid.alias("safe_id"), "value"), "value").where(F.col("safe_id").rlike(SAFE_ID))


def read_contract_text(spark: SparkSession, path: str) -> DataFrame:
    """Contract texts by id; unsafe ids are rejected, empty texts are texts."""
    t = spark.read.schema("safe_id string, content binary").parquet(path)
    return t.select("safe_id", F.decode("content", "UTF-8").alias("text")).where(F.col("safe_id").rlike(SAFE_ID))


def read_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Stored bytes (path, length, content) of a file or of the files of a folder.

    ``binaryFile`` leaves out empty files, as there is nothing to read; they are added from the
    folder's listing, which the driver holds anyway.
    """
    full = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    empty = [(f.getPath().toString(), 0, b"") for f in fs.listStatus(at)
             if f.isFile() and f.getLen() == 0 and fnmatch(f.getPath().getName(), pattern) and f.getPath().getName()[0] not in "._"]
    return full.unionByName(spark.createDataFrame(empty, full.schema))


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """S8 over single files: ``<id>.txt``."""
    b = read_objects(spark, folder, "*.txt")
    sid = F.regexp_extract(F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1)), r"^(.*)\.txt$", 1)
    return b.select(sid.alias("safe_id"), F.decode("content", "UTF-8").alias("text")).where(F.col("safe_id").rlike(SAFE_ID))


def list_contracts(snippets: DataFrame, texts: DataFrame) -> DataFrame:
    """S7 + A12: safe ids with a text and parseable JSON; title falls back to the id; clause count."""
    ok = snippets.where(F.col("_corrupt").isNull() & F.col("safe_id").rlike(SAFE_ID))
    j = ok.join(texts.select("safe_id").distinct(), "safe_id", "left_semi")
    title = F.when(X.is_blank("title"), F.col("safe_id")).otherwise(F.col("title"))
    return j.select(F.col("safe_id").alias("id"), title.alias("title"), X.clause_count("clauses").alias("clause_count"))


def contracts_by_title(listing: DataFrame) -> DataFrame:
    """T4: the listing by title ignoring case, then id."""
    return listing.orderBy(F.lower("title"), "id")


def append_log(rows: DataFrame, sink: str) -> DataFrame:
    """Insert-only log: append, never update; returns the stored log."""
    rows.write.mode("append").parquet(sink)
    return rows.sparkSession.read.parquet(sink)


def write_workflow_tables(docs: DataFrame, log: DataFrame, base: str) -> tuple[str, str]:
    """Store documents partitioned by status and the audit log by date.

    Queue and dashboard reads filter on status and audit reads on dates, so
    those filters become partition filters (whole directories skipped).
    """
    docs.write.mode("overwrite").partitionBy("status").parquet(f"{base}/documents")
    log.withColumn("log_date", F.to_date(F.col("action_ts").cast("timestamp_ntz"))) \
        .write.mode("overwrite").partitionBy("log_date").parquet(f"{base}/audit_log")
    return f"{base}/documents", f"{base}/audit_log"
