"""A write-once table whose batches become visible by a commit file.

A batch is staged, judged in one shuffle with the stored rows of its buckets, and
its rows and rejects are written in one pass and moved below folders of its own
attempt, which no reader looks at. Then one small file, ``_commits/<n>``, names batch and
attempt; it is moved into place only if number n is free, so data and rejects
become visible together or not at all. A batch that was committed before is not
written again. If another writer takes number n first, the rows are judged again
with that writer's rows among the stored ones. Attempts that were never
committed stay invisible; ``remove_uncommitted`` deletes them. Staged rows and
shuffle files are deleted as soon as they are used up.

Rows are kept by key: a row equal to the stored one is a replay and is dropped;
a row that differs from the stored or the first new one, and a row without a
key, is a reject. Data are partitioned by a hash bucket of the key; a batch writes
one file a bucket, or one for about each ``FILE_ROWS`` of the largest bucket's
rows, and reads the stored rows of its own buckets only. The driver holds commit names
(one a batch) and bucket numbers, no rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from covenant.session import remove, short_shuffles

BUCKETS = 64
FILE_ROWS = 1_000_000


class WriteOnce:
    """The table at ``path`` with rows of ``schema``, one per ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "storage_key"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.path).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    # ---- commits -------------------------------------------------------------

    def commits(self) -> list[dict]:
        """What is committed, in order: number, batch, attempt, and whether it has data and rejects."""
        folder = self._path(f"{self.path}/_commits")
        if not self.fs.exists(folder):
            return []
        names = sorted(x.getPath().getName() for x in self.fs.listStatus(folder) if x.getPath().getName().isdigit())
        return [{"number": int(n)} | json.loads(self._text(f"{self.path}/_commits/{n}")) for n in names]

    def _text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, number: int, record: dict) -> bool:
        """Put the commit file in place; False if the number is taken."""
        temporary = self._path(f"{self.path}/_commits/.{uuid.uuid4().hex}")
        out = self.fs.create(temporary, False)
        out.write(json.dumps(record).encode())
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(temporary, self._path(f"{self.path}/_commits/{number:020d}"), options)
            return True
        except Exception as e:  # noqa: BLE001 - only a taken number is expected
            self.fs.delete(temporary, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False

    # ---- reading ---------------------------------------------------------------

    def _read(self, kind: str, commits: list[dict]) -> DataFrame:
        attempts = [c["attempt"] for c in commits if c[kind]]
        extra = StructType([*self.schema.fields, StructField("attempt", StringType()), StructField("_bucket", IntegerType())])
        if not attempts:
            return self.spark.createDataFrame([], extra)
        paths = [f"{self.path}/{kind}/attempt={a}" for a in attempts]
        return self.spark.read.schema(extra).option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def rows(self) -> DataFrame:
        """The committed rows, one per key."""
        return self._read("data", self.commits()).select(self.schema.fieldNames())

    def rejects(self) -> DataFrame:
        return self._read("rejects", self.commits()).select(self.schema.fieldNames())

    # ---- writing ---------------------------------------------------------------

    def write(self, batch: DataFrame, batch_id: str, tries: int = 20) -> bool:
        """Write a batch; False if it was committed before. Of several rows for a new key the smallest by
        content is kept."""
        staged = f"{self.path}/_staged/{uuid.uuid4().hex}"
        with short_shuffles(self.spark), short_shuffles(batch.sparkSession):
            try:
                rows = None
                for _ in range(tries):
                    commits = self.commits()
                    if any(c["batch"] == batch_id for c in commits):
                        return False
                    if rows is None:
                        rows = self._stage(batch, staged)
                    attempt = uuid.uuid4().hex
                    record = self._attempt(rows, commits, attempt) | {"batch": batch_id, "attempt": attempt}
                    if self._commit(len(commits) and commits[-1]["number"] + 1, record):
                        return True
            finally:
                remove(self.spark, staged)
        raise RuntimeError(f"{tries} other writers committed to {self.path} meanwhile")

    def _stage(self, batch: DataFrame, staged: str) -> DataFrame:
        """The batch, written once as it comes: it is counted and judged, again if another writer was first."""
        rows = batch.select(*self.schema.fieldNames(), F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int").alias("_bucket"))
        rows.write.parquet(staged)
        return self.spark.read.schema(rows.schema).parquet(staged)

    def _attempt(self, rows: DataFrame, commits: list[dict], attempt: str) -> dict:
        key, rest = self.key, [c for c in self.schema.fieldNames() if c != self.key]
        sizes = dict(tuple(r) for r in rows.groupBy("_bucket").count().collect())       # at most BUCKETS numbers
        mine, parts = list(sizes), -(-max(sizes.values(), default=1) // FILE_ROWS)
        old = self._read("data", commits).where(F.col("_bucket").isin(mine))
        row, null = F.struct(*rest).alias("_row"), F.col(key).isNull()
        both = (rows.select("_bucket", key, row, F.lit(False).alias("_old"))
                .unionByName(old.select("_bucket", key, row, F.lit(True).alias("_old"))))
        # a key's rows meet in the task that writes its bucket, or a part of it; rows without a key are dealt by content
        spread = F.when(null, F.xxhash64("_row"))
        at = F.col("_bucket") * parts + F.pmod(F.hash(key, spread), F.lit(parts))
        dealt = both.withColumn("_at", at).drop("_bucket").repartition(BUCKETS * parts, "_at").withColumn("_spread", spread)
        same = Window.partitionBy("_at", key, "_spread").orderBy(F.desc("_old"), "_row")    # the stored row, else the smallest
        kind = F.when(null | ~F.col("_row").eqNullSafe(F.col("_held")), "rejects").when(F.col("_nth") == 1, "data")
        judged = (dealt.withColumn("_held", F.first("_row").over(same)).withColumn("_nth", F.row_number().over(same))
                  .where(~F.col("_old")).withColumn("_kind", kind).where("_kind is not null"))
        wrote, made = {}, f"{self.path}/_attempts/{attempt}"
        (judged.select(key, "_row.*", "_kind", F.expr(f"_at div {parts}").cast("int").alias("_bucket"))
         .sortWithinPartitions("_kind", "_bucket", key).write.partitionBy("_kind", "_bucket").parquet(made))
        for kind in ("rejects", "data"):
            wrote[kind] = self.fs.exists(self._path(f"{made}/_kind={kind}"))
            if wrote[kind]:
                self.fs.mkdirs(self._path(f"{self.path}/{kind}"))
                if not self.fs.rename(self._path(f"{made}/_kind={kind}"), self._path(f"{self.path}/{kind}/attempt={attempt}")):
                    raise OSError(f"{made}/_kind={kind} was not moved")
        remove(self.spark, made)
        return wrote

    def remove_uncommitted(self) -> int:
        """Delete the folders of attempts that no commit names. Not while a writer is at work."""
        named, n = {c["attempt"] for c in self.commits()}, 0
        for kind in ("data", "rejects"):
            folder = self._path(f"{self.path}/{kind}")
            for x in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
                name = x.getPath().getName()
                if name.startswith("attempt=") and name.removeprefix("attempt=") not in named:
                    n += self.fs.delete(x.getPath(), True)
        for scratch in ("_staged", "_attempts"):        # of writers that died
            remove(self.spark, f"{self.path}/{scratch}")
        return n


def stream(spark: SparkSession, src: str, table: WriteOnce, checkpoint: str, source: str, files_per_trigger: int = 1000) -> None:
    """The files that have arrived, one commit per micro-batch, named after ``source`` and its batch number."""
    files = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)
    q = (files.writeStream.foreachBatch(lambda b, n: table.write(b, f"{source}/{n}") and None)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
