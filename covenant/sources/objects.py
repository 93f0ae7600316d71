"""Objects by key (S9): ``doc-<id>/v<n>/<name>`` below a base folder.

Three jobs, none of which lets the driver hold a listing:

* ``store_objects`` writes one file per row, write-once;
* ``list_objects`` is a partitioned data source: each task reads the names in
  the base folder one by one, keeps the documents that fall to it and goes
  down into these only. Comparisons and ``IN`` on ``document_id`` are pushed
  into the source, so other documents' folders are not opened; documents named
  one by one are looked up without reading the base folder;
* ``read_keys`` opens the keys of a table, wherever that table comes from.

``read_tree`` is the listing and the contents together. Listed rows are
shuffled by key before the contents are read, so a document with very many
versions is read by many tasks. Contents leave a task in batches of at most
``BATCH_BYTES`` (a larger object makes a batch of its own).

Defined cases: an empty file is an object of length 0; a key without a file,
a null key and a key that is not of this form (so any that leads out of the
base) have null length and content; files and folders of other names are not
objects; a missing or empty base has no objects. A second content for a key is
a ``conflict`` and writes nothing, the same content again is ``stored``: a task
that is tried again gives the same outcome.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, LessThan, LessThanOrEqual)

from covenant.functions import text as X

BATCH_BYTES = 16 << 20
KEY = re.compile(r"doc-(0|-?[1-9][0-9]{0,18})/v(0|[1-9][0-9]{0,8})/([A-Za-z0-9._-]+)")
LISTED = "document_id bigint, version int, name string, key string, length bigint"


class Folder:
    """The base folder, on a local disk or any file system that Arrow opens by address."""

    def __init__(self, base: str):
        local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", base)
        self.disk = local is not None
        self.fs, self.base = (pafs.LocalFileSystem(), os.path.normpath(local[1])) if local else pafs.FileSystem.from_uri(base)

    def names(self, *below: str) -> Iterator[tuple[str, int | None]]:
        """(name, length or None for a folder); on a disk one by one, elsewhere as the store lists them."""
        at = "/".join((self.base, *below))
        if self.disk:
            try:
                with os.scandir(at) as entries:
                    for e in entries:
                        yield e.name, (None if e.is_dir() else e.stat().st_size)
            except (FileNotFoundError, NotADirectoryError):
                return
        else:
            for f in self.fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
                yield f.base_name, (None if f.type == pafs.FileType.Directory else f.size)

    def read(self, key: str | None) -> bytes | None:
        if key is None or not _is_key(key):
            return None
        at = f"{self.base}/{key}"
        if self.fs.get_file_info(at).type != pafs.FileType.File:
            return None
        with self.fs.open_input_stream(at) as f:
            return f.read()

    def store(self, key: str, content: bytes) -> str:
        if not _is_key(key):
            return "bad key"
        there = self.read(key)
        if there is None:
            at = f"{self.base}/{key}"
            folder = at.rpartition("/")[0]
            self.fs.create_dir(folder, recursive=True)
            part = f"{folder}/~{uuid.uuid4().hex}"      # no key has this form: a broken write is no object
            with self.fs.open_output_stream(part) as f:
                f.write(content)
            self.fs.move(part, at)
            there = content
        return "stored" if there == content else "conflict"


def _is_key(key: str) -> bool:
    m = KEY.fullmatch(key)
    return m is not None and m[3] not in (".", "..")


class _Part(InputPartition):
    def __init__(self, number: int, ids: list[int] | None):
        super().__init__(number)
        self.ids = ids


class ObjectReader(DataSourceReader):
    """Lists the objects of the documents that fall to a part; the bounds come from pushed filters."""

    def __init__(self, options):
        self.base = options["path"]
        self.parts = int(options.get("parts", 16))
        self.low, self.high, self.ids = None, None, None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) != ("document_id",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
                ids.discard(None)
                self.ids = ids if self.ids is None else self.ids & ids
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = f.value + isinstance(f, GreaterThan)
                self.low = low if self.low is None else max(low, self.low)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                high = f.value - isinstance(f, LessThan)
                self.high = high if self.high is None else min(high, self.high)
            else:
                yield f

    def partitions(self):
        if self.ids is None:
            return [_Part(n, None) for n in range(self.parts)]
        ids = sorted(i for i in self.ids if self._within(i))
        return [_Part(n, ids[n::self.parts]) for n in range(min(self.parts, len(ids)))] or [_Part(0, [])]

    def _within(self, i: int) -> bool:
        return (self.low is None or i >= self.low) and (self.high is None or i <= self.high)

    def _documents(self, folder: Folder, part: _Part) -> Iterator[int]:
        if part.ids is not None:
            yield from part.ids
            return
        for name, length in folder.names():
            # every part reads all names: the cheapest test first
            if crc32(name.encode(errors="surrogatepass")) % self.parts == part.value and length is None and _is_key(f"{name}/v0/x"):
                i = int(name[4:])
                if self._within(i):
                    yield i

    def read(self, part):
        folder = Folder(self.base)
        for i in self._documents(folder, part):
            for v, length in folder.names(f"doc-{i}"):
                if length is not None or not _is_key(f"doc-{i}/{v}/x"):
                    continue
                for name, size in folder.names(f"doc-{i}", v):
                    key = f"doc-{i}/{v}/{name}"
                    if size is not None and _is_key(key):
                        yield i, int(v[1:]), name, key, size


class ObjectSource(DataSource):
    """``spark.read.format("contract_objects").load(base)``; option ``parts``: number of listing tasks."""

    @classmethod
    def name(cls):
        return "contract_objects"

    def schema(self):
        return LISTED

    def reader(self, schema):
        return ObjectReader(self.options)


def list_objects(spark: SparkSession, base: str, parts: int = 16) -> DataFrame:
    """(document_id, version, name, key, length) of every object below ``base``."""
    # without this setting Spark refuses a Python source that takes filters
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ObjectSource)
    return spark.read.format("contract_objects").option("parts", str(parts)).load(base)


def read_keys(keys: DataFrame, base: str, key: str = "key") -> DataFrame:
    """The rows of ``keys`` with ``length`` and ``content`` of the object that the column ``key`` names.

    Columns of these two names in the input are replaced.
    """
    kept = keys.drop("length", "content")
    schema = T.StructType([*kept.schema.fields, T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])

    def run(batches):
        folder = Folder(base)
        for b in batches:
            names, held, first, found = b.column(b.schema.get_field_index(key)).to_pylist(), 0, 0, []
            for n, k in enumerate(names):
                found.append(folder.read(k))
                held += len(found[-1] or b"")
                if held >= BATCH_BYTES or n == len(names) - 1:
                    sizes = pa.array([None if x is None else len(x) for x in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([*b.slice(first, len(found)).columns, sizes, pa.array(found, pa.binary())],
                                                     names=[*b.schema.names, "length", "content"])
                    held, first, found = 0, n + 1, []

    return kept.mapInArrow(run, schema)


def read_tree(listed: DataFrame, base: str) -> DataFrame:
    """Contents of the objects of a listing; versions of one document are spread over the tasks."""
    return read_keys(_dealt(listed), base)


def _dealt(rows: DataFrame, *then: str) -> DataFrame:
    """The rows by hash of their key, in as many tasks as a shuffle has. Adaptive execution leaves a given number as
    it is, where it would join the few bytes of a listing to one task that then reads all contents. Sorted, objects
    are read in the order in which they were written."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key") \
        .sortWithinPartitions("key", *then)


def store_objects(rows: DataFrame, base: str) -> DataFrame:
    """Write (document_id, version, name, content) once each; (key, outcome) per row, in any order.

    ``outcome`` is ``stored``, ``conflict`` (another content is there, or came first in order of its hash) or
    ``no content``. The rows are written whenever the result is evaluated; evaluating it again changes nothing.
    """
    keyed = rows.select(X.storage_key("document_id", "version", "name").alias("key"), "content", F.sha2("content", 256).alias("sha"))
    # all rows of a key in one task, one after the other; a null content comes first and writes nothing
    dealt = _dealt(keyed, "sha")

    def run(batches):
        folder = Folder(base)
        for b in batches:
            keys = b.column(0).to_pylist()
            done = ["no content" if k is None or c is None else folder.store(k, c) for k, c in zip(keys, (x.as_py() for x in b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], names=["key", "outcome"])

    return dealt.mapInArrow(run, "key string, outcome string")
