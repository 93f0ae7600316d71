"""Scans of the relational input tables.

Reads are plain ``spark.read.parquet``: Catalyst prunes columns and pushes
filters into the scan, so callers select only what they use. The same
functions accept any DataFrame source (``read.jdbc`` etc.) via ``load``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from covenant.schemas import QA_SCHEMA

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; nothing is materialised."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_qa(spark: SparkSession, path: str) -> DataFrame:
    """Load a question/answer table with its explicit schema.

    ``row_ord`` must be present in the stored data: pandas row order is
    semantic in the reference (text concatenation order) and Spark has none.
    """
    return spark.read.schema(QA_SCHEMA).parquet(path)
