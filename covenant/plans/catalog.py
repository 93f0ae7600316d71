"""Named queries: (spark, sf_dir) -> DataFrame, and their DuckDB oracles.

Every query reads the driver tables (through the fixture derivations), so
its work grows with the data. Keys follow SURVEY §2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from covenant.operators import risk as R
from covenant.plans import sqlparts as Q
from covenant.sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _qa(spark, sf_dir, context=False):
    return FX.fx_qa(spark, sf_dir, with_context=context)


# ---- flagship --------------------------------------------------------------

@register("contract_risk", Q.with_fx(["fx_risk"], "SELECT title, risk_score, risk_text, risk_label FROM fx_risk"))
def contract_risk(spark, sf_dir):
    return R.contract_risk(_qa(spark, sf_dir))


# Importing the query modules registers their keys.
from covenant.plans import q_metrics, q_ml, q_risk, q_split, q_stream, q_workflow  # noqa: E402,F401
from covenant.plans import q_sources  # noqa: E402,F401
