"""W1, W6 as increments: stored state per document that a delta is merged with.

Version numbers go on from the stored maximum, a status from the stored one. The
state of a document is small and mergeable: its highest version, and the
function on the five statuses that its log rows compose to, with the number of
moves tried. Rows of a delta count as later than all that the state holds, as a
submission gets the next free number whatever its date. So a base and deltas in
order of time give what one run over all rows gives, and old rows are not read.

Defined cases: a document that only the state or only the delta has keeps or
gets its state; rows without a document form a group of their own; an empty
delta changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.operators import workflow as W


def version_state(numbered: DataFrame) -> DataFrame:
    """document_id, max_version of rows that have their version_number."""
    return numbered.groupBy("document_id").agg(F.max("version_number").alias("max_version"))


def next_versions(delta: DataFrame, state: DataFrame, order: list | None = None) -> DataFrame:
    """W1 for a delta: its rows numbered on from ``state`` (document_id, max_version)."""
    return W.assign_versions(delta, order, state.select("document_id", F.col("max_version").alias("start")))


def merge_versions(state: DataFrame, numbered: DataFrame) -> DataFrame:
    """The state after the numbered rows of a delta."""
    return (state.select("document_id", "max_version").unionByName(version_state(numbered))
            .groupBy("document_id").agg(F.max("max_version").alias("max_version")))


def status_state(log: DataFrame) -> DataFrame:
    """document_id, moves (status reached from each of the five statuses), n_tried of a log or a delta."""
    replay = W._status_replay(log, ["target"])
    sections = replay.sections()
    per_key = replay.per_key(sections)
    return per_key.select("document_id", F.aggregate(
        "ss", replay.identity, lambda f, s: F.transform(f, lambda e: replay.then(e, s.getField("fn")))).alias("moves"),
        F.col("n").alias("n_tried"))


def merge_statuses(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The state after a delta, both as ``status_state`` gives them."""
    later = delta.select(F.col("document_id").alias("_id"), F.col("moves").alias("_moves"), F.col("n_tried").alias("_n"))
    both = state.join(later, F.col("document_id").eqNullSafe(F.col("_id")), "full_outer")
    none = F.array(*[F.lit(i) for i in range(len(W.STATUS_NAMES))])
    first, then = F.coalesce("moves", none), F.coalesce("_moves", none)
    return both.select(F.coalesce("document_id", "_id").alias("document_id"),
                       F.transform(first, lambda s: F.element_at(then, s + 1)).alias("moves"),
                       (F.coalesce("n_tried", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_tried"))


def statuses(state: DataFrame) -> DataFrame:
    """W6 from the state: every document starts as a draft."""
    return state.select("document_id", W._sname(F.element_at("moves", 1)).alias("status"), "n_tried")
