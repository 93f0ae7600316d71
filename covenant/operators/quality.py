"""Data rules of the relational schema as batch checks.

CHECK / NOT NULL rules: one aggregate pass per table with one ``count_if``
per rule. Foreign keys: one ``left_anti`` join per key. Uniqueness: grouped
counts with ``count > 1``. Results are one row per rule (counts), so nothing
row-sized comes back to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant import schemas as S
from covenant.plans.sqlparts import in_list

_STATUS = [s for s, _ in S.STATUSES]
_ACTION = [a for a, _ in S.ACTIONS]
_ROLE = [r for r, _ in S.ROLES]


def _in_or_null(col, values):
    return F.col(col).isNull() | ~F.col(col).isin(values)


def _rules_to_rows(agg: DataFrame, names: list[str]) -> DataFrame:
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("n_violations"))
                                for i, n in enumerate(names)]))
    return agg.select(stack.alias("r")).select("r.*")


def domain_checks(docs: DataFrame, log: DataFrame, users: DataFrame, versions: DataFrame) -> DataFrame:
    """Violations per CHECK / NOT NULL rule."""
    d_rules = {
        "documents.status": _in_or_null("status", _STATUS),
        "documents.file_name not null": F.col("file_name").isNull(),
        "documents.storage_key not null": F.col("storage_key").isNull(),
        "documents.uploaded_by not null": F.col("uploaded_by").isNull(),
        "documents.version_number not null": F.col("version_number").isNull(),
    }
    l_rules = {
        "audit.action": _in_or_null("action", _ACTION),
        "audit.document_id not null": F.col("document_id").isNull(),
    }
    u_rules = {
        "users.role": _in_or_null("role", _ROLE),
        "users.name not null": F.col("name").isNull(),
        "users.email not null": F.col("email").isNull(),
    }
    v_rules = {f"versions.{c} not null": F.col(c).isNull()
               for c in ("document_id", "version_number", "storage_key", "submitted_by")}
    v_rules["versions.storage_key length"] = F.length("storage_key") > S.KEY_LIMIT
    parts = []
    for df, rules in ((docs, d_rules), (log, l_rules), (users, u_rules), (versions, v_rules)):
        agg = df.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())])
        parts.append(_rules_to_rows(agg, list(rules)))
    return reduce(DataFrame.unionByName, parts)


def _orphans(child: DataFrame, ccol: str, parent: DataFrame, pcol: str, name: str) -> DataFrame:
    c = child.select(F.col(ccol).alias("_k")).where(F.col("_k").isNotNull())
    p = parent.select(F.col(pcol).alias("_k"))
    return c.join(p, "_k", "left_anti").agg(F.count(F.lit(1)).alias("n_orphans")) \
        .select(F.lit(name).alias("fk"), "n_orphans")


def fk_orphans(docs: DataFrame, versions: DataFrame, log: DataFrame, users: DataFrame) -> DataFrame:
    """Rows whose foreign key does not resolve, per key."""
    parts = [
        _orphans(versions, "document_id", docs, "document_id", "versions.document_id"),
        _orphans(versions, "submitted_by", users, "user_id", "versions.submitted_by"),
        _orphans(docs, "uploaded_by", users, "user_id", "documents.uploaded_by"),
        _orphans(log, "document_id", docs, "document_id", "audit.document_id"),
        _orphans(log, "user_id", users, "user_id", "audit.user_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _dups(df: DataFrame, keys: list, name: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return g.agg(F.count(F.lit(1)).alias("n_dup_keys"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows")) \
        .select(F.lit(name).alias("check"), "n_dup_keys", "n_rows")


def unique_checks(docs: DataFrame, versions: DataFrame, log: DataFrame, users: DataFrame) -> DataFrame:
    """Duplicated keys per PRIMARY KEY / UNIQUE rule (email compared case-insensitively)."""
    parts = [
        _dups(users, ["user_id"], "users.user_id"),
        _dups(users, [F.lower("email").alias("email")], "users.email"),
        _dups(docs, ["document_id"], "documents.document_id"),
        _dups(log, ["log_id"], "audit.log_id"),
        _dups(versions, ["document_id", "l_linenumber"], "versions.(document_id, line)"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _nn(rule, cond, table):
    return f"SELECT '{rule}' AS rule, CAST(count_if({cond}) AS BIGINT) AS n_violations FROM {table}"


DOMAIN_SQL = "\nUNION ALL\n".join([
    _nn("documents.status", f"status IS NULL OR status NOT IN {in_list(_STATUS)}", "fx_documents"),
    _nn("documents.file_name not null", "file_name IS NULL", "fx_documents"),
    _nn("documents.storage_key not null", "storage_key IS NULL", "fx_documents"),
    _nn("documents.uploaded_by not null", "uploaded_by IS NULL", "fx_documents"),
    _nn("documents.version_number not null", "version_number IS NULL", "fx_documents"),
    _nn("audit.action", f"action IS NULL OR action NOT IN {in_list(_ACTION)}", "fx_audit"),
    _nn("audit.document_id not null", "document_id IS NULL", "fx_audit"),
    _nn("users.role", f"role IS NULL OR role NOT IN {in_list(_ROLE)}", "fx_users"),
    _nn("users.name not null", "name IS NULL", "fx_users"),
    _nn("users.email not null", "email IS NULL", "fx_users"),
    *(_nn(f"versions.{c} not null", f"{c} IS NULL", "vk")
      for c in ("document_id", "version_number", "storage_key", "submitted_by")),
    _nn("versions.storage_key length", f"length(storage_key) > {S.KEY_LIMIT}", "vk"),
])


def _fk(name, child, ccol, parent, pcol):
    return (f"SELECT '{name}' AS fk, count(*) AS n_orphans FROM {child} c "
            f"WHERE c.{ccol} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pcol} = c.{ccol})")


FK_SQL = "\nUNION ALL\n".join([
    _fk("versions.document_id", "fx_versions", "document_id", "fx_documents", "document_id"),
    _fk("versions.submitted_by", "fx_versions", "submitted_by", "fx_users", "user_id"),
    _fk("documents.uploaded_by", "fx_documents", "uploaded_by", "fx_users", "user_id"),
    _fk("audit.document_id", "fx_audit", "document_id", "fx_documents", "document_id"),
    _fk("audit.user_id", "fx_audit", "user_id", "fx_users", "user_id"),
])


def _uq(name, keys, table):
    return (f"SELECT '{name}' AS \"check\", count(*) AS n_dup_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows "
            f"FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys} HAVING count(*) > 1)")


UNIQUE_SQL = "\nUNION ALL\n".join([
    _uq("users.user_id", "user_id", "fx_users"),
    _uq("users.email", "lower(email)", "fx_users"),
    _uq("documents.document_id", "document_id", "fx_documents"),
    _uq("audit.log_id", "log_id", "fx_audit"),
    _uq("versions.(document_id, line)", "document_id, l_linenumber", "fx_versions"),
])
