"""Roles, access lists, keys and encryption at rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.values import decrypt, encrypt

#: The operations, and which of them each role may do by default.
OPERATIONS = (
    "read", "write", "delete",
    "create_collection", "drop_collection", "list_collections",
    "create_index", "drop_index", "list_indexes",
    "create_user", "update_user", "delete_user", "list_users", "change_password",
    "backup", "restore", "view_metrics", "view_logs", "configure_server",
    "subscribe", "publish",
    "flush_cache", "view_cache_stats",
    "configure_replication", "view_replication_status",
)
READ_ONLY = ("read", "list_collections", "list_indexes", "change_password", "subscribe", "view_cache_stats", "view_replication_status")
READ_WRITE = ("read", "write", "delete", "list_collections", "list_indexes", "change_password", "subscribe", "publish", "view_cache_stats", "view_replication_status")
ROLES = {"admin": OPERATIONS, "read_write": READ_WRITE, "read_only": READ_ONLY}


def role_permissions(spark: SparkSession) -> DataFrame:
    """(role, operation): a few dozen rows, fixed."""
    return spark.createDataFrame([(r, o) for r, ops in ROLES.items() for o in ops], "role string, operation string")


def decide(requests: DataFrame, permissions: DataFrame, acl: DataFrame) -> DataFrame:
    """requests (request_id, user, role, operation, resource) with allowed and reason.

    The role decides first. Rows of the access list (principal: a user or a role, resource, operation, deny) count where the
    principal is the request's user or role and the resource its own; a null operation stands for an entry without operations.
    Of those of the request's operation, a denial beats a permission; if there are rows, but none permits the operation, it is
    denied; without rows the role's decision stands. reason: role, denied, permitted or not_listed.

    The list becomes a row for each principal and resource, with a set of at most all operations; a request meets its one or two
    principals by one equi-join, and its votes are added up by request.
    """
    entries = acl.groupBy("principal", "resource").agg(F.collect_set(F.when(F.col("deny"), F.col("operation"))).alias("_denied"), F.collect_set(F.when(~F.col("deny"), F.col("operation"))).alias("_allowed"))
    asked = requests.select("request_id", "operation", "resource", F.explode(F.array_distinct(F.array("user", "role"))).alias("principal"))
    met = asked.join(entries, ["principal", "resource"])
    votes = met.groupBy("request_id").agg(F.max(F.expr("array_contains(_denied, operation)")).alias("_no"), F.max(F.expr("array_contains(_allowed, operation)")).alias("_yes"))
    out = requests.join(permissions.distinct().withColumn("_role", F.lit(True)), ["role", "operation"], "left").join(votes, "request_id", "left")
    reason = F.when(F.col("_role").isNull() | F.col("_no").isNull(), "role").when(F.col("_no"), "denied").when(F.col("_yes"), "permitted").otherwise("not_listed")
    out = out.withColumn("reason", reason)
    return out.withColumn("allowed", F.col("_role").isNotNull() & ~F.col("reason").isin("denied", "not_listed")).select(*requests.columns, "reason", "allowed")


def encrypt_fields(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    return df.withColumns({c: encrypt(F.col(c), key) for c in columns})


def decrypt_fields(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    return df.withColumns({c: decrypt(F.col(c), key) for c in columns})


def rotate(df: DataFrame, columns: list[str], old: Column, new: Column) -> DataFrame:
    """df with columns under the new key, and rotated: whether all of a row's could be read; rows that could not stay as they are."""
    plain = {c: F.try_aes_decrypt(F.col(c), old, F.lit("GCM")) for c in columns}
    whole = F.lit(True)
    for c in columns:
        whole = whole & (F.col(c).isNull() | plain[c].isNotNull())
    df = df.withColumn("rotated", whole)
    return df.withColumns({c: F.when(F.col("rotated"), F.aes_encrypt(plain[c], new, F.lit("GCM"))).otherwise(F.col(c)) for c in columns})


def key_ages(keys: DataFrame, now: Column) -> DataFrame:
    """keys (key_id, active, last_rotated, rotation_days) with age_days, needs_rotation (active and older than its days),
    warning (active, from four fifths of its days on) and days_remaining."""
    age = F.datediff(now, F.col("last_rotated"))
    out = keys.withColumn("age_days", age)
    due = F.col("active") & (F.col("age_days") > F.col("rotation_days"))
    soon = F.col("active") & (F.col("age_days") >= F.col("rotation_days") * 0.8) & (F.col("age_days") < F.col("rotation_days"))
    return out.withColumn("needs_rotation", due).withColumn("warning", soon).withColumn("days_remaining", F.col("rotation_days") - F.col("age_days"))


def rotation_statistics(rotations: DataFrame) -> DataFrame:
    """Of rotations (status, records): total, completed, failed, running, records."""
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return rotations.agg(F.count(F.lit(1)).alias("total"), n("completed").alias("completed"), n("failed").alias("failed"), n("idle", "re-encrypting").alias("running"), F.coalesce(F.sum("records"), F.lit(0)).cast("long").alias("records"))
