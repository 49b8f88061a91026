"""Analytics over operations, slow queries, audit events and the state of a system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.values import ratio

#: Samples that percentiles look back on, kept slow queries, the slow threshold in ms.
SAMPLES, SLOW_KEPT, SLOW_MS = 10_000, 1000, 100
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
#: From where a figure is degraded, and from where unhealthy; hit rate is the other way round.
HEALTH = {"memory_gb": (4, 8), "error_rate": (5, 10), "p99_ms": (50, 100), "lag_ms": (1000, 5000)}
LEAST_HIT_RATE = 50


def latency_percentiles(samples: DataFrame, last: int = SAMPLES) -> DataFrame:
    """Of samples (seq, micros), the percentiles and max of the last ones: the sample at place min(floor(n * p), n - 1) in order.

    `last` bounds what is ranked: the top-k by seq is taken first, so one task sorts that many rows at most.
    """
    recent = samples.orderBy(F.desc("seq")).limit(last).select("micros")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    places = recent.withColumn("n", n).withColumn("at", F.row_number().over(Window.orderBy("micros")) - 1)
    pick = lambda p: F.max(F.when(F.col("at") == F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1), F.col("micros")))
    return places.agg(*[pick(p).alias(name) for name, p in PERCENTILES.items()], F.max("micros").alias("max"), F.count(F.lit(1)).alias("samples"))


def operation_counts(ops: DataFrame) -> DataFrame:
    """(op, n) of ops (op)."""
    return ops.groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def rates(ops: DataFrame, uptime_seconds: Column | float) -> DataFrame:
    """Of ops (op, ok, hit): total, per_second, error_rate and hit_rate in percent (hit null: no cache access)."""
    out = ops.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(~F.col("ok"), 1)).alias("errors"), F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count("hit").alias("lookups"))
    seconds = uptime_seconds if isinstance(uptime_seconds, Column) else F.lit(float(uptime_seconds))
    return out.select("total", "errors", "hits", "lookups", ratio(F.col("total"), seconds).alias("per_second"), ratio(F.col("errors"), F.col("total"), 100).alias("error_rate"), ratio(F.col("hits"), F.col("lookups"), 100).alias("hit_rate"))


def collection_metrics(ops: DataFrame) -> DataFrame:
    """(collection, reads, writes, documents, bytes) of ops (collection, op, doc_id, size_bytes)."""
    reads = F.count(F.when(F.col("op").isin("read", "query"), 1))
    writes = F.count(F.when(F.col("op").isin("insert", "update", "delete"), 1))
    return ops.groupBy("collection").agg(reads.alias("reads"), writes.alias("writes"), F.countDistinct("doc_id").alias("documents"), F.sum("size_bytes").alias("bytes"))


def slow_queries(log: DataFrame, n: int = SLOW_KEPT, threshold_ms: float = SLOW_MS) -> DataFrame:
    """The n latest queries (seq, millis, ...) of at least the threshold, latest first: a filtered top-k."""
    return log.where(F.col("millis") >= threshold_ms).orderBy(F.desc("seq")).limit(n)


def slow_statistics(log: DataFrame, threshold_ms: float = SLOW_MS) -> DataFrame:
    """n, the whole-number average and the maximum of slow queries' milliseconds; zeros without one."""
    slow = log.where(F.col("millis") >= threshold_ms)
    total = F.sum(F.floor("millis"))
    n = F.count(F.lit(1))
    return slow.agg(n.alias("n"), F.coalesce(F.floor(total / F.nullif(n, F.lit(0))), F.lit(0)).cast("long").alias("avg_millis"), F.coalesce(F.max(F.floor("millis")), F.lit(0)).cast("long").alias("max_millis"))


def audit_statistics(audit: DataFrame) -> DataFrame:
    """Counts of events (kind, success): authentication and authorization by outcome, administration, configuration."""
    n = lambda kind, ok=None: F.count(F.when((F.col("kind") == kind) & (F.lit(True) if ok is None else F.col("success") == ok), 1))
    return audit.agg(F.count(F.lit(1)).alias("total"), n("auth", True).alias("auth_ok"), n("auth", False).alias("auth_failed"), n("authz", False).alias("authz_failed"), n("admin").alias("admin"), n("config").alias("config_changes"))


def audit_recent(audit: DataFrame, n: int, user: str | None = None, operation: str | None = None) -> DataFrame:
    """The n latest events, of a user or an operation if asked."""
    if user is not None:
        audit = audit.where(F.col("user") == user)
    if operation is not None:
        audit = audit.where(F.col("operation") == operation)
    return audit.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def level(value: Column, degraded: float, unhealthy: float) -> Column:
    return F.when(value > unhealthy, "unhealthy").when(value > degraded, "degraded").otherwise("healthy")


def health(figures: DataFrame) -> DataFrame:
    """figures (memory_gb, error_rate, p99_ms, lag_ms, hit_rate) with a check of each and overall, the last that is not healthy."""
    names = []
    for name, (degraded, unhealthy) in HEALTH.items():
        figures = figures.withColumn(f"{name}_check", level(F.col(name), degraded, unhealthy))
        names.append(f"{name}_check")
    figures = figures.withColumn("hit_rate_check", F.when(F.col("hit_rate") < LEAST_HIT_RATE, "degraded").otherwise("healthy"))
    names.append("hit_rate_check")
    overall = F.coalesce(*[F.when(F.col(n) != "healthy", F.col(n)) for n in reversed(names)], F.lit("healthy"))
    return figures.withColumn("overall", overall)


def users_by_role(users: DataFrame) -> DataFrame:
    return users.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def cluster_health(replicas: DataFrame) -> DataFrame:
    """Of replicas (healthy): total, healthy and whether the cluster is, that is all of them."""
    return replicas.agg(F.count(F.lit(1)).alias("replicas"), F.count(F.when(F.col("healthy"), 1)).alias("healthy")).withColumn("cluster_healthy", F.col("replicas") == F.col("healthy"))


def storage_statistics(collections: DataFrame) -> DataFrame:
    """Of documents (collection, size_bytes, created_at, updated_at): what a catalog tells about each collection."""
    return collections.groupBy("collection").agg(F.count(F.lit(1)).alias("documents"), F.sum("size_bytes").alias("bytes"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def server_info(operations: DataFrame, sessions: DataFrame, collections: int, started: Column, now: Column, seconds: int = 5) -> DataFrame:
    """One row of (operations (ts, hit), sessions): uptime_seconds, connections, collections, total, ops_per_second over the last
    `seconds`, and hit_rate of all lookups (0 without one)."""
    recent = F.count(F.when((F.col("ts") <= now) & (F.col("ts") > now - F.make_dt_interval(secs=F.lit(seconds))), 1))
    hits, lookups = F.count(F.when(F.col("hit"), 1)), F.count("hit")
    out = operations.agg(F.count(F.lit(1)).alias("total"), (recent / seconds).alias("ops_per_second"), F.coalesce(hits / F.nullif(lookups, F.lit(0)), F.lit(0.0)).alias("hit_rate"))
    connections = sessions.agg(F.count(F.lit(1))).scalar()
    return out.select(F.timestamp_diff("SECOND", started, now).alias("uptime_seconds"), connections.alias("connections"), F.lit(collections).alias("collections"), "total", "ops_per_second", "hit_rate")
