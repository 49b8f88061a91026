"""Messages, monitoring, access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import monitor, security
from docquarry.queries.base import query, table
from docquarry.streaming import changelog, pubsub

# Messages: an event is a message on the channel <type>.<user>; suppliers subscribe to the clicks of the user of their number.


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = F.concat("event_type", F.lit("."), F.col("user_id"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), channel.alias("channel"), F.col("props").alias("payload"))


def subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100).alias("subscriber_id"), F.concat(F.lit("click."), F.col("s_suppkey")).alias("channel"))


PATTERNS = [(1, "click.*"), (2, "*.3"), (3, "p*.?"), (3, "p*.?"), (4, "view.1"), (5, "nothing*"), (6, "*")]


def patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATTERNS, "subscriber_id long, pattern string")


MSG = "(SELECT event_id AS id, event_type || '.' || user_id AS channel, props AS payload FROM events)"
SUB = "(SELECT s_suppkey + 100 AS subscriber_id, 'click.' || s_suppkey AS channel FROM supplier)"
PAT = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in PATTERNS) + ") t(subscriber_id, pattern))"
EXACT_SQL = f"SELECT m.id, m.channel, CAST(s.subscriber_id AS BIGINT) AS subscriber_id FROM {MSG} m JOIN {SUB} s ON m.channel = s.channel"
PATTERN_SQL = f"SELECT m.id, m.channel, CAST(p.subscriber_id AS BIGINT) AS subscriber_id FROM {MSG} m JOIN {PAT} p ON regexp_matches(m.channel, '^' || replace(replace(p.pattern, '*', '.*'), '?', '.') || '$')"
ALL_SQL = f"({EXACT_SQL} UNION ALL {PATTERN_SQL})"


@query(EXACT_SQL)
def ps_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pubsub.exact(messages(spark, sf_dir), subs(spark, sf_dir))


@query(PATTERN_SQL)
def ps_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pubsub.by_pattern(messages(spark, sf_dir), patterns(spark))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pubsub.fan_out(messages(spark, sf_dir), subs(spark, sf_dir), patterns(spark))


@query(f"SELECT e.event_id AS id, count(d.id) AS delivered FROM events e LEFT JOIN {ALL_SQL} d ON e.event_id = d.id GROUP BY 1")
def ps_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pubsub.delivered(messages(spark, sf_dir), deliveries(spark, sf_dir))


@query(f"SELECT id, channel, subscriber_id FROM (SELECT *, row_number() OVER (PARTITION BY subscriber_id ORDER BY id DESC, channel) AS r FROM {ALL_SQL}) WHERE r <= 100")
def ps_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pubsub.queues(deliveries(spark, sf_dir), 100)


@query(f"SELECT subscriber_id, count(*) AS received, CAST(greatest(count(*) - 100, 0) AS BIGINT) AS dropped FROM {ALL_SQL} GROUP BY 1")
def ps_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pubsub.dropped(deliveries(spark, sf_dir), 100)


@query(f"""SELECT (SELECT count(DISTINCT channel) FROM {SUB}) AS channels, (SELECT count(DISTINCT subscriber_id) FROM {SUB}) AS subscribers, (SELECT count(*) FROM events) AS published,
 CAST(sum(n) AS BIGINT) AS delivered, CAST(sum(greatest(n - 100, 0)) AS BIGINT) AS dropped FROM (SELECT count(*) AS n FROM {ALL_SQL} GROUP BY subscriber_id)""")
def ps_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pubsub.statistics(messages(spark, sf_dir), subs(spark, sf_dir), deliveries(spark, sf_dir), 100)


@query("SELECT user_id AS session_id, max(ts) AS last_active FROM events GROUP BY 1 HAVING date_sub('second', max(ts), (SELECT max(ts) FROM events)) > 3600")
def sess_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    sessions = events.groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last_active"))
    return changelog.idle_sessions(sessions, events.agg(F.max("ts")).scalar(), 3600)


# Monitoring: an event is an operation of a type, on a collection, taking value milliseconds


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.expr("case event_type when 'view' then 'read' when 'click' then 'query' when 'purchase' then 'insert' when 'signup' then 'update' else 'delete' end")
    df = table(spark, sf_dir, "events")
    return df.select(F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type").isin("view", "click"), F.col("value") > 30).alias("hit"), F.concat(F.lit("c"), F.col("user_id") % 5).alias("collection"), F.col("user_id").alias("doc_id"), F.length("props").cast("long").alias("size_bytes"), "value", "ts")


OPS = """(SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'query' WHEN 'purchase' THEN 'insert' WHEN 'signup' THEN 'update' ELSE 'delete' END AS op,
 event_type <> 'error' AS ok, CASE WHEN event_type IN ('view', 'click') THEN value > 30 END AS hit, 'c' || (user_id % 5) AS collection, user_id AS doc_id, length(props) AS size_bytes, value, ts FROM events)"""


@query("""
WITH s AS (SELECT value AS micros FROM events ORDER BY event_id DESC LIMIT 10000), r AS (SELECT micros, row_number() OVER (ORDER BY micros) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT max(micros) FILTER (WHERE i = least(floor(n * 0.5), n - 1)) AS p50, max(micros) FILTER (WHERE i = least(floor(n * 0.9), n - 1)) AS p90, max(micros) FILTER (WHERE i = least(floor(n * 0.95), n - 1)) AS p95,
 max(micros) FILTER (WHERE i = least(floor(n * 0.99), n - 1)) AS p99, max(micros) FILTER (WHERE i = least(floor(n * 0.999), n - 1)) AS p999, max(micros) AS max, count(*) AS samples FROM r""")
def n_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.latency_percentiles(operations(spark, sf_dir).select("seq", F.col("value").alias("micros")))


@query(f"SELECT op, count(*) AS n FROM {OPS} GROUP BY 1")
def n_op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.operation_counts(operations(spark, sf_dir))


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE NOT ok) AS errors, count(*) FILTER (WHERE hit) AS hits, count(hit) AS lookups, round(count(*) / 3600.0, 6) AS per_second,
 round(100.0 * count(*) FILTER (WHERE NOT ok) / count(*), 6) AS error_rate, round(100.0 * count(*) FILTER (WHERE hit) / count(hit), 6) AS hit_rate FROM {OPS}""")
def n_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.rates(operations(spark, sf_dir), 3600)
    return out.withColumns({c: F.round(c, 6) for c in ("per_second", "error_rate", "hit_rate")})


@query(f"""SELECT collection, count(*) FILTER (WHERE op IN ('read', 'query')) AS reads, count(*) FILTER (WHERE op IN ('insert', 'update', 'delete')) AS writes, count(DISTINCT doc_id) AS documents,
 CAST(sum(size_bytes) AS BIGINT) AS bytes FROM {OPS} GROUP BY 1""")
def n_coll_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.collection_metrics(operations(spark, sf_dir))


@query("SELECT event_id AS seq, value AS millis FROM events WHERE value >= 100 ORDER BY event_id DESC LIMIT 1000")
def n_slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.slow_queries(operations(spark, sf_dir).select("seq", F.col("value").alias("millis")))


@query("SELECT count(*) AS n, CAST(coalesce(floor(sum(floor(value)) / count(*)), 0) AS BIGINT) AS avg_millis, CAST(coalesce(max(floor(value)), 0) AS BIGINT) AS max_millis FROM events WHERE value >= 100")
def n_slow_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.slow_statistics(operations(spark, sf_dir).select(F.col("value").alias("millis")))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("case event_type when 'signup' then 'auth' when 'error' then 'authz' when 'purchase' then 'admin' when 'view' then 'config' else 'other' end")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", kind.alias("kind"), (F.col("value") > 25).alias("success"), F.concat(F.lit("user"), F.col("user_id") % 10).alias("user"), F.col("event_type").alias("operation"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'signup' AND value > 25) AS auth_ok, count(*) FILTER (WHERE event_type = 'signup' AND value <= 25) AS auth_failed,
 count(*) FILTER (WHERE event_type = 'error' AND value <= 25) AS authz_failed, count(*) FILTER (WHERE event_type = 'purchase') AS admin, count(*) FILTER (WHERE event_type = 'view') AS config_changes FROM events""")
def n_audit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.audit_statistics(audit(spark, sf_dir))


@query("SELECT event_id AS seq, event_type AS operation FROM events WHERE user_id % 10 = 3 ORDER BY ts DESC, event_id DESC LIMIT 50")
def n_audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.audit_recent(audit(spark, sf_dir), 50, user="user3").select("seq", "operation")


@query("""
WITH f AS (SELECT s_suppkey, s_acctbal / 1000 AS memory_gb, CAST(s_nationkey AS DOUBLE) AS error_rate, s_acctbal / 50 AS p99_ms, s_acctbal AS lag_ms, s_acctbal / 100 + 10 AS hit_rate FROM supplier),
c AS (SELECT s_suppkey, CASE WHEN memory_gb > 8 THEN 'unhealthy' WHEN memory_gb > 4 THEN 'degraded' ELSE 'healthy' END AS m, CASE WHEN error_rate > 10 THEN 'unhealthy' WHEN error_rate > 5 THEN 'degraded' ELSE 'healthy' END AS e,
 CASE WHEN p99_ms > 100 THEN 'unhealthy' WHEN p99_ms > 50 THEN 'degraded' ELSE 'healthy' END AS p, CASE WHEN lag_ms > 5000 THEN 'unhealthy' WHEN lag_ms > 1000 THEN 'degraded' ELSE 'healthy' END AS l,
 CASE WHEN hit_rate < 50 THEN 'degraded' ELSE 'healthy' END AS h FROM f)
SELECT s_suppkey, m AS memory_gb_check, coalesce(nullif(h, 'healthy'), nullif(l, 'healthy'), nullif(p, 'healthy'), nullif(e, 'healthy'), nullif(m, 'healthy'), 'healthy') AS overall FROM c""")
def n_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    figures = s.select("s_suppkey", (F.col("s_acctbal") / 1000).alias("memory_gb"), F.col("s_nationkey").cast("double").alias("error_rate"), (F.col("s_acctbal") / 50).alias("p99_ms"), F.col("s_acctbal").alias("lag_ms"), (F.col("s_acctbal") / 100 + 10).alias("hit_rate"))
    return monitor.health(figures).select("s_suppkey", "memory_gb_check", "overall")


@query("SELECT c_mktsegment AS role, count(*) AS n FROM customer GROUP BY 1")
def n_users_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.users_by_role(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "role"))


@query("SELECT count(*) AS replicas, count(*) FILTER (WHERE s_acctbal > 0) AS healthy, count(*) = count(*) FILTER (WHERE s_acctbal > 0) AS cluster_healthy FROM supplier")
def n_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.cluster_health(table(spark, sf_dir, "supplier").select((F.col("s_acctbal") > 0).alias("healthy")))


@query(f"SELECT collection, count(*) AS documents, CAST(sum(size_bytes) AS BIGINT) AS bytes, min(ts) AS created_at, max(ts) AS updated_at FROM {OPS} GROUP BY 1")
def n_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.storage_statistics(operations(spark, sf_dir).withColumn("created_at", F.col("ts")).withColumn("updated_at", F.col("ts")))


# Access


#: Roles and operations of the requests, and who may do what without a list, written out: r is the role, o the operation.
ASKED_ROLES = ("read_only", "read_write", "admin")
ASKED = ("read", "write", "drop_collection", "list_indexes", "view_metrics", "publish", "create_index", "change_password", "no_such_operation")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("u"), F.col("c_custkey") % 11).alias("user"), one(ASKED_ROLES, F.col("c_custkey")).alias("role"), one(ASKED, F.floor(F.col("c_custkey") / 3)).alias("operation"), F.concat(F.lit("collection:c"), F.col("c_nationkey") % 5).alias("resource"))


REQ = f"""(SELECT c_custkey AS request_id, 'u' || (c_custkey % 11) AS usr, {list(ASKED_ROLES)}[CAST(c_custkey % 3 + 1 AS INT)] AS r, {list(ASKED)}[CAST((c_custkey // 3) % {len(ASKED)} + 1 AS INT)] AS o,
 'collection:c' || (c_nationkey % 5) AS res FROM customer)"""
ROLE_SQL = "(o IN ('read', 'list_indexes', 'change_password') OR (o IN ('write', 'publish') AND r IN ('read_write', 'admin')) OR (o IN ('drop_collection', 'view_metrics', 'create_index') AND r = 'admin'))"
ACL = "principal string, resource string, operation string, deny boolean"


@query(f"SELECT request_id, {ROLE_SQL} AS allowed FROM {REQ}")
def e_rbac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.decide(requests(spark, sf_dir), security.role_permissions(spark), spark.createDataFrame([], ACL)).select("request_id", "allowed")


#: Principals are users and roles; c2 has a permission and a denial that meet, c3 an entry for another operation, c4 one without any.
RULES = [
    ("u1", "collection:c1", "write", True), ("u1", "collection:c1", "read", False),
    ("u5", "collection:c2", "read", False), ("read_write", "collection:c2", "read", True), ("admin", "collection:c2", "drop_collection", False),
    ("u7", "collection:c3", "list_indexes", False), ("read_only", "collection:c3", "publish", False),
    ("u9", "collection:c4", None, True), ("admin", "collection:c4", "create_index", False), ("admin", "collection:c4", "read", False),
    ("u2", "index:c1:i", "read", True),
]
RULES_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in rule) + ")" for rule in RULES) + ") a(p, res, o, deny)"


@query(f"""SELECT q.request_id, {ROLE_SQL.replace("o IN", "q.o IN")} AND NOT coalesce(bool_or(a.o = q.o AND a.deny), false) AND (count(a.p) = 0 OR coalesce(bool_or(a.o = q.o AND NOT a.deny), false)) AS allowed
FROM {REQ} q LEFT JOIN {RULES_SQL} ON a.res = q.res AND a.p IN (q.usr, q.r) GROUP BY q.request_id, q.o, q.r""")
def e_acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.decide(requests(spark, sf_dir), security.role_permissions(spark), spark.createDataFrame(RULES, ACL)).select("request_id", "allowed")


@query("SELECT n_nationkey, n_name, n_name AS back, true AS hidden, true AS rotated, CAST(NULL AS VARCHAR) AS wrong FROM nation")
def e_aes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, other = F.sha2(F.lit("one"), 256).substr(1, 32), F.sha2(F.lit("two"), 256).substr(1, 32)
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_name").alias("secret"))
    df = security.rotate(security.encrypt_fields(df, ["secret"], key), ["secret"], key, other)
    return df.select("n_nationkey", "n_name", security.decrypt(F.col("secret"), other).alias("back"), (F.col("secret") != F.col("n_name").cast("binary")).alias("hidden"), "rotated", security.decrypt(F.col("secret"), key).alias("wrong"))


@query("""SELECT key_id, age_days, age_days > 90 AND active AS needs_rotation, active AND age_days >= 72 AND age_days < 90 AS warning, 90 - age_days AS days_remaining FROM
 (SELECT o_orderkey AS key_id, o_orderstatus <> 'P' AS active, date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-06-01') AS age_days FROM orders)""")
def e_key_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key_id"), (F.col("o_orderstatus") != "P").alias("active"), F.col("o_orderdate").alias("last_rotated"), F.lit(90).alias("rotation_days"))
    out = security.key_ages(keys, F.to_date(F.lit("1996-06-01")))
    return out.select("key_id", F.col("age_days").cast("long").alias("age_days"), "needs_rotation", "warning", F.col("days_remaining").cast("long").alias("days_remaining"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS completed, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, count(*) FILTER (WHERE o_orderstatus = 'P') AS running,
 CAST(sum(o_custkey) AS BIGINT) AS records FROM orders""")
def e_rotation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("case o_orderstatus when 'O' then 'completed' when 'F' then 'failed' else 'idle' end")
    return security.rotation_statistics(table(spark, sf_dir, "orders").select(status.alias("status"), F.col("o_custkey").alias("records")))
