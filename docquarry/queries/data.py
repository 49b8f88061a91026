"""Schemas, indexes, changes, changelogs, structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import values
from docquarry.operators import dml, index, kv, structures
from docquarry.operators.schema import FieldDef, bounded, duplicates, violation, with_defaults
from docquarry.plans import planner
from docquarry.plans.parse import parse_query
from docquarry.queries.base import query, table
from docquarry.sources import exchange
from docquarry.streaming import changelog

EVENTS_SQL = "(SELECT *, nullif(event_type, 'error') AS kind FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id").withColumn("kind", F.expr("nullif(event_type, 'error')"))


# Schemas


@query(f"SELECT event_id, 'required:kind' AS violation FROM {EVENTS_SQL} WHERE kind IS NULL")
def v_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    return df.select("event_id", violation(df, {"kind": FieldDef("string", required=True)}).alias("violation")).where("violation is not null")


@query("SELECT p_partkey, 'type:p_name' AS violation FROM part")
def v_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", violation(df, {"p_name": FieldDef("int64"), "p_size": FieldDef("float64")}).alias("violation"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'min:s_acctbal' WHEN s_acctbal > 5000 THEN 'max:s_acctbal' END AS violation FROM supplier")
def v_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier")
    return df.select("s_suppkey", violation(df, {"s_acctbal": FieldDef("float64", validators=(("min", 0), ("max", 5000)))}).alias("violation"))


@query("SELECT item_id, CASE WHEN octet_length(encode(text)) < 120 THEN 'min_length:text' WHEN octet_length(encode(text)) > 250 THEN 'max_length:text' END AS violation FROM benchmark")
def v_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "benchmark")
    return df.select("item_id", violation(df, {"text": FieldDef("string", validators=(("min_length", 120), ("max_length", 250)))}).alias("violation"))


@query("SELECT c_custkey FROM customer WHERE NOT regexp_matches(c_name, '[0-4]$')")
def v_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return df.where(violation(df, {"c_name": FieldDef("string", validators=(("regex", "[0-4]$"),))}) == "regex:c_name").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')")
def v_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return df.where(violation(df, {"c_mktsegment": FieldDef("string", validators=(("enum", ["BUILDING", "AUTOMOBILE"]),))}).isNotNull()).select("c_custkey")


@query(f"SELECT event_id, coalesce(kind, 'unknown') AS kind, 1 AS version FROM {EVENTS_SQL}")
def v_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_defaults(events(spark, sf_dir), {"kind": FieldDef("string", default="unknown"), "version": FieldDef("int32", default=1)}).select("event_id", "kind", "version")


@query(f"""SELECT event_id, CASE WHEN kind IS NULL THEN 'required:kind' WHEN kind NOT IN ('click', 'view') THEN 'enum:kind' WHEN user_id > 100 THEN 'max:user_id'
 WHEN value < 10 THEN 'min:value' END AS violation FROM {EVENTS_SQL}""")
def v_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    rules = {"value": FieldDef("float64", validators=(("min", 10),)), "user_id": FieldDef("int64", validators=(("max", 100),)), "kind": FieldDef("string", required=True, validators=(("enum", ["click", "view"]),))}
    return df.select("event_id", violation(df, rules).alias("violation"))


@query("SELECT url, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1")
def v_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "pages"), "url")


@query("""SELECT n_nationkey, CAST(4 + 11 + octet_length(encode(n_name)) + 6 + 4 + 11 AS BIGINT) AS bytes, true AS fits FROM nation""")
def v_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation")
    return df.select("n_nationkey", values.document_size(df).alias("bytes"), bounded(df).alias("fits"))


# Indexes


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 370")
def i_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lookup(table(spark, sf_dir, "orders"), {"o_custkey": 370}).select("o_orderkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 25 AND p_size < 35")
def i_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.between(table(spark, sf_dir, "part"), "p_size", 25, 35, end_inclusive=False).select("p_partkey", "p_size")


@query("SELECT p_brand AS k0, p_size AS k1, CAST(p_partkey AS VARCHAR) AS _id FROM part WHERE p_brand = 'Brand#12' AND p_size = 10")
def i_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index.lookup(table(spark, sf_dir, "part", "p_partkey"), {"p_brand": "Brand#12", "p_size": 10})
    return index.keyed(df, ["p_brand", "p_size"])


@query(f"SELECT kind AS k0, CAST(event_id AS VARCHAR) AS _id FROM {EVENTS_SQL} WHERE kind IS NOT NULL")
def i_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.keyed(events(spark, sf_dir), ["kind"], sparse=True)


@query("SELECT o_custkey AS k0, CAST(o_orderdate AS VARCHAR) AS k1, count(*) AS n, min(CAST(o_orderkey AS VARCHAR)) AS first_id FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1")
def i_unique_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.conflicts(table(spark, sf_dir, "orders", "o_orderkey"), ["o_custkey", "o_orderdate"]).withColumn("k1", F.date_format("k1", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT count(*) AS lookups, count(*) FILTER (WHERE user_id % 4 > 0) AS hits, count(*) FILTER (WHERE user_id % 4 = 0) AS misses, CAST(min(user_id) AS BIGINT) AS min_micros,
 CAST(max(user_id) AS BIGINT) AS max_micros, round(avg(user_id), 6) AS avg_micros, round(count(*) FILTER (WHERE user_id % 4 > 0) / count(*), 6) AS hit_rate FROM events""")
def i_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("results"), F.col("user_id").alias("micros"))
    return index.statistics(log).withColumn("avg_micros", F.round("avg_micros", 6)).withColumn("hit_rate", F.round("hit_rate", 6))


#: Requests to choose an index for, and the same as SQL rows: conditions (request, path, kind), requests (request, sort, projected)
#: and indexes (name, first field, second field, unique, text), in the order in which equals are told apart.
DEFS = [planner.IndexDef("email", ("email",), unique=True), planner.IndexDef("name_age", ("name", "age")), planner.IndexDef("by_name", ("nick",), text=True)]
REQUESTS = [
    {"filter": {"nick": {"$regex": "a"}, "age": {"$exists": True}, "email": {"$exists": False}}, "limit": 5},
    {"filter": {"email": "x"}},
    {"filter": {"name": "a", "age": {"$gt": 3}}, "projection": {"age": 1}, "sort": {"age": 1}},
    {"filter": {"other": {"$regex": "x"}}},
    {"filter": {"name": "a"}, "sort": {"name": 1}},
]


@query("""
WITH c(request, path, kind) AS (VALUES (0, 'nick', 'regex'), (0, 'age', 'exists'), (0, 'email', 'exists'), (1, 'email', 'eq'), (2, 'name', 'eq'), (2, 'age', 'gt'), (3, 'other', 'regex'), (4, 'name', 'eq')),
r(request, sort, projected) AS (VALUES (0, NULL, false), (1, NULL, false), (2, 'age', true), (3, NULL, false), (4, 'name', false)),
i(place, name, first, second, uniq, text) AS (VALUES (0, 'email', 'email', NULL, true, false), (1, 'name_age', 'name', 'age', false, false), (2, 'by_name', 'nick', NULL, false, true)),
s AS (SELECT r.request, i.place, i.name, r.sort IS NOT NULL AND r.sort = i.first AS sorted,
  CASE WHEN i.uniq AND bool_or(c.kind = 'eq' AND c.path IN (i.first, i.second)) THEN 10 ELSE 0 END + CASE WHEN r.sort = i.first THEN 5 ELSE 0 END
  + CASE WHEN i.second IS NOT NULL THEN 2 * count(*) FILTER (WHERE c.path IN (i.first, i.second)) ELSE 0 END + CASE WHEN i.text AND bool_or(c.kind = 'regex' AND c.path = i.first) THEN 5 ELSE 0 END AS score
  FROM r JOIN c ON r.request = c.request CROSS JOIN i GROUP BY r.request, r.sort, i.place, i.name, i.first, i.second, i.uniq, i.text HAVING bool_or(c.path = i.first)),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY request ORDER BY score DESC, place) = 1),
work AS (SELECT request, sum(CASE kind WHEN 'regex' THEN 10 WHEN 'exists' THEN 1 WHEN 'eq' THEN 1 WHEN 'gt' THEN 2 END) AS work FROM c GROUP BY 1)
SELECT CAST(r.request AS INT) AS request, b.name AS index_name, CAST(coalesce(b.score, 0) AS INT) AS score,
  CAST(CASE WHEN b.name IS NULL THEN 1000 ELSE 100 END + 10 * w.work + CASE WHEN r.sort IS NULL THEN 0 WHEN coalesce(b.sorted, false) THEN 50 ELSE 500 END + CASE WHEN r.projected THEN 10 ELSE 0 END AS DOUBLE) AS cost
FROM r JOIN work w ON r.request = w.request LEFT JOIN best b ON b.request = r.request""")
def i_selector_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for place, request in enumerate(REQUESTS):
        q = parse_query(request)
        chosen, plan = planner.choose_index(DEFS, q), planner.plan(q, DEFS)
        rows.append((place, chosen.name if chosen else None, planner.score(chosen, q) if chosen else 0, plan.cost))
    return spark.createDataFrame(rows, "request int, index_name string, score int, cost double")


# Changes


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 100 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey < 100 UNION ALL SELECT 900000001, 'added'")
def d_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer", "c_custkey").select("_id", "c_custkey", "c_name")
    added = spark.createDataFrame([(900000001, "added")], "c_custkey long, c_name string").withColumn("_id", F.col("c_custkey").cast("string"))
    new = df.where("c_custkey < 100").withColumn("c_name", F.lit("new")).unionByName(added)
    return dml.insert(df, new).select("c_custkey", "c_name")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def d_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_id"), "c_name", "c_acctbal")
    return dml.replace(df, {"c_acctbal": {"$lt": 0}}, {"c_acctbal": 0.0}).withColumnRenamed("_id", "c_custkey")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_size + 100 ELSE p_size END AS p_size, CASE WHEN p_size < 10 THEN 'small' ELSE p_brand END AS p_brand, CASE WHEN p_size >= 10 THEN p_type END AS p_type FROM part")
def d_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    return dml.modify(df, {"p_size": {"$lt": 10}}, {"$inc": {"p_size": 100}, "$set": {"p_brand": "small"}, "$unset": {"p_type": 1}})


@query(f"SELECT event_id FROM {EVENTS_SQL} WHERE NOT coalesce(kind = 'click', false)")
def d_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.delete(events(spark, sf_dir), {"kind": "click"}).select("event_id")


@query("SELECT count(*) FILTER (WHERE event_type = 'click') AS affected FROM events")
def d_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.affected(events(spark, sf_dir), {"event_type": "click"})


# Changelogs: events are entries on documents of two collections


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    df = table(spark, sf_dir, "events")
    return df.select((F.col("event_id") + 1).alias("sequence"), F.col("ts").alias("timestamp"), op.alias("op"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("collection"), F.col("user_id").cast("string").alias("doc_id"), F.when(F.col("event_type") != "view", F.col("value")).alias("value"), F.col("event_type").alias("kind"))


REPLAY_SQL = """
WITH l AS (SELECT event_id + 1 AS sequence, ts, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
  CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS collection, CAST(user_id AS VARCHAR) AS doc_id, CASE WHEN event_type <> 'view' THEN value END AS value, event_type AS kind
  FROM events WHERE {where}),
r AS (SELECT collection, doc_id, max(sequence) AS start, arg_max(op, sequence) AS op FROM l WHERE op IN ('insert', 'delete') GROUP BY 1, 2)
SELECT l.collection, l.doc_id, arg_max(value, sequence) FILTER (WHERE value IS NOT NULL) AS value, arg_max(kind, sequence) AS kind
FROM l JOIN r ON l.collection = r.collection AND l.doc_id = r.doc_id WHERE r.op = 'insert' AND l.sequence >= r.start GROUP BY 1, 2"""


@query(REPLAY_SQL.format(where="event_id + 1 >= 100"))
def w_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.replay(None, log(spark, sf_dir), ["value", "kind"], since=100)


@query(REPLAY_SQL.format(where="ts <= TIMESTAMP '2024-01-10 00:00:00'"))
def w_pitr(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = log(spark, sf_dir)
    return changelog.recover(None, entries, ["value", "kind"], middle())


@query("SELECT count(*) FILTER (WHERE event_id + 1 >= 500) AS replayed, count(*) FILTER (WHERE event_id + 1 < 500) AS skipped, CAST(max(event_id) + 1 AS BIGINT) AS last_sequence FROM events")
def w_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.replay_statistics(log(spark, sf_dir), since=500)


@query("""SELECT sequence, problem FROM (SELECT event_id + 1 AS sequence, CASE WHEN ts < lag(ts) OVER (ORDER BY event_id) THEN 'timestamp' END AS problem FROM events) WHERE problem IS NOT NULL""")
def w_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.irregular(log(spark, sf_dir)).select("sequence", "problem")


@query("SELECT event_id + 1 AS sequence FROM events WHERE event_id % 97 = 5 AND event_type <> 'view' OR event_id % 101 = 7")
def w_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries sealed, then damaged: every 97th has another payload (no change where it had none), every 101st another checksum."""
    entries = exchange.sealed(log(spark, sf_dir).withColumn("changes", F.to_json(F.struct("value"))).drop("value", "kind"))
    at = lambda n, k: (F.col("sequence") - 1) % n == k
    changed = F.when(at(97, 5), F.regexp_replace("changes", '"value":', '"valve":')).otherwise(F.col("changes"))
    entries = entries.withColumn("changes", changed).withColumn("checksum", F.when(at(101, 7), F.col("checksum").bitwiseXOR(F.lit(1))).otherwise(F.col("checksum")))
    return exchange.damaged(entries).select("sequence")


@query("SELECT CAST(greatest(0, date_sub('millisecond', max(ts), TIMESTAMP '2030-01-01')) AS BIGINT) AS lag_ms FROM events")
def w_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.lag_ms(log(spark, sf_dir), F.to_timestamp_ntz(F.lit("2030-01-01 00:00:00")))


@query("SELECT CAST(greatest(max(event_id) + 1 - 100, 0) AS BIGINT) AS lag, max(event_id) + 1 - 100 > 10000 OR min(event_id) + 1 > 101 AS full_sync FROM events")
def w_full_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.needs_full_sync(log(spark, sf_dir), 100)


@query("SELECT event_id + 1 AS sequence FROM events WHERE event_id + 1 > 200 ORDER BY 1 LIMIT 1000")
def w_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.missing_entries(log(spark, sf_dir), 200, 1000).select("sequence")


@query("SELECT 'seg-' || (event_id // 100) AS file FROM events GROUP BY event_id // 100 HAVING max(event_id + 1) < 550")
def w_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select(F.concat(F.lit("seg-"), F.expr("event_id div 100")).alias("file"), (F.col("event_id") + 1).alias("sequence"))
    return exchange.compactable(entries, 550)


@query("""SELECT user_id, event_id AS seq, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events
 WHERE ts <= TIMESTAMP '2024-01-10 00:00:00') WHERE r = 1""")
def wb_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "ts", "event_type")
    return changelog.last_writes(queue, ["user_id"], middle()).select("user_id", "seq", "event_type")


@query("SELECT s_suppkey AS backup_id, rank, rank <= 5 AS kept FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey DESC) AS rank FROM supplier)")
def b_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    backups = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("backup_id"), F.col("s_acctbal").alias("created_at"))
    return exchange.retained(backups).select("backup_id", F.col("rank").cast("long").alias("rank"), "kept")


# Structures: conversations are lists, events sets, sorted sets and hashes


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.col("text").alias("value"))


LIST_SQL = "(SELECT conv_id AS key, turn, text AS value, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


@query(f"SELECT key, i AS index, value FROM {LIST_SQL} WHERE i >= 1 AND i <= n - 2")
def l_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.list_range(turns(spark, sf_dir), 1, -2).withColumn("index", F.col("index").cast("long"))


@query(f"SELECT key, value FROM {LIST_SQL} WHERE i = n - 1")
def l_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.at_index(turns(spark, sf_dir), -1)


@query("SELECT conv_id AS key, count(*) AS n FROM conversations GROUP BY 1")
def l_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.lengths(turns(spark, sf_dir))


@query(f"SELECT key, value FROM {LIST_SQL} WHERE i = 0")
def l_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.popped(turns(spark, sf_dir))


@query(f"SELECT key, CAST(i AS BIGINT) AS pos FROM {LIST_SQL} UNION ALL SELECT DISTINCT conv_id, -1 FROM conversations UNION ALL SELECT DISTINCT conv_id, -2 FROM conversations")
def l_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = turns(spark, sf_dir)
    keys = items.select("key").distinct()
    new = keys.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("value", F.lit("x"))
    return structures.push(items, new, left=True).select("key", "pos")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member"))


@query("SELECT user_id AS member FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'purchase'")
def s_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.combined(members(spark, sf_dir), ["click", "purchase"], "union")


@query("SELECT user_id AS member FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def s_inter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.combined(members(spark, sf_dir), ["click", "purchase"], "inter")


@query("SELECT user_id AS member FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50")
def s_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "events").where("event_type <> 'purchase' or value > 50").select(F.col("event_type").alias("key"), F.col("user_id").alias("member"))
    return structures.combined(big, ["click", "purchase"], "diff")


@query("SELECT event_type AS key, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def s_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.cardinality(members(spark, sf_dir))


@query("SELECT r.r_name AS key, u.user_id AS member, EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'click' AND e.user_id = u.user_id) AND r.r_name = 'click' AS is_member FROM (SELECT 'click' AS r_name UNION ALL SELECT 'none') r CROSS JOIN (SELECT DISTINCT user_id FROM events) u")
def s_is_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = members(spark, sf_dir).select("member").distinct().withColumn("key", F.explode(F.array(F.lit("click"), F.lit("none"))))
    return structures.is_member(members(spark, sf_dir), asked.select("key", "member"))


ZSET_SQL = "(SELECT event_type AS key, CAST(user_id AS VARCHAR) AS member, arg_max(value, event_id) AS score FROM events GROUP BY 1, 2)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    log_ = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    return structures.set_scores(log_.where("false").drop("seq"), log_)


@query(f"SELECT * FROM {ZSET_SQL}")
def z_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir)


@query(f"SELECT key, rank, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM {ZSET_SQL}) WHERE rank <= 9")
def z_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.by_rank(scores(spark, sf_dir), 0, 9).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT key, member, score FROM {ZSET_SQL} WHERE score BETWEEN 90 AND 100")
def z_rangebyscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.by_score(scores(spark, sf_dir), 90, 100)


@query("SELECT key, field, value FROM (SELECT user_id AS key, event_type AS field, arg_max(value, event_id) AS value, arg_max(value < 20, event_id) AS gone FROM events GROUP BY 1, 2) WHERE NOT gone")
def h_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    log_ = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), "value", F.col("event_id").alias("seq"), (F.col("value") < 20).alias("deleted"))
    return structures.set_fields(log_.where("false").select("key", "field", "value"), log_)


@query("""SELECT key, string_agg(field, ',' ORDER BY field) AS names, count(*) AS n, round(max(value) FILTER (WHERE field = 'click'), 6) AS click FROM
 (SELECT user_id AS key, event_type AS field, max(value) AS value FROM events GROUP BY 1, 2) GROUP BY key""")
def h_getall(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("field")).agg(F.max("value").alias("value"))
    out = structures.as_map(fields)
    return out.select("key", F.array_join(F.map_keys("fields"), ",").alias("names"), F.size("fields").cast("long").alias("n"), F.round(F.try_element_at("fields", F.lit("click")), 6).alias("click"))


@query("SELECT conv_id AS key, CAST(sum(octet_length(encode(text)) + 8) + 16 AS BIGINT) AS bytes FROM conversations GROUP BY 1")
def struct_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.structure_bytes(turns(spark, sf_dir), ["value"], extra=structures.ITEM)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select(F.col("event_id").alias("key"), (F.col("user_id") * 10 + 1).alias("size_bytes"), F.col("ts").alias("last_accessed"), F.col("user_id").alias("access_count"), F.when(F.col("event_type") != "view", F.col("ts") + F.expr("interval 1 hour")).alias("expires_at"))


ENTRIES_SQL = "(SELECT event_id AS key, user_id * 10 + 1 AS size_bytes, ts AS last_accessed, user_id AS access_count, CASE WHEN event_type <> 'view' THEN ts + INTERVAL 1 HOUR END AS expires_at FROM events)"
NOW_SQL = "TIMESTAMP '2024-01-10 00:00:00'"


def middle() -> F.Column:
    """A time that stands for now, within the events."""
    return F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00"))


@query(f"SELECT key FROM {ENTRIES_SQL} WHERE expires_at <= {NOW_SQL}")
def ttl_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.expired(entries(spark, sf_dir), middle()).select("key")


@query(f"SELECT key FROM {ENTRIES_SQL} WHERE expires_at IS NULL OR expires_at > {NOW_SQL}")
def ttl_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.live(entries(spark, sf_dir), middle()).select("key")


@query(f"SELECT key, CAST(CASE WHEN expires_at IS NULL THEN -1 ELSE greatest(0, date_sub('second', TIMESTAMP '2020-01-01', expires_at)) END AS BIGINT) AS ttl FROM {ENTRIES_SQL}")
def ttl_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("key", structures.remaining_seconds(F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00"))).alias("ttl"))


EVICT_SQL = "SELECT key FROM (SELECT key, coalesce(sum(size_bytes) OVER (ORDER BY {order}, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM " + ENTRIES_SQL + ") WHERE before < 50000"


@query(EVICT_SQL.format(order="last_accessed"))
def evict_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.victims(entries(spark, sf_dir), "lru", 50_000).select("key")


@query(EVICT_SQL.format(order="access_count"))
def evict_lfu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.victims(entries(spark, sf_dir), "lfu", 50_000).select("key")


@query(EVICT_SQL.format(order="expires_at NULLS LAST"))
def evict_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.victims(entries(spark, sf_dir), "ttl", 50_000).select("key")


@query("SELECT count(*) FILTER (WHERE value > 30) AS hits, count(*) FILTER (WHERE value <= 30) AS misses, round(count(*) FILTER (WHERE value > 30) / count(*), 6) AS hit_rate FROM events")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    accesses = table(spark, sf_dir, "events").select((F.col("value") > 30).alias("hit"))
    return structures.cache_statistics(accesses).withColumn("hit_rate", F.round("hit_rate", 6))


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "del").when(F.col("event_type") == "purchase", "cas").otherwise("set")
    df = table(spark, sf_dir, "events")
    return df.select(F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("k"), F.col("user_id")).alias("key"), F.col("event_type").alias("value"), F.when(op == "cas", F.col("event_id") % 3).alias("expected_version"))


@query("""SELECT key, value FROM (SELECT 'k' || user_id AS key, arg_max(event_type, event_id) AS value FROM events WHERE event_type <> 'purchase' GROUP BY 1) WHERE value <> 'error'""")
def kv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.latest(kv_log(spark, sf_dir))


@query("""WITH l AS (SELECT 'k' || user_id AS key, arg_max(event_type, event_id) AS value FROM events WHERE event_type <> 'purchase' GROUP BY 1)
SELECT count(*) AS ops, count(*) FILTER (WHERE event_type NOT IN ('error', 'purchase')) AS sets, count(*) FILTER (WHERE event_type = 'error') AS deletes,
 (SELECT count(*) FROM l WHERE value <> 'error') AS keys, CAST((SELECT coalesce(sum(length(key) + length(value)), 0) FROM l WHERE value <> 'error') AS BIGINT) AS memory FROM events""")
def kv_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.statistics(kv_log(spark, sf_dir))


#: A key's operations one after another: a recursion over their places.
@query("""
WITH RECURSIVE l AS (SELECT event_id AS seq, 'k' || user_id AS key, CASE event_type WHEN 'error' THEN 'del' WHEN 'purchase' THEN 'cas' ELSE 'set' END AS op, event_type AS new, event_id % 3 AS expected,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events),
f(seq, key, op, place, status, version, value) AS (
  SELECT seq, key, op, place, CASE op WHEN 'set' THEN 'created' ELSE 'not_found' END, CASE op WHEN 'set' THEN 1 END, CASE op WHEN 'set' THEN new END FROM l WHERE place = 1
  UNION ALL
  SELECT l.seq, l.key, l.op, l.place,
    CASE WHEN l.op = 'set' THEN CASE WHEN f.version IS NULL THEN 'created' ELSE 'ok' END WHEN f.version IS NULL THEN 'not_found' WHEN l.op = 'cas' AND f.version <> l.expected THEN 'version_mismatch' ELSE 'ok' END,
    CASE WHEN l.op = 'set' THEN coalesce(f.version, 1) WHEN l.op = 'del' THEN NULL WHEN f.version = l.expected THEN f.version + 1 ELSE f.version END,
    CASE WHEN l.op = 'set' THEN l.new WHEN l.op = 'del' THEN NULL WHEN f.version = l.expected THEN l.new ELSE f.value END
  FROM f JOIN l ON l.key = f.key AND l.place = f.place + 1)
SELECT seq, key, op, status, CAST(version AS BIGINT) AS version, value FROM f""")
def kv_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.replay(kv_log(spark, sf_dir))


# Functions


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 3 + 1 AS depth FROM events""")
def x_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """props.k by path, and the depth of props with 0 to 2 levels around it, brackets in a string among them."""
    df = table(spark, sf_dir, "events")
    around = F.expr("concat(repeat('{\"a\":[\"[{\",', int(event_id % 3) div 2), if(event_id % 3 = 1, '[', ''), props, if(event_id % 3 = 1, ']', ''), repeat(']}', int(event_id % 3) div 2))")
    return df.select("event_id", F.try_variant_get(values.path(df, "props.k"), "$", "bigint").alias("k"), values.depth(around).cast("long").alias("depth"))


@query("SELECT count(*) AS documents, count(DISTINCT md5(n_name || n_comment)) AS contents, true AS same_twice, false AS same_changed FROM (SELECT n_name, CAST(n_regionkey AS VARCHAR) AS n_comment FROM nation)")
def x_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of a collection: the same however its rows lie, another once a value changes."""
    df = table(spark, sf_dir, "nation")
    one, again, other = exchange.digest(df), exchange.digest(df.orderBy(F.desc("n_name")).repartition(3)), exchange.digest(df.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "X").otherwise(F.col("n_name"))))
    contents = df.select(F.md5(F.concat("n_name", F.col("n_regionkey").cast("string"))).alias("h")).distinct().agg(F.count(F.lit(1))).scalar()
    ask = lambda d: d.select("checksum").scalar()
    return one.select("documents", contents.alias("contents"), (F.col("checksum") == ask(again)).alias("same_twice"), (F.col("checksum") == ask(other)).alias("same_changed"))


#: FNV-1a by a recursion over bytes in 128-bit arithmetic; name-based ids by SHA-1 of the namespace and the name.
@query("""
WITH RECURSIVE n AS (SELECT n_name, encode(n_name) AS b FROM nation),
h(n_name, b, place, h) AS (
  SELECT n_name, b, 1, 14695981039346656037::HUGEINT FROM n
  UNION ALL
  SELECT n_name, b, place + 1, CAST((xor(h, CAST(('0x' || substr(hex(b), 2 * place - 1, 2))::INT AS HUGEINT)) * 435 + ((xor(h, CAST(('0x' || substr(hex(b), 2 * place - 1, 2))::INT AS HUGEINT)) % 16777216) * 1099511627776)) % 18446744073709551616 AS HUGEINT)
  FROM h WHERE place <= octet_length(b)),
f AS (SELECT n_name, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS fnv FROM h WHERE place = octet_length(b) + 1),
d AS (SELECT n_name, lower(sha1(unhex('6BA7B8129DAD11D180B400C04FD430C8') || encode(n_name))) AS s FROM nation)
SELECT f.n_name, fnv, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(s, 17, 1))::INT + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS id
FROM f JOIN d ON f.n_name = d.n_name""")
def x_key_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_name", values.key_id(F.col("n_name")).alias("id"), values.fnv1a(F.col("n_name")).alias("fnv"))
