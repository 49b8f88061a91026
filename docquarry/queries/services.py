"""What an engine does around its queries: collections, files, backups, cache commands, index upkeep, subscriptions, server figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import values
from docquarry.operators import find, index, kv, monitor, pipeline, security, structures
from docquarry.operators.schema import FieldDef, register_validator, violation
from docquarry.plans.ast import QueryError, fields_of
from docquarry.plans.parse import parse_filter, parse_query, validate
from docquarry.queries.base import SQL, query, table
from docquarry.queries.data import ENTRIES_SQL, NOW_SQL, ZSET_SQL, entries, events, kv_log, middle, scores
from docquarry.queries.operations import MSG, PAT, SUB, messages, operations, patterns, subs
from docquarry.sources import exchange
from docquarry.sources.catalog import Engine
from docquarry.sources.shared import fresh_path
from docquarry.streaming import changelog, pubsub

# Collections


@query("SELECT id, EXISTS (SELECT 1 FROM nation WHERE CAST(n_nationkey AS VARCHAR) = id) AS found FROM (VALUES ('0'), ('24'), ('25'), ('x'), ('')) t(id)")
def s_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation", "n_nationkey")
    return spark.createDataFrame([(i, find.exists(nation, i)) for i in ("0", "24", "25", "x", "")], "id string, found boolean")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Three collections, of which one is dropped, with two indexes, saved and loaded again."""
    first, root = Engine(spark), fresh_path(spark, "engine")
    for name, key in (("nation", "n_nationkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey")):
        first.create(f"svc_{name}", table(spark, sf_dir, name), key)
    first.collection("svc_supplier").create_index("by_nation", ["s_nationkey", "s_name"], sparse=True)
    first.collection("svc_nation").create_index("name", ["n_name"], unique=True)
    first.collection("svc_nation").create_index("name", ["n_regionkey"])
    first.drop("svc_region")
    first.save(root)
    out = Engine(spark)
    out.load(root, first.list())
    return out


@query("SELECT 'svc_nation' AS collection, count(*) AS documents, 1 AS indexes FROM nation UNION ALL SELECT 'svc_supplier', count(*), 1 FROM supplier")
def c_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).info().select("collection", "documents", "indexes")


@query("SELECT * FROM (VALUES ('svc_nation', 'name', true, 'n_name', false), ('svc_supplier', 'by_nation', false, 's_nationkey,s_name', true)) t(collection, index_name, is_unique, fields, sparse)")
def i_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).definitions().select("collection", "index_name", F.col("unique").alias("is_unique"), F.array_join("fields", ",").alias("fields"), "sparse")


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS n_name, 1 AS version FROM nation WHERE n_nationkey <> 7")
def c_write_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes queued until a flush, then read from storage: two changes, one version."""
    folder = fresh_path(spark, "behind")
    c = Engine(spark).create("svc_behind", table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", storage=folder, strategy="write_behind")
    c.update({"n_nationkey": {"$lt": 5}}, {"$set": {"n_name": "new"}})
    c.delete({"n_nationkey": 7})
    version = c.flush()
    return spark.read.parquet(f"{folder}/version={version}").select("n_nationkey", "n_name", F.lit(version).alias("version"))


# Requests


#: Request, the paths that it reads, whether it looks up one key, whether it parses.
ASKED = [
    ({"filter": {"a": 1}, "limit": 1}, "a", True),
    ({"filter": {"b": {"$gt": 1, "$lt": 5}, "a": {"$in": [1]}}}, "a,b", False),
    ({"filter": {"$or": [{"x.y": 1}, {"$not": {"c": None}}]}, "limit": 1}, "c,x.y", False),
    ({"filter": {"a": 1}, "limit": 1, "sort": {"a": 1}}, "a", False),
    ({"filter": {}}, "", False),
    ({"filter": {"a": {"$nope": 1}}}, None, None),
    ({"filter": {"$and": 5}}, None, None),
    ({"filter": {"a": 1}, "projection": {"a": 1, "b": 0}}, None, None),
    ({"filter": {"a": {"$regex": "["}}}, None, None),
    ({"filter": {"a": 1}, "skip": 1_000_000, "limit": 100_000}, "a", False),
    ({"filter": {"a": 1}, "skip": 1_000_001}, None, None),
    ({"filter": {"a": 1}, "limit": 100_001}, None, None),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, " + (f"'{p}', {str(k).lower()}, true" if p is not None else "NULL, NULL, false") + ")" for i, (_, p, k) in enumerate(ASKED)) + ") t(request, paths, key_lookup, valid)")
def f_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for i, (request, _, _) in enumerate(ASKED):
        try:
            q = validate(parse_query(request))
            rows.append((i, ",".join(fields_of(q.filter)), q.is_key_lookup(), True))
        except QueryError:
            rows.append((i, None, None, False))
    return spark.createDataFrame(rows, "request int, paths string, key_lookup boolean, valid boolean")


@query("SELECT count(*) FILTER (WHERE user_id > 50) AS whole_by_real, 0 AS text_by_number, 0 AS number_by_text, count(*) AS not_equal FROM events")
def m_cross_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """$match over types that differ: numbers compare with numbers of any kind, and with nothing else; $ne holds for what can't be equal."""
    df = events(spark, sf_dir)
    n = lambda condition: pipeline.match(df, condition).agg(F.count(F.lit(1))).scalar()
    one = spark.range(1)
    return one.select(n({"user_id": {"$gt": 50.0}}).alias("whole_by_real"), n({"event_type": {"$gt": 5}}).cast("int").alias("text_by_number"), n({"user_id": {"$lt": "zzz"}}).cast("int").alias("number_by_text"), n({"user_id": {"$ne": "x"}}).alias("not_equal"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100000)")
def o_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older engine's cap on what a pipeline returns, where it is asked for."""
    return pipeline.aggregate(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), [{"$sort": {"l_orderkey": 1, "l_linenumber": 1}}], caps=True)


#: Pipelines that are refused, and one that isn't.
STAGES = [[{"$nope": 1}], [{"$match": 5}], [{"$limit": -1}], [{"$skip": "x"}], [{"$match": {}, "$limit": 1}], [{"$group": {"_id": None, "n": {"$nope": 1}}}], [{"$match": {"kind": "click"}}, {"$limit": 3}]]


@query("SELECT i::INT AS pipeline, i = 6 AS accepted FROM range(0, 7) t(i)")
def g_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, rows = events(spark, sf_dir), []
    for i, stages in enumerate(STAGES):
        try:
            pipeline.aggregate(df, stages)
            rows.append((i, True))
        except QueryError:
            rows.append((i, False))
    return spark.createDataFrame(rows, "pipeline int, accepted boolean")


@query("SELECT event_id FROM events WHERE (event_type IN ('click', 'view') OR value > 90) AND NOT user_id < 20 AND regexp_matches(event_type, 'i') AND CAST(json_extract_string(props, '$.k') AS BIGINT) NOT IN (1, 2, 3)")
def m_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """$match with the whole filter language: patterns, logic, $nin, dotted paths."""
    condition = {"$or": [{"event_type": {"$in": ["click", "view"]}}, {"value": {"$gt": 90}}], "$not": {"user_id": {"$lt": 20}}, "event_type": {"$regex": "i"}, "props.k": {"$nin": [1, 2, 3]}}
    return pipeline.match(table(spark, sf_dir, "events"), condition).select("event_id")


# Files


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'again' ELSE n_name END AS n_name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey + 1000, n_name FROM nation WHERE n_nationkey < 2")
def x_json_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents exported as JSON and imported in place of a collection, then others over them by id."""
    df, root = table(spark, sf_dir, "nation", "n_nationkey").select("_id", "n_nationkey", "n_name").where("n_nationkey < 10"), fresh_path(spark, "json")
    more = df.where("n_nationkey < 3").withColumn("n_name", F.lit("again")).unionByName(df.where("n_nationkey < 2").withColumn("n_nationkey", F.col("n_nationkey") + 1000).withColumn("_id", F.col("n_nationkey").cast("string")))
    exchange.export_json(df, f"{root}/a")
    exchange.export_json(more, f"{root}/b", pretty=True)
    first = exchange.imported(df.limit(0), exchange.import_json(spark, f"{root}/a", df.schema), replace=True)
    return exchange.imported(first, exchange.import_json(spark, f"{root}/b", df.schema, pretty=True), replace=False).select("n_nationkey", "n_name")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name AS name, n_nationkey % 2 = 0 AS has_region FROM nation")
def x_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two shapes through JSON lines: a field that is missing is not one that is null."""
    df, root = table(spark, sf_dir, "nation", "n_nationkey"), fresh_path(spark, "dynamic")
    shaped = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.struct("_id", "n_name", "n_regionkey"))).otherwise(F.to_json(F.struct("_id", "n_name")))
    df.select(shaped.alias("value")).write.text(root)
    doc = exchange.import_dynamic(spark, root)
    return doc.select("_id", F.try_variant_get("doc", "$.n_name", "string").alias("name"), F.try_variant_get("doc", "$.n_regionkey", "variant").isNotNull().alias("has_region"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def b_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "snapshot")
    exchange.write_snapshot(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), root, "supplier", 12)
    return exchange.read_snapshot(spark, root, "supplier", 12)


@query("SELECT CAST(s AS BIGINT) AS sequence, count(*) FILTER (WHERE n_nationkey < s) AS documents, s <> 20 AS intact FROM nation, (VALUES (10), (20)) t(s) GROUP BY s")
def b_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three backups of which the two newest are kept, and rows put into one behind its manifest's back."""
    df, root = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), fresh_path(spark, "backups")
    for day, sequence in enumerate((5, 10, 20)):
        exchange.create_backup(df.where(F.col("n_nationkey") < sequence), root, "nation", sequence, f"2024010{day + 1}T000000", kept=2)
    kept = exchange.backups(spark, root).collect()
    sizes = {b.sequence: exchange.restore_backup(spark, root, b.backup_id)[0].count() for b in kept}
    df.limit(1).write.mode("append").parquet(f"{root}/{kept[0].backup_id}/seq=000000000020/collection=nation/data")
    rows = [(b.sequence, sizes[b.sequence], exchange.verify_backup(spark, root, b.backup_id)) for b in kept]
    return spark.createDataFrame(rows, "sequence long, documents long, intact boolean")


def plain_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select((F.col("event_id") + 1).alias("sequence"), F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit("update").alias("op"), F.lit("c").alias("collection"), F.col("user_id").cast("string").alias("doc_id"), F.col("event_type").alias("changes"))


BODY_SQL = """(SELECT event_id + 1 AS sequence, length('{"sequence":,"timestamp":null,"op":"update","collection":"c","doc_id":"","changes":""}') + length(CAST(event_id + 1 AS VARCHAR)) + length(CAST(user_id AS VARCHAR)) + length(event_type) AS size FROM events)"""


@query(f"SELECT CAST(segment AS BIGINT) AS segment, min(sequence) AS first, max(sequence) AS last, count(*) AS entries, count(*) FILTER (WHERE sequence % 50 = 0) AS damaged FROM (SELECT sequence, coalesce(sum(size) OVER (ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 20000 AS segment FROM {BODY_SQL}) GROUP BY 1")
def w_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changelog rotated at 20,000 bytes a file, written, read again and checked, every 50th entry damaged on the way."""
    path = fresh_path(spark, "log")
    exchange.append_changelog(plain_log(spark, sf_dir), path, 20_000)
    back = exchange.read_changelog(spark, path).withColumn("changes", F.when(F.col("sequence") % 50 == 0, F.lit("?")).otherwise(F.col("changes")))
    bad = exchange.damaged(back).select("sequence", F.lit(1).alias("bad"))
    return back.join(bad, "sequence", "left").groupBy("segment").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count(F.lit(1)).alias("entries"), F.count("bad").alias("damaged"))


@query(f"SELECT count(*) AS files, sum(n)::BIGINT AS entries FROM (SELECT segment, count(*) AS n FROM (SELECT coalesce(sum(size) OVER (ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 20000 AS segment FROM {BODY_SQL}) GROUP BY 1)")
def w_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "log")
    exchange.append_changelog(plain_log(spark, sf_dir), path, 20_000)
    return exchange.changelog_files(spark, path).agg(F.count(F.lit(1)).alias("files"), F.sum("entries").alias("entries"))


@query("SELECT min(sequence) FILTER (WHERE bad) - 1 AS ack, min(sequence) FILTER (WHERE bad) - 201 AS applied, count(*) FILTER (WHERE bad) AS rejected FROM (SELECT event_id + 1 AS sequence, (event_id + 1) % 333 = 0 AS bad FROM events) WHERE sequence > 200")
def w_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = exchange.sealed(plain_log(spark, sf_dir))
    torn = sealed.withColumn("checksum", F.when(F.col("sequence") % 333 == 0, F.lit(0).cast("long")).otherwise(F.col("checksum")))
    return changelog.acknowledged(torn, 200)


@query(f"SELECT max(event_id) + 1 AS sequence, {NOW_SQL} AS sent_at FROM events")
def w_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.heartbeat(plain_log(spark, sf_dir), middle())


@query(f"SELECT user_id AS replica_id FROM events GROUP BY 1 HAVING date_sub('second', max(ts), {NOW_SQL}) > 90")
def w_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("replica_id")).agg(F.max("ts").alias("last_seen"))
    return changelog.silent(seen, middle()).select("replica_id")


@query("SELECT event_id + 1 AS sequence, event_type AS changes, true AS intact, true AS hidden, CAST(NULL AS VARCHAR) AS other FROM events")
def e_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changelog whose entries are encrypted: its checksums hold, its changes come back under the key and under no other."""
    key, wrong = F.sha2(F.lit("one"), 256).substr(1, 32), F.sha2(F.lit("two"), 256).substr(1, 32)
    path = fresh_path(spark, "secret")
    exchange.encrypted_changelog(plain_log(spark, sf_dir), key).write.parquet(path)
    stored = spark.read.parquet(path)
    intact = F.crc32(exchange.body(stored).cast("binary")) == F.col("checksum")
    stored = stored.withColumn("intact", intact).withColumn("raw", F.col("changes"))
    out = exchange.decrypted_changelog(stored, key)
    return out.select("sequence", "changes", "intact", (F.col("raw") != F.col("changes")).alias("hidden"), security.decrypt(F.unbase64("raw"), wrong).alias("other"))


# Indexes


@query("SELECT n_regionkey AS k0, n_name AS k1, CAST(n_nationkey AS VARCHAR) AS _id FROM nation WHERE n_nationkey >= 10 UNION ALL SELECT n_regionkey + 1, n_name, CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey BETWEEN 5 AND 9")
def i_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after five documents were removed and five changed."""
    df = table(spark, sf_dir, "nation", "n_nationkey")
    built = index.keyed(df, ["n_regionkey", "n_name"])
    changed = df.where("n_nationkey between 5 and 9").withColumn("n_regionkey", F.col("n_regionkey") + 1)
    return index.maintained(index.without(built, df.where("n_nationkey < 5")), changed, ["n_regionkey", "n_name"])


@query("""WITH new AS (SELECT n_nationkey + 20 AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'N' || n_nationkey END AS name, n_nationkey // 6 AS code FROM nation),
bad AS (SELECT k FROM new WHERE name IN (SELECT n_name FROM nation WHERE n_nationkey < 20 OR n_nationkey >= 45) UNION SELECT k FROM new WHERE k NOT IN (SELECT arg_min(k, CAST(k AS VARCHAR)) FROM new GROUP BY code))
SELECT CAST(k AS BIGINT) AS k, k IN (SELECT k FROM bad) AS rejected FROM new""")
def i_unique_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts under two unique indexes: a document that one of them refuses leaves no entry in either."""
    df = table(spark, sf_dir, "nation", "n_nationkey").select("_id", F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit(None).cast("long").alias("code"))
    new = df.select((F.col("k") + 20).alias("k"), F.when(F.col("k") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("N"), "k")).alias("name"), F.expr("k div 6").alias("code")).withColumn("_id", F.col("k").cast("string"))
    after, refused = index.insert_unique(df, new, [["name"], ["code"]])
    taken = after.where("code is not null").select("k", F.lit(False).alias("rejected"))
    return taken.unionByName(refused.select("k", F.lit(True).alias("rejected")))


@query("""SELECT event_id, row_number() OVER (ORDER BY CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END, CASE WHEN event_id % 5 = 1 THEN user_id % 2 WHEN event_id % 5 = 2 THEN user_id WHEN event_id % 5 = 3 THEN value END,
 CASE WHEN event_id % 5 = 4 THEN event_type END, event_id) AS place FROM events WHERE event_id < 200""")
def i_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of five types in the order of an index: null, booleans, whole numbers, other numbers (whatever their size), text."""
    text = F.expr("""case event_id % 5 when 0 then 'null' when 1 then if(user_id % 2 = 1, 'true', 'false') when 2 then string(user_id) when 3 then concat(value, 'e0') else concat('"', event_type, '"') end""")
    df = table(spark, sf_dir, "events").where("event_id < 200").withColumn("v", F.parse_json(text))
    # Places come from the order alone: the rows are few.
    ordered = df.orderBy(*index.in_key_order(df, "v"), "event_id").select("event_id")
    return spark.createDataFrame([(r.event_id, i + 1) for i, r in enumerate(ordered.collect())], "event_id long, place long")


@query("SELECT o_orderkey, o_custkey, (SELECT count(*) + (count(*) + 999) // 1000 * 10 FROM orders)::BIGINT AS estimate_ms FROM orders WHERE o_custkey BETWEEN 100 AND 120")
def i_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index built as files sorted by its key, and a range read from them; what a background build is taken to last."""
    orders, target = table(spark, sf_dir, "orders"), fresh_path(spark, "sorted")
    index.write_sorted(orders, ["o_custkey", "o_orderkey"], target, files=4)
    found = index.between(spark.read.parquet(target), "o_custkey", 100, 120)
    return found.select("o_orderkey", "o_custkey", F.lit(index.build_estimate_ms(orders.count())).cast("long").alias("estimate_ms"))


# Cache commands: some keys are written again, read, expired and made to stay


def few(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(condition).select(F.col("event_id").alias("key"))


@query(f"SELECT key, CASE WHEN key % 10 = 0 THEN 7 ELSE size_bytes END AS size_bytes, CASE WHEN key % 10 = 0 THEN 0 ELSE access_count END AS access_count, CASE WHEN key % 10 = 0 THEN {NOW_SQL} + INTERVAL 90 SECOND ELSE expires_at END AS expires_at FROM {ENTRIES_SQL}")
def c_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = few(spark, sf_dir, "event_id % 10 = 0").withColumn("size_bytes", F.lit(7).cast("long"))
    return structures.put(entries(spark, sf_dir), new, middle(), 90).select("key", "size_bytes", "access_count", "expires_at")


@query(f"SELECT key, access_count + CASE WHEN key % 7 = 0 THEN 2 ELSE 0 END AS access_count, CASE WHEN key % 7 = 0 THEN {NOW_SQL} ELSE last_accessed END AS last_accessed FROM {ENTRIES_SQL} WHERE expires_at IS NULL OR expires_at > {NOW_SQL}")
def c_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = few(spark, sf_dir, "event_id % 7 = 0")
    return structures.read(entries(spark, sf_dir), asked.union(asked), middle())[0].select("key", "access_count", "last_accessed")


@query(f"SELECT key, coalesce(expires_at > {NOW_SQL}, true) AS exists FROM {ENTRIES_SQL} WHERE key % 3 = 0 UNION ALL SELECT -1, false")
def c_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = few(spark, sf_dir, "event_id % 3 = 0").union(spark.createDataFrame([(-1,)], "key long"))
    return structures.exists(entries(spark, sf_dir), asked, middle())


@query(f"SELECT key, expires_at FROM {ENTRIES_SQL} WHERE key % 4 <> 1")
def c_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.removed(entries(spark, sf_dir), few(spark, sf_dir, "event_id % 4 = 1")).select("key", "expires_at")


@query(f"SELECT key, CAST(CASE WHEN key % 4 = 1 THEN 30 WHEN key % 4 = 2 THEN -1 WHEN expires_at IS NULL THEN -1 ELSE greatest(0, date_sub('second', {NOW_SQL}, expires_at)) END AS BIGINT) AS ttl FROM {ENTRIES_SQL} UNION ALL SELECT -5, NULL")
def c_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds left after EXPIRE of some keys and PERSIST of others; a key that isn't there has none."""
    e = structures.expire(entries(spark, sf_dir), few(spark, sf_dir, "event_id % 4 = 1"), middle(), 30)
    e = structures.expire(e, few(spark, sf_dir, "event_id % 4 = 2"), middle(), None)
    asked = entries(spark, sf_dir).select("key").union(spark.createDataFrame([(-5,)], "key long"))
    return structures.time_left(e, asked, middle())


@query(f"SELECT key FROM (SELECT key, coalesce(sum(size_bytes) OVER (ORDER BY last_accessed, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size_bytes) OVER () AS used FROM {ENTRIES_SQL}) WHERE before < (used + 5000 - 0.9 * used) * 1.2")
def evict_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes so that an entry of 5,000 bytes fits a cache of nine tenths of what is in use."""
    e = entries(spark, sf_dir)
    used = e.agg(F.sum("size_bytes")).first()[0]
    return structures.victims(e, "lru", structures.needed_bytes(used, 5000, 0.9 * used)).select("key")


@query(f"SELECT key FROM (SELECT key, coalesce(sum(size_bytes) OVER (ORDER BY access_count, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size_bytes) OVER () AS used FROM {ENTRIES_SQL}) WHERE before < used * 0.25")
def evict_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of what is in use, by frequency; a policy that evicts nothing refuses."""
    e = entries(spark, sf_dir)
    used = e.agg(F.sum("size_bytes")).first()[0]
    try:
        structures.victims(e, "none", 1)
    except MemoryError:
        return structures.victims(e, "lfu", structures.share_to_evict(used, 0.25)).select("key")
    raise AssertionError("evicted without a policy")


@query(f"SELECT key, member, score FROM {ZSET_SQL} WHERE CAST(member AS BIGINT) % 3 <> 0")
def z_rem(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = scores(spark, sf_dir)
    return structures.remove_scores(z, z.where("bigint(member) % 3 = 0"))


@query(f"SELECT key, rank, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM {ZSET_SQL}) WHERE rank >= greatest(n - 5, 0) AND rank <= n - 2")
def z_range_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.by_rank(scores(spark, sf_dir), -5, -2).withColumn("rank", F.col("rank").cast("long"))


@query("(SELECT event_type AS key, user_id AS member FROM events WHERE value > 20 UNION SELECT event_type, user_id FROM events) EXCEPT SELECT event_type, user_id FROM events WHERE value > 60")
def s_add_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member"), "value")
    grown = structures.add_members(df.where("value > 20").select("key", "member").distinct(), df)
    return structures.remove_members(grown, df.where("value > 60"))


@query(f"{SQL['kv_cas'].rsplit('SELECT seq, key', 1)[0]} SELECT key, arg_max(CASE WHEN version IS NOT NULL THEN {{'v': value}} END, seq).v AS value FROM f GROUP BY key HAVING arg_max(version IS NOT NULL, seq) ORDER BY key LIMIT 20")
def kv_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.Store(kv_log(spark, sf_dir)).fetch(20)


@query("SELECT key, value FROM (VALUES ('a', '2'), ('c', '3')) t(key, value)")
def kv_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands one after another, in a store that keeps its log in a folder."""
    store = kv.Store(spark.createDataFrame([], kv.LOG), fresh_path(spark, "kv"))
    store.set("a", "1")
    store.set("b", "1")
    store.store()
    store.cas("a", 1, "2")
    store.cas("a", 1, "9")
    store.delete("b")
    store.set("c", "3")
    store.store()
    return store.fetch()


# Values


@query("SELECT n_nationkey, n_name AS kept, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE n_regionkey END AS b, n_nationkey AS made FROM nation")
def x_with_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("n"), F.struct(F.col("n_regionkey").alias("b")).alias("a")).alias("d"))
    df = values.with_path(df, "d.a.b", F.when(F.col("n_nationkey") % 2 == 0, F.lit(1).cast("long")).otherwise(F.col("d.a.b")))
    df = values.with_path(df, "d.new.deep", F.col("n_nationkey"))
    return df.select("n_nationkey", F.col("d.n").alias("kept"), F.col("d.a.b").alias("b"), F.col("d.new.deep").alias("made"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def x_object_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.unhex(F.concat(F.lpad(F.hex(F.unix_seconds(F.col("ts").cast("timestamp"))), 8, "0"), F.lpad(F.hex("event_id"), 16, "0")))
    return table(spark, sf_dir, "events").select("event_id", values.object_id_seconds(made).alias("seconds"))


@query("SELECT p_partkey, p_size / 100.0 AS utilization, CASE WHEN p_size % 60 = 0 THEN 0 ELSE 1 - p_size / 60.0 END AS fragmentation FROM part")
def x_arena(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.lit(100).alias("total_size"), F.when(F.col("p_size") % 60 == 0, 0).otherwise(60).alias("current_offset"), F.col("p_size").alias("allocated_bytes"))
    return structures.arena_use(df).select("p_partkey", "utilization", "fragmentation")


@query("SELECT event_id, CASE WHEN user_id % 2 = 1 THEN 'custom:user_id' END AS violation FROM events")
def v_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_validator("even_number", lambda c: c % 2 == 0)
    df = table(spark, sf_dir, "events")
    return df.select("event_id", violation(df, {"user_id": FieldDef("int64", validators=(("custom", "even_number"),)), "value": FieldDef("float64", validators=(("custom", "no_such_validator"),))}).alias("violation"))


# Subscriptions


@query(f"SELECT * FROM (SELECT subscriber_id, channel FROM {SUB} UNION SELECT subscriber_id, 'view.1' FROM {SUB}) WHERE NOT (channel LIKE 'click.%' AND subscriber_id % 2 = 0) AND subscriber_id <> 101")
def ps_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribed twice, partly unsubscribed, one subscriber removed."""
    s = subs(spark, sf_dir)
    grown = pubsub.subscribe(pubsub.subscribe(s, s.withColumn("channel", F.lit("view.1"))), s)
    return pubsub.remove_subscriber(pubsub.unsubscribe(grown, s.where("subscriber_id % 2 = 0")), 101)


@query(f"SELECT m.id, m.channel, CAST(p.subscriber_id AS BIGINT) AS subscriber_id FROM {MSG} m JOIN (SELECT * FROM {PAT} WHERE NOT (subscriber_id = 3 AND pattern = 'p*.?') UNION ALL SELECT 9, 'click.*' UNION ALL SELECT 9, 'click.*') p ON regexp_matches(m.channel, '^' || replace(replace(p.pattern, '*', '.*'), '?', '.') || '$')")
def ps_psubscribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern taken back (both of its subscriptions), another subscribed to twice."""
    more = spark.createDataFrame([(9, "click.*"), (9, "click.*")], "subscriber_id long, pattern string")
    left = pubsub.punsubscribe(patterns(spark), spark.createDataFrame([(3, "p*.?"), (3, "none")], "subscriber_id long, pattern string"))
    return pubsub.by_pattern(messages(spark, sf_dir), pubsub.psubscribe(left, more))


@query("SELECT event_id AS id FROM events WHERE event_id < 6 AND 1048573 + event_id <= 1048576 UNION ALL SELECT event_id FROM events WHERE event_id BETWEEN 6 AND 50")
def ps_size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = messages(spark, sf_dir).where("id <= 50").withColumn("payload", F.when(F.col("id") < 6, F.repeat(F.lit("x"), (F.col("id") + 1048573).cast("int"))).otherwise(F.col("payload")))
    return pubsub.acceptable(big).select("id")


# Server


@query(f"""SELECT CAST(date_sub('second', TIMESTAMP '2024-01-01', {NOW_SQL}) AS BIGINT) AS uptime_seconds, (SELECT count(DISTINCT user_id) FROM events) AS connections, 3 AS collections, count(*) AS total,
 count(*) FILTER (WHERE ts <= {NOW_SQL} AND ts > {NOW_SQL} - INTERVAL 36000 SECOND) / 36000.0 AS ops_per_second, round(count(*) FILTER (WHERE event_type IN ('view', 'click') AND value > 30) / count(*) FILTER (WHERE event_type IN ('view', 'click') AND value IS NOT NULL), 6) AS hit_rate FROM events""")
def n_server_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "events").select("user_id").distinct()
    out = monitor.server_info(operations(spark, sf_dir), sessions, 3, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")), middle(), 36000)
    return out.withColumn("hit_rate", F.round("hit_rate", 6))


@query("SELECT user_id, total, CASE WHEN hits + misses = 0 THEN 0 ELSE round(hits / (hits + misses), 6) END AS hit_rate FROM (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS hits, count(*) FILTER (WHERE event_type = 'view') AS misses FROM events GROUP BY 1)")
def n_storage_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind, name: F.count(F.when(F.col("event_type") == kind, 1)).alias(name)
    counters = table(spark, sf_dir, "events").groupBy("user_id").agg(n("click", "hits"), n("view", "misses"), n("purchase", "writes"), n("signup", "stored_reads"), n("error", "stored_writes"))
    return structures.storage_operations(counters).select("user_id", "total", F.round("hit_rate", 6).alias("hit_rate"))


@query(f"SELECT CAST(event_id AS VARCHAR) AS _id FROM events WHERE {' AND '.join(['user_id >= 30', 'user_id < 40'])}")
def f_parsed_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter parsed beforehand runs like its text."""
    return find.where(table(spark, sf_dir, "events", "event_id"), parse_filter({"user_id": {"$gte": 30, "$lt": 40}})).select("_id")
