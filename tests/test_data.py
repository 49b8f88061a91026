import datetime as dt
import time
import uuid

import pytest
from pyspark.sql import functions as F

from docquarry.functions import values
from docquarry.operators import dml, index, kv, monitor, security, structures
from docquarry.operators.schema import FieldDef, checked, register_validator, violation
from docquarry.plans import planner
from docquarry.plans.parse import parse_filter, parse_query
from docquarry.sources import exchange
from docquarry.sources.catalog import Engine
from docquarry.streaming import changelog


def got(df, *names):
    return sorted((tuple(r[n] for n in (names or df.columns)) for r in df.collect()), key=str)


# Schemas


def broken(spark, sql, schema):
    df = spark.sql(sql)
    return [r[0] for r in df.select(violation(df, schema)).collect()]


def test_validators(spark):
    field = lambda *v, **k: {"x": FieldDef(validators=v, **k)}
    cases = [("15", ("min", 10), None), ("5", ("min", 10), "min:x"), ("50", ("max", 100), None), ("150", ("max", 100), "max:x"), ("'John'", ("min_length", 3), None), ("'Jo'", ("min_length", 3), "min_length:x"), ("'éé'", ("min_length", 4), None), ("'VeryLongName'", ("max_length", 10), "max_length:x"), ("'123-4567'", ("regex", r"^\d{3}-\d{4}$"), None), ("'invalid'", ("regex", r"^\d{3}-\d{4}$"), "regex:x"), ("'red'", ("enum", ["red", "green"]), None), ("'yellow'", ("enum", ["red", "green"]), "enum:x"), ("array(1, 2)", ("max_length", 1), "max_length:x"), ("'a'", ("min", 5), None), ("'a'", ("custom", "unknown"), None)]
    for value, rule, want in cases:
        assert broken(spark, f"select {value} as x", field(rule)) == [want], (value, rule)
    register_validator("even", lambda c: c % 2 == 0)
    assert broken(spark, "select 3 as x", field(("custom", "even"))) == ["custom:x"]


def test_schema(spark):
    schema = {"name": FieldDef("string", required=True), "age": FieldDef("int32"), "status": FieldDef("string", default="active")}
    df = spark.createDataFrame([("a", 1, None), (None, 2, "x")], "name string, age int, status string")
    good, bad = checked(df, schema)
    assert got(good) == [("a", 1, "active")] and got(bad, "age", "violation") == [(2, "required:name")]
    assert broken(spark, "select 'thirty' as age, 'n' as name", schema) == ["type:age"]
    assert broken(spark, "select 1 as other", schema) == ["required:name"]
    assert broken(spark, "select array('t') as x", {"x": FieldDef("array", item=FieldDef("int32"))}) == ["type:x"]
    assert broken(spark, "select array(1) as x", {"x": FieldDef("array", item=FieldDef("int64"))}) == [None]
    assert broken(spark, "select named_struct('a', cast(null as int)) as x", {"x": FieldDef("object", fields={"a": FieldDef("int32", required=True)})}) == ["required:x.a"]


# Functions


def test_sizes_and_depths(spark):
    df = spark.sql("select 1 as i, 'é' as s, array(1L, 2L) as a, cast(null as string) as n")
    assert [r[0] for r in df.select(values.document_size(df)).collect()] == [(1 + 4) + (1 + 2) + (1 + 8 + 16)]
    cases = {"1": 0, "[1,2]": 1, "[[1]]": 2, '{"a":{"b":[1]}}': 3, '"[{"': 0, '{"a":"\\"[["}': 1}
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    assert {r.j: r.d for r in df.select("j", values.depth(F.col("j")).alias("d")).collect()} == cases


def test_path_writes(spark):
    df = spark.sql("select named_struct('a', 1, 'b', named_struct('c', 2)) as x")
    r = values.with_path(df, "x.b.d", F.lit(9)).first()
    assert r.x.b.d == 9 and r.x.b.c == 2 and r.x.a == 1
    assert values.with_path(df, "y.z.w", F.lit(1)).first().y.z.w == 1
    with pytest.raises(ValueError):
        values.with_path(df, "x.a.q", F.lit(1))


def test_scalars(spark):
    df = spark.createDataFrame([("abc",), ("",), ("ключ",), (None,)], "s string")
    out = {r.s: r for r in df.select("s", values.key_id(F.col("s")).alias("id"), values.fnv1a(F.col("s")).alias("h")).collect()}
    for s in ("abc", "", "ключ"):
        assert out[s].id == str(uuid.uuid5(uuid.NAMESPACE_OID, s))
    assert out[""].h & (2**64 - 1) == 0xCBF29CE484222325 and out["abc"].h & (2**64 - 1) == 0xE71FA2190541574B and out[None].h is None
    one = spark.range(1)
    assert one.select(values.object_id_seconds(F.unhex(F.lit("65a1b2c3" + "00" * 8)))).first()[0] == 0x65A1B2C3
    assert one.select(values.ratio(F.lit(1), F.lit(0)), values.ratio(F.lit(1), F.lit(4), 100), values.clamp(F.lit(1.5), 0.0, 1.0)).first()[:] == (0.0, 25.0, 1.0)


# Index and planner


def test_index(spark):
    df = spark.createDataFrame([("a", 20), ("b", 25), ("c", 30), ("d", 35), ("e", 40), ("f", None), ("g", 25)], "_id string, age int")
    assert [r._id for r in index.between(df, "age", 25, 35).collect()] == ["b", "g", "c", "d"]
    assert [r._id for r in index.between(df, "age", 25, 35, False, False).collect()] == ["c"]
    assert got(index.lookup(df, {"age": None}), "_id") == [("f",)]
    assert got(index.conflicts(df, ["age"])) == [(25, 2, "b")] and index.keyed(df, ["age"], sparse=True).count() == 6
    ranks = spark.sql("select parse_json(j) as v, j from values ('null'), ('false'), ('10'), ('1.5'), ('\"a\"') t(j)").select("j", index.type_rank(F.col("v")).alias("r"))
    assert {r.j: r.r for r in ranks.collect()} == {"null": 0, "false": 1, "10": 2, "1.5": 3, '"a"': 4}
    log = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (0, 40)], "results int, micros int")
    assert got(index.statistics(log), "lookups", "hits", "misses", "hit_rate", "min_micros") == [(4, 3, 1, 0.75, 10)]
    assert index.build_estimate_ms(2500) == 2530


def test_sorted_files(spark, tmp_path):
    df = spark.range(1000).withColumn("_id", F.col("id").cast("string"))
    index.write_sorted(df, ["id"], str(tmp_path / "t"), 4)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.groupBy(F.input_file_name()).agg((F.max("id") - F.min("id")).alias("d")).agg(F.max("d")).first()[0] < 500


def test_planner():
    cost = lambda spec: planner.filter_cost(parse_filter(spec))
    assert cost({"a": 1}) == 1.0 and cost({"a": {"$regex": "x"}}) == 10.0 and cost({"a": 1, "b": {"$gt": 1}}) == 3.0
    assert cost({"$or": [{"a": 1}, {"b": 1}]}) == 3.0 and cost({"$not": {"a": 1}}) == 1.2 and cost({"a": {"$in": [1, 2]}}) == 1.0
    defs = [planner.IndexDef("name", ("name",)), planner.IndexDef("age", ("age",)), planner.IndexDef("both", ("name", "age"))]
    q = parse_query({"filter": {"name": "x", "age": 5}})
    assert planner.choose_index(defs, q).name == "both" and planner.choose_index(defs, parse_query({"filter": {"z": 1}})) is None
    p = planner.plan(parse_query({"filter": {"age": 1}, "sort": {"age": 1}}), defs)
    assert p.strategy == "index scan" and not p.needs_sort and p.cost == 160
    assert [planner.filter_cost(t) for t in planner.cheapest_first(parse_filter({"a": {"$regex": "x"}, "b": 1})).terms] == [1.0, 10.0]


# Changes and changelogs


def test_dml(spark):
    df = spark.createDataFrame([("1", 1, "a"), ("2", 2, None)], "_id string, n int, s string")
    assert got(dml.insert(df, spark.createDataFrame([("2", 9), ("3", 3)], "_id string, n int"))) == [("1", 1, "a"), ("2", 9, None), ("3", 3, None)]
    assert got(dml.replace(df, {"n": 1}, {"s": "z"})) == [("1", None, "z"), ("2", 2, None)]
    assert got(dml.modify(df, {"s": {"$ne": "a"}}, {"$inc": {"n": 5}, "$set": {"s": "q", "new": 1}})) == [("1", 1, "a", None), ("2", 7, "q", 1)]
    assert got(dml.modify(df, {}, {"$unset": {"s": 1}}), "s") == [(None,), (None,)]
    assert got(dml.delete(df, {"s": "a"}), "_id") == [("2",)] and dml.affected(df, {"n": {"$gt": 0}}).first()[0] == 2


def test_collection_insert_checks(spark):
    c = Engine(spark).create("c", spark.createDataFrame([("1", "a")], "_id string, name string"), schema={"name": FieldDef("string", required=True)})
    rejected = c.insert(spark.createDataFrame([("2", None), ("3", "x")], "_id string, name string"))
    assert got(rejected, "_id", "violation") == [("2", "required:name")] and got(c.df, "_id") == [("1",), ("3",)]


LOG = "sequence long, timestamp timestamp, op string, collection string, doc_id string, a int, b string"
T0 = dt.datetime(2024, 1, 1)


def entries(spark, *rows):
    return spark.createDataFrame([(s, T0 + dt.timedelta(seconds=s), *r) for s, r in enumerate(rows, 1)], LOG)


def test_replay(spark):
    log = entries(spark, ("insert", "c", "1", 1, "x"), ("update", "c", "1", 2, None), ("update", "c", "9", 5, "n"), ("insert", "c", "2", 1, "y"), ("delete", "c", "2", None, None), ("insert", "d", "1", 7, "d"), ("insert", "c", "3", 3, None), ("update", "c", "3", None, "late"))
    assert got(changelog.replay(None, log, ["a", "b"])) == [("c", "1", 2, "x"), ("c", "3", 3, "late"), ("d", "1", 7, "d")]
    assert got(changelog.recover(None, log, ["a", "b"], F.lit(T0 + dt.timedelta(seconds=4)))) == [("c", "1", 2, "x"), ("c", "2", 1, "y")]
    base = spark.createDataFrame([("c", "9", 1, "base")], "collection string, doc_id string, a int, b string")
    assert ("c", "9", 5, "n") in got(changelog.replay(base, log, ["a", "b"]))
    assert got(changelog.replay(base, log, ["a", "b"], since=4)) == [("c", "3", 3, "late"), ("c", "9", 1, "base"), ("d", "1", 7, "d")]
    dropped = log.unionByName(entries(spark, *[("drop", "c", None, None, None)] * 9).where("sequence = 9"))
    assert got(changelog.replay(None, dropped, ["a", "b"])) == [("d", "1", 7, "d")]
    assert got(changelog.replay_statistics(log, 2)) == [(7, 1, 8)]


def test_irregular_logs(spark):
    rows = [(1, 10), (2, 20), (3, 15), (3, 30), (100_001, 25), (100_002, 40)]
    log = spark.createDataFrame([(s, T0 + dt.timedelta(seconds=t)) for s, t in rows], "sequence long, timestamp timestamp")
    assert [(r.sequence, r.problem) for r in changelog.irregular(log).orderBy("sequence").collect()] == [(3, "timestamp"), (3, "sequence"), (100_001, "timestamp")]


def test_changelog_files(spark, tmp_path):
    rows = [(i, T0, "insert", "c", str(i), f'{{"n":{i}}}') for i in range(5)]
    e = spark.createDataFrame(rows, exchange.ENTRY)
    exchange.append_changelog(e, str(tmp_path / "log"))
    back = exchange.read_changelog(spark, str(tmp_path / "log"))
    assert back.count() == 5 and exchange.damaged(back).count() == 0
    assert exchange.damaged(back.withColumn("changes", F.when(F.col("sequence") == 3, "x").otherwise(F.col("changes")))).count() == 1
    data = exchange.frames([{"sequence": 1}, {"sequence": 2}])
    (tmp_path / "wal").mkdir()
    (tmp_path / "wal" / "wal-1.log").write_bytes(data)
    (tmp_path / "wal" / "wal-2.log").write_bytes(data[:8] + b"X" + data[9:-3])
    frames = [(r.file[-5:-4], r.place, r.intact) for r in exchange.read_frames(spark, str(tmp_path / "wal" / "wal-*.log")).collect()]
    assert sorted(frames) == [("1", 0, True), ("1", 1, True), ("2", 0, False), ("2", 1, False)]


def test_replication(spark):
    log = spark.createDataFrame([(i,) for i in range(50, 60)], "sequence long")
    assert [r.sequence for r in changelog.missing_entries(log, 55, 2).collect()] == [56, 57]
    assert got(changelog.needs_full_sync(log, 55)) == [(4, False)] and got(changelog.needs_full_sync(log, 10)) == [(49, True)] and got(changelog.needs_full_sync(log.where("false"), 7)) == [(0, False)]


def test_follow_and_write_behind(spark, tmp_path):
    src, log = str(tmp_path / "src"), "seq long, key string, v int, ts timestamp_ntz"
    first = spark.createDataFrame([(1, "a", 1, T0), (2, "a", 2, T0), (3, "b", 5, T0)], log)
    first.coalesce(1).write.parquet(src)
    for run, more in enumerate((None, [(4, "b", 6, T0)])):
        if more:
            spark.createDataFrame(more, log).coalesce(1).write.mode("append").parquet(src)
        q = changelog.follow(spark.readStream.schema(log).parquet(src), str(tmp_path / "copy"), str(tmp_path / "cp1"))
        assert q.awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "copy")).count() == 3 + run
    q = changelog.write_behind(spark.readStream.schema(log).parquet(src), str(tmp_path / "flushed"), str(tmp_path / "cp2"), ["key"])
    assert q.awaitTermination(60)
    assert got(spark.read.parquet(str(tmp_path / "flushed")), "key", "v") == [("a", 2), ("b", 6)]


def test_write_behind_keeps_what_is_not_due(spark, tmp_path):
    src, log = str(tmp_path / "src"), "seq long, key string, v int, ts timestamp_ntz"
    soon = dt.datetime.now(dt.UTC).replace(tzinfo=None) - dt.timedelta(seconds=50)
    run = lambda: changelog.write_behind(spark.readStream.schema(log).parquet(src), str(tmp_path / "out"), str(tmp_path / "cp"), ["key"], "60 seconds").awaitTermination(60)
    spark.createDataFrame([(1, "a", 1, T0), (2, "a", 2, soon), (3, "b", 3, soon)], log).coalesce(1).write.mode("append").parquet(src)
    assert run() and got(spark.read.parquet(str(tmp_path / "out")), "key", "v") == [("a", 1)]
    time.sleep(max(0.0, 11 - (dt.datetime.now(dt.UTC).replace(tzinfo=None) - soon).total_seconds() + 50))
    spark.createDataFrame([(4, "c", 4, T0)], log).coalesce(1).write.mode("append").parquet(src)
    assert run() and got(spark.read.parquet(str(tmp_path / "out")), "key", "v") == [("a", 1), ("a", 2), ("b", 3), ("c", 4)]


def test_exchange(spark, tmp_path):
    df = spark.createDataFrame([("1", [1, 2], None), ("2", [], "é\n")], "_id string, xs array<int>, s string")
    for pretty in (False, True):
        exchange.export_json(df, str(tmp_path / f"j{pretty}"), pretty)
        assert got(exchange.import_json(spark, str(tmp_path / f"j{pretty}"), df.schema, pretty), "_id", "s") == [("1", None), ("2", "é\n")]
    dynamic = exchange.import_dynamic(spark, str(tmp_path / "jFalse"))
    assert sorted(r._id for r in dynamic.collect()) == ["1", "2"]
    exchange.write_snapshot(df, str(tmp_path / "snap"), "c", 7)
    assert exchange.read_snapshot(spark, str(tmp_path / "snap"), "c", 7).count() == 2
    exchange.write_snapshot(df.limit(1), str(tmp_path / "snap"), "c", 9)
    assert [(r.sequence, r.collection, r.documents) for r in exchange.snapshots(spark, str(tmp_path / "snap")).collect()] == [(9, "c", 1), (7, "c", 2)]
    df.limit(1).write.mode("append").parquet(str(tmp_path / "snap/seq=000000000007/collection=c/data"))
    with pytest.raises(ValueError):
        exchange.read_snapshot(spark, str(tmp_path / "snap"), "c", 7)
    backups = spark.createDataFrame([(f"b{i}", i) for i in range(8)], "backup_id string, created_at long")
    assert got(exchange.retained(backups).where("not kept"), "backup_id") == [("b0",), ("b1",), ("b2",)]


# Structures


def test_lists(spark):
    items = spark.createDataFrame([("k", i, f"v{i}") for i in range(5)] + [("one", 0, "x")], "key string, pos long, value string")
    assert [r[2] for r in got(structures.list_range(items.where("key = 'k'"), 1, 3))] == ["v1", "v2", "v3"]
    assert [r[2] for r in got(structures.list_range(items.where("key = 'k'"), -2, 99))] == ["v3", "v4"]
    assert structures.list_range(items, 3, 1).count() == 0 and got(structures.at_index(items, -1)) == [("k", "v4"), ("one", "x")]
    new = spark.createDataFrame([("k", 1, "p"), ("k", 2, "q"), ("new", 1, "n")], "key string, seq long, value string")
    left = structures.push(items, new, left=True)
    assert got(structures.popped(left)) == [("k", "q"), ("new", "n"), ("one", "x")] and got(structures.popped(left, left=False)) == [("k", "v4"), ("new", "n"), ("one", "x")]
    assert got(structures.lengths(structures.without_end(left))) == [("k", 6)]


def test_sets_zsets_hashes(spark):
    m = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "b"), ("t", "c")], "key string, member string")
    assert [got(structures.combined(m, ["s", "t"], how)) for how in ("union", "inter", "diff")] == [[("a",), ("b",), ("c",)], [("b",)], [("a",)]]
    assert got(structures.cardinality(structures.add_members(m, m)))[0] == ("s", 2) and structures.remove_members(m, m.limit(1)).count() == 3
    assert got(structures.is_member(m, spark.createDataFrame([("s", "a"), ("s", "z")], m.schema))) == [("s", "a", True), ("s", "z", False)]
    z = spark.createDataFrame([("z", "alice", 100.0), ("z", "bob", 85.0), ("z", "charlie", 95.0)], "key string, member string, score double")
    assert [r.member for r in structures.by_rank(z, 0, 1).orderBy("rank").collect()] == ["bob", "charlie"] and [r.member for r in structures.by_score(z, 90, 100).collect()] == ["charlie", "alice"]
    assert got(structures.set_scores(z, spark.createDataFrame([("z", "bob", 1.0, 1), ("z", "dan", 2.0, 2), ("z", "bob", 3.0, 3)], "key string, member string, score double, seq long")), "member", "score") == [("alice", 100.0), ("bob", 3.0), ("charlie", 95.0), ("dan", 2.0)]
    h = spark.createDataFrame([("h", "b", "1"), ("h", "a", "2")], "key string, field string, value string")
    assert structures.as_map(h).first().fields == {"a": "2", "b": "1"}
    log = spark.createDataFrame([("h", "a", None, 1, True), ("h", "c", "3", 2, False)], "key string, field string, value string, seq long, deleted boolean")
    assert got(structures.set_fields(h, log), "field", "value") == [("b", "1"), ("c", "3")]
    assert got(structures.structure_bytes(m, ["member"])) == [("s", 18), ("t", 18)]


def test_expiry_and_eviction(spark):
    ago = lambda s: T0 - dt.timedelta(seconds=s)
    rows = [("key1", 50, ago(100), 5, ago(-10)), ("key2", 50, ago(50), 50, None), ("key3", 50, ago(10), 100, ago(-100)), ("old", 50, ago(1), 200, T0)]
    e = spark.createDataFrame(rows, "key string, size_bytes long, last_accessed timestamp, access_count long, expires_at timestamp")
    now = F.lit(T0)
    assert [got(structures.victims(e, p, n), "key") for p, n in (("lru", 60), ("lfu", 50), ("ttl", 101))] == [[("key1",), ("key2",)], [("key1",)], [("key1",), ("key3",), ("old",)]]
    assert got(structures.live(e, now), "key") == [("key1",), ("key2",), ("key3",)] and got(structures.expired(e, now), "key") == [("old",)]
    assert got(e.select("key", structures.remaining_seconds(now).alias("t"))) == [("key1", 10), ("key2", -1), ("key3", 100), ("old", 0)]
    assert structures.needed_bytes(100, 50, 120) == pytest.approx(36) and structures.needed_bytes(1, 1, 5) == 0 and structures.share_to_evict(100, 1.5) == 100
    with pytest.raises(MemoryError):
        structures.victims(e, "none", 5)


@pytest.mark.parametrize("pad", [0, 400])
def test_eviction_over_many_ranges(spark, pad):
    """Right however adaptive execution merges ranges: many partitions, narrow and wide rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.range(100_000).select(F.col("id").alias("key"), (F.xxhash64("id") % 50 + 60).alias("size_bytes"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5000)).alias("access_count"), F.repeat(F.lit("x"), pad).alias("pad"), F.lit(T0).alias("last_accessed"), F.lit(None).cast("timestamp").alias("expires_at"))
        gone = {r.key for r in structures.victims(df, "lfu", 3_000_000).select("key").collect()}
        rows = sorted((r.access_count, r.key, r.size_bytes) for r in df.select("key", "access_count", "size_bytes").collect())
        want, freed = set(), 0
        for _, key, size in rows:
            if freed >= 3_000_000:
                break
            want.add(key)
            freed += size
        assert gone == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_cache_commands(spark):
    now, later = F.lit(T0).cast("timestamp_ntz"), F.lit(T0 + dt.timedelta(seconds=61)).cast("timestamp_ntz")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    new = spark.createDataFrame([("a", 10), ("b", 20)], "key string, size_bytes long")
    empty = spark.createDataFrame([], "key string, size_bytes long, last_accessed timestamp_ntz, access_count long, expires_at timestamp_ntz")
    e = structures.put(structures.put(empty, new, now), new.where("key = 'b'"), now, 60)
    assert got(structures.time_left(e, keys("a", "b", "c"), now)) == [("a", -1), ("b", 60), ("c", None)]
    after, hits = structures.read(e, keys("a", "a", "c"), now)
    assert got(after, "key", "access_count") == [("a", 2), ("b", 0)] and got(hits) == [("a", True), ("a", True), ("c", False)]
    assert got(structures.read(e, keys("b"), later)[1]) == [("b", False)] and structures.read(e, keys("b"), later)[0].count() == 1
    assert got(structures.exists(e, keys("b"), now)) == [("b", True)] and structures.cleared(e).count() == 0 and got(structures.removed(e, keys("a", "z")), "key") == [("b",)]
    assert got(structures.time_left(structures.expire(e, keys("a", "z"), now, 5), keys("a"), now)) == [("a", 5)]
    assert got(structures.time_left(structures.expire(e, keys("b"), now, None), keys("b"), now)) == [("b", -1)]
    assert got(structures.remove_scores(spark.createDataFrame([("z", "m", 1.0), ("z", "n", 2.0)], "key string, member string, score double"), spark.createDataFrame([("z", "m"), ("q", "n")], "key string, member string")), "member") == [("n",)]
    assert got(structures.cache_statistics(spark.createDataFrame([(True,), (False,)], "hit boolean"))) == [(1, 1, 0.5)]


def test_kv(spark):
    rows = [(1, "set", "k", "a", None), (2, "cas", "k", "b", 999), (3, "cas", "k", "c", 1), (4, "cas", "none", "x", 1), (5, "set", "k", "d", None), (6, "del", "k", None, None), (7, "set", "k", "e", None), (8, "set", "j", "f", None)]
    log = spark.createDataFrame(rows, "seq long, op string, key string, value string, expected_version long")
    assert [(r.seq, r.status, r.version) for r in kv.replay(log).orderBy("seq").collect()] == [(1, "created", 1), (2, "version_mismatch", 1), (3, "ok", 2), (4, "not_found", None), (5, "ok", 2), (6, "ok", None), (7, "created", 1), (8, "created", 1)]
    assert got(kv.latest(log)) == [("j", "f"), ("k", "e")]
    assert got(kv.get(log, spark.createDataFrame([("k",), ("q",)], "key string"))) == [("k", "e", "ok"), ("q", None, "not_found")]
    assert got(kv.statistics(log)) == [(8, 4, 1, 2, 4)]


def test_store(spark):
    s = kv.Store(spark.createDataFrame([], "seq long, op string, key string, value string, expected_version long"))
    s.set("k", "a")
    assert s.get("k") == "a" and s.get("q") is None and s.cas("k", 999, "x") == "version_mismatch" and s.cas("k", 1, "b") == "ok" and s.cas("q", 1, "x") == "not_found"
    assert s.get("k") == "b"
    s.delete("k")
    assert s.get("k") is None and s.keys().count() == 0


def test_warm(spark):
    c = Engine(spark).create("w", spark.range(10).withColumn("_id", F.col("id").cast("string")))
    assert c.warm() == 10 and c.warm(3) == 3 and c.df.is_cached
    c.cool()


# Monitoring and security


def test_monitoring(spark):
    s = spark.createDataFrame([(i, i * 1000) for i in range(1, 101)], "seq long, micros long")
    assert got(monitor.latency_percentiles(s)) == [(51_000, 91_000, 96_000, 100_000, 100_000, 100_000, 100)]
    assert got(monitor.latency_percentiles(s, last=10), "p50", "samples") == [(96_000, 10)]
    log = spark.createDataFrame([(1, 50.0), (2, 200.0), (3, 101.0)], "seq long, millis double")
    assert [r.seq for r in monitor.slow_queries(log).collect()] == [3, 2] and got(monitor.slow_statistics(log)) == [(2, 150, 200)] and got(monitor.slow_statistics(log.where("false"))) == [(0, 0, 0)]
    audit = spark.createDataFrame([(1, "auth", True), (2, "auth", False), (3, "authz", False), (4, "admin", True), (5, "x", True), (6, "config", False)], "seq long, kind string, success boolean")
    assert got(monitor.audit_statistics(audit)) == [(6, 1, 1, 1, 1, 1)]
    ops = spark.createDataFrame([("a", True, True), ("b", True, True), ("c", False, False), ("d", True, None)], "op string, ok boolean, hit boolean")
    r = monitor.rates(ops, 2).first()
    assert (r.total, r.per_second, r.error_rate, round(r.hit_rate, 3)) == (4, 2.0, 25.0, 66.667)
    h = monitor.health(spark.createDataFrame([(1.0, 0.0, 10.0, 0.0, 90.0), (5.0, 11.0, 10.0, 0.0, 90.0), (1.0, 0.0, 60.0, 6000.0, 90.0), (1.0, 0.0, 0.0, 0.0, 10.0)], "memory_gb double, error_rate double, p99_ms double, lag_ms double, hit_rate double"))
    assert [x.overall for x in h.collect()] == ["healthy", "unhealthy", "unhealthy", "degraded"]


def test_access(spark):
    req = spark.createDataFrame([(1, "t", "read_write", "write", "c"), (2, "o", "read_write", "write", "c"), (3, "o", "read_only", "write", "c"), (4, "t", "read_only", "read", "d"), (5, "o", "admin", "drop_collection", "x"), (6, "admin", "admin", "view_metrics", "x")], "request_id long, user string, role string, operation string, resource string")
    schema = "principal string, resource string, operation string, deny boolean"
    decide = lambda *rules: [r.allowed for r in security.decide(req, security.role_permissions(spark), spark.createDataFrame(list(rules), schema)).orderBy("request_id").collect()]
    assert decide() == [True, True, False, True, True, True]
    assert decide(("t", "c", "write", True)) == [False, True, False, True, True, True]
    assert decide(("read_write", "c", "write", True), ("t", "c", "write", False)) == [False, False, False, True, True, True]
    assert decide(("t", "c", "read", False), ("read_only", "c", "write", False)) == [False, True, False, True, True, True]
    assert decide(("t", "d", None, False), ("admin", "x", "drop_collection", False)) == [True, True, False, False, True, False]
    assert len(security.OPERATIONS) == 25 and set(security.READ_ONLY) < set(security.READ_WRITE) < set(security.OPERATIONS)


def test_encryption(spark):
    one, two = F.lit("0" * 32), F.lit("1" * 32)
    df = security.encrypt_fields(spark.createDataFrame([("a", "x"), ("b", None)], "k string, s string"), ["s"], one)
    assert got(security.decrypt_fields(df, ["s"], one)) == [("a", "x"), ("b", None)] and got(security.decrypt_fields(df, ["s"], two), "s") == [(None,), (None,)]
    assert got(security.decrypt_fields(security.rotate(df, ["s"], one, two), ["s"], two)) == [("a", "x", True), ("b", None, True)]
    assert got(security.rotate(df, ["s"], two, one), "rotated") == [(False,), (True,)]
    keys = spark.createDataFrame([("k1", True, dt.date(2024, 1, 1), 90), ("k2", True, dt.date(2024, 1, 30), 90), ("k3", False, dt.date(2020, 1, 1), 90), ("k4", True, dt.date(2024, 4, 1), 90)], "key_id string, active boolean, last_rotated date, rotation_days int")
    assert got(security.key_ages(keys, F.lit(dt.date(2024, 4, 10))), "key_id", "age_days", "needs_rotation", "warning") == [("k1", 100, True, False), ("k2", 71, False, False), ("k3", 1561, False, False), ("k4", 9, False, False)]


# What surrounds the queries


def test_recovery_refuses_a_log_out_of_order(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, at(0), "insert", "c", "a", 1), (2, at(5), "update", "c", "a", 2), (3, at(3), "update", "c", "a", 3), (4, at(9), "update", "c", "a", 4)]
    log = spark.createDataFrame(rows, "sequence long, timestamp timestamp, op string, collection string, doc_id string, v int")
    assert got(changelog.recover_checked(None, log.where("sequence <> 3"), ["v"], F.lit(at(6))), "v") == [(2,)]
    with pytest.raises(ValueError):
        changelog.recover_checked(None, log, ["v"], F.lit(at(6)))
    assert got(changelog.recover_checked(None, log, ["v"], F.lit(at(2))), "v") == [(1,)]


def test_translated_commands():
    assert kv.translated("SET", "k", "v") == {"op": "insert", "collection": kv.LEGACY, "document": {"_id": "k", "value": "v"}}
    assert kv.translated("GET", "k")["limit"] == 1 and kv.translated("FETCH")["limit"] == 1000 and kv.translated("DEL", "k")["op"] == "delete"
    assert kv.translated("CAS", "k", "new", "old")["filter"] == {"_id": "k", "value": "old"}
    with pytest.raises(ValueError):
        kv.translated("NOPE")


def test_storage_strategies(spark, tmp_path):
    df = spark.createDataFrame([("1", 1), ("2", 2)], "_id string, v int")
    for strategy, versions in (("write_through", [1, 2]), ("write_behind", [2]), ("read_through", [1, 2])):
        folder = str(tmp_path / strategy)
        c = Engine(spark).create(f"st_{strategy}", df, storage=folder, strategy=strategy)
        c.update({"v": 1}, {"$inc": {"v": 10}})
        c.delete({"v": 2})
        assert got(c.df, "v") == [(11,)] and c.flush() == len(versions)
        assert got(spark.read.parquet(f"{folder}/version={c.version}"), "v") == [(11,)]
        assert c.refresh() and not c.refresh(3600) and c.df.is_cached and c.count() == 1
        c.cool()
    with pytest.raises(Exception, match="strategy"):
        Engine(spark).create("st_none", df, strategy="nope")


def test_backups_that_are_not_there(spark, tmp_path):
    exchange.create_backup(spark.range(3), str(tmp_path), "c", 1, "20240101")
    assert not exchange.verify_backup(spark, str(tmp_path), "nope") and exchange.verify_backup(spark, str(tmp_path), "backup-20240101-000000000001")
    with pytest.raises(ValueError):
        exchange.restore_backup(spark, str(tmp_path), "nope")
