import pytest
from pyspark.sql import functions as F

from docquarry.operators.find import find, get, exists, where
from docquarry.plans.ast import And, Compare, Exists, Filter, Member, Not, Or, QueryError, Regex, fields_of, served_by
from docquarry.plans.parse import parse_filter, parse_query, validate
from docquarry.sources.catalog import Engine


@pytest.fixture(scope="module")
def users(spark):
    rows = [(str(i), f"User{i}", 20 + i, i % 2 == 0) for i in range(10)]
    return spark.createDataFrame(rows, "_id string, name string, age int, active boolean").cache()


CASES = [
    ({}, 10), ({"name": "User5"}, 1), ({"age": {"$gt": 25}}, 4), ({"name": {"$in": ["User1", "User3", "User5"]}}, 3), ({"age": {"$exists": True}}, 10), ({"email": {"$exists": True}}, 0),
    ({"age": {"$gt": 23}, "active": True}, 3), ({"$or": [{"name": "User1"}, {"name": "User2"}]}, 2), ({"$not": {"active": True}}, 5), ({"name": {"$regex": "^User[0-4]$"}}, 5),
    ({"email": {"$ne": "x"}}, 10), ({"email": {"$nin": ["x"]}}, 10), ({"age": "25"}, 0), ({"age": {"$ne": "25"}}, 10), ({"active": {"$gt": False}}, 0), ({"$and": []}, 10), ({"$or": []}, 0),
]


@pytest.mark.parametrize(("spec", "n"), CASES)
def test_filters(users, spec, n):
    assert where(users, spec).count() == n


def test_sort_skip_limit_project(users):
    assert [r.age for r in find(users, {"sort": {"age": -1}}).collect()] == list(range(29, 19, -1))
    assert [r.age for r in find(users, {"sort": {"age": "asc"}, "skip": 3, "limit": 4}).collect()] == [23, 24, 25, 26]
    assert find(users, {"projection": {"name": 1, "age": 1}}).columns == ["_id", "name", "age"]
    out = find(users, {"filter": {"age": {"$gte": 22, "$lte": 27}, "active": True}, "projection": {"age": 1, "_id": 0}, "sort": {"age": -1}, "limit": 2})
    assert [tuple(r) for r in out.collect()] == [(26,), (24,)]
    assert find(users, {"skip": 50}).count() == 0 and find(users, {"limit": 0}).count() == 0
    assert find(users, {"projection": {"age": 0}}).columns == ["_id", "name", "active"]
    assert find(users, {"projection": {"_id": 0}}).columns == ["name", "age", "active"]


def test_a_limited_sort_is_a_top_k_and_filters_reach_the_scan(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = spark.read.parquet(f"{sf}/orders.parquet")
    plan = find(df, {"filter": {"o_orderstatus": "O", "o_totalprice": {"$gte": 1000}, "o_custkey": {"$ne": 5}}, "sort": {"o_totalprice": -1}, "skip": 3, "limit": 4, "projection": {"o_orderkey": 1}})._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    pushed = plan.split("PushedFilters: ")[1].split("]")[0]
    assert "EqualTo(o_orderstatus,O)" in pushed and "GreaterThanOrEqual(o_totalprice" in pushed and "Not(EqualNullSafe(o_custkey" in pushed
    assert "o_orderdate" not in plan.split("ReadSchema: ")[1].split(">")[0]


def test_parser():
    assert parse_query("{}").filter == Filter()
    assert parse_filter({"a": 5}) == Compare("eq", "a", 5)
    assert parse_filter({"a": {"$gt": 5, "$lte": 9}}) == And((Compare("gt", "a", 5), Compare("lte", "a", 9)))
    assert parse_filter({"a": {"$in": [1, 2]}}) == Member("a", (1, 2)) and parse_filter({"a": {"$exists": False}}) == Exists("a", False)
    assert parse_filter({"a": {"$regex": "x", "$options": "i"}}) == Regex("a", "x", "i")
    assert parse_filter({"$or": [{"a": 1}], "b": 2}) == And((Or((Compare("eq", "a", 1),)), Compare("eq", "b", 2)))
    assert parse_filter({"$or": [{"a": 1}], "b": 2}, strict=True) == Or((Compare("eq", "a", 1),))
    q = parse_query({"filter": {"a": 1}, "sort": {"x": 1, "y": "descending"}, "skip": 5, "limit": 1})
    assert [(k.path, k.descending) for k in q.sort] == [("x", False), ("y", True)] and (q.skip, q.limit) == (5, 1)
    assert parse_query({"filter": {"a": 1}, "limit": 1}).is_key_lookup() and not q.is_key_lookup()


@pytest.mark.parametrize("bad", [{"filter": {"a": {"$what": 1}}}, {"filter": {"$nor": []}}, {"sort": {"a": 2}}, {"projection": {"a": 1, "b": 0}}, {"skip": -1}, {"limit": "5"}, {"filter": {"a": {"$in": 5}}}, {"filter": {"$and": {}}}, "{", {"projection": {"a": "x"}}])
def test_bad_requests(bad):
    with pytest.raises(QueryError):
        parse_query(bad)


def test_bounds():
    for bad in ({"skip": 2_000_000}, {"limit": 200_000}, {"filter": {"a": {"$regex": "("}}}):
        with pytest.raises(QueryError):
            validate(parse_query(bad))
    assert validate(parse_query({"skip": 1_000_000, "limit": 100_000})).limit == 100_000


def test_utilities():
    node = parse_filter({"$or": [{"a": 1, "b": 2}, {"$not": {"a": 3}}]})
    assert fields_of(node) == ["a", "b"]
    assert served_by(node, "a") and not served_by(node, "b")
    assert isinstance(parse_filter({"$not": {"a": 1}}), Not)


def test_strict_equality_by_tag(spark):
    df = spark.createDataFrame([(30, 30, 30.0)], "i int, l long, d double")
    count = lambda spec, strict: where(df, spec, strict).count()
    assert [count({c: 30}, False) for c in "ild"] == [1, 1, 1]
    assert [count({c: 30}, True) for c in "ild"] == [1, 0, 0]
    assert [count({c: 30.0}, True) for c in "ild"] == [0, 0, 1]
    assert [count({c: {"$gte": "x"}}, True) for c in "ild"] == [1, 1, 1] and [count({c: {"$gt": "x"}}, True) for c in "ild"] == [0, 0, 0]


def test_nested_paths(spark):
    df = spark.sql("select '1' as _id, named_struct('name', 'John', 'address', named_struct('city', 'New York')) as user, array(1, 2, 3) as xs, map('k', 5) as m, '{\"a\":{\"b\":[7]}}' as js")
    for spec, n in [({"user.name": "John"}, 1), ({"user.address.city": {"$regex": "York"}}, 1), ({"user.email": {"$exists": False}}, 1), ({"xs.1": 2}, 1), ({"xs.9": {"$exists": True}}, 0), ({"m.k": {"$gt": 4}}, 1), ({"js.a.b.0": 7}, 1), ({"js.a.c": {"$ne": 1}}, 1), ({"user.name.x": {"$exists": True}}, 0)]:
        assert where(df, spec).count() == n, spec


def test_dynamic_documents(spark):
    docs = ['{"_id":"1","n":null,"s":"a","x":1}', '{"_id":"2","s":"b","x":2.5}', '{"_id":"3","n":5,"s":7,"x":true}', '{"_id":"4","n":[1],"x":"1"}']
    df = spark.createDataFrame([(d,) for d in docs], "j string").select(F.parse_json("j").alias("doc")).withColumn("_id", F.try_variant_get("doc", "$._id", "string"))
    ids = lambda spec, **k: sorted(r._id for r in where(df, spec, variant="doc", **k).collect())
    assert ids({"n": {"$exists": True}}) == ["1", "3", "4"] and ids({"n": {"$exists": False}}) == ["2"]
    assert ids({"n": None}) == ["1"] and ids({"n": {"$ne": None}}) == ["2", "3", "4"]
    assert ids({"x": 1}) == ["1"] and ids({"x": {"$gte": 1}}) == ["1", "2"] and ids({"x": "1"}) == ["4"] and ids({"x": True}) == ["3"]
    assert ids({"s": {"$in": ["a", 7]}}) == ["1", "3"] and ids({"s": {"$nin": ["a", 7]}}) == ["2", "4"]
    assert ids({"s": {"$regex": "[ab]"}}) == ["1", "2"] and ids({"$not": {"s": "a"}}) == ["2", "3", "4"]
    assert ids({"n": {"$lt": 1}}) == [] and ids({"n": {"$lt": 1}}, strict=True) == ["1"] and ids({"n": {"$gte": 9}}, strict=True) == ["4"]
    assert ids({"_id": "2"}) == ["2"]


def evaluate(node, row):
    """The language's meaning in plain Python, missing and null alike."""
    if isinstance(node, And):
        return all(evaluate(t, row) for t in node.terms)
    if isinstance(node, Or):
        return any(evaluate(t, row) for t in node.terms)
    if isinstance(node, Not):
        return not evaluate(node.term, row)
    value = row.get(node.path)
    if isinstance(node, Exists):
        return (value is not None) == node.wanted
    if isinstance(node, Member):
        return (value is None or value not in node.values) if node.negated else value in node.values
    if node.op in ("eq", "ne"):
        return (value == node.value) == (node.op == "eq")
    if value is None or isinstance(value, str) != isinstance(node.value, str):
        return False
    return {"gt": value > node.value, "gte": value >= node.value, "lt": value < node.value, "lte": value <= node.value}[node.op]


def test_random_filters(spark):
    import random

    rng = random.Random(11)
    rows = [(str(i), rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"])) for i in range(60)]
    df = spark.createDataFrame(rows, "_id string, n int, s string").cache()

    def any_filter(depth):
        kind = rng.choice(["cmp", "cmp", "in", "exists", *(["and", "or", "not"] if depth else [])])
        path = rng.choice(["n", "s"])
        value = lambda: rng.choice([1, 2, 3] if path == "n" else ["a", "b"])
        if kind == "cmp":
            return Compare(rng.choice(["eq", "ne", "gt", "gte", "lt", "lte"]), path, value())
        if kind == "in":
            return Member(path, (value(), value()), rng.random() < 0.5)
        if kind == "exists":
            return Exists(path, rng.random() < 0.5)
        if kind == "not":
            return Not(any_filter(depth - 1))
        return (And if kind == "and" else Or)(tuple(any_filter(depth - 1) for _ in range(rng.randint(0, 3))))

    filters = [any_filter(3) for _ in range(60)]
    from docquarry.operators.find import predicate

    flags = df.select("_id", *[F.coalesce(predicate(df, f), F.lit(False)).alias(f"f{i}") for i, f in enumerate(filters)]).collect()
    data = {r[0]: dict(zip(("n", "s"), r[1:], strict=True)) for r in rows}
    for r in flags:
        for i, f in enumerate(filters):
            assert r[f"f{i}"] == evaluate(f, data[r._id]), (f, data[r._id])


def test_engine(spark, users):
    engine = Engine(spark)
    c = engine.create("people", users)
    assert engine.list() == ["people"] and c.exists("3") and not c.exists("x") and c.get("3").first().age == 23
    assert [r._id for r in c.find({"age": 25}).collect()] == ["5"]
    assert [r._id for r in c.find({"filter": {"age": {"$lt": 22}}, "sort": {"age": -1}}).collect()] == ["1", "0"]
    assert get(users, "nope").count() == 0 and exists(users, "0")
    with pytest.raises(QueryError):
        engine.create("a:b", users)
    with pytest.raises(QueryError):
        engine.collection("none")
    c.create_index("by_age", ["age"])
    c.create_index("by_age", ["name"])
    assert c.explain({"filter": {"age": 5}}).index == "by_age" and c.explain({"filter": {"name": "x"}}).index is None
    c.delete({"age": {"$gte": 25}})
    c.update({"age": 20}, {"$set": {"name": "first"}})
    assert c.count() == 5 and c.get("0").first().name == "first"
    assert [tuple(r) for r in engine.info().collect()] == [("people", 5, 4, 1)]
    assert engine.drop("people") and engine.list() == [] and engine.info().count() == 0
