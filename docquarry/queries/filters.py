"""Filters, projections, sorts: find() over typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import find
from docquarry.plans.ast import And, Compare, Regex
from docquarry.queries.base import add, query, table

#: Filters over events with the error type made missing, and their conditions in SQL (kind: event_type or null, n: props.k).
FILTERS = {
    "f_empty": ({}, "true"),
    "f_eq": ({"kind": "click"}, "kind = 'click'"),
    "f_eq_null": ({"kind": None}, "kind IS NULL"),
    "f_ne_missing": ({"kind": {"$ne": "click"}}, "kind IS DISTINCT FROM 'click'"),
    "f_ne_null": ({"kind": {"$ne": None}}, "kind IS NOT NULL"),
    "f_gt": ({"value": {"$gt": 50.5}}, "value > 50.5"),
    "f_gte": ({"user_id": {"$gte": 100}}, "user_id >= 100"),
    "f_lt": ({"value": {"$lt": 10}}, "value < 10"),
    "f_lte": ({"user_id": {"$lte": 20}}, "user_id <= 20"),
    "f_in": ({"kind": {"$in": ["click", "view", 5]}}, "kind IN ('click', 'view')"),
    "f_in_null": ({"kind": {"$in": ["click", None]}}, "kind = 'click' OR kind IS NULL"),
    "f_nin_missing": ({"kind": {"$nin": ["click", "view"]}}, "kind IS NULL OR kind NOT IN ('click', 'view')"),
    "f_exists": ({"kind": {"$exists": True}}, "kind IS NOT NULL"),
    "f_not_exists": ({"kind": {"$exists": False}}, "kind IS NULL"),
    "f_no_such_field": ({"nowhere": {"$ne": 1}, "user_id": {"$lt": 9}}, "user_id < 9"),
    "f_other_type": ({"kind": {"$gte": 5}}, "false"),
    "f_regex": ({"kind": {"$regex": "^(cl|vi)"}}, "regexp_matches(kind, '^(cl|vi)')"),
    "f_regex_i": ({"kind": {"$regex": "CLICK$", "$options": "i"}}, "regexp_matches(kind, '(?i)CLICK$')"),
    "f_and": ({"$and": [{"kind": "click"}, {"value": {"$gt": 20}}]}, "kind = 'click' AND value > 20"),
    "f_or": ({"$or": [{"kind": "click"}, {"user_id": {"$lt": 10}}]}, "coalesce(kind = 'click', false) OR user_id < 10"),
    "f_or_empty": ({"$or": []}, "false"),
    "f_not": ({"$not": {"kind": "click"}}, "NOT coalesce(kind = 'click', false)"),
    "f_implicit_and": ({"kind": "view", "user_id": {"$gte": 50}}, "kind = 'view' AND user_id >= 50"),
    "f_range": ({"user_id": {"$gte": 30, "$lt": 40}}, "user_id >= 30 AND user_id < 40"),
    "f_nested_logic": ({"$not": {"$or": [{"kind": {"$in": ["click", "view"]}}, {"$and": [{"value": {"$lt": 30}}, {"kind": {"$exists": False}}]}]}}, "NOT (coalesce(kind IN ('click', 'view'), false) OR (value < 30 AND kind IS NULL))"),
    "f_siblings": ({"$or": [{"kind": "click"}, {"kind": "view"}], "user_id": {"$lt": 25}}, "coalesce(kind IN ('click', 'view'), false) AND user_id < 25"),
    "f_path": ({"props.k": {"$gte": 50}}, "CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50"),
    "f_path_missing": ({"props.none": {"$exists": False}, "props.k": {"$lt": 5}}, "CAST(json_extract_string(props, '$.k') AS BIGINT) < 5"),
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id").withColumn("kind", F.expr("nullif(event_type, 'error')"))


EVENTS_SQL = "(SELECT *, nullif(event_type, 'error') AS kind FROM events)"

for _name, (_spec, _sql) in FILTERS.items():
    add(_name, lambda spark, sf_dir, spec=_spec: find.where(events(spark, sf_dir), spec).select("event_id", "kind", "value"), f"SELECT event_id, kind, value FROM {EVENTS_SQL} WHERE {_sql}")


@query("SELECT vec_id, label FROM embeddings WHERE embedding[1] > 0.1")
def f_array_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.where(table(spark, sf_dir, "embeddings"), {"embedding.0": {"$gt": 0.1}}).select("vec_id", "label")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND regexp_matches(c_name, '7$') AND c_acctbal >= 0")
def f_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = And((Regex("c_name", "7$"), Compare("gte", "c_acctbal", 0), find.parse_filter({"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}})))
    return find.where(table(spark, sf_dir, "customer"), node).select("c_custkey")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) <> 7")
def f_dynamic_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("doc"))
    return find.where(docs, {"k": {"$ne": 7}}, variant="doc").select("event_id")


@query("SELECT event_id, props LIKE '%k%' AS has_k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 20")
def f_dynamic_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").select("event_id", "props", F.parse_json("props").alias("doc"))
    return find.where(docs, {"k": {"$gte": 10, "$lte": 20}}, variant="doc").select("event_id", F.expr("props like '%k%'").alias("has_k"))


@query("""
SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS DISTINCT FROM 1""")
def f_sparse_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return find.where(docs, {"quality": {"$ne": 1}}).select("doc_id")


ORDERS = "SELECT CAST(o_orderkey AS VARCHAR) AS _id, * FROM orders"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_orderkey")


@query(f"SELECT _id, o_totalprice FROM ({ORDERS}) WHERE o_orderstatus = 'F'")
def p_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find(orders(spark, sf_dir), {"filter": {"o_orderstatus": "F"}, "projection": {"o_totalprice": 1}})


@query("SELECT o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def p_id_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find(orders(spark, sf_dir), {"filter": {"o_orderstatus": "F"}, "projection": {"o_totalprice": True, "_id": 0}})


@query(f"SELECT _id, o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM ({ORDERS}) WHERE o_orderstatus = 'P'")
def p_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find(orders(spark, sf_dir), {"filter": {"o_orderstatus": "P"}, "projection": {"o_totalprice": 0, "o_orderpriority": False}})


@query(f"SELECT _id, o_orderpriority, o_totalprice FROM ({ORDERS}) ORDER BY o_orderpriority NULLS FIRST, o_totalprice DESC NULLS LAST, _id LIMIT 500")
def o_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find(orders(spark, sf_dir), {"sort": {"o_orderpriority": 1, "o_totalprice": "desc"}, "limit": 500, "projection": {"o_orderpriority": 1, "o_totalprice": 1}})


@query(f"SELECT event_id, kind FROM {EVENTS_SQL} ORDER BY kind ASC NULLS FIRST, CAST(event_id AS VARCHAR) LIMIT 300")
def o_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find(events(spark, sf_dir), {"sort": {"kind": "ascending"}, "limit": 300}).select("event_id", "kind")


@query(f"SELECT event_id, kind FROM {EVENTS_SQL} ORDER BY kind DESC NULLS LAST, CAST(event_id AS VARCHAR) LIMIT 300")
def o_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find(events(spark, sf_dir), {"sort": {"kind": -1}, "limit": 300}).select("event_id", "kind")


@query(f"SELECT _id FROM ({ORDERS}) ORDER BY o_orderdate NULLS FIRST, _id LIMIT 50 OFFSET 100")
def o_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find(orders(spark, sf_dir), {"sort": {"o_orderdate": 1}, "skip": 100, "limit": 50, "projection": {"_id": 1}})


@query("SELECT o_orderkey FROM orders LIMIT 0")
def o_limit_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find(orders(spark, sf_dir), {"limit": 0}).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 100")
def o_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"l_extendedprice": -1, "l_orderkey": 1, "l_linenumber": 1}
    return find.find(table(spark, sf_dir, "lineitem"), {"sort": keys, "limit": 100, "projection": {k: 1 for k in keys}})


@query(f"SELECT _id, o_orderkey, o_totalprice FROM ({ORDERS}) WHERE o_orderstatus = 'O' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC NULLS LAST, _id LIMIT 4 OFFSET 3")
def find_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find(orders(spark, sf_dir), {"filter": {"o_orderstatus": "O", "o_totalprice": {"$gte": 100000}}, "projection": {"o_orderkey": 1, "o_totalprice": 1}, "sort": {"o_totalprice": -1}, "skip": 3, "limit": 4})


@query(f"SELECT _id, o_custkey FROM ({ORDERS}) WHERE _id = '100'")
def find_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.get(orders(spark, sf_dir), "100").select("_id", "o_custkey")
