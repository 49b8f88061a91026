"""Aggregation pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.pipeline import aggregate
from docquarry.queries.base import query, table
from docquarry.queries.filters import EVENTS_SQL, events


def rounded(df: DataFrame, *names: str, places: int = 2) -> DataFrame:
    """df with doubles rounded: sums depend on their order in the last digits."""
    return df.withColumns({n: F.round(n, places) for n in names})


FLAGSHIP = [
    {"$match": {"l_quantity": {"$gte": 5}, "l_discount": {"$lt": 0.09}}},
    {"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "total": {"$sum": "$l_extendedprice"}, "n": {"$count": {}}, "mean": {"$avg": "l_quantity"}, "low": {"$min": "l_discount"}, "high": {"$max": "l_tax"}}},
    {"$sort": {"total": -1}},
    {"$limit": 10},
]


@query("""
SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_extendedprice), 2) AS total, count(*) AS n, round(avg(l_quantity), 6) AS mean,
       min(l_discount) AS low, max(l_tax) AS high
FROM lineitem WHERE l_quantity >= 5 AND l_discount < 0.09 GROUP BY 1, 2 ORDER BY total DESC LIMIT 10""")
def pl_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate(table(spark, sf_dir, "lineitem"), FLAGSHIP)
    return rounded(out.select("_id.flag", "_id.status", "total", "n", "mean", "low", "high"), "total").withColumn("mean", F.round("mean", 6))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05 AND l_returnflag IN ('A', 'R') AND l_linestatus = 'F'")
def m_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(table(spark, sf_dir, "lineitem"), [{"$match": {"l_quantity": {"$gt": 45}, "l_discount": {"$gte": 0.05}, "l_returnflag": {"$in": ["A", "R"]}, "l_linestatus": "F"}}, {"$project": {"l_orderkey": 1, "l_linenumber": 1}}])


@query(f"SELECT event_id FROM {EVENTS_SQL} WHERE kind <> 'click'")
def m_ne_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(events(spark, sf_dir), [{"$match": {"kind": {"$ne": "click"}}}]).select("event_id")


@query("SELECT event_id FROM events WHERE user_id >= 30")
def m_strict_first_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(events(spark, sf_dir), [{"$match": {"user_id": {"$gte": 30, "$lte": 40}}}], strict=True).select("event_id")


@query("SELECT event_type AS _id, count(*) AS n FROM events GROUP BY 1")
def g_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(events(spark, sf_dir), [{"$group": {"_id": "$event_type", "n": {"$count": {}}}}])


@query("SELECT o_orderpriority AS _id, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def g_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate(table(spark, sf_dir, "orders"), [{"$group": {"_id": "$o_orderpriority", "total": {"$sum": "$o_totalprice"}}}]), "total")


@query("SELECT c_mktsegment AS _id, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1")
def g_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate(table(spark, sf_dir, "customer"), [{"$group": {"_id": "$c_mktsegment", "mean": {"$avg": "c_acctbal"}}}]), "mean", places=6)


@query("SELECT p_brand AS _id, CAST(min(p_size) AS DOUBLE) AS low FROM part GROUP BY 1")
def g_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(table(spark, sf_dir, "part"), [{"$group": {"_id": "$p_brand", "low": {"$min": "p_size"}}}])


@query("SELECT p_brand AS _id, CAST(max(p_retailprice) AS DOUBLE) AS high FROM part GROUP BY 1")
def g_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(table(spark, sf_dir, "part"), [{"$group": {"_id": "$p_brand", "high": {"$": "max", "value": "$p_retailprice"}}}])


@query("SELECT n_regionkey AS _id, CAST(0 AS DOUBLE) AS text_sum, CAST(0 AS DOUBLE) AS absent, CAST(count(*) AS DOUBLE) AS ones FROM nation GROUP BY 1")
def g_odd_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(table(spark, sf_dir, "nation"), [{"$group": {"_id": "$n_regionkey", "text_sum": {"$sum": "$n_name"}, "absent": {"$max": "nowhere"}, "ones": {"$sum": 1}}}])


@query("SELECT 'all' AS _id, count(*) AS n, round(sum(o_totalprice), 1) AS total FROM orders")
def g_const_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate(table(spark, sf_dir, "orders"), [{"$group": {"_id": "all", "n": {"$count": {}}, "total": {"$sum": "$o_totalprice"}}}]), "total", places=1)


@query(f"SELECT kind AS _id, count(*) AS n FROM {EVENTS_SQL} GROUP BY 1")
def g_missing_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(events(spark, sf_dir), [{"$group": {"_id": "$kind", "n": {"$count": {}}}}])


@query(f"""SELECT CASE WHEN kind IS NULL THEN '$kind' ELSE 'String("' || kind || '")' END AS _id, count(*) AS n FROM {EVENTS_SQL} GROUP BY 1""")
def g_debug_key_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(events(spark, sf_dir), [{"$group": {"_id": "$kind", "n": {"$count": {}}}}], strict=True)


@query("SELECT o_custkey AS _id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def g_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(table(spark, sf_dir, "orders"), [{"$group": {"_id": "$o_custkey", "n": {"$count": {}}}}, {"$match": {"n": {"$gte": 15}}}])


@query("SELECT n AS _id, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def g_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(table(spark, sf_dir, "orders"), [{"$group": {"_id": "$o_custkey", "n": {"$count": {}}}}, {"$group": {"_id": "$n", "customers": {"$count": {}}}}])


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2")
def g_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate(table(spark, sf_dir, "orders"), [{"$group": {"_id": {"status": "$o_orderstatus", "priority": "$o_orderpriority"}, "n": {"$count": {}}}}])
    return out.select("_id.status", "_id.priority", "n")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 10")
def pl_sort_skip_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(table(spark, sf_dir, "customer"), [{"$match": {"c_acctbal": {"$gt": 0}}}, {"$sort": {"c_acctbal": -1, "c_custkey": 1}}, {"$skip": 10}, {"$limit": 20}, {"$project": {"c_custkey": 1, "c_acctbal": 1}}])


@query("SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_orderkey LIMIT 100000")
def pl_many_groups_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate(table(spark, sf_dir, "lineitem"), [{"$group": {"_id": "$l_orderkey", "n": {"$count": {}}}}, {"$sort": {"n": -1, "_id": 1}}, {"$limit": 100000}])
    return out.withColumnRenamed("_id", "l_orderkey")
