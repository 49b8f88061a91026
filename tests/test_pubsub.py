import pytest

from docquarry.streaming import pubsub

CHANNELS = ["user.created", "user.deleted", "order.created", "order.1.status", "order.2.status", "user.x", "user.y", "other", "xorder"]


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([(i, c, "p" * i) for i, c in enumerate(CHANNELS)], "id long, channel string, payload string").cache()


def test_exact(spark, messages):
    subs = spark.createDataFrame([(1, "other"), (2, "other"), (3, "other"), (1, "none")], "subscriber_id long, channel string")
    assert pubsub.exact(messages, subs).count() == 3
    again = pubsub.subscribe(subs, subs.limit(2))
    assert again.count() == 4 and pubsub.unsubscribe(subs, subs.limit(1)).count() == 3 and pubsub.remove_subscriber(subs, 1).count() == 2
    back = {r.id: r.delivered for r in pubsub.delivered(messages, pubsub.exact(messages, subs)).collect()}
    assert back == {i: 3 if c == "other" else 0 for i, c in enumerate(CHANNELS)}


def test_patterns(spark, messages):
    pats = spark.createDataFrame([(1, "user.*"), (2, "*.created"), (3, "order.*.status"), (4, "other"), (5, "oth?r"), (5, "oth?r"), (6, "zzz*"), (7, "")], "subscriber_id long, pattern string")
    n = {r.subscriber_id: r["count"] for r in pubsub.by_pattern(messages, pats).groupBy("subscriber_id").count().collect()}
    assert n == {1: 4, 2: 2, 3: 2, 4: 1, 5: 2}


def test_queues_drop_the_oldest(spark, messages):
    pats = spark.createDataFrame([(1, "user.*"), (2, "other")], "subscriber_id long, pattern string")
    d = pubsub.by_pattern(messages, pats)
    assert sorted((r.subscriber_id, r.id) for r in pubsub.queues(d, 2).collect()) == [(1, 5), (1, 6), (2, 7)]
    assert sorted(tuple(r) for r in pubsub.dropped(d, 2).collect()) == [(1, 4, 2), (2, 1, 0)]
    subs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "subscriber_id long, channel string")
    assert tuple(pubsub.statistics(messages, subs, d, 2).first()) == (2, 3, 9, 5, 2)


def test_size_limit(spark):
    df = spark.createDataFrame([(1, "x" * pubsub.MAX_BYTES), (2, "x" * (pubsub.MAX_BYTES + 1))], "id long, payload string")
    assert [r.id for r in pubsub.acceptable(df).collect()] == [1]


def test_stream_fan_out_and_queue(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, src = "id long, channel string, payload string", str(tmp_path / "src")
    subs = spark.createDataFrame([(1, "a"), (2, "a")], "subscriber_id long, channel string")
    seen = []
    for first in (0, 4):
        spark.createDataFrame([(first + i, "a", "x") for i in range(4)], schema).coalesce(1).write.mode("append").parquet(src)
        stream = pubsub.exact(spark.readStream.schema(schema).parquet(src), subs)
        q = pubsub.queue_stream(stream, 3).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: seen.append(sorted(map(tuple, b.collect())))).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    seen = [s for s in seen if s]
    assert seen == [[(1, 3, 1, 3, 1), (2, 3, 1, 3, 1)], [(1, 3, 5, 7, 5), (2, 3, 5, 7, 5)]]
