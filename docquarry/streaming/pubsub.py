"""Publish and subscribe: fan-out to channels and patterns, bounded queues, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docquarry.functions.values import glob_pattern
from docquarry.session import ship

#: Messages that wait for a subscriber, and bytes that one may have.
CAPACITY, MAX_BYTES = 1000, 1024 * 1024


def subscribe(subs: DataFrame, new: DataFrame) -> DataFrame:
    """(subscriber_id, channel) with new ones; subscribing twice changes nothing."""
    return subs.union(new.select(*subs.columns)).distinct()


def unsubscribe(subs: DataFrame, gone: DataFrame) -> DataFrame:
    return subs.join(gone, subs.columns, "left_anti")


def psubscribe(patterns: DataFrame, new: DataFrame) -> DataFrame:
    """(subscriber_id, pattern) with new ones; subscribing twice to a pattern delivers twice."""
    return patterns.unionByName(new.select(*patterns.columns))


def punsubscribe(patterns: DataFrame, gone: DataFrame) -> DataFrame:
    """Without every subscription of gone's subscribers to gone's patterns."""
    return patterns.join(gone.select(*patterns.columns).distinct(), patterns.columns, "left_anti")


def remove_subscriber(subs: DataFrame, subscriber_id: int) -> DataFrame:
    return subs.where(F.col("subscriber_id") != subscriber_id)


def acceptable(messages: DataFrame) -> DataFrame:
    """Messages within the size that may be published."""
    return messages.where(F.octet_length("payload") <= MAX_BYTES)


def exact(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """(id, channel, subscriber_id) for each subscriber of a message's channel."""
    return messages.join(subs, "channel").select("id", "channel", "subscriber_id")


def matching_channels(channels: DataFrame, patterns: DataFrame) -> DataFrame:
    """(channel, subscriber_id) for each pattern that a channel matches, duplicates included.

    Patterns without wildcards meet channels by equality. The others meet on the text before the first wildcard: a pattern is
    joined with the channels' prefixes of its own length, so a match is looked for among those only.
    """
    globs = patterns.withColumn("prefix", F.regexp_extract("pattern", r"^[^*?.\\\[\](){}+|^$]*", 0)).withColumn("size", F.length("prefix"))
    lengths = globs.select("size").distinct()
    cut = channels.select("channel").distinct().withColumn("size", F.explode(F.sequence(F.lit(0), F.length("channel"))))
    cut = cut.join(lengths, "size", "left_semi").withColumn("prefix", F.expr("left(channel, size)"))
    met = cut.join(globs, ["size", "prefix"])
    return met.where(F.rlike("channel", glob_pattern(F.col("pattern")))).select("channel", "subscriber_id")


def by_pattern(messages: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, channel, subscriber_id) for each pattern that a message's channel matches: patterns are tried once a channel, not a message."""
    return messages.join(matching_channels(messages, patterns), "channel").select("id", "channel", "subscriber_id")


def fan_out(messages: DataFrame, subs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Deliveries by channel and by pattern; who has both gets a message twice."""
    return exact(messages, subs).unionByName(by_pattern(messages, patterns))


def delivered(messages: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(id, delivered): what publishing each message returns."""
    n = deliveries.groupBy("id").agg(F.count(F.lit(1)).alias("delivered"))
    return messages.select("id").join(n, "id", "left").fillna(0, ["delivered"])


def queues(deliveries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Deliveries that are still queued: the last `capacity` of each subscriber, for the oldest are dropped."""
    rank = F.row_number().over(Window.partitionBy("subscriber_id").orderBy(F.desc("id"), "channel"))
    return deliveries.withColumn("rank", rank).where(F.col("rank") <= capacity).drop("rank")


def dropped(deliveries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(subscriber_id, received, dropped)."""
    n = deliveries.groupBy("subscriber_id").agg(F.count(F.lit(1)).alias("received"))
    return n.withColumn("dropped", F.greatest(F.col("received") - capacity, F.lit(0)))


def statistics(messages: DataFrame, subs: DataFrame, deliveries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: channels and subscribers (of exact subscriptions), published, delivered, dropped."""
    one = F.lit(1).alias("_one")
    parts = [
        subs.agg(F.countDistinct("channel").alias("channels"), F.countDistinct("subscriber_id").alias("subscribers")),
        messages.agg(F.count(F.lit(1)).alias("published")),
        dropped(deliveries, capacity).agg(F.coalesce(F.sum("received"), F.lit(0)).alias("delivered"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped")),
    ]
    out = parts[0].select("*", one)
    for p in parts[1:]:
        out = out.join(p.select("*", one), "_one")
    return out.drop("_one")


class BoundedQueue(StatefulProcessor):
    """A subscriber's queue over batches of deliveries: holds the last messages and tells how many were dropped so far."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getListState("ids", "id long")
        self.lost = handle.getValueState("lost", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ids = [r[0] for r in self.ids.get()] if self.ids.exists() else []
        for part in rows:
            ids += sorted(part["id"].tolist())
        lost = (self.lost.get()[0] if self.lost.exists() else 0) + max(0, len(ids) - self.capacity)
        ids = ids[-self.capacity :]
        self.ids.put([(int(i),) for i in ids])
        self.lost.update((int(lost),))
        yield pd.DataFrame({"subscriber_id": [key[0]], "queued": [len(ids)], "oldest": [ids[0]], "newest": [ids[-1]], "dropped": [lost]})

    def close(self) -> None:
        pass


def queue_stream(deliveries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """For a stream of deliveries: (subscriber_id, queued, oldest, newest, dropped) after each batch. Needs the RocksDB state store."""
    ship(deliveries.sparkSession)
    return deliveries.groupBy("subscriber_id").transformWithStateInPandas(BoundedQueue(capacity), "subscriber_id long, queued long, oldest long, newest long, dropped long", "Update", "None")
