"""Changelogs folded into collections: replay, point-in-time recovery, integrity, replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.sources.exchange import body
from docquarry.sources.shared import remove

#: Operations that concern documents; entries behind which a replica takes a snapshot instead; seconds between heartbeats.
DOCUMENT_OPS, FULL_SYNC_LAG, HEARTBEAT_SECONDS = ("insert", "update", "delete"), 10_000, 30


def replay(base: DataFrame | None, log: DataFrame, fields: list[str], since: int = 0) -> DataFrame:
    """(collection, doc_id, fields...) after the entries of log from sequence `since` on, over base (the same columns).

    log: sequence, op, collection, doc_id and a column for each field (null: unchanged by an update). An insert puts the
    document, an update merges its fields if the document is there, a delete removes it, drop removes a collection. One
    aggregation by document finds the last entry that sets it anew; fields then take their last value since.
    """
    keys = ["collection", "doc_id"]
    entries = log.where(F.col("sequence") >= since).select("sequence", "op", *keys, *fields)
    if base is not None:
        entries = entries.unionByName(base.select(F.lit(-1).cast("long").alias("sequence"), F.lit("insert").alias("op"), *keys, *fields))
    docs = entries.where(F.col("op").isin(*DOCUMENT_OPS))
    drops = entries.where("op = 'drop'").groupBy("collection").agg(F.max("sequence").alias("dropped"))
    resets = docs.where("op in ('insert', 'delete')").groupBy(*keys).agg(F.max(F.struct("sequence", "op")).alias("reset"))
    resets = resets.where("reset.op = 'insert'").select(*keys, F.col("reset.sequence").alias("start"))
    alive = resets.join(drops, "collection", "left").where(F.col("dropped").isNull() | (F.col("start") > F.col("dropped"))).drop("dropped")
    since_start = docs.join(alive, keys).where(F.col("sequence") >= F.col("start"))
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("sequence"))).alias(f) for f in fields]
    return since_start.groupBy(*keys).agg(*last)


def replay_statistics(log: DataFrame, since: int = 0) -> DataFrame:
    """replayed, skipped (before since) and last_sequence of a replay."""
    late = F.col("sequence") >= since
    return log.agg(F.count(F.when(late, 1)).alias("replayed"), F.count(F.when(~late, 1)).alias("skipped"), F.coalesce(F.max("sequence"), F.lit(0)).alias("last_sequence"))


def recover(base: DataFrame | None, log: DataFrame, fields: list[str], target: Column, since: int = 0) -> DataFrame:
    """The state as of a time: base (a snapshot up to `since`) and the entries after it whose timestamp is not past the target."""
    return replay(base, log.where(F.col("timestamp") <= target), fields, since)


def recover_checked(base: DataFrame | None, log: DataFrame, fields: list[str], target: Column, since: int = 0) -> DataFrame:
    """recover(), but for a log whose timestamps go back or whose sequence doesn't grow among the entries to apply: ValueError."""
    wrong = irregular(log.where((F.col("sequence") >= since) & (F.col("timestamp") <= target))).orderBy("sequence").first()
    if wrong:
        raise ValueError(f"entry {wrong.sequence} breaks the log's order ({wrong.problem})")
    return recover(base, log, fields, target, since)


def irregular(log: DataFrame) -> DataFrame:
    """Entries that break the order of a log: sequence not above the one before, or timestamp below it, with what is wrong.

    Neighbours are compared within stretches of sequence numbers of bounded length; each stretch also sees the last entry before it.
    """
    step = 100_000
    parts = log.select("sequence", "timestamp").withColumn("part", F.floor(F.col("sequence") / step))
    ends = parts.groupBy("part").agg(F.max(F.struct("sequence", "timestamp")).alias("e"))
    ends = ends.select((F.lead("part").over(Window.orderBy("part"))).alias("part"), "e.sequence", "e.timestamp").where("part is not null")
    both = parts.withColumn("own", F.lit(True)).unionByName(ends.select("sequence", "timestamp", "part").withColumn("own", F.lit(False)))
    w = Window.partitionBy("part").orderBy("sequence", F.col("own"), "timestamp")
    both = both.withColumn("before", F.lag("sequence").over(w)).withColumn("earlier", F.lag("timestamp").over(w)).where("own")
    problem = F.when(F.col("sequence") <= F.col("before"), "sequence").when(F.col("timestamp") < F.col("earlier"), "timestamp")
    return both.withColumn("problem", problem).where("problem is not null").select("sequence", "timestamp", "problem")


def missing_entries(log: DataFrame, applied: int, limit: int | None = None) -> DataFrame:
    """What a replica at sequence `applied` lacks, in order."""
    out = log.where(F.col("sequence") > applied).orderBy("sequence")
    return out if limit is None else out.limit(limit)


def received(sealed: DataFrame, applied: int) -> DataFrame:
    """Entries of a sealed log (with checksum) after `applied`, with intact."""
    return sealed.where(F.col("sequence") > applied).withColumn("intact", F.crc32(body(sealed).cast("binary")) == F.col("checksum"))


def acknowledged(sealed: DataFrame, applied: int) -> DataFrame:
    """One row: what a replica at `applied` acknowledges, the last entry before the first damaged one; applied (entries), rejected."""
    got = received(sealed, applied)
    first = got.where("not intact").agg(F.min("sequence").alias("bad"))
    # One row joins one row's worth of figures: the first damaged sequence is a scalar.
    bad = F.coalesce(first.scalar(), F.lit(2**63 - 1))
    good = F.col("sequence") < bad
    return got.agg(F.coalesce(F.max(F.when(good, F.col("sequence"))), F.lit(applied)).cast("long").alias("ack"), F.count(F.when(good, 1)).alias("applied"), F.count(F.when(~F.col("intact"), 1)).alias("rejected"))


def heartbeat(log: DataFrame, now: Column) -> DataFrame:
    """One row that a primary sends: its last sequence (0 without entries) and the time."""
    return log.agg(F.coalesce(F.max("sequence"), F.lit(0)).cast("long").alias("sequence")).withColumn("sent_at", now)


def silent(replicas: DataFrame, now: Column, every_seconds: int = HEARTBEAT_SECONDS, missed: int = 3) -> DataFrame:
    """replicas (replica_id, last_seen) that have been silent for more than `missed` heartbeats."""
    return replicas.where(F.timestamp_diff("SECOND", F.col("last_seen"), now) > every_seconds * missed)


def needs_full_sync(log: DataFrame, applied: int) -> DataFrame:
    """One row: lag in entries, and whether a snapshot is due (too far behind, or the log no longer reaches back)."""
    out = log.agg(F.max("sequence").alias("top"), F.min("sequence").alias("low"))
    lag = F.greatest(F.coalesce(F.col("top"), F.lit(applied)) - applied, F.lit(0))
    return out.select(lag.alias("lag"), ((lag > FULL_SYNC_LAG) | (F.coalesce(F.col("low"), F.lit(0)) > applied + 1)).alias("full_sync"))


def lag_ms(log: DataFrame, now: Column) -> DataFrame:
    """Milliseconds since the last applied entry (timestamp), 0 at least; 0 for an empty log."""
    behind = F.timestamp_diff("MILLISECOND", F.max("timestamp"), now)
    return log.agg(F.greatest(F.lit(0), F.coalesce(behind, F.lit(0))).cast("long").alias("lag_ms"))


def follow(stream: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Replicate a stream of entries: each batch is appended to the replica's log at target, once whatever is retried."""

    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def last_writes(queue: DataFrame, keys: list[str], due: Column | None = None) -> DataFrame:
    """Of queued writes (keys..., seq, ts, ...), the last of each key among those that are due: what a flush stores."""
    if due is not None:
        queue = queue.where(F.col("ts") <= due)
    others = [c for c in queue.columns if c not in keys]
    return queue.groupBy(*keys).agg(F.max_by(F.struct(*others), "seq").alias("w")).select(*keys, "w.*")


def write_behind(stream: DataFrame, target: str, checkpoint: str, keys: list[str], delay: str = "0 seconds", available_now: bool = True) -> StreamingQuery:
    """Flush queued writes (keys..., seq, ts, ...) to target: per batch the last write of each key older than the delay.

    Writes that are not yet due wait in a table beside the checkpoint and are looked at again with the next batch; a rate source
    beats once a second, so that batches go on where no writes come in. With available_now the run ends with the data: what is not
    due by then waits for the next run. A batch that is tried again overwrites its own files and reads those of the one before.
    """
    spark, schema = stream.sparkSession, stream.schema
    waiting = f"{checkpoint}-waiting"

    def flush(batch: DataFrame, epoch: int) -> None:
        queue = batch
        if epoch > 0:
            queue = batch.unionByName(spark.read.schema(schema).parquet(f"{waiting}/epoch={epoch - 1}"))
        limit = spark.sql(f"select cast(current_timestamp() as timestamp_ntz) - interval {delay} as t").first().t
        ready = F.col("ts") <= F.lit(limit).cast("timestamp_ntz")
        queue = queue.persist()
        last_writes(queue.where(ready), keys).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")
        queue.where(~F.coalesce(ready, F.lit(False))).write.mode("overwrite").parquet(f"{waiting}/epoch={epoch}")
        queue.unpersist()
        if epoch > 1:
            remove(spark, f"{waiting}/epoch={epoch - 2}")

    if available_now:
        return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where("false")
    beat = beat.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    return stream.unionByName(beat).writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(processingTime="50 milliseconds").start()


def idle_sessions(sessions: DataFrame, now: Column, timeout_seconds: int) -> DataFrame:
    """Sessions (session_id, last_active) idle for longer than the timeout."""
    return sessions.where(F.timestamp_diff("SECOND", F.col("last_active"), now) > timeout_seconds)
