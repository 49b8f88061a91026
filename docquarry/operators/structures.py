"""Lists, sets, sorted sets, hashes, expiry and eviction over keyed tables.

list (key, pos, value) · set (key, member) · zset (key, member, score) · hash (key, field, value) ·
entries (key, size_bytes, last_accessed, access_count, expires_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.sources.shared import cut
from docquarry.functions.values import spare

#: Bytes that a structure counts besides its payload, a member's score, and the margin that eviction frees beyond need.
OVERHEAD, SCORE, ITEM, MARGIN = 16, 8, 8, 1.2


# Lists

def push(items: DataFrame, new: DataFrame, left: bool = False) -> DataFrame:
    """items with the rows of new (key, seq, value) put at an end in the order of seq, each further out than the one before."""
    ends = items.groupBy("key").agg((F.min("pos") if left else F.max("pos")).alias("end"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    placed = new.withColumn("rank", rank).join(ends, "key", "left")
    pos = F.coalesce(F.col("end"), F.lit(0 if left else -1)) + (-F.col("rank") if left else F.col("rank"))
    return items.select("key", "pos", "value").unionByName(placed.select("key", pos.cast("long").alias("pos"), "value"))


def ranked(items: DataFrame) -> DataFrame:
    """items with index (from 0) and n, the list's length."""
    whole = Window.partitionBy("key")
    return items.withColumn("index", F.row_number().over(whole.orderBy("pos")) - 1).withColumn("n", F.count(F.lit(1)).over(whole))


def popped(items: DataFrame, left: bool = True) -> DataFrame:
    """(key, value) of the outermost item of each list."""
    end = F.min_by("value", "pos") if left else F.max_by("value", "pos")
    return items.groupBy("key").agg(end.alias("value"))


def without_end(items: DataFrame, left: bool = True) -> DataFrame:
    """items after a pop of each list."""
    end = items.groupBy("key").agg((F.min("pos") if left else F.max("pos")).alias("pos"))
    return items.join(end, ["key", "pos"], "left_anti")


def at_index(items: DataFrame, index: int) -> DataFrame:
    """(key, value) at an index; negative ones count from the tail. Lists that are too short have no row."""
    place = F.lit(index) if index >= 0 else F.col("n") + index
    return ranked(items).where(F.col("index") == place).select("key", "value")


def bounds(start: int, stop: int, n: Column) -> tuple[Column, Column]:
    """start and stop (both inclusive, negative from the tail) as indices within a length."""
    low = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    high = F.lit(stop) if stop >= 0 else n + stop
    return low, F.least(high, n - 1)


def list_range(items: DataFrame, start: int, stop: int) -> DataFrame:
    """(key, index, value) from start to stop."""
    low, high = bounds(start, stop, F.col("n"))
    return ranked(items).where((F.col("index") >= low) & (F.col("index") <= high)).select("key", "index", "value")


def lengths(items: DataFrame) -> DataFrame:
    """(key, n): items of a list, members of a set or sorted set, or fields of a hash."""
    return items.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


# Sets

def add_members(members: DataFrame, new: DataFrame) -> DataFrame:
    return members.select("key", "member").union(new.select("key", "member")).distinct()


def remove_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone.select("key", "member"), ["key", "member"], "left_anti")


def is_member(members: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key, member) with is_member."""
    have = members.select("key", "member").distinct().withColumn("is_member", F.lit(True))
    return asked.join(have, ["key", "member"], "left").fillna(False, ["is_member"])


def cardinality(members: DataFrame) -> DataFrame:
    return members.groupBy("key").agg(F.countDistinct("member").alias("n"))


def combined(members: DataFrame, keys: list[str], how: str) -> DataFrame:
    """The union, intersection or difference (of the first with all others) of sets, as (member): one aggregation over their rows."""
    own = members.where(F.col("key").isin(keys)).groupBy("member").agg(F.countDistinct("key").alias("n"), F.max((F.col("key") == keys[0]).cast("int")).alias("first"))
    if how == "inter":
        own = own.where(F.col("n") == len(set(keys)))
    elif how == "diff":
        own = own.where("first = 1 and n = 1")
    elif how != "union":
        raise ValueError(f"no set operation {how}")
    return own.select("member")


# Sorted sets

def set_scores(scores: DataFrame, log: DataFrame) -> DataFrame:
    """scores after a log (key, member, score, seq): the last score of a member counts."""
    base = scores.select("key", "member", "score", F.lit(-1).cast("long").alias("seq"))
    every = base.unionByName(log.select("key", "member", "score", F.col("seq").cast("long").alias("seq")))
    return every.groupBy("key", "member").agg(F.max_by("score", "seq").alias("score"))


def by_rank(scores: DataFrame, start: int, stop: int) -> DataFrame:
    """(key, rank, member, score) with rank from start to stop, by score and then member. Ranks from the head are cut off before the
    shuffle; only ranks from the tail need each set's size."""
    whole = Window.partitionBy("key")
    place = F.row_number().over(whole.orderBy("score", "member"))
    if start >= 0 and stop >= 0:
        out = scores.withColumn("place", place).where(F.col("place") <= stop + 1).withColumn("rank", F.col("place") - 1)
        return out.where(F.col("rank") >= start).select("key", "rank", "member", "score")
    out = scores.withColumn("rank", place - 1).withColumn("n", F.count(F.lit(1)).over(whole))
    low, high = bounds(start, stop, F.col("n"))
    return out.where((F.col("rank") >= low) & (F.col("rank") <= high)).select("key", "rank", "member", "score")


def remove_scores(scores: DataFrame, gone: DataFrame) -> DataFrame:
    """scores without the members of gone (key, member); members that aren't there change nothing."""
    return scores.join(gone.select("key", "member").distinct(), ["key", "member"], "left_anti").select(*scores.columns)


def by_score(scores: DataFrame, low: float, high: float) -> DataFrame:
    """Members with low <= score <= high, in order."""
    return scores.where(F.col("score").between(low, high)).orderBy("key", "score", "member")


# Hashes

def set_fields(fields: DataFrame, log: DataFrame) -> DataFrame:
    """fields after a log (key, field, value, seq, deleted): the last entry of a field counts."""
    base = fields.select("key", "field", "value", F.lit(-1).cast("long").alias("seq"), F.lit(False).alias("deleted"))
    every = base.unionByName(log.select("key", "field", "value", F.col("seq").cast("long").alias("seq"), "deleted"))
    last = every.groupBy("key", "field").agg(F.max_by(F.struct("value", "deleted"), "seq").alias("last"))
    return last.where("not last.deleted").select("key", "field", "last.value")


def as_map(fields: DataFrame) -> DataFrame:
    """(key, fields): all of a hash as a map in the order of its field names. A hash is one row, so it should fit one."""
    return fields.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))


# Sizes, expiry, eviction

def structure_bytes(rows: DataFrame, columns: list[str], extra: int = 0) -> DataFrame:
    """(key, bytes): the bytes of the named text columns, extra a row, and OVERHEAD."""
    one = sum((F.octet_length(c) for c in columns), F.lit(extra))
    return rows.groupBy("key").agg((F.sum(one) + OVERHEAD).cast("long").alias("bytes"))


def live(entries: DataFrame, now: Column) -> DataFrame:
    """Entries that have not expired: an entry is gone once its time has come."""
    return entries.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def expired(entries: DataFrame, now: Column) -> DataFrame:
    return entries.where(F.col("expires_at") <= now)


def remaining_seconds(now: Column) -> Column:
    """Whole seconds until expiry, -1 for entries that stay."""
    left = F.timestamp_diff("SECOND", now, F.col("expires_at"))
    return F.when(F.col("expires_at").isNull(), F.lit(-1)).otherwise(F.greatest(F.lit(0), left)).cast("long")


def due(now: Column, ttl_seconds: int | None) -> Column:
    """When an entry written now expires; null for never."""
    return F.lit(None).cast("timestamp_ntz") if ttl_seconds is None else (now + F.make_dt_interval(secs=F.lit(ttl_seconds))).cast("timestamp_ntz")


def put(entries: DataFrame, new: DataFrame, now: Column, ttl_seconds: int | None = None) -> DataFrame:
    """entries with new (key, size_bytes) written now: each replaces its key's entry and starts with no access; of rows that
    repeat a key the largest stays."""
    written = new.groupBy("key").agg(F.max("size_bytes").alias("size_bytes"))
    written = written.select("key", "size_bytes", now.alias("last_accessed"), F.lit(0).cast("long").alias("access_count"), due(now, ttl_seconds).alias("expires_at"))
    return removed(entries, new).unionByName(written, allowMissingColumns=True)


def read(entries: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(entries after, asked (key) with hit): expired entries go first; each time a key is asked for counts as an access now."""
    alive = live(entries, now)
    wanted = asked.groupBy("key").agg(F.count(F.lit(1)).alias("_asked"))
    out = alive.join(wanted, "key", "left").withColumn("access_count", F.col("access_count") + F.coalesce("_asked", F.lit(0)))
    out = out.withColumn("last_accessed", F.when(F.col("_asked").isNull(), F.col("last_accessed")).otherwise(now)).select(*entries.columns)
    have = alive.select("key").distinct().withColumn("hit", F.lit(True))
    return out, asked.join(have, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def removed(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """entries without those of keys (key)."""
    return entries.join(keys.select("key").distinct(), "key", "left_anti").select(*entries.columns)


def exists(entries: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """asked (key) with exists: there is an entry that has not expired."""
    return read(entries, asked, now)[1].withColumnRenamed("hit", "exists")


def cleared(entries: DataFrame) -> DataFrame:
    return entries.limit(0)


def expire(entries: DataFrame, keys: DataFrame, now: Column, ttl_seconds: int | None) -> DataFrame:
    """entries in which those of keys (key) expire ttl_seconds from now; None: never (persist)."""
    marked = keys.select("key").distinct().withColumn("_new", F.lit(True))
    out = entries.join(marked, "key", "left")
    return out.withColumn("expires_at", F.when(F.col("_new"), due(now, ttl_seconds)).otherwise(F.col("expires_at"))).select(*entries.columns)


def time_left(entries: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """asked (key) with ttl: whole seconds until expiry, -1 for entries that stay, null where there is none."""
    return asked.join(entries.select("key", remaining_seconds(now).alias("ttl")), "key", "left").select("key", "ttl")


#: Which entries go first.
POLICIES = {
    "lru": lambda: [F.col("last_accessed").asc(), F.col("key")],
    "lfu": lambda: [F.col("access_count").asc(), F.col("key")],
    "ttl": lambda: [F.col("expires_at").asc_nulls_last(), F.col("key")],
}


def victims(entries: DataFrame, policy: str, need_bytes: float) -> DataFrame:
    """The entries that go, in the policy's order, until need_bytes are freed. "none" evicts nothing, and fails if bytes are needed.

    The running sum is over range partitions: sums of the partitions before are added to sums within, so no task holds all entries.
    Entries with equal keys have no order among them.
    """
    if policy == "none":
        if need_bytes > 0:
            raise MemoryError("the cache is full")
        return entries.limit(0)
    return running_before(entries, POLICIES[policy](), "size_bytes").where(F.col("before") < need_bytes).drop("before")


def running_before(df: DataFrame, keys: list[Column], size: str) -> DataFrame:
    """df with before: the sum of size over the rows that precede in the order of keys (which tell rows apart).

    Rows are dealt into ranges once, in a table that keeps each row's range: planned twice, two shuffles could draw different
    bounds, or have their ranges merged differently.
    """
    part, inside, total, base = spare(df, "part", "in", "sum", "base")
    spans = cut(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "ranges")
    inner = Window.partitionBy(part).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    parts = spans.groupBy(part).agg(F.sum(size).alias(total))
    # One row a range: as many as there are partitions.
    outer = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(part, F.coalesce(F.sum(total).over(outer), F.lit(0)).alias(base))
    spans = spans.withColumn(inside, F.coalesce(F.sum(size).over(inner), F.lit(0)))
    return spans.join(bases, part).withColumn("before", F.col(inside) + F.col(base)).drop(part, inside, base)


def needed_bytes(used: int, incoming: int, capacity: int) -> float:
    """Bytes to free for an entry: what is over capacity, with a margin."""
    over = used + incoming - capacity
    return over * MARGIN if over > 0 else 0.0


def share_to_evict(used: int, share: float) -> float:
    return used * min(max(share, 0.0), 1.0)


def cache_statistics(accesses: DataFrame) -> DataFrame:
    """Of accesses (hit boolean): hits, misses, hit_rate (0 without accesses)."""
    out = accesses.agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return out.withColumn("hit_rate", F.when(total == 0, 0.0).otherwise(F.col("hits") / F.greatest(total, F.lit(1))))


def storage_operations(counters: DataFrame) -> DataFrame:
    """counters (hits, misses, writes, stored_reads, stored_writes) with hit_rate (0 without lookups) and total, the sum of all."""
    lookups = F.col("hits") + F.col("misses")
    out = counters.withColumn("hit_rate", F.when(lookups == 0, 0.0).otherwise(F.col("hits") / F.greatest(lookups, F.lit(1))))
    return out.withColumn("total", lookups + F.col("writes") + F.col("stored_reads") + F.col("stored_writes"))


def arena_use(arenas: DataFrame) -> DataFrame:
    """arenas (total_size, current_offset, allocated_bytes) with utilization (allocated of total) and fragmentation (what of the
    bytes up to the offset is not allocated); 0 where there is nothing to divide by."""
    share = lambda whole: F.col("allocated_bytes") / F.nullif(F.col(whole), F.lit(0))
    out = arenas.withColumn("utilization", F.coalesce(share("total_size"), F.lit(0.0)))
    return out.withColumn("fragmentation", F.coalesce(1.0 - share("current_offset"), F.lit(0.0)))
