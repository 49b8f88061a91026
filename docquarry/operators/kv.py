"""A key-value store over a log of operations (seq, op, key, value, expected_version)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.session import ship

#: Commands that wait on the driver, pairs that a fetch returns, and the collection that stands for the older protocol's keys.
PENDING, FETCH_LIMIT, LEGACY = 1000, 1000, "_legacy_kv"

LOG = "seq long, op string, key string, value string, expected_version long"


class Store:
    """Commands on keys as entries of a log: what is asked is answered from the log's fold, in the order of the commands.

    Entries wait on the driver and become rows of the log at once, PENDING together at most; a log over folder is appended to there,
    so that its plan stays one scan however many commands come.
    """

    def __init__(self, log: DataFrame, folder: str | None = None):
        self.spark, self.folder, self.base = log.sparkSession, folder, log.select(*[c.split()[0] for c in LOG.split(", ")])
        self.seq = log.agg(F.max("seq")).first()[0] or 0
        self.waiting: list[tuple] = []
        self.in_folder = False

    @property
    def log(self) -> DataFrame:
        return self.base.unionByName(self.spark.createDataFrame(self.waiting, LOG)) if self.waiting else self.base

    def _append(self, op: str, key: str, value: str | None = None, expected_version: int | None = None) -> None:
        self.seq += 1
        self.waiting.append((self.seq, op, key, value, expected_version))
        if len(self.waiting) >= PENDING:
            self.store()

    def store(self) -> None:
        """Move waiting entries into the log: to its folder, or into one batch of its plan."""
        if self.waiting and self.folder:
            new = self.spark.createDataFrame(self.waiting, LOG)
            (new if self.in_folder else self.log).write.mode("append").parquet(self.folder)
            self.in_folder, self.base = True, self.spark.read.schema(LOG).parquet(self.folder)
        elif self.waiting:
            self.base = self.log
        self.waiting = []

    def set(self, key: str, value: str) -> None:
        self._append("set", key, value)

    def delete(self, key: str) -> None:
        self._append("del", key)

    def cas(self, key: str, expected_version: int, value: str) -> str:
        """Set the value if the key's version is the one expected; returns ok, version_mismatch or not_found."""
        self._append("cas", key, value, expected_version)
        return replay(self.log.where(F.col("key") == key)).orderBy(F.desc("seq")).first().status

    def get(self, key: str) -> str | None:
        """The value now: the last of the key's folded history, which is all that is read."""
        row = replay(self.log.where(F.col("key") == key)).orderBy(F.desc("seq")).first()
        return row.value if row else None

    def fetch(self, limit: int = FETCH_LIMIT) -> DataFrame:
        """Up to `limit` pairs (key, value), in key order."""
        return current(self.log).orderBy("key").limit(limit)

    def keys(self) -> DataFrame:
        return current(self.log).select("key")


def translated(op: str, key: str | None = None, value: Any = None, expected: Any = None) -> dict[str, Any]:
    """A command of the older protocol as one of the newer: an insert, query, delete or update on the collection LEGACY."""
    at = {"collection": LEGACY}
    if op == "SET":
        return {"op": "insert", **at, "document": {"_id": key, "value": value}}
    if op == "GET":
        return {"op": "query", **at, "filter": {"_id": key}, "limit": 1}
    if op == "DEL":
        return {"op": "delete", **at, "filter": {"_id": key}}
    if op == "CAS":
        return {"op": "update", **at, "filter": {"_id": key, "value": expected}, "update": {"$set": {"value": value}}}
    if op == "FETCH":
        return {"op": "query", **at, "filter": {}, "limit": FETCH_LIMIT}
    raise ValueError(f"no command {op}")


def current(log: DataFrame) -> DataFrame:
    """(key, value) after all operations, compare-and-set included: each key's last state of its fold."""
    last = replay(log).groupBy("key").agg(F.max_by(F.struct("version", "value"), "seq").alias("last"))
    return last.where("last.version is not null").select("key", "last.value")


def latest(log: DataFrame) -> DataFrame:
    """(key, value) after a log of set and del operations; a deleted key has no row. Pre-aggregated by key before the shuffle."""
    last = log.where("op in ('set', 'del')").groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("last"))
    return last.where("last.op = 'set'").select("key", "last.value")


def get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (key) with value and status, ok or not_found."""
    out = keys.join(latest(log), "key", "left")
    return out.withColumn("status", F.when(F.col("value").isNull(), "not_found").otherwise("ok"))


def statistics(log: DataFrame) -> DataFrame:
    """ops, sets, deletes, keys (present), memory (bytes of keys and values present)."""
    now = latest(log).agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(F.octet_length(F.col("key").cast("binary")) + F.octet_length(F.col("value").cast("binary"))), F.lit(0)).cast("long").alias("memory"))
    ops = log.agg(F.count(F.lit(1)).alias("ops"), F.count(F.when(F.col("op") == "set", 1)).alias("sets"), F.count(F.when(F.col("op") == "del", 1)).alias("deletes"))
    return ops.withColumn("_one", F.lit(1)).join(now.withColumn("_one", F.lit(1)), "_one").drop("_one")


def step(state: tuple | None, op: str, value: object, expected: int | None) -> tuple[tuple | None, str]:
    """(value, version) of a key after an operation, and its status. A first set has version 1; later sets keep the version;
    cas needs the version expected and adds one."""
    if op == "set":
        return (value, state[1] if state else 1), "ok" if state else "created"
    if state is None:
        return None, "not_found"
    if op == "del":
        return None, "ok"
    if op == "cas":
        return ((value, state[1] + 1), "ok") if state[1] == expected else (state, "version_mismatch")
    return state, "ok"


def replay(log: DataFrame) -> DataFrame:
    """log with status, and version and value after the operation (null for no key): each key's operations folded in order of seq.

    Only compare-and-set needs the fold. Keys are dealt out by hash and sorted within partitions, so a task streams over its
    keys' histories with the state of one key at a time, however long a history is.
    """
    ship(log.sparkSession)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            out = []
            for seq, op, key, value, expected in batch.itertuples(index=False):
                if key != last:
                    last, state = key, None
                state, status = step(state, op, value, None if pd.isna(expected) else int(expected))
                out.append((seq, key, op, status, state[1] if state else None, state[0] if state else None))
            made = pd.DataFrame(out, columns=["seq", "key", "op", "status", "version", "value"])
            yield made.astype({"version": "Int64"})

    kind = dict(log.dtypes)
    ordered = log.select("seq", "op", "key", "value", "expected_version").repartition("key").sortWithinPartitions("key", "seq")
    return ordered.mapInPandas(fold, f"seq long, key {kind['key']}, op string, status string, version long, value {kind['value']}")
