"""An engine over named collections: where requests come in."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import dml, find, pipeline
from docquarry.operators.schema import Schema, checked
from docquarry.plans import planner
from docquarry.plans.ast import QueryError
from docquarry.plans.parse import parse_query


#: How a collection's changes reach its storage: at once, or queued for flush(); and whether reads come from memory.
STRATEGIES = ("write_through", "write_behind", "read_through")


class Collection:
    """A named DataFrame with _id, perhaps of dynamic shape (variant names its VARIANT column).

    Without storage, changes are plans only. With a storage folder, write_through writes each change to a new version there,
    write_behind on flush(), read_through keeps what is read in memory until a change.
    """

    def __init__(self, name: str, df: DataFrame, schema: Schema | None = None, variant: str | None = None, storage: str | None = None, strategy: str = "write_through"):
        if strategy not in STRATEGIES:
            raise QueryError(f"unknown strategy {strategy}")
        self.name, self.df, self.schema, self.variant, self.storage, self.strategy = name, df, schema, variant, storage, strategy
        self.indexes: dict[str, planner.IndexDef] = {}
        self.version, self.pending, self.refreshed_at = 0, False, 0.0

    def _changed(self, df: DataFrame) -> None:
        if self.strategy == "read_through":
            self.df.unpersist()
        self.df, self.pending = df, self.storage is not None
        if self.strategy != "write_behind":
            self.flush()
        if self.strategy == "read_through":
            self.df = self.df.cache()

    def flush(self) -> int:
        """Write a pending version to storage and read on from there; returns the version that storage has."""
        if self.pending and self.storage:
            target = f"{self.storage}/version={self.version + 1}"
            self.df.write.mode("overwrite").parquet(target)
            self.df = self.df.sparkSession.read.schema(self.df.schema).parquet(target)
            self.version, self.pending = self.version + 1, False
        return self.version

    def refresh(self, every_seconds: float = 300.0) -> bool:
        """Load storage's version into memory again, if the last time is longer ago than that; call it on a schedule."""
        if time.monotonic() - self.refreshed_at < every_seconds and self.refreshed_at:
            return False
        self.df.unpersist()
        if self.storage and self.version:
            self.df = self.df.sparkSession.read.schema(self.df.schema).parquet(f"{self.storage}/version={self.version}")
        self.df, self.refreshed_at = self.df.cache(), time.monotonic()
        return True

    def find(self, query: Any = None, strict: bool = False, **parts: Any) -> DataFrame:
        """find({"a": 1}, sort={"b": -1}, limit=10), or find(request) with its parts in one."""
        request = {"filter": query, **parts} if parts or query is None or (isinstance(query, Mapping) and not set(query) & {"filter", "projection", "sort", "skip", "limit"}) else query
        return find.find(self.df, request, strict, self.variant)

    def get(self, doc_id: str) -> DataFrame:
        return find.get(self.df, doc_id)

    def exists(self, doc_id: str) -> bool:
        return find.exists(self.df, doc_id)

    def aggregate(self, stages: Sequence[Mapping[str, Any]], strict: bool = False, caps: bool = False) -> DataFrame:
        return pipeline.aggregate(self.df, stages, strict, caps)

    def insert(self, new: DataFrame) -> DataFrame:
        """Put rows in; returns those that the schema rejects, with their violation."""
        accepted, rejected = checked(new, self.schema) if self.schema else (new, new.where("false").withColumn("violation", F.lit(None).cast("string")))
        self._changed(dml.insert(self.df, accepted))
        return rejected

    def update(self, condition: Mapping[str, Any], change: Mapping[str, Any]) -> None:
        """Replace the documents that meet the condition, or change them by $set, $inc and $unset."""
        operators = [k for k in change if k.startswith("$")]
        if operators and len(operators) < len(change):
            raise QueryError("an update has operators or values, not both")
        self._changed(dml.modify(self.df, condition, change) if operators else dml.replace(self.df, condition, change))

    def delete(self, condition: Mapping[str, Any]) -> None:
        self._changed(dml.delete(self.df, condition))

    def create_index(self, name: str, fields: Sequence[str], unique: bool = False, sparse: bool = False, text: bool = False) -> None:
        """Note an index for explain(); creating it again changes nothing."""
        self.indexes.setdefault(name, planner.IndexDef(name, tuple(fields), unique, sparse, text))

    def drop_index(self, name: str) -> None:
        self.indexes.pop(name, None)

    def explain(self, request: Mapping[str, Any]) -> planner.Plan:
        return planner.plan(parse_query(request), list(self.indexes.values()))

    def warm(self, limit: int | None = None) -> int:
        """Keep the collection (or up to limit documents of it, as a view of their own) in memory across executors; returns how many."""
        kept = self.df.cache() if limit is None else self.df.limit(limit).cache()
        return kept.count()

    def cool(self) -> None:
        self.df.unpersist()

    def count(self) -> int:
        return self.df.count()


class Engine:
    """Collections by name, each also a temporary view."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.collections: dict[str, Collection] = {}

    def create(self, name: str, df: DataFrame, id_column: str | None = None, schema: Schema | None = None, variant: str | None = None, storage: str | None = None, strategy: str = "write_through") -> Collection:
        """Register df as a collection; _id comes from id_column, or is drawn where df has none."""
        if not name or ":" in name:
            raise QueryError(f"no collection name: {name!r}")
        if find.ID not in df.columns:
            df = df.withColumn(find.ID, F.col(id_column).cast("string") if id_column else F.uuid())
        self.collections[name] = Collection(name, df, schema, variant, storage, strategy)
        df.createOrReplaceTempView(name)
        return self.collections[name]

    def open(self, name: str, path: str, id_column: str | None = None, **options: Any) -> Collection:
        return self.create(name, self.spark.read.parquet(path), id_column, **options)

    def collection(self, name: str) -> Collection:
        if name not in self.collections:
            raise QueryError(f"no collection {name}")
        return self.collections[name]

    def list(self) -> list[str]:
        return sorted(self.collections)

    def drop(self, name: str) -> bool:
        self.spark.catalog.dropTempView(name)
        return self.collections.pop(name, None) is not None

    def definitions(self) -> DataFrame:
        """(collection, index_name, unique, fields, sparse): the indexes of all collections, none of them built."""
        rows = [(n, i.name, i.unique, list(i.fields), i.sparse) for n, c in sorted(self.collections.items()) for i in c.indexes.values()]
        return self.spark.createDataFrame(rows, "collection string, index_name string, unique boolean, fields array<string>, sparse boolean")

    def save(self, root: str) -> None:
        """Write the rows of each collection and the definitions of all indexes under root."""
        for name, c in self.collections.items():
            c.df.write.mode("overwrite").parquet(f"{root}/collections/{name}")
        self.definitions().coalesce(1).write.mode("overwrite").json(f"{root}/indexes")

    def load(self, root: str, names: Sequence[str]) -> None:
        """Open collections that save() wrote, with their index definitions."""
        for name in names:
            self.create(name, self.spark.read.parquet(f"{root}/collections/{name}"))
        schema = "collection string, index_name string, unique boolean, fields array<string>, sparse boolean"
        for r in self.spark.read.schema(schema).json(f"{root}/indexes").collect():
            if r.collection in self.collections:
                self.collections[r.collection].create_index(r.index_name, r.fields, r.unique, r.sparse)

    def info(self) -> DataFrame:
        """(collection, documents, fields, indexes), counted by one plan."""
        parts = [c.df.agg(F.count(F.lit(1)).alias("documents")).select(F.lit(n).alias("collection"), "documents", F.lit(len(c.df.columns)).alias("fields"), F.lit(len(c.indexes)).alias("indexes")) for n, c in self.collections.items()]
        if not parts:
            return self.spark.createDataFrame([], "collection string, documents long, fields int, indexes int")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
