"""Ordered lookups by key. There is no index structure: columns sorted into files are pruned by their statistics."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators.find import ID
from docquarry.plans.compile import Typed


def keyed(df: DataFrame, paths: Sequence[str], sparse: bool = False) -> DataFrame:
    """The index of paths: k0, k1, ... and _id. sparse: rows with a null among the keys are left out."""
    out = df.select(*[Typed(df).find(p)[0].alias(f"k{i}") for i, p in enumerate(paths)], ID)
    return out.where(" and ".join(f"k{i} is not null" for i in range(len(paths)))) if sparse else out


def write_sorted(df: DataFrame, paths: Sequence[str], target: str, files: int | None = None) -> None:
    """Write df sorted by paths over range partitions, so that a scan for keys reads the few files and row groups that have them."""
    columns = [Typed(df).find(p)[0] for p in paths]
    ranged = df.repartitionByRange(files, *columns) if files else df.repartitionByRange(*columns)
    ranged.sortWithinPartitions(*columns).write.mode("overwrite").parquet(target)


def lookup(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Rows with these values, by equality filters that reach the scan."""
    for path, value in values.items():
        column = Typed(df).find(path)[0]
        df = df.where(column.isNull() if value is None else column == F.lit(value))
    return df


def between(df: DataFrame, path: str, start: Any = None, end: Any = None, start_inclusive: bool = True, end_inclusive: bool = True) -> DataFrame:
    """Rows with start <= path <= end (either end open if None, exclusive if asked), in key order."""
    column = Typed(df).find(path)[0]
    if start is not None:
        df = df.where(column >= F.lit(start) if start_inclusive else column > F.lit(start))
    if end is not None:
        df = df.where(column <= F.lit(end) if end_inclusive else column < F.lit(end))
    return df.orderBy(column.asc_nulls_first(), *([F.col(ID)] if ID in df.columns else []))


def conflicts(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Keys of a unique index that more than one row has, with their number and least _id."""
    names = [f"k{i}" for i in range(len(paths))]
    return keyed(df, paths, sparse=True).groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min(ID).alias("first_id")).where("n > 1")


def without(index: DataFrame, gone: DataFrame) -> DataFrame:
    """An index (k0, ..., _id) after the documents of gone (_id) are removed: their entries go, and with them keys left empty."""
    return index.join(gone.select(ID).distinct(), ID, "left_anti").select(*index.columns)


def maintained(index: DataFrame, changed: DataFrame, paths: Sequence[str], sparse: bool = False) -> DataFrame:
    """An index after the documents of changed were inserted or updated: their old entries go, their new ones come in."""
    return without(index, changed).unionByName(keyed(changed, paths, sparse))


def insert_unique(df: DataFrame, new: DataFrame, uniques: Sequence[Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """(df after, rejected): rows of new (each a document of its own _id) put in where no unique index objects.

    A row is rejected, with all its entries, if another document of df or a row of new of a smaller _id has its key in any of the
    indexes; a null in a key objects to nothing. Rows of new replace documents of the same _id, whose keys don't count.
    """
    stays = df.join(new.select(ID).distinct(), ID, "left_anti")
    refused = None
    for paths in uniques:
        names = [f"k{i}" for i in range(len(paths))]
        own = keyed(new, paths, sparse=True)
        taken = own.join(keyed(stays, paths, sparse=True).select(*names).distinct(), names, "left_semi").select(ID)
        again = own.join(own.groupBy(*names).agg(F.min(ID).alias("_first")), names).where(F.col(ID) != F.col("_first")).select(ID)
        refused = taken.union(again) if refused is None else refused.union(taken).union(again)
    if refused is None:
        return stays.unionByName(new, allowMissingColumns=True), new.where("false")
    refused = refused.distinct()
    accepted = new.join(refused, ID, "left_anti")
    kept = df.join(accepted.select(ID), ID, "left_anti")
    return kept.unionByName(accepted, allowMissingColumns=True), new.join(refused, ID, "left_semi")


def in_key_order(df: DataFrame, name: str) -> list[Column]:
    """Sort keys that put a VARIANT column's values in the order of an index: by type (type_rank), then by value."""
    value = F.col(name)
    text = F.try_variant_get(value, "$", "string")
    number = F.when(type_rank(value).isin(2, 3), F.try_variant_get(value, "$", "double"))
    return [type_rank(value), number.asc_nulls_first(), F.when(type_rank(value) == 2, F.try_variant_get(value, "$", "bigint")).asc_nulls_first(), text.asc_nulls_first()]


def type_rank(column: Column) -> Column:
    """Where a variant's type stands in the order of keys: null, booleans, whole numbers, other numbers, strings, bytes, times."""
    kind = F.schema_of_variant(column)
    order = [("VOID", 0), ("BOOLEAN", 1), ("BIGINT", 2), ("(DOUBLE|FLOAT|DECIMAL.*)", 3), ("STRING", 4), ("BINARY", 5), ("TIMESTAMP.*|DATE", 7)]
    out = F.when(column.isNull(), 0)
    for pattern, rank in order:
        out = out.when(kind.rlike(f"^({pattern})$"), rank)
    return out.otherwise(8)


def statistics(log: DataFrame) -> DataFrame:
    """Of a log of lookups (results, micros): lookups, hits (with a result), misses, hit_rate, and times, 0 without lookups."""
    hits = F.count(F.when(F.col("results") > 0, 1))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = log.agg(F.count(F.lit(1)).alias("lookups"), hits.alias("hits"), zero(F.min("micros")).alias("min_micros"), zero(F.max("micros")).alias("max_micros"), F.coalesce(F.avg("micros"), F.lit(0.0)).alias("avg_micros"))
    return out.withColumn("misses", F.col("lookups") - F.col("hits")).withColumn("hit_rate", F.when(F.col("lookups") == 0, 0.0).otherwise(F.col("hits") / F.greatest("lookups", F.lit(1))))


def build_estimate_ms(documents: int, batch: int = 1000, pause_ms: int = 10) -> int:
    """What a background build is taken to last: a millisecond a document and a pause a batch."""
    return documents + -(-documents // batch) * pause_ms
