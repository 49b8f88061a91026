"""Inserts, updates and deletes as plans from one version of a collection to the next."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.find import ID, predicate
from docquarry.plans.ast import QueryError


def insert(df: DataFrame, new: DataFrame) -> DataFrame:
    """df with new rows put in; a row replaces one of the same _id. Fields of either that the other lacks are null."""
    kept = df.join(new.select(ID).distinct(), ID, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def replace(df: DataFrame, condition: Mapping[str, Any], values: Mapping[str, Any]) -> DataFrame:
    """Documents that meet the condition become just their _id and the values."""
    hit = F.coalesce(predicate(df, condition), F.lit(False))
    names = [*df.columns, *[n for n in values if n not in df.columns]]
    out = []
    for n in names:
        if n == ID:
            out.append(F.col(ID))
            continue
        value = F.lit(values.get(n))
        old = F.col(f"`{n}`") if n in df.columns else F.lit(None)
        out.append(F.when(hit, value.cast(df.schema[n].dataType) if n in df.columns else value).otherwise(old).alias(n))
    return df.select(*out)


def modify(df: DataFrame, condition: Mapping[str, Any], changes: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Apply $set, $inc and $unset to top-level fields of the documents that meet the condition."""
    hit = F.coalesce(predicate(df, condition), F.lit(False))
    new = {}
    for op, fields in changes.items():
        if op not in ("$set", "$inc", "$unset"):
            raise QueryError(f"unknown change {op}")
        for name, value in fields.items():
            old = new.get(name, F.col(f"`{name}`") if name in df.columns else F.lit(None))
            to = {"$set": lambda: F.lit(value), "$inc": lambda: F.coalesce(old, F.lit(0)) + F.lit(value), "$unset": lambda: F.lit(None)}[op]()  # noqa: B023
            new[name] = F.when(hit, to.cast(df.schema[name].dataType) if name in df.columns else to).otherwise(old)
    return df.withColumns(new)


def delete(df: DataFrame, condition: Mapping[str, Any]) -> DataFrame:
    """df without the documents that meet the condition."""
    return df.where(~F.coalesce(predicate(df, condition), F.lit(False)))


def affected(df: DataFrame, condition: Mapping[str, Any]) -> DataFrame:
    """One row, affected: how many documents meet the condition."""
    return df.agg(F.count(F.when(predicate(df, condition), 1)).alias("affected"))
