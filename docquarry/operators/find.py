"""find: filter, sort, skip, limit, project - in that order."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.plans.ast import Filter, Projection, Query, SortKey
from docquarry.plans.compile import Compiler, Dynamic, Typed
from docquarry.plans.parse import parse_filter, parse_query

ID = "_id"


def resolver(df: DataFrame, variant: str | None) -> Typed | Dynamic:
    return Dynamic(df, variant) if variant else Typed(df)


def predicate(df: DataFrame, condition: Filter | Mapping[str, Any] | None, strict: bool = False, variant: str | None = None) -> Column:
    node = condition if isinstance(condition, Filter) else parse_filter(condition, strict)
    return Compiler(resolver(df, variant), strict).column(node)


def where(df: DataFrame, condition: Filter | Mapping[str, Any] | None, strict: bool = False, variant: str | None = None) -> DataFrame:
    node = condition if isinstance(condition, Filter) else parse_filter(condition, strict)
    return df if type(node) is Filter else df.where(predicate(df, node, strict, variant))


def order(df: DataFrame, keys: tuple[SortKey, ...], variant: str | None = None) -> list[Column]:
    """Missing values come first in ascending order and last in descending; _id breaks ties, where there is one."""
    paths, columns = resolver(df, variant), []
    for key in keys:
        column, _ = paths.find(key.path)
        columns.append(column.desc_nulls_last() if key.descending else column.asc_nulls_first())
    if ID in df.columns and ID not in {k.path for k in keys}:
        columns.append(F.col(ID).asc())
    return columns


def project(df: DataFrame, projection: Projection | None) -> DataFrame:
    if projection is None:
        return df
    if not projection.include and not projection.exclude:
        return df.select(ID) if projection.keep_id and ID in df.columns else df
    if projection.include:
        names = [c for c in projection.include if c in df.columns]
        return df.select(*([ID] if projection.keep_id and ID in df.columns else []), *[f"`{n}`" for n in names])
    return df.drop(*projection.exclude)


def find(df: DataFrame, query: Query | Mapping[str, Any] | str, strict: bool = False, variant: str | None = None) -> DataFrame:
    """The documents of df that a query asks for. Sort keys need not be projected; a sort under a limit plans as top-k."""
    if not isinstance(query, Query):
        query = parse_query(query, strict)
    out = where(df, query.filter, strict, variant)
    if query.sort:
        out = out.orderBy(*order(out, query.sort, variant))
    if query.skip:
        out = out.offset(query.skip)
    if query.limit is not None:
        out = out.limit(query.limit)
    return project(out, query.projection)


def get(df: DataFrame, doc_id: str) -> DataFrame:
    """The document of an id: no row or one."""
    return df.where(F.col(ID) == doc_id).limit(1)


def exists(df: DataFrame, doc_id: str) -> bool:
    return not get(df, doc_id).isEmpty()
