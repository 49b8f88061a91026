"""Filters to Columns: for typed columns, and for documents of unknown shape in a VARIANT column.

Predicates are two-valued: a missing value makes a condition false, except $ne, $nin and $exists: false. Null terms need no
wrapping in a conjunction or disjunction, where null counts as false, so that they reach the scan; only what stands
under a $not is made two-valued.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime
from decimal import Decimal
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.plans.ast import And, Compare, Exists, Filter, Member, Not, Or, QueryError, Regex

INT32 = range(-(2**31), 2**31)


def family(value: Any) -> str:
    """The kind of a literal: values of different kinds are neither equal nor ordered."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float | Decimal):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, datetime):
        return "time"
    return "binary" if isinstance(value, bytes | bytearray) else "array" if isinstance(value, list | tuple) else "object"


def family_of(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "time"
    names = {T.StringType: "string", T.BooleanType: "boolean", T.BinaryType: "binary", T.ArrayType: "array", T.StructType: "object", T.MapType: "object", T.NullType: "null"}
    return next((n for k, n in names.items() if isinstance(kind, k)), "variant")


def tag(value: Any, wide_ints: bool) -> str:
    """The exact tag of a literal: int32, int64, float64, or its kind. Match stages read whole numbers as int64."""
    if isinstance(value, float | Decimal):
        return "float64"
    if isinstance(value, int) and not isinstance(value, bool):
        return "int64" if wide_ints or value not in INT32 else "int32"
    return family(value)


def tag_of(kind: T.DataType) -> str:
    numbers = {T.IntegerType: "int32", T.LongType: "int64", T.DoubleType: "float64"}
    return next((n for k, n in numbers.items() if isinstance(kind, k)), family_of(kind))


def json_path(segments: Sequence[str]) -> str:
    return "$" + "".join(f"[{s}]" if s.isdigit() else "['" + s.replace("'", "\\'") + "']" for s in segments)


class Typed:
    """Paths over typed columns: fields of structs and maps, places of arrays, and members of JSON held in a string."""

    def __init__(self, df: DataFrame):
        self.schema = df.schema

    def find(self, path: str) -> tuple[Column, T.DataType]:
        """The column at a dotted path and its type; a path that leads nowhere is a null of no type."""
        names = {f.name: f for f in self.schema.fields}
        if path in names:
            return F.col(f"`{path}`"), names[path].dataType
        first, *rest = path.split(".")
        if first not in names:
            return F.lit(None), T.NullType()
        column, kind = F.col(f"`{first}`"), names[first].dataType
        for i, segment in enumerate(rest):
            if isinstance(kind, T.StructType) and segment in kind.names:
                column, kind = column.getField(segment), kind[segment].dataType
            elif isinstance(kind, T.MapType):
                column, kind = F.try_element_at(column, F.lit(segment)), kind.valueType
            elif isinstance(kind, T.ArrayType) and segment.isdigit():
                column, kind = F.get(column, int(segment)), kind.elementType
            elif isinstance(kind, T.VariantType):
                return F.try_variant_get(column, json_path(rest[i:]), "variant"), T.VariantType()
            elif isinstance(kind, T.StringType):
                return F.try_variant_get(F.try_parse_json(column), json_path(rest[i:]), "variant"), T.VariantType()
            else:
                return F.lit(None), T.NullType()
        return column, kind


class Dynamic:
    """Paths into one VARIANT column, beside ordinary columns (as _id)."""

    def __init__(self, df: DataFrame, column: str = "doc"):
        self.typed, self.column = Typed(df), column

    def find(self, path: str) -> tuple[Column, T.DataType]:
        if path in self.typed.schema.names and path != self.column:
            return self.typed.find(path)
        return F.try_variant_get(F.col(self.column), json_path(path.split(".")), "variant"), T.VariantType()


class Compiler:
    """strict: as the language's first engine had it - equality by exact type tag, incomparable values count as equal in an
    order, nulls sort first. wide_ints: literals are read as match stages read them."""

    def __init__(self, paths: Typed | Dynamic, strict: bool = False, wide_ints: bool = False, missing_never: bool = False):
        self.paths, self.strict, self.wide_ints = paths, strict, wide_ints
        #: In match stages a missing field fails every condition, $ne and $nin included.
        self.missing_never = missing_never

    def column(self, node: Filter) -> Column:
        if isinstance(node, And):
            return reduce(and_, map(self.column, node.terms), F.lit(True)) if len(node.terms) != 1 else self.column(node.terms[0])
        if isinstance(node, Or):
            return reduce(or_, map(self.column, node.terms)) if node.terms else F.lit(False)
        if isinstance(node, Not):
            return ~F.coalesce(self.column(node.term), F.lit(False))
        if type(node) is Filter:
            return F.lit(True)
        column, kind = self.paths.find(node.path)
        if isinstance(kind, T.VariantType):
            return self.dynamic(node, column)
        return self.typed(node, column, kind)

    def equal(self, column: Column, kind: T.DataType, value: Any) -> Column | None:
        """column == value, or None where no value of the kind can be."""
        if value is None or isinstance(kind, T.NullType):
            return None
        if family(value) != family_of(kind) or (self.strict and tag(value, self.wide_ints) != tag_of(kind)):
            return None
        return column == (F.lit(list(value)) if isinstance(value, tuple | list) else F.lit(value))

    def typed(self, node: Filter, column: Column, kind: T.DataType) -> Column:
        if isinstance(node, Exists):
            return column.isNotNull() if node.wanted else column.isNull()
        if isinstance(node, Regex):
            return column.rlike(pattern_of(node)) if isinstance(kind, T.StringType) else F.lit(False)
        if isinstance(node, Member):
            found = [v for v in node.values if self.equal(column, kind, v) is not None]
            inside = column.isin(*found) if found else F.lit(False)
            if any(v is None for v in node.values) and not node.negated:
                inside = inside | column.isNull()
            if not node.negated:
                return inside
            outside = ~inside if found else F.lit(True)
            return outside & column.isNotNull() if self.missing_never else column.isNull() | outside
        assert isinstance(node, Compare)
        value = node.value
        if node.op in ("eq", "ne"):
            if value is None:
                same = column.isNull() if not self.missing_never else F.lit(False)
                return same if node.op == "eq" else column.isNotNull()
            same = self.equal(column, kind, value)
            if node.op == "eq":
                return F.lit(False) if same is None else same
            if self.missing_never:
                return column.isNotNull() if same is None else ~same
            return F.lit(True) if same is None else ~column.eqNullSafe(F.lit(value))
        if family(value) != family_of(kind) or family(value) in ("boolean", "object", "array", "null", "binary") or (self.strict and self.wide_ints and tag(value, True) != tag_of(kind)):
            equal = node.op in ("gte", "lte") and self.strict
            return column.isNotNull() if equal else F.lit(False)
        literal = F.lit(value)
        return {"gt": column > literal, "gte": column >= literal, "lt": column < literal, "lte": column <= literal}[node.op]

    def dynamic(self, node: Filter, value: Column) -> Column:
        """value: a variant, SQL null where the path is missing."""
        null = F.coalesce(F.is_variant_null(value), F.lit(False))
        kind = F.schema_of_variant(value)
        casts = {"number": ("double", kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")), "string": ("string", kind == "STRING"), "boolean": ("boolean", kind == "BOOLEAN"), "time": ("timestamp_ntz", kind.isin("TIMESTAMP", "TIMESTAMP_NTZ"))}

        def as_kind(name: str) -> Column | None:
            if name not in casts:
                return None
            cast, is_kind = casts[name]
            return F.when(is_kind, F.try_variant_get(value, "$", cast))

        def same(v: Any) -> Column:
            if v is None:
                return null
            found = as_kind(family(v))
            return F.lit(False) if found is None else F.coalesce(found == F.lit(float(v) if family(v) == "number" else v), F.lit(False))

        if isinstance(node, Exists):
            return value.isNotNull() if node.wanted else value.isNull()
        if isinstance(node, Regex):
            return F.coalesce(as_kind("string").rlike(pattern_of(node)), F.lit(False))
        if isinstance(node, Member):
            inside = reduce(or_, map(same, node.values), F.lit(False))
            return value.isNotNull() & inside if not node.negated else value.isNull() | ~inside
        assert isinstance(node, Compare)
        if node.op == "eq":
            return value.isNotNull() & same(node.value)
        if node.op == "ne":
            return (value.isNotNull() if self.missing_never else F.lit(True)) & ~(value.isNotNull() & same(node.value))
        found = as_kind(family(node.value))
        if found is None:
            ordered = F.lit(None).cast("boolean")
        else:
            literal = F.lit(float(node.value) if family(node.value) == "number" else node.value)
            ordered = {"gt": found > literal, "gte": found >= literal, "lt": found < literal, "lte": found <= literal}[node.op]
            if family(node.value) == "boolean":
                ordered = F.lit(None).cast("boolean")
        if self.strict:
            low = F.lit(node.op in ("lt", "lte")) if node.value is not None else F.lit(node.op in ("gte", "lte"))
            ordered = F.when(null, low).otherwise(F.coalesce(ordered, F.lit(node.op in ("gte", "lte"))))
        return value.isNotNull() & F.coalesce(ordered, F.lit(False))


def pattern_of(node: Regex) -> str:
    try:
        re.compile(node.pattern)
    except re.error as e:
        raise QueryError(f"no pattern: {e}") from e
    return ("(?iu)" if "i" in node.options else "") + node.pattern
