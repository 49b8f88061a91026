"""Optional, open schemas: required fields, types, validators, defaults, uniqueness, and bounds of documents."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.values import MAX_BYTES, MAX_DEPTH, depth_of_type, document_size

TYPES: dict[str, type] = {"string": T.StringType, "int32": T.IntegerType, "int64": T.LongType, "float64": T.DoubleType, "boolean": T.BooleanType, "date": T.TimestampType, "binary": T.BinaryType, "objectid": T.BinaryType, "reference": T.BinaryType, "array": T.ArrayType, "object": T.StructType}
#: Types that a declared type takes besides its own: numbers widen.
WIDENS = {"int64": ("int32",), "float64": ("int32", "int64")}
CUSTOM: dict[str, Callable[[Column], Column]] = {}


def register_validator(name: str, valid: Callable[[Column], Column]) -> None:
    """Make a custom validator known: a function from a column to whether it is valid. Unknown names are valid."""
    CUSTOM[name] = valid


@dataclass(frozen=True)
class FieldDef:
    """validators: (kind, argument) with kinds min, max, min_length, max_length, regex, enum, custom."""

    type: str = "any"
    required: bool = False
    default: Any = None
    unique: bool = False
    validators: tuple[tuple[str, Any], ...] = ()
    item: FieldDef | None = None
    fields: Mapping[str, FieldDef] = field(default_factory=dict)


Schema = Mapping[str, FieldDef]


def kind_fits(declared: FieldDef, kind: T.DataType) -> bool:
    """Whether a column of a type can hold the declared one, containers part by part."""
    if declared.type == "any" or isinstance(kind, T.NullType):
        return True
    names = (declared.type, *WIDENS.get(declared.type, ()))
    if not any(isinstance(kind, TYPES[n]) for n in names) and not (declared.type == "date" and isinstance(kind, T.TimestampNTZType | T.DateType)):
        return False
    if declared.type == "array" and declared.item is not None:
        return kind_fits(declared.item, kind.elementType)
    if declared.type == "object":
        return all((n in kind.names and kind_fits(d, kind[n].dataType)) or (n not in kind.names and not d.required) for n, d in declared.fields.items())
    return True


def fails(kind: str, argument: Any, column: Column, dtype: T.DataType) -> Column | None:
    """Whether a present value breaks a validator; None where the validator doesn't concern the column's type."""
    numeric, text = isinstance(dtype, T.NumericType), isinstance(dtype, T.StringType)
    if kind in ("min", "max"):
        return (column < argument if kind == "min" else column > argument) if numeric else None
    if kind in ("min_length", "max_length"):
        length = F.octet_length(column) if isinstance(dtype, T.StringType | T.BinaryType) else F.size(column) if isinstance(dtype, T.ArrayType) else None
        return None if length is None else length < argument if kind == "min_length" else length > argument
    if kind == "regex":
        return ~column.rlike(argument) if text else None
    if kind == "enum":
        return ~column.isin(*argument)
    valid = CUSTOM.get(argument)
    return ~valid(column) if valid else None


def with_defaults(df: DataFrame, schema: Schema) -> DataFrame:
    """Absent values become their field's default; fields that df lacks are added where they have one."""
    new = {}
    for name, d in schema.items():
        if d.default is not None:
            new[name] = F.coalesce(F.col(name), F.lit(d.default)) if name in df.columns else F.lit(d.default)
    return df.withColumns(new) if new else df


def violation(df: DataFrame, schema: Schema) -> Column:
    """The first rule that a row breaks, as code:field, null if none. Fields come in alphabetical order; in each, required, then type, then validators."""
    checks: list[Column] = []
    for name, d in sorted(schema.items()):
        if name not in df.columns:
            if d.required:
                checks.append(F.lit(f"required:{name}"))
            continue
        column, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if d.required:
            checks.append(F.when(column.isNull(), F.lit(f"required:{name}")))
        if not kind_fits(d, kind):
            checks.append(F.when(column.isNotNull(), F.lit(f"type:{name}")))
            continue
        if d.type == "object":
            for inner, e in sorted(d.fields.items()):
                if e.required:
                    checks.append(F.when(column.isNotNull() & column.getField(inner).isNull(), F.lit(f"required:{name}.{inner}")))
        for rule, argument in d.validators:
            broken = fails(rule, argument, column, kind)
            if broken is not None:
                checks.append(F.when(column.isNotNull() & broken, F.lit(f"{rule}:{name}")))
    return F.coalesce(*checks, F.lit(None).cast("string")) if checks else F.lit(None).cast("string")


def duplicates(df: DataFrame, name: str) -> DataFrame:
    """Values of a unique field that more than one row has, with their number."""
    return df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bounded(df: DataFrame, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH) -> Column:
    """Whether a row is within the size and nesting of a document. Nesting is the type's, so it is known without looking."""
    deep = max((depth_of_type(f.dataType) for f in df.schema.fields), default=0)
    return (document_size(df) <= max_bytes) & F.lit(deep <= max_depth)


def checked(df: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with defaults filled, rejected rows with a column violation); each a filter of one plan."""
    judged = with_defaults(df, schema)
    judged = judged.withColumn("violation", violation(judged, schema))
    return judged.where("violation is null").drop("violation"), judged.where("violation is not null")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
