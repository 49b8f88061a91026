"""Scalar functions over documents and their values."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.plans.compile import Typed
from docquarry.session import ship

#: Bytes that a value of each kind counts, and what a container adds; the bounds of a document.
FIXED_SIZES = {T.BooleanType: 1, T.ByteType: 4, T.ShortType: 4, T.IntegerType: 4, T.LongType: 8, T.FloatType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8, T.DateType: 8}
CONTAINER, MAX_BYTES, MAX_DEPTH = 8, 16 * 1024 * 1024, 16
#: FNV-1a of 64 bits; the namespace under which keys are turned into ids.
FNV_OFFSET, FNV_PRIME, NAMESPACE = 0xCBF29CE484222325, 0x100000001B3, uuid.NAMESPACE_OID


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names made of names that df has not (whatever the case), so that helper columns never meet df's own."""
    taken = {c.lower() for c in df.columns}
    end = next(e for e in (f"__{i}" if i else "" for i in range(len(taken) + 1)) if not taken & {f"_{n}{e}".lower() for n in names})
    return [f"_{n}{end}" for n in names]


def path(df: DataFrame, dotted: str) -> Column:
    """The value at a dotted path; null where it leads nowhere."""
    return Typed(df).find(dotted)[0]


def with_path(df: DataFrame, dotted: str, value: Column) -> DataFrame:
    """df with the value at a dotted path replaced; missing structs on the way are made. Arrays and scalars cannot be entered."""
    first, *rest = dotted.split(".")
    if not rest:
        return df.withColumn(first, value)

    def placed(column: Column | None, kind: T.DataType | None, names: Sequence[str]) -> Column:
        if not names:
            return value
        if kind is not None and not isinstance(kind, T.StructType):
            raise ValueError(f"{dotted}: a path enters objects only")
        have = kind is not None and names[0] in kind.names
        inner = placed(column.getField(names[0]) if have else None, kind[names[0]].dataType if have else None, names[1:])
        if kind is None:
            return F.struct(inner.alias(names[0]))
        return F.when(column.isNotNull(), column.withField(names[0], inner)).otherwise(F.struct(*[(inner if n == names[0] else F.lit(None).cast(kind[n].dataType)).alias(n) for n in dict.fromkeys([*kind.names, names[0]])]))

    kind = df.schema[first].dataType if first in df.columns else None
    return df.withColumn(first, placed(F.col(first) if kind is not None else None, kind, rest))


def size_of(column: Column, kind: T.DataType) -> Column:
    """Approximate bytes of a value: fixed for scalars, bytes of strings, the sum of parts and CONTAINER for containers, 1 for null."""
    fixed = next((n for k, n in FIXED_SIZES.items() if isinstance(kind, k)), None)
    if fixed is not None:
        own = F.lit(fixed).cast("long")
    elif isinstance(kind, T.StringType | T.BinaryType):
        own = F.octet_length(column).cast("long")
    elif isinstance(kind, T.ArrayType):
        own = F.aggregate(F.transform(column, lambda x: size_of(x, kind.elementType)), F.lit(CONTAINER).cast("long"), lambda a, x: a + x)
    elif isinstance(kind, T.MapType):
        parts = F.transform(F.map_entries(column), lambda e: size_of(e["key"], kind.keyType) + size_of(e["value"], kind.valueType))
        own = F.aggregate(parts, F.lit(CONTAINER).cast("long"), lambda a, x: a + x)
    elif isinstance(kind, T.StructType):
        own = sum((size_of(column.getField(f.name), f.dataType) + len(f.name.encode()) for f in kind.fields), F.lit(CONTAINER).cast("long"))
    else:
        own = F.octet_length(column.cast("string")).cast("long")
    return F.when(column.isNull(), F.lit(1).cast("long")).otherwise(own)


def document_size(df: DataFrame) -> Column:
    """Approximate bytes of a row: names and values of its fields that are not null."""
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        total = total + F.when(F.col(f.name).isNotNull(), size_of(F.col(f.name), f.dataType) + len(f.name.encode())).otherwise(F.lit(0))
    return total


def depth_of_type(kind: T.DataType) -> int:
    """Nesting of a type: scalars 0, a container one more than its deepest part."""
    inner = {T.ArrayType: lambda k: [k.elementType], T.MapType: lambda k: [k.valueType], T.StructType: lambda k: [f.dataType for f in k.fields]}
    for cls, parts in inner.items():
        if isinstance(kind, cls):
            return 1 + max(map(depth_of_type, parts(kind)), default=0)
    return 0


def depth(json: Column) -> Column:
    """Nesting of JSON text: the deepest bracket outside strings. Native: strings are cut out, then brackets are summed."""
    bare = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', "")
    signs = F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), 0)
    step = lambda a, c: F.struct((a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(a["top"], a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("top"))
    return F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda a: a["top"])


def glob_pattern(glob: Column) -> Column:
    """A pattern of channels as a regular expression: * is any text, ? any character, everything else as in one."""
    return F.concat(F.lit("^"), F.replace(F.replace(glob, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def object_id_seconds(object_id: Column) -> Column:
    """Seconds since 1970 of a 12-byte object id: its first four bytes."""
    return F.conv(F.substring(F.hex(object_id), 1, 8), 16, 10).cast("long")


def to_number(column: Column, kind: T.DataType) -> Column:
    """A value as a double: numbers as they are, anything else 0."""
    return F.coalesce(column.cast("double"), F.lit(0.0)) if isinstance(kind, T.NumericType) else F.lit(0.0)


def clamp(column: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(column, F.lit(low)), F.lit(high))


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part / whole * scale, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * scale)


def encrypt(column: Column, key: Column) -> Column:
    """AES-256-GCM under a 32-byte key; every call draws a nonce."""
    return F.aes_encrypt(column, key, F.lit("GCM"))


def decrypt(column: Column, key: Column) -> Column:
    """The text under a key, null where the key or the bytes don't fit."""
    return F.try_aes_decrypt(column, key, F.lit("GCM")).cast("string")


def fnv1a(column: Column) -> Column:
    """FNV-1a, 64 bits, of UTF-8 text or bytes, as a signed long."""
    ship(SparkSession.active())

    @F.pandas_udf("long")
    def hashed(values: pd.Series) -> pd.Series:
        # Place by place over the whole batch, longest first, so that those with a byte at a place are a prefix.
        raw = [b"" if v is None else v.encode() if isinstance(v, str) else bytes(v) for v in values]
        order = np.argsort([-len(r) for r in raw], kind="stable")
        sizes = np.array([len(raw[i]) for i in order], np.int64)
        data, start = np.frombuffer(b"".join(raw[i] for i in order), np.uint8).astype(np.uint64), np.r_[0, np.cumsum(sizes)][:-1]
        h = np.full(len(raw), FNV_OFFSET, np.uint64)
        for place in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -place, "left"))
            h[:n] = (h[:n] ^ data[start[:n] + place]) * np.uint64(FNV_PRIME)
        out = np.empty(len(raw), np.int64)
        out[order] = h.view(np.int64)
        return pd.Series(out, dtype="Int64").where(~pd.isna(values).to_numpy(), pd.NA)

    return hashed(column)


def key_id(column: Column) -> Column:
    """The id that stands for a key: its name-based UUID (version 5). Native: SHA-1 of namespace and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), column.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
