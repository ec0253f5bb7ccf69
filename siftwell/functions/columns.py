"""The same notions as columns: pointers over VARIANT, token estimates, identities, value texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .canonical import pointer_tokens


def variant_paths(pointer: str) -> list[str]:
    """The variant paths that a pointer may mean: a numeric token is an index of a list or a key of an object."""
    paths = ["$"]
    for token in pointer_tokens(pointer):
        quoted = token.replace("\\", "\\\\").replace("'", "\\'")
        ways = [f"['{quoted}']"]
        if re.fullmatch(r"0|[1-9][0-9]*", token):
            ways.append(f"[{token}]")
        paths = [p + w for p in paths for w in ways]
    return paths


def resolved(entry: Column, pointer: str, kind: str = "variant") -> Column:
    """What a pointer leads to in a VARIANT column, or SQL NULL; JSON null is a variant that is no SQL NULL."""
    found = [F.try_variant_get(entry, path, kind) for path in variant_paths(pointer)]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def is_present(entry: Column, pointer: str) -> Column:
    """Whether a pointer leads anywhere in a VARIANT column; JSON null counts."""
    return resolved(entry, pointer).isNotNull()


def token_estimate(text: Column) -> Column:
    return (F.ceil(F.octet_length(text) / F.lit(2.0)) + 16).cast("long")


def escaped(key: Column) -> Column:
    """A key as one token of a pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def value_text(value: Column, kind: T.DataType) -> Column:
    """A typed value as the text or JSON-ready value that entries hold.

    Decimals keep their scale, times are ISO with a fraction only if there is one, binary is hex: and hex
    digits, numbers that JSON lacks are nan, inf and -inf; arrays, structs and maps are done inside out.
    """
    if isinstance(kind, T.DecimalType):
        return value.cast("string")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        whole, part = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(value, "SSSSSS")
        return F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), part))
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("hex:"), F.lower(F.hex(value)))
    if isinstance(kind, T.FloatType | T.DoubleType):
        x = value.cast("double")
        return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(x.cast("string"))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: value_text(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[value_text(value[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.MapType):
        if isinstance(kind.keyType, T.StringType):
            return F.transform_values(value, lambda _, x: value_text(x, kind.valueType))
        return F.transform(F.map_entries(value), lambda e: F.struct(value_text(e["key"], kind.keyType).alias("key"), value_text(e["value"], kind.valueType).alias("value")))
    return value
