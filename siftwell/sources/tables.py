"""Spark tables as entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import pointer_key
from ..functions.columns import value_text


def selector(schema: str, name: str) -> str:
    """The canonical name of a table."""
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    return f"{quoted(schema)}.{quoted(name)}"


def _json(value: Column, kind: T.DataType) -> Column:
    """A converted value as JSON text; null is JSON null."""
    if isinstance(kind, T.BooleanType | T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return F.coalesce(value.cast("string"), F.lit("null"))
    text = value_text(value, kind)
    if isinstance(kind, T.FloatType | T.DoubleType):
        odd = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(value.isNull(), "null").when(odd, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
    if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
        return F.coalesce(F.to_json(text), F.lit("null"))
    quoted = F.to_json(F.struct(text.alias("x")))
    return F.when(value.isNull(), "null").otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))


def key_id(schema: str, name: str, table: DataFrame, key: Sequence[str]) -> Column:
    """The id of a row by its primary key, whose parts stand as a JSON list."""
    parts = F.concat_ws(",", *[_json(table[k], table.schema[k].dataType) for k in key])
    return F.concat(F.lit(f"{selector(schema, name)}:key:["), parts, F.lit("]"))


def object_json(table: DataFrame, columns: Sequence[str]) -> Column:
    """Columns of a row as the text of a JSON object with sorted keys."""
    name = lambda c: F.to_json(F.array(F.lit(c)))
    pairs = [F.concat(name(c).substr(F.lit(2), F.length(name(c)) - 2), F.lit(":"), _json(table[c], table.schema[c].dataType)) for c in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def catalogued(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, columns, rows) of each table."""
    found = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), F.lit(len(t.columns)).cast("long").alias("columns"), "rows") for n, t in tables.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def entries(table: DataFrame, name: str, key: Sequence[str], schema: str = "main") -> DataFrame:
    """(id, source, entry_json, fields) for each row: columns as an object with sorted keys, all of them fields."""
    columns = sorted(table.columns)
    found = key_id(schema, name, table, key)
    return table.select(found.alias("id"), F.concat(F.lit(f"table:{selector(schema, name)}:"), found).alias("source"), object_json(table, columns).alias("entry_json"), F.array(*[F.lit(f"/{pointer_key(c)}") for c in columns]).alias("fields"))
