"""Entries out of JSON columns without Python: records of a document, default fields, identities, checks, and shapes.

A VARIANT is taken apart by Spark's own expressions, so all of this stays in the scan's stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import InvalidValue, pointer_key, pointer_tokens
from ..functions.columns import escaped, is_present, resolved


def as_list(value: Column) -> Column:
    """The items of a JSON array, or null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def as_object(value: Column) -> Column:
    """The members of a JSON object, or null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def failure(*parts: Column | str) -> Column:
    return F.raise_error(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))


def fan_out(rows: DataFrame, entry: str, records: str = "", id_field: str | None = None, where: str | None = None) -> DataFrame:
    """rows with `place`, `id` and `data`: an entry for each item of the list at the pointer `records`, or for what else
    stands there.

    Ids are places from 1, or the nonempty scalar under the key `id_field`. A document that lacks the pointer, and an
    item without such an id, are errors that name the document (by the column `where`) and the place.
    """
    named = F.concat(F.col(where).cast("string"), F.lit(": ")) if where else F.lit("")
    there = resolved(F.col(entry), records)
    found = F.when(there.isNull(), failure(named, f"there are no records at '{records}'")).otherwise(there)
    listed = rows.withColumn("_records", found).withColumn("_items", F.coalesce(as_list(F.col("_records")), F.array("_records")))
    # an item that is JSON null may come out of the list as SQL null, but it's an entry
    items = listed.select(*rows.columns, F.posexplode_outer("_items").alias("_place", "_item")).where("_place IS NOT NULL")
    data = F.coalesce("_item", F.parse_json(F.lit("null")))
    out = items.select(*rows.columns, (F.col("_place") + 1).cast("long").alias("place"), data.alias("data"))
    if id_field is None:
        return out.select(*rows.columns, "place", F.col("place").cast("string").alias("id"), "data")
    return out.select(*rows.columns, "place", scalar_text(resolved(F.col("data"), f"/{pointer_key(id_field)}"), F.concat(named, F.lit("entry "), F.col("place").cast("string"))).alias("id"), "data")


def scalar_text(value: Column, where: Column) -> Column:
    """A nonempty scalar as an id: 0, false and "0001" are fine; null, "", lists and objects are errors."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    flag = F.initcap(text)
    bad = value.isNull() | text.isNull() | (text == "") | F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")) | (kind == "VOID")
    return F.when(bad, failure(where, ": an id must be a nonempty scalar")).when(kind == "BOOLEAN", flag).otherwise(text)


def default_fields(data: Column) -> Column:
    """Pointers of an object's own members, in the order of their names; of anything else, or an empty object, the root."""
    own = F.transform(F.array_sort(F.map_keys(as_object(data))), lambda k: F.concat(F.lit("/"), escaped(k)))
    return F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(F.array(F.lit("")))


def checked(rows: DataFrame, data: str, fields: Sequence[str], entry_id: str = "id") -> DataFrame:
    """rows with `fields`, which must be distinct pointers that lead somewhere in every entry; null is something."""
    if not fields:
        raise InvalidValue("an entry needs a field")
    if len({*fields}) < len(fields):
        raise InvalidValue("a field is asked for twice")
    for p in fields:
        pointer_tokens(p)
    out = F.array(*[F.lit(p) for p in fields])
    for p in reversed(fields):
        out = F.when(is_present(F.col(data), p), out).otherwise(failure("entry ", F.col(entry_id), f" has no '{p}'"))
    return rows.withColumn("fields", out)


def _below(found: Column) -> Column:
    """The pointers one level further down, with what they lead to."""

    def children(x: Column) -> Column:
        members = F.transform(F.map_entries(as_object(x["value"])), lambda e: F.struct(F.concat(x["path"], F.lit("/"), escaped(e["key"])).alias("path"), F.coalesce(e["value"], F.parse_json(F.lit("null"))).alias("value")))
        items = F.transform(as_list(x["value"]), lambda e, i: F.struct(F.concat(x["path"], F.lit("/"), i.cast("string")).alias("path"), F.coalesce(e, F.parse_json(F.lit("null"))).alias("value")))
        return F.coalesce(members, items, F.filter(F.array(x), lambda _: F.lit(False)))

    return F.flatten(F.transform(found, children))


def _levels(rows: DataFrame, data: str, levels: int) -> DataFrame:
    """What stands at each level, _l0 (the root) to _l<levels>; a column for each, so that a level is made once."""
    out = rows.select(F.array(F.struct(F.lit("").alias("path"), F.col(data).alias("value"))).alias("_l0"))
    for i in range(levels):
        out = out.withColumn(f"_l{i + 1}", _below(F.col(f"_l{i}")))
    return out


def nesting(rows: DataFrame, data: str) -> int:
    """How many levels the deepest entry has below its root: four are looked at, then twice as many while some entry
    goes on. Each look sends a number a task."""
    levels = 4
    while True:
        deepest = _levels(rows, data, levels).agg(F.max(F.greatest(*[F.when(F.size(f"_l{i}") > 0, i).otherwise(0) for i in range(levels + 1)]))).first()[0] or 0
        if deepest < levels:
            return deepest
        levels *= 2


def shapes(rows: DataFrame, data: str, levels: int | None = None) -> DataFrame:
    """(paths, entries): which pointers entries have, the root left out, and how many entries have just these.

    Entries of one shape are added up in each task before anything is sent, so what is kept grows with the kinds of
    entries and not with their number. Every question about pointers that meet is answered from this one table.
    """
    levels = nesting(rows, data) if levels is None else levels
    found = [F.array().cast("array<string>"), *[F.transform(f"_l{i + 1}", lambda x: x["path"]) for i in range(levels)]]
    out = _levels(rows, data, levels)
    return out.select(F.array_sort(F.concat(*found)).alias("paths")).groupBy("paths").agg(F.count(F.lit(1)).alias("entries"))


def pointer_counts(found: DataFrame) -> DataFrame:
    """(pointer, entries) of shapes()."""
    return found.select(F.explode("paths").alias("pointer"), "entries").groupBy("pointer").agg(F.sum("entries").alias("entries"))


def selection_problems(found: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """(problem, pointers) that shapes() tells of a selection: `unknown` pointers that no entry has, `apart` pairs of
    required ones that no entry has both of, and `never together` where no entry has all that are required."""
    has = lambda p: F.array_contains("paths", p)
    every = [*required, *optional]
    pairs = [(a, b) for i, a in enumerate(required) for b in required[i + 1 :]]
    told = found.agg(*[F.max(has(p)).alias(f"k{i}") for i, p in enumerate(every)], *[F.max(has(a) & has(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)], F.max(F.array_size(F.array_except(F.array(*[F.lit(p) for p in required]).cast("array<string>"), F.col("paths"))) == 0).alias("all"))
    row = lambda bad, problem, names: F.when(bad, F.struct(F.lit(problem).alias("problem"), F.array(*[F.lit(n) for n in names]).alias("pointers")))
    no = lambda name: ~F.coalesce(F.col(name), F.lit(False))
    known = {p: f"k{i}" for i, p in enumerate(every)}
    rows = [row(no(known[p]), "unknown", [p]) for p in every]
    rows += [row(no(f"p{i}") & ~no(known[a]) & ~no(known[b]), "apart", [a, b]) for i, (a, b) in enumerate(pairs)]
    if len(required) > 1:
        met = F.lit(True)
        for p in required:
            met = met & ~no(known[p])
        rows.append(row(no("all") & met, "never together", list(required)))
    return told.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.problem", "r.pointers")
