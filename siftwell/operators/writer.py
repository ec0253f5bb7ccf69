"""Reports as files of many tasks: lines in order, counted while they are written, published when all are there.

A row's line is made by Spark's own functions. Rows are sorted by ranges, each task writes a part, and the parts'
names are in order, so no row goes through the driver. What a failed job has written is deleted, and what stood at
the target before stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .report import FIELD_VIEW, JSON_COLUMNS, ReportError
from .rules import field_rows
from .shared import discard, exists, names, rename, shared_dir, streamed
from .sinks import CSV_COLUMNS

_PARENT = ("label", "score", "confidence", "warning")


def _text(value: Column) -> Column:
    """A text as JSON, null as null."""
    found = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(found, F.lit(2), F.length(found) - 2)


def _object(pairs: dict[str, Column]) -> Column:
    """A JSON object with sorted keys of members that are JSON already."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(pairs[k], F.lit("null"))) for k in sorted(pairs)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _probabilities(value: Column) -> Column:
    pairs = F.array_sort(F.transform(F.map_entries(value), lambda e: F.concat(_text(e["key"]), F.lit(":"), e["value"].cast("string"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _json(name: str, value: Column) -> Column:
    """A report's column as JSON; values and usage are JSON texts already."""
    if name in ("value", "usage"):
        return value
    if name in ("score", "confidence", "warning", "cached", "entry_score", "entry_confidence", "entry_warning"):
        return value.cast("string")
    if name == "probabilities":
        return _probabilities(value)
    if name == "absent":
        return F.to_json(F.coalesce(value, F.array().cast("array<string>")))
    if name == "fields":
        one = lambda f: _object({k: _json(k, f[k]) for k in ("path", "value", "label", "probabilities", "confidence", "score")})
        return F.concat(F.lit("["), F.array_join(F.transform(value, one), ","), F.lit("]"))
    return _text(value)


def _cell(name: str, value: Column) -> Column:
    """A report's column as a cell of a CSV row."""
    text = F.coalesce(_json(name, value) if name in JSON_COLUMNS else value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def fields_view(found: DataFrame, threshold: float) -> DataFrame:
    """A row for each field of results, in their order (`ordinal`, `place`), with its entry's verdict as entry_* columns."""
    told = found.withColumn("fields", F.transform("fields", lambda f, i: F.struct(f["path"].alias("path"), f["value"].alias("value"), f["label"].alias("label"), f["probabilities"].alias("probabilities"), f["confidence"].alias("confidence"), f["score"].alias("score"), i.alias("place"))))
    return field_rows(told).withColumn("warning", F.col("score") >= threshold)


def report_lines(found: DataFrame, rows: str = "entries", kind: str = "jsonl", threshold: float = 0.5) -> DataFrame:
    """(ordinal, place, first, warning, cached, line) of results, as scan_frame() returns them: each entry or field as
    JSON, each entry's fields as CSV of 17 columns, or each field as CSV of 19. `first` marks an entry's first line."""
    if kind not in ("jsonl", "csv") or rows not in ("entries", "fields"):
        raise ReportError(f"a report by many tasks is jsonl or csv of entries or fields, not {kind} of {rows}")
    common = ("id", "source", "model", "assessed_at", "request_hash", "cached", "absent", "usage")
    if rows == "entries" and kind == "jsonl":
        line = _object({k: _json(k, F.col(k)) for k in (*common, *_PARENT, "fields")})
        return found.select("ordinal", F.lit(0).alias("place"), F.lit(True).alias("first"), "warning", "cached", line.alias("line"))
    each = fields_view(found, threshold)
    if kind == "jsonl":
        line = _object({k: _json(k, F.col(k)) for k in (*common, *_PARENT, *(f"entry_{k}" for k in _PARENT), "path", "value", "probabilities")})
    elif rows == "fields":
        line = F.concat_ws(",", *[_cell(k, F.col(k)) for k, _ in FIELD_VIEW])
    else:
        of = {"label": "entry_label", "score": "entry_score", "warning": "entry_warning", "field_label": "label", "field_score": "score", "field_confidence": "confidence"}
        line = F.concat_ws(",", *[_cell(k, F.col(of.get(k, k))) for k in CSV_COLUMNS])
    return each.select("ordinal", "place", (F.col("place") == 0).alias("first"), F.col("entry_warning").alias("warning"), "cached", line.alias("line"))


def write_report(found: DataFrame, path: str, rows: str = "entries", kind: str = "jsonl", threshold: float = 0.5, single: bool = True) -> dict[str, int]:
    """Write results to `path` in the order of ordinal, and tell how many (assessed, warnings, cached, lines) there were.

    The numbers come from the writing job itself. The parts stand in the shared folder until all tasks have ended;
    then they become the folder `path`, or with `single` one file of that name, which the driver puts together by
    streaming parts through a buffer of fixed size. Either replaces what was there only when it is whole.
    """
    spark = found.sparkSession
    lines = report_lines(found, rows, kind, threshold)
    if kind == "csv":
        head = spark.range(1).select(F.lit(-(1 << 62)).cast("long").alias("ordinal"), F.lit(-1).alias("place"), F.lit(False).alias("first"), F.lit(False).alias("warning"), F.lit(False).alias("cached"), F.lit(",".join(x for x, _ in FIELD_VIEW) if rows == "fields" else ",".join(CSV_COLUMNS)).alias("line"))
        lines = lines.unionByName(head)
    seen = Observation("report")
    counts = [F.count_if("first").alias("assessed"), F.count_if(F.col("first") & F.col("warning")).alias("warnings"), F.count_if(F.col("first") & F.col("cached")).alias("cached"), F.count_if(F.col("place") >= 0).alias("lines")]
    parts = shared_dir(spark, "report")
    try:
        lines.orderBy("ordinal", "place").observe(seen, *counts).select("line").write.option("lineSep", "\n").text(parts)
        publish(spark, parts, path, single)
    finally:
        discard(spark, parts)
    return {k: int(v) for k, v in seen.get.items()}


def publish(spark: SparkSession, parts: str, path: str, single: bool) -> None:
    """Make the parts in a folder the file or folder `path`."""
    if single:
        staged = f"{path}.part"
        streamed(spark, [f"{parts}/{x}" for x in names(spark, parts) if x.startswith("part-")], staged)
    else:
        staged = parts
    if exists(spark, path):
        discard(spark, path)
    rename(spark, staged, path)
