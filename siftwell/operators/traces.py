"""Conversations as entries: segments that start with a user's turn, what came before, fields to assess."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.canonical import canonical
from ..sources.readers import Entry, SourceError

CONTEXT_LIMIT = "These are the chosen events and the user messages before them. What assistants and tools did before, and the state of things outside, may be missing; that the file ends doesn't mean that the task was done."


def _so_far(key: str, order: str):
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def numbered(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """turns with segment: how many user turns there have been."""
    return turns.withColumn("segment", F.sum((F.col(role) == "user").cast("long")).over(_so_far(key, order)))


def segments(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """A row for each segment: its turns' span and number, and the turns as a list in order."""
    rest = [c for c in turns.columns if c != key]
    return numbered(turns, key, order, role).groupBy(key, "segment").agg(
        F.min(order).alias("first_turn"), F.max(order).alias("last_turn"), F.count(F.lit(1)).alias("events"), F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("turns")
    )


def prior_messages(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str | None = None) -> DataFrame:
    """turns with prior: the places of the user's turns before each, or with text structs of place and text."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    told = F.col(order).cast("string") if text is None else F.struct(F.col(order).alias("i"), F.col(text).alias("text"))
    return turns.withColumn("prior", F.collect_list(F.when(F.col(role) == "user", told)).over(before))


def _pieced(turns: DataFrame, key: str, order: str, size: int) -> DataFrame:
    return turns.withColumn("piece", F.floor(F.col(order) / size))


def context_pieces(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", size: int = 1000) -> DataFrame:
    """(key, piece, before, users): the user's turns of each stretch of `size` places as structs of place and text, and how
    many there are before it. Each text stands once, however many turns follow on it, and a conversation of any length is
    as many rows as it has stretches; what a stretch passes on is a count."""
    users = F.array_compact(F.array_sort(F.collect_list(F.when(F.col(role) == "user", F.struct(F.col(order).alias("i"), F.col(text).alias("text"))))))
    found = _pieced(turns, key, order, size).groupBy(key, "piece").agg(users.alias("users"))
    before = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return found.select(key, "piece", F.coalesce(F.sum(F.size("users").cast("long")).over(before), F.lit(0)).alias("before"), "users")


def prior_counts(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", size: int = 1000) -> DataFrame:
    """turns with n_prior: how many user turns come before each; with context_pieces() this is all that a list for each
    turn would say, in a size that grows with the turns and not with their square."""
    placed = _pieced(turns, key, order, size)
    is_user = F.coalesce((F.col(role) == "user").cast("long"), F.lit(0))
    sums = placed.groupBy(key, "piece").agg(F.sum(is_user).alias("_n"))
    before = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.sum(is_user).over(Window.partitionBy(key, "piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("_own", F.coalesce(own, F.lit(0))).join(sums, [key, "piece"]).select(*turns.columns, (F.col("_before") + F.col("_own")).alias("n_prior"))


def prior_lists(some: DataFrame, pieces: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Rows of prior_counts() with `prior`, the user turns before them, cut from the stretches: for the turns that are
    asked about, and not before that."""
    told = pieces.select(key, F.col("before").alias("_before"), F.col("users").alias("_users"))
    met = some.join(told, key).where(F.col("_before") < F.col("n_prior")).withColumn("_cut", F.struct("_before", F.slice("_users", F.lit(1), F.greatest(F.least(F.size("_users").cast("long"), F.col("n_prior") - F.col("_before")), F.lit(0)).cast("int")).alias("l")))
    lists = met.groupBy(key, order).agg(F.flatten(F.transform(F.array_sort(F.collect_list("_cut")), lambda c: c["l"])).alias("prior"))
    none = F.lit(None).cast(lists.schema["prior"].dataType)
    return some.join(lists, [key, order], "left").withColumn("prior", F.coalesce("prior", F.filter(F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit("").alias("text"))), lambda _: F.lit(False)), none))


def selected(rows: DataFrame, keep: Sequence[str], messages: str = "messages", answer: str = "answer_text", entry_id: str = "total_index") -> DataFrame:
    """Whole traces as entries (id, entry_json, fields): of the columns only `keep`, so that labels and reference
    answers never reach a request; fields are the assistant's messages and the answer."""
    names = sorted(x for x in keep if x in rows.columns)
    pointers = F.transform(F.col(messages), lambda m, i: F.when(m["role"] == "assistant", F.concat(F.lit(f"/{messages}/"), i.cast("string"))))
    told = F.concat(F.array_compact(pointers), F.array(F.lit(f"/{answer}")))
    return rows.select(F.col(entry_id).cast("string").alias("id"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("entry_json"), told.alias("fields"))


def event_entries(text: str, name: str, whole: bool = False) -> Iterator[Entry]:
    """Segments of one trace file: its events from each user message to the next (those before the first too), each
    with its pointer into the file, and the user messages before; or all events as one entry.

    The file is an object with events, or with a session that has them.
    """
    document = json.loads(text)
    session = document.get("session", document) if isinstance(document, dict) else None
    events = session.get("events") if isinstance(session, dict) else None
    if not isinstance(events, list) or not all(isinstance(e, dict) for e in events):
        raise SourceError(f"{name}: a trace is an object with a list of events")
    prefix = "/session/events" if "session" in document else "/events"
    trace = session.get("session_id") or os.path.splitext(os.path.basename(name))[0]
    pointed = [{"source_pointer": f"{prefix}/{i}", "event": e} for i, e in enumerate(events)]
    asked = [i for i, e in enumerate(events) if e.get("kind") == "message" and e.get("role") == "user"]
    cuts = [0, len(events)] if whole else sorted({0, *asked, len(events)})
    for a, b in pairwise(cuts):
        if a < b:
            about = {"trace_id": trace, "scope": "whole_trace" if whole else "user_turn_segment", "event_range": {"start": a, "stop_exclusive": b}}
            data = about | {"prior_user_messages": [pointed[i] for i in asked if i < a], "segment": pointed[a:b], "context_limit": CONTEXT_LIMIT}
            yield Entry(f"{trace}:{a}-{b}", data, ["/segment"], f"{name}#{prefix}/{a}")


def read_events(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """event_entries() of every file under path, read by Spark: (id, source, entry_json, fields, absent)."""
    names = ["id", "source", "entry_json", "fields", "absent"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [(e.id, e.source, canonical(e.data), e.fields, e.absent) for e in event_entries(raw.as_py().decode(), name, whole)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "id string, source string, entry_json string, fields array<string>, absent array<string>")


def assistant_fields(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", answer: str | None = None) -> DataFrame:
    """(key, messages, fields): pointers to the assistant's messages, and to the answer if there is one."""
    whole = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(role).alias("role"), "text"))).alias("messages"))
    pointers = F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: F.concat(F.lit("/messages/"), m["i"].cast("string")))
    return whole.withColumn("fields", F.concat(pointers, F.array(F.lit(f"/{answer}"))) if answer else pointers)


def fields_under(fields: str, *prefixes: str):
    """The pointers of a list column that stand below one of the prefixes."""
    return F.filter(fields, lambda p: F.exists(F.array(*[F.lit(x) for x in prefixes]), lambda x: F.startswith(p, x)))
