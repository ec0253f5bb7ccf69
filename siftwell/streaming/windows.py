"""Scans of streams with state: ids that are unique over all batches, and windows that don't depend on how batches are cut.

Both are stateful operators of Structured Streaming, whose state is part of the stream's checkpoint: a restart goes
on with the ids that were seen and the windows that were open. State is spread by id, and by lane (a source, say);
a lane's state is one open window, which its budget bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.config import Config
from ..operators.packed import PLAN_SCHEMA, plan_frame, state_tokens
from ..operators.planner import BatchOptions
from ..operators.scan import scan_windows
from ..operators.shared import discard, written

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = [x.split()[0] for x in PLAN_SCHEMA.split(", ")]
_LANED = f"lane string, {PLAN_SCHEMA}"
_PLACED = f"{_LANED}, window long"


class UniqueIds(StatefulProcessor):
    """Passes on the first entry of each id; a later one fails the stream, or is dropped."""

    def __init__(self, drop: bool):
        self.drop = drop

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "ordinal long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r.ordinal):
            if r.layout != "end":
                if self.seen.exists():
                    if self.drop:
                        continue
                    raise ValueError(f"id {r.id} occurs twice")
                self.seen.update((r.ordinal,))
            yield Row(**r.asDict())

    def close(self) -> None:
        pass


class OpenWindows(StatefulProcessor):
    """Puts a lane's entries into windows in the order of their ordinals, and gives a window out when it is full.

    A window is full as it is for a scan of the whole: by tokens (the shared state counted once), by its cap, or when
    an entry of its own layout, or one that doesn't fit, comes next. An end of the lane gives out what is held, and so
    does a timer after `wait` milliseconds.
    """

    def __init__(self, budget: int, cap: int, wait: int | None):
        self.budget, self.cap, self.wait = budget, cap, wait

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", PLAN_SCHEMA)
        self.open = handle.getValueState("open", "window long, used long")

    def _given(self, lane: str, number: int, held: list[tuple]) -> Iterator[Row]:
        for values in held:
            yield Row(lane=lane, **dict(zip(_COLUMNS, values, strict=True)), window=number)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        number, used = self.open.get() if self.open.exists() else (0, 0)
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        for r in sorted(rows, key=lambda r: r.ordinal):
            size = self.budget + 1 if r.layout == "entry" else r.tokens
            if held and (r.layout == "end" or used + size > self.budget or len(held) == self.cap):
                yield from self._given(key[0], number, held)
                number, used, held = number + 1, 0, []
            if r.layout == "end":
                continue
            held.append(tuple(r[x] for x in _COLUMNS))
            used += size
            if used >= self.budget or len(held) == self.cap:
                yield from self._given(key[0], number, held)
                number, used, held = number + 1, 0, []
        self.open.update((number, used))
        if held:
            self.held.put(held)
            if self.wait is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        elif self.held.exists():
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            number, _ = self.open.get()
            yield from self._given(key[0], number, [tuple(x) for x in self.held.get()])
            self.held.clear()
            self.open.update((number + 1, 0))

    def close(self) -> None:
        pass


def windowed_stream(entries: DataFrame, config: Config, options: BatchOptions, lane: str = "source", drop_repeated: bool = False, wait: float | None = None) -> DataFrame:
    """(lane, plan columns, window) of a stream of entries with unique ids, each row as soon as its window is full."""
    entries.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    named = entries.withColumn("_lane", F.coalesce(F.col(lane).cast("string"), F.lit("")))
    # the lane rides along in `source`'s place through the planner, which looks at entries only
    planned = plan_frame(named.withColumn("source", F.to_json(F.struct("_lane", "source"))), config, options)
    laned = planned.select(F.get_json_object("source", "$._lane").alias("lane"), *[F.get_json_object("source", "$.source").alias("source") if x == "source" else F.col(x) for x in _COLUMNS])
    unique = laned.withColumn("_key", F.coalesce("id", F.concat(F.lit("end of "), "lane"))).groupBy("_key").transformWithState(UniqueIds(drop_repeated), _LANED, "Append", "None")
    budget = max(1, options.tokens - state_tokens(config))
    cap = 1 if options.size == 1 else options.cap
    return unique.groupBy("lane").transformWithState(OpenWindows(budget, cap, None if wait is None else int(wait * 1000)), _PLACED, "Append", "None" if wait is None else "ProcessingTime")


def scan_stream_windows(entries: DataFrame, config: Config, store_path: str, out_path: str, checkpoint: str, make: Callable | None = None, options: BatchOptions | None = None, lane: str = "source", drop_repeated: bool = False, wait: float | None = None, available_now: bool = True) -> StreamingQuery:
    """Assess a stream of (ordinal, id, source, entry_json, fields, absent) in shared requests; results go to out_path.

    Ordinals ascend within a lane from batch to batch. A row whose entry_json is null ends its lane's window. A
    batch that is run again after a failure finds its answers in the store and writes the same files anew.
    """
    options = options or BatchOptions("auto")

    def one(batch: DataFrame, number: int) -> None:
        placed, path = written(batch.withColumn("window", F.xxhash64("lane", "window")), "batch")
        # ordinals are those of lanes; over all of a batch's lanes they are made distinct
        rows = placed.withColumn("lane_ordinal", F.col("ordinal")).withColumn("ordinal", F.xxhash64("id"))
        found = scan_windows(rows.select(*_COLUMNS), rows.select("ordinal", "window"), config, store_path, make, options=options)
        told = found.join(rows.select("ordinal", "lane", "lane_ordinal"), "ordinal").withColumn("ordinal", F.col("lane_ordinal")).drop("lane_ordinal")
        told.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        discard(batch.sparkSession, path)

    writer = windowed_stream(entries, config, options, lane, drop_repeated, wait).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
