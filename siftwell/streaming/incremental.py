"""Incremental scans (an extension): new rows of a stream are assessed as they come, each key once.

foreachBatch runs the batch operators on each micro-batch; the answer store makes a replayed batch free, and
the stream's checkpoint makes a restart go on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.config import Config
from ..operators.rules import Rule, assess
from ..operators.scan import scan_frame


def assess_stream(rows: DataFrame, entry_id: str, rules: list[Rule], threshold: float = 0.5) -> DataFrame:
    """The rule evaluator on a streaming frame: no state, so any output mode that appends."""
    return assess(rows, entry_id, rules, threshold)


def scan_stream(entries: DataFrame, config: Config, store_path: str, out_path: str, checkpoint: str, make: Callable | None = None, available_now: bool = True) -> StreamingQuery:
    """Assess a stream of entries (as the entries source has them), appending results to out_path."""

    def one(batch: DataFrame, number: int) -> None:
        scan_frame(batch, config, store_path, make).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    writer = entries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
