"""Request packing: entry caps and token budgets, as frames."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ColumnOrName = Column | str


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows, computed once: what is read twice after a sort by ranges must have the same ranges both times."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="siftwell-")
        context.setCheckpointDir(base)
    return rows.checkpoint()


def _sorted(rows: DataFrame, *keys: ColumnOrName) -> DataFrame:
    """rows in order, with _at: the number of their range << 33 | their place in it."""
    return checkpointed(rows.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()))


def ranked(rows: DataFrame, *keys: ColumnOrName) -> DataFrame:
    """rows with place 0, 1, ... in the order of keys (distinct together), without one task that sees all.

    Rows are sorted by ranges and numbered in their range; only the ranges' sizes, a row each, are summed and
    broadcast.
    """
    placed = _sorted(rows, *keys).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("place"))


def capped(rows: DataFrame, order: str, cap: int) -> DataFrame:
    """rows with batch: `cap` consecutive rows each."""
    return ranked(rows, order).select(*rows.columns, F.floor(F.col("place") / cap).alias("batch"))


class _Open(NamedTuple):
    """The batch that is open: its number, and how many tokens and rows it has."""

    batch: int = 0
    used: int = 0
    members: int = 0


def _filled(tokens: np.ndarray, state: _Open, budget: int, cap: int) -> tuple[np.ndarray, np.ndarray, _Open]:
    """batch and used of consecutive rows of a group, and what is open after them; a step for each batch."""
    n, total = len(tokens), np.concatenate([[0], np.cumsum(tokens)])
    at = fits = int(np.clip(min(np.searchsorted(total, budget - state.used, side="right") - 1, cap - state.members), 0, n)) if state.members else 0
    starts = []
    while at < n:
        starts.append(at)
        at = min(max(int(np.searchsorted(total, total[at] + budget, side="right")) - 1, at + 1), at + cap)
    k = np.searchsorted(starts, np.arange(n), side="right")
    first = np.array([-1, *starts])[k]
    batch = state.batch + k - (0 if state.members else 1)
    used = np.where(k > 0, total[1:] - total[np.maximum(first, 0)], state.used + total[1:])
    members = n - starts[-1] if starts else state.members + fits
    return batch, used, _Open(int(batch[-1]), int(used[-1]), members)


def _entrances(tokens: np.ndarray, budget: int, cap: int) -> list[tuple[int, int, int, int, int]]:
    """What is open after a part of a group, by how many of its rows the batch open before it takes.

    (rows, their tokens, batches opened, used, members) for each number of rows from which on the outcome
    changes; a few, as batches soon open at the same rows. That all rows are taken isn't listed.
    """
    n, total = len(tokens), np.concatenate([[0], np.cumsum(tokens)])
    most = min(int(np.searchsorted(total, budget, side="right")), n, cap)  # a batch open before has a row at least
    step = np.minimum(np.maximum(np.searchsorted(total, total[:-1] + budget, side="right") - 1, np.arange(n) + 1), np.arange(n) + cap)
    at, of = np.arange(most), np.arange(most)  # chains that are still told apart, and the chain of each entrance
    opened, last, lag = np.zeros(most, dtype=np.int64), np.arange(most), np.zeros(most, dtype=np.int64)
    while len(at) and (low := int(at.min())) < n:  # the hindmost chain goes on until it meets another
        moves = at == low
        at, last, opened = np.where(moves, step[low], at), np.where(moves, low, last), opened + moves
        meets = np.flatnonzero(at == step[low])
        if len(meets) > 1 and step[low] < n:
            stays = np.ones(len(at), dtype=bool)
            for other in meets[1:].tolist():
                lag[of == other] += opened[other] - opened[meets[0]]
                of[of == other] = meets[0]
                stays[other] = False
            of = (np.cumsum(stays) - 1)[of]
            at, last, opened = at[stays], last[stays], opened[stays]
    out: list[tuple[int, int, int, int, int]] = []
    for j in range(most):
        end = int(last[of[j]])
        found = (int(opened[of[j]] + lag[j]), int(total[n] - total[end]), n - end)
        if not out or out[-1][2:] != found:
            out.append((j, int(total[j]), *found))
    return out


def _after(state: _Open, n: int, total: int, entrances: list[int], budget: int, cap: int) -> _Open:
    """What is open after a part of n rows and total tokens with these entrances, given what is open before it."""
    if state.used + total <= budget and state.members + n <= cap:
        return _Open(state.batch, state.used + total, state.members + n)
    ways = [entrances[i : i + 5] for i in range(0, len(entrances), 5)]
    _, _, opened, used, members = [w for w in ways if not w[0] or (state.used + w[1] <= budget and state.members + w[0] <= cap)][-1]
    return _Open(state.batch + opened, used, members)


def budgeted(rows: DataFrame, group: Sequence[str], order: str, budget: int, cap: int | None = None) -> DataFrame:
    """rows with batch and used (tokens of the batch so far), greedily within each group.

    A row that would take its batch over the budget, or be more than the cap, opens the next one; a row
    larger than the budget has a batch of its own. Null tokens count as none; tokens aren't negative, and
    (group, order) is distinct.

    Rows are sorted by ranges, so that a large group is spread over many tasks. Each range says what is open
    after it for every way the range before may end (a few numbers); these are put together in the driver,
    a step a range, and each range is then filled from what is open before it.
    """
    columns, limit = rows.columns, 1 << 62 if cap is None else cap
    keys, size = [columns.index(g) for g in group], columns.index("tokens")

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, np.ndarray]]:
        """(group, from, to, tokens) of each run of rows of one group."""
        codes = np.zeros((len(keys) + 1, batch.num_rows), dtype=np.int64)
        for i, k in enumerate(keys):
            codes[i] = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        tokens = batch.column(size).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield repr([batch.column(k)[i].as_py() for k in keys]), i, j, tokens[i:j]

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, name, state, first = None, [], None, _Open(), None
        for batch in batches:
            part = batch.column(len(columns))[0].as_py() >> 33 if part is None and batch.num_rows else part
            for group_, _, _, tokens in runs(batch):
                first = group_ if first is None else first
                if group_ == first and name in (None, first):
                    head.append(tokens)
                if group_ != name:
                    name, state = group_, _Open()
                state = _filled(tokens, state, budget, limit)[2]
        if part is not None:
            tokens = np.concatenate(head)
            row = {"part": part, "first": first, "last": name, "n": len(tokens), "total": int(tokens.sum()), "batch": state.batch, "used": state.used, "members": state.members, "entrances": [x for e in _entrances(tokens, budget, limit) for x in e]}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int64()), ("first", pa.string()), ("last", pa.string()), *((x, pa.int64()) for x in ("n", "total", "batch", "used", "members")), ("entrances", pa.list_(pa.int64()))]))

    placed = _sorted(rows, *group, order)
    found = placed.mapInArrow(survey, "part long, first string, last string, n long, total long, batch long, used long, members long, entrances array<long>")
    before: dict[int, tuple[str | None, _Open]] = {}
    name, state = None, _Open()
    for r in sorted(found.collect(), key=lambda r: r["part"]):
        before[r["part"]] = name, state
        whole = r["first"] == name == r["last"]
        state = _after(state, r["n"], r["total"], r["entrances"], budget, limit) if whole else _Open(r["batch"], r["used"], r["members"])
        name = r["last"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, begun = None, _Open(), False
        for batch in batches:
            if batch.num_rows and not begun:
                (name, state), begun = before[batch.column(len(columns))[0].as_py() >> 33], True
            out, sums = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for group_, i, j, tokens in runs(batch):
                if group_ != name:
                    name, state = group_, _Open()
                out[i:j], sums[i:j], state = _filled(tokens, state, budget, limit)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(out), pa.array(sums)], names=[*columns, "batch", "used"])

    return placed.mapInArrow(fill, T.StructType([*rows.schema, T.StructField("batch", T.LongType()), T.StructField("used", T.LongType())]))
