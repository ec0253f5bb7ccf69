"""Best-fit packing of token sequences by a configuration linear program.

Only the histogram of piece lengths (at most `capacity` numbers, whatever the corpus) reaches the driver.
There the covering program over configurations (multisets of lengths that fit one sequence) is solved by
multiplicative weights: lengths have prices, a knapsack dynamic program finds configurations of greatest
price, they are used as often as what is left allows, and lengths that are left over or that sequences with
room to spare had to take become dearer. A dual solution bounds the program from below, and passes go on
until the gap is small. The fractional solution is rounded down, and what the rounding leaves is packed by
best-fit decreasing, in arithmetic on counts. The result, a table of configurations with numbers of copies,
is bounded too; executors give each piece its rank among those of its length and read its place off it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, pieces, written
from .tokens import encoder, tokenizer_path

Config = dict[int, int]


class Knapsack:
    """Multisets of lengths of greatest value for every capacity, each length at most `most` times."""

    def __init__(self, lengths: np.ndarray, most: np.ndarray, value: np.ndarray, capacity: int):
        size, worth, length, number = [], [], [], []
        left = np.minimum(most, capacity // lengths)
        k = 1
        while (left > 0).any():  # a length's copies in lots of 1, 2, 4, ...
            some = np.flatnonzero(left > 0)
            take = np.minimum(left[some], k)
            size.append(lengths[some] * take)
            worth.append(value[some] * take)
            length.append(lengths[some])
            number.append(take)
            left[some] -= take
            k *= 2
        self.size, self.worth, self.length, self.number = (np.concatenate(x) for x in (size, worth, length, number))
        self.best = np.zeros(capacity + 1)
        self.taken = np.zeros((len(self.size), capacity + 1), dtype=bool)
        for i, (n, v) in enumerate(zip(self.size.tolist(), self.worth.tolist(), strict=True)):
            other = self.best[: capacity + 1 - n] + v
            self.taken[i, n:] = other > self.best[n:]
            np.maximum(self.best[n:], other, out=self.best[n:])

    def within(self, capacity: int) -> Config:
        found: Config = {}
        lots = np.flatnonzero(self.taken[:, capacity])
        while len(lots):
            i = int(lots[-1])
            length = int(self.length[i])
            found[length] = found.get(length, 0) + int(self.number[i])
            capacity -= int(self.size[i])
            lots = np.flatnonzero(self.taken[:i, capacity])
        return found


def dual_bound(lengths: np.ndarray, count: np.ndarray, price: np.ndarray, capacity: int) -> float:
    """Value of the dual solution that prices give: divided by the dearest configuration's price, they charge no
    configuration more than 1, so no cover has fewer sequences than what all lengths are charged."""
    best = np.zeros(capacity + 1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = int(fit[c])
        best[c] = max(best[c - 1], (best[c - lengths[:k]] + price[:k]).max()) if k else 0
    return float(count @ price / best[capacity])


def covering(histogram: dict[int, int], capacity: int, weight: np.ndarray, block: int = 32) -> list[tuple[Config, float]]:
    """A fractional cover of a histogram, every length as often as it occurs.

    Each pricing of what is left yields up to `block` configurations, from the dearest lengths on the dearest
    one that holds each; each is used as often as what is left allows, so it uses some length up. A length's
    weight grows exponentially with the part of it that is still left.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    count = np.array([histogram[x] for x in lengths.tolist()], dtype=np.float64)
    left = count.copy()
    place = {x: i for i, x in enumerate(lengths.tolist())}
    chosen: list[tuple[Config, float]] = []
    while len(open_ := np.flatnonzero(left > 1e-9)):
        price = lengths[open_] / capacity * (1 + 0.05 * weight[open_] * np.exp(left[open_] / count[open_] - 1))
        bag = Knapsack(lengths[open_], np.maximum(1, left[open_]).astype(np.int64), price, capacity)
        value = price + bag.best[capacity - lengths[open_]]
        used, near = 0, np.flatnonzero(value >= 0.99 * value.max())
        for i in near[np.argsort(-price[near], kind="stable")].tolist():
            first = int(lengths[open_[i]])
            config = bag.within(capacity - first)
            config[first] = config.get(first, 0) + 1
            at = [place[x] for x in config]
            times = np.array(list(config.values()), dtype=np.float64)
            x = float(np.min(left[at] / times))
            if x >= 1 or (not used and x > 1e-9):
                left[at] -= times * x
                left[left < 1e-9] = 0
                chosen.append((config, x))
                used += 1
            if used == block:
                break
    return chosen


def fractional(histogram: dict[int, int], capacity: int, gap: float = 0.001, passes: int = 8) -> tuple[list[tuple[Config, float]], float]:
    """Configurations with fractional numbers of copies that cover the histogram, and a bound of the program.

    Passes end when their sequences are at most 1 + gap times the bound, or after `passes`; the best one counts.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return [], 0.0
    count = np.array([histogram[x] for x in lengths.tolist()], dtype=np.float64)
    place = {x: i for i, x in enumerate(lengths.tolist())}
    weight, best, bound = np.ones(len(lengths)), None, 0.0
    bound = max(dual_bound(lengths, count, lengths / capacity, capacity), dual_bound(lengths, count, np.where(2 * lengths > capacity, 1.0, np.where(2 * lengths == capacity, 0.5, 1e-9)), capacity))
    for _ in range(passes):
        bound = max(bound, dual_bound(lengths, count, lengths / capacity * (1 + 0.05 * weight), capacity))
        found = covering(histogram, capacity, weight)
        if best is None or sum(x for _, x in found) < sum(x for _, x in best):
            best = found
        if sum(x for _, x in best) <= (1 + gap) * bound:
            break
        waste = np.zeros(len(lengths))
        for config, x in found:
            spare = 1 - sum(k * m for k, m in config.items()) / capacity
            for k, m in config.items():
                waste[place[k]] += m * x * spare
        weight = weight * np.exp(8 * waste / count)
    return best, bound


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Best-fit decreasing, on counts: equal sequences are kept as one entry with their number."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}
    frees: list[int] = []
    import bisect

    def put(free: int, config: Config, n: int) -> None:
        if free not in groups:
            groups[free] = []
            bisect.insort(frees, free)
        groups[free].append((config, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = bisect.bisect_left(frees, length)
            if i == len(frees):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, {length: each}, left // each)
                if left % each:
                    put(capacity - left % each * length, {length: left % each}, 1)
                break
            free = frees[i]
            config, n = groups[free].pop()
            if not groups[free]:
                del groups[free]
                frees.pop(i)
            each = free // length
            whole = min(n, left // each)
            if whole:
                put(free - each * length, config | {length: each}, whole)
                left -= whole * each
            if whole < n:
                n -= whole
                if left and left < each:
                    put(free - left * length, config | {length: left}, 1)
                    left, n = 0, n - 1
                if n:
                    put(free, config, n)
    return [x for entries in groups.values() for x in entries]


def plan(histogram: dict[int, int], capacity: int, gap: float = 0.001) -> list[tuple[Config, int]]:
    """Configurations with whole numbers of copies that use each length exactly as often as it occurs."""
    full = histogram.get(capacity, 0)
    rounded: list[tuple[Config, int]] = [({capacity: 1}, full)] if full else []
    left = {k: v for k, v in histogram.items() if k < capacity}
    for config, x in fractional(left, capacity, gap)[0]:
        n = min(int(x + 1e-6), *(left[k] // m for k, m in config.items()))
        if n > 0:
            rounded.append((config, n))
            for k, m in config.items():
                left[k] -= n * m
    return rounded + best_fit_decreasing({k: v for k, v in left.items() if v}, capacity)


def _slots(found: list[tuple[Config, int]]) -> dict[str, np.ndarray]:
    """For each length the runs of ranks that a configuration takes: where they start and what they get."""
    rows, base, used = [], 0, {}
    for config, n in found:
        offset = 0
        for length, m in config.items():
            rows.append((length, used.get(length, 0), n, base, offset))
            used[length] = used.get(length, 0) + m * n
            offset += m * length
        base += n
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "copies", "base", "offset"), columns, strict=True))


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document's ids with the end id: (doc_id, piece, start, length, ids_crc32)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part in pieces(batch, "text", 2_000_000):
                ids, counts = encode(part.column(1))
                out = []
                at = 0
                for doc, n in zip(part.column(0).to_pylist(), counts.tolist(), strict=True):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    start = 0
                    for k, end in enumerate(range((n % capacity) + 1, n + 2, capacity)):
                        out.append((doc, k, start, end - start, zlib.crc32(own[start:end].tobytes())))
                        start = end
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def place(found: DataFrame, capacity: int, gap: float = 0.001, salts: int = 64) -> DataFrame:
    """Give each row of (doc_id, piece, length, ...) its sequence_id and offset; length is 1 .. capacity.

    Ranks among equal lengths come from (length, salt) windows and the counts before them, so a length that
    most pieces have is split; ties of (doc_id, piece), as from repeated rows, are ranked in any order.
    Returns the columns of found with sequence_id and offset.
    """
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = _slots(plan(histogram, capacity, gap))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))).join(first, ["length", "_salt"])
    names = [x for x in found.columns]
    ranked = ranked.select(*names, (F.col("_first") + F.col("_rank") - 1).alias("_rank"))
    key = table["length"] * (1 << 42) + table["rank"] if len(histogram) else np.zeros(0, dtype=np.int64)

    def read_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            i = np.searchsorted(key, length * (1 << 42) + rank, side="right") - 1
            q = rank - table["rank"][i]
            copies = table["copies"][i]
            sequence, offset = table["base"][i] + q % copies, table["offset"][i] + q // copies * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in found.schema)
    return ranked.mapInArrow(read_off, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, gap: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into few sequences of at most `capacity` ids.

    Each document's ids with one end id form one piece; a longer one is cut into pieces of `capacity`, of
    which the first may be shorter. Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset),
    a row for each piece. A null text is empty (one end id); a null doc_id is kept; repeated rows are packed
    as rows of their own; an empty table gives no rows.
    """
    found, _ = written(token_pieces(docs, capacity, tokenizer or tokenizer_path(), end_id, id_col, text_col), "pieces")
    return place(found, capacity, gap)
