"""Exact removal of repeated byte strings by a distributed, sparse suffix array.

A string of `size` bytes is repeated if it also starts earlier. Sorting every suffix would move the corpus
a hundred times over; instead each window of `size` bytes is represented by its anchor, the 32-byte gram in
it of least hash. Equal windows have equal anchors at equal places, so only suffixes at anchors are sorted:

1. Sampled splitters range-partition the anchors' suffixes by leading bytes (then by hashes of the gram and
   of all that the anchor's windows cover, then by position, so that even one suffix that a third of the
   rows hold is dealt evenly). A bucket is sorted by multikey quicksort and neighbours are compared, the
   edges of buckets with those of the buckets beside them. An anchor whose whole cover occurs earlier is
   done; one whose gram has different covers is left open.
2. A window has 66 bytes from its anchor on, or 66 up to its anchor's gram's end (for size 100). Each open
   anchor's windows of either kind go, with their text, to those that share these bytes, where windows are
   compared. A key that more than 20,000 of these rows have isn't gathered: its windows are dealt out and
   compared as in step 1.

Hashes are of 64 bits besides the leading bytes; two different strings pass for equal with a chance of
about 1e-5 over 1e8 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import binary_list, discard, free_shuffles, keyed, lean, mix, pieces, ragged, text_bytes, written

GRAM = 32
#: The longest string that can be asked for: a place has eight bits for the windows of an anchor.
MOST_SIZE = GRAM + 254
_SEGMENT = 1 << 18
_TABLE = np.random.default_rng(7).integers(1, 2**63, size=256, dtype=np.uint64)
_R = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    if not _POWERS:
        n = 4 * _SEGMENT + 4096
        for base in (_R, pow(_R, -1, 1 << 64)):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _POWERS.append(np.cumprod(x, dtype=np.uint64))
    return _POWERS


class Hashes:
    """Hashes of any stretches of some bytes, from one pass over them."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers()
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice, at: np.ndarray | slice) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[at])


def segments(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of at least size bytes in groups: their bytes joined, where each begins, its row's ord and place.

    A long text comes in stretches that share size - 1 bytes with the next one.
    """
    data, at = text_bytes(batch.column(1))
    ords = batch.column(0).to_numpy()
    lengths = np.diff(at)
    starts, ends, rows = [], [], []
    for i in np.flatnonzero(lengths >= size):
        for lo in range(0, int(lengths[i]) - size + 1, _SEGMENT):
            starts.append(at[i] + lo)
            ends.append(min(at[i] + lo + _SEGMENT + size - 1, at[i + 1]))
            rows.append(i)
    k = 0
    while k < len(starts):
        j, total = k, 0
        while j < len(starts) and (j == k or total + ends[j] - starts[j] <= 2 * _SEGMENT):
            total += ends[j] - starts[j]
            j += 1
        some = np.array(rows[k:j])
        yield np.concatenate([data[a:b] for a, b in zip(starts[k:j], ends[k:j], strict=True)]), np.cumsum([0, *(b - a for a, b in zip(starts[k:j], ends[k:j], strict=True))]), ords[some], np.array(starts[k:j]) - at[some]
        k = j


def anchors(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """For the runs of windows that share an anchor: key of its suffix, hash of their cover, first window,
    number of windows, and the anchor's distance from the first window."""
    hashes, n = Hashes(data), len(data)
    m = n - GRAM + 1
    gram = hashes.of(slice(0, m), slice(GRAM, n + 1), slice(0, m))
    low = np.uint64((1 << 22) - 1)
    least = (gram & ~low) | np.arange(m, dtype=np.uint64)
    width, reach = size - GRAM + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    anchor = (least & low).astype(np.int64)  # of the window at each place, whether it's within one text or not
    within = np.zeros(len(anchor), dtype=bool)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
    within[:] = np.arange(len(anchor)) + size <= at[owner + 1]
    change = np.ones(len(anchor), dtype=bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (within[1:] != within[:-1])
    first = np.flatnonzero(change)
    number = np.diff(np.append(first, len(anchor)))
    keep = within[first]
    first, number = first[keep], number[keep]
    a = anchor[first]
    lead = np.zeros(len(a), dtype=np.uint64)
    for i in range(4):
        lead = (lead << np.uint64(8)) | data[a + i].astype(np.uint64)
    key = (lead << np.uint64(32)) | (gram[a] >> np.uint64(32))
    cover = mix(hashes.of(first, first + number + size - 1, first) + (a - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number.astype(np.uint64))
    return key, cover, first, number, a - first


def anchor_rows(rows: DataFrame, size: int) -> DataFrame:
    """(key, cover, ord, place) of all anchors; place is the first window << 16 | the anchor's distance << 8 | windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 2_000_000):
                for data, at, ords, base in segments(part, size):
                    key, cover, first, number, distance = anchors(data, at, size)
                    owner = np.searchsorted(at, first, side="right") - 1
                    place = (first - at[owner] + base[owner]) << 16 | distance << 8 | number
                    yield _batch(key, cover, ords[owner], place)

    return rows.select("ord", "text").mapInArrow(lean(run), "key long, cover long, ord long, place long")


def side_rows(rows: DataFrame, size: int) -> DataFrame:
    """(g, ord, place, bytes): for each open anchor (places in column `open`) its windows of either kind.

    g is a hash of the bytes that all windows of the kind share; place is the first window << 16 | windows.
    """
    reach = size - GRAM - (size - GRAM) // 2  # windows that start this far before the anchor, or nearer, are of kind 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 2_000_000):
                data, at = text_bytes(part.column(1))
                lists = part.column(2)
                values = lists.flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                first, distance, number = (values >> 16) + at[row], values >> 8 & 255, values & 255
                a = first + distance
                for kind in (0, 1):
                    start = np.maximum(first, a - reach) if not kind else first
                    end = first + number if not kind else np.minimum(first + number, a - reach)
                    has = np.flatnonzero(start < end)
                    s, n, anchor = start[has], (end - start)[has], a[has]
                    common = (anchor, anchor + size - reach) if not kind else (anchor - reach - 1, anchor + GRAM)
                    g = mix(_stretches(data, *common) ^ np.uint64(kind))
                    length = n + size - 1
                    raw = data[ragged(s, length)]
                    ords = part.column(0).to_numpy()[row[has]]
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ords), pa.array((s - at[row[has]]) << 16 | n), binary_list(raw, length)], names=["g", "ord", "place", "bytes"])

    return rows.mapInArrow(lean(run), "g long, ord long, place long, bytes binary")


def _stretches(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches of ascending starts, in parts that the powers' table holds."""
    out = np.zeros(len(start), dtype=np.uint64)
    lo = 0
    while lo < len(start):
        base = int(start[lo])
        hi = int(np.searchsorted(start, base + 2 * _SEGMENT, side="left"))
        h = Hashes(data[base : int(end[lo:hi].max())])
        out[lo:hi] = h.of(start[lo:hi] - base, end[lo:hi] - base, start[lo:hi] - base)
        lo = hi
    return out


def _opened(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, ...]:
    """All windows of rows (g, ord, place, bytes): the row, the window's start in its text, its hash and first 8 bytes."""
    data, at = text_bytes(batch.column(3))
    place = batch.column(2).to_numpy()
    number = place & 0xFFFF
    row = np.repeat(np.arange(batch.num_rows), number)
    p = ragged(at[:-1], number)
    lead = np.zeros(len(p), dtype=np.uint64)
    for i in range(8):
        lead = (lead << np.uint64(8)) | data[p + i].astype(np.uint64)
    return row, p - at[row] + (place >> 16)[row], _stretches(data, p, p + size), lead


def compared_sides(cold: DataFrame, size: int) -> DataFrame:
    """(ord, place): windows of rows (g, ord, place, bytes) that another row of the same g has earlier."""

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, start, h, _ = _opened(batch, size)
        ords = batch.column(1).to_numpy()[row]
        g = batch.column(0).to_numpy()[row]
        order = multikey_order([h, g, ords, start])
        h, g, ords, start = (x[order] for x in (h, g, ords, start))
        again = np.flatnonzero((h[1:] == h[:-1]) & (g[1:] == g[:-1])) + 1
        ords, start = ords[again], start[again]
        order = np.lexsort((start, ords))
        ords, start = ords[order], start[order]
        new = np.append(True, (ords[1:] != ords[:-1]) | (start[1:] != start[:-1] + 1)) if len(ords) else np.zeros(0, dtype=bool)
        at = np.flatnonzero(new)
        number = np.diff(np.append(at, len(ords)))
        cut = -(-number // 200)  # a place holds at most 255 windows
        at, number = ragged(np.zeros(len(at), dtype=np.int64), cut) * 200 + np.repeat(at, cut), np.repeat(number, cut)
        number = np.minimum(200, number - (at - np.repeat(np.flatnonzero(new), cut)))
        return pa.RecordBatch.from_arrays([pa.array(ords[at]), pa.array(start[at] << 16 | number)], names=["ord", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            g = batch.column(0).to_numpy()
            last = int(np.searchsorted(g, g[-1])) if len(g) else 0
            if last:
                ready = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()
                yield from map(whole, ready)
                held = []
            held.append(batch.slice(last))
        for x in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
            yield whole(x)

    return cold.repartition("g").sortWithinPartitions("g").mapInArrow(lean(run), "ord long, place long")


def window_rows(hot: DataFrame, size: int) -> DataFrame:
    """(key, cover, ord, place) of all windows of rows (g, ord, place, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                row, start, h, lead = _opened(part, size)
                yield _batch(lead, h, part.column(1).to_numpy()[row], start << 16 | 1)

    return hot.mapInArrow(lean(run), "key long, cover long, ord long, place long")


def _batch(key: np.ndarray, cover: np.ndarray, ords: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Unsigned keys are stored with the top bit turned, so that signed order is theirs."""
    turned = (key ^ np.uint64(1 << 63)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(turned), pa.array(cover.view(np.int64)), pa.array(ords), pa.array(place)], names=["key", "cover", "ord", "place"])


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several keys: quicksort by the first, and by the next where runs are still tied."""
    order = np.argsort(columns[0])
    tied = np.zeros(len(order), dtype=bool)
    value = columns[0][order]
    same = value[1:] == value[:-1]
    for k in range(1, len(columns)):
        if not same.any():
            break
        tied[:] = False
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        run = np.cumsum(np.append(True, ~same))[at]
        order[at] = order[at][np.lexsort((columns[k][order[at]], run))]
        value = columns[k][order]
        same = same & (value[1:] == value[:-1])
    return order


def bucket(columns: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """How many splitters (rows of as many keys) are at or below each row, in lexicographic order.

    The first keys give each row a range of splitters with the same one; rows whose range isn't empty go on by
    bisection in it, all at once, so the work grows with the logarithm of the number of splitters.
    """
    low = np.searchsorted(splitters[:, 0], columns[0], side="left")
    own = np.flatnonzero(low < np.searchsorted(splitters[:, 0], columns[0], side="right"))
    if not len(own):
        return low
    keys = [c[own] for c in columns]
    a, z = low[own], np.searchsorted(splitters[:, 0], keys[0], side="right")
    while (open_ := a < z).any():
        middle = np.minimum((a + z) // 2, len(splitters) - 1)
        below = np.ones(len(own), dtype=bool)
        for k in range(len(keys) - 1, 0, -1):
            at = splitters[middle, k]
            below = (at < keys[k]) | ((at == keys[k]) & below)
        a, z = np.where(open_ & below, middle + 1, a), np.where(open_ & ~below, middle, z)
    low[own] = a
    return low


def compare(rows: DataFrame, sample: DataFrame, share: float, bucket_rows: int, name: str, want_open: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """Sort (key, cover, ord, place) and compare neighbours.

    sample: the rows of a part `share` of the texts, from which splitters are taken so that buckets have
    about bucket_rows rows. Returns, as written tables: the rows (ord, place) whose (key, cover) is also in
    an earlier row; if want_open, the first rows of their (key, cover) whose key has other covers too; and
    the paths.
    """
    spark = rows.sparkSession
    n = sample.count()
    buckets = max(int(n / share / bucket_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = 100
    part = min(1.0, each * buckets / max(n, 1))
    taken = sample.where(F.pmod(F.xxhash64("ord", "place"), F.lit(1 << 30)) < int(part * (1 << 30)) + 1)
    splitters = _every(taken, min(each, max(1, n // buckets)), buckets // 1000 + 1)
    columns = ["key", "cover", "ord", "place"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = bucket([c.to_numpy() for c in batch.columns], splitters)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*columns, "bucket"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        values = [table.column(i).to_numpy() for i in (4, 0, 1, 2, 3)]
        order = multikey_order(values)
        b, key, cover, ords, place = (v[order] for v in values)
        new_bucket = np.append(True, b[1:] != b[:-1])
        new_key = np.append(True, key[1:] != key[:-1]) | new_bucket
        first = np.append(True, cover[1:] != cover[:-1]) | new_key
        run = np.cumsum(new_key) - 1
        covers = np.bincount(run, weights=first).astype(np.int64)[run]
        kind = np.where(first, np.where(covers > 1, 1, 9), 0)
        # what stands at a bucket's edges may go on in the next one: its first row, and the last run's rows
        ends = np.append(new_bucket[1:], True)
        in_last = np.isin(run, run[ends])
        in_first = np.isin(run, run[new_bucket])
        edge = first & (new_bucket | ((covers == 1) & (in_last | in_first)))
        kind[edge] = 2
        tail = ends & ~edge  # says what a bucket ends with; no row of its own
        for wanted, rows_ in ((0, kind == 0), (1, kind == 1), (2, edge), (3, tail)):
            if wanted == 1 and not want_open:
                continue
            i = np.flatnonzero(rows_)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), wanted, dtype=np.int32)), pa.array(b[i]), pa.array(key[i]), pa.array(cover[i]), pa.array(ords[i]), pa.array(place[i]), pa.array(covers[i])], names=["kind", "bucket", *columns, "covers"])

    dealt = rows.mapInArrow(lean(deal), "key long, cover long, ord long, place long, bucket int")
    found = dealt.repartitionById(len(splitters) + 1, F.col("bucket")).mapInArrow(lean(sort), "kind int, bucket int, key long, cover long, ord long, place long, covers long")
    found, path = written(found, name)
    # a few rows for each bucket: equal rows are neighbours, so an edge is repeated if any edge row precedes it
    edges = found.where("kind >= 2")
    before = F.row_number().over(Window.partitionBy("key", "cover").orderBy("ord", "place")) > 1
    of_key = Window.partitionBy("key")
    mixed = (F.col("covers") > 1) | (F.min("cover").over(of_key) != F.max("cover").over(of_key))
    edges = edges.withColumn("before", before).withColumn("mixed", mixed).where("kind = 2")
    repeated = found.where("kind = 0").select("ord", "place").unionAll(edges.where("before").select("ord", "place"))
    open_ = found.where("kind = 1").select("ord", "place").unionAll(edges.where("mixed and not before").select("ord", "place"))
    return repeated, open_, [path]


def _every(rows: DataFrame, step: int, parts: int) -> np.ndarray:
    """Each step-th row of (key, cover, ord, place) in ascending order, chosen in sorted ranges; distinct."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = step // 2
        for batch in batches:
            yield batch.take(pa.array(np.arange(skip, batch.num_rows, step)))
            skip = (skip - batch.num_rows) % step

    columns = ["key", "cover", "ord", "place"]
    ranges = rows.select(*columns).repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    found = ranges.mapInArrow(lean(pick), "key long, cover long, ord long, place long").toArrow()
    return np.unique(np.column_stack([found.column(i).to_numpy() for i in range(4)]).reshape(-1, 4), axis=0)


def repeated_spans(rows: DataFrame, size: int = 100, bucket_rows: int = 400_000, hot_rows: int = 20_000) -> tuple[DataFrame, list[str]]:
    """(ord, spans): for each text with repeats the windows, as places, that also start earlier; and paths.

    A key of more than hot_rows rows is dealt out by its windows.
    """
    share, spark = 16, rows.sparkSession
    some = rows.where(F.pmod(F.xxhash64("ord"), F.lit(share)) == 0)
    done, open_, paths = compare(anchor_rows(rows, size), anchor_rows(some, size), 1 / share, bucket_rows, "anchors", True)
    free_shuffles(spark)
    lists = open_.groupBy("ord").agg(F.sort_array(F.collect_list("place")).alias("open"))
    sides, path = written(side_rows(rows.select("ord", "text").join(lists, "ord"), size), "sides")
    free_shuffles(spark)
    hot, hot_path = written(sides.groupBy("g").count().where(F.col("count") > hot_rows).select("g"), "hot-keys")
    cold, more, others = compared_sides(sides.join(hot, "g", "left_anti"), size), done.limit(0), []
    if hot.head(1):
        windows = window_rows(sides.join(hot, "g", "left_semi"), size)
        more, _, others = compare(windows, windows, 1, bucket_rows, "window-runs", False)
    near, cold_path = written(cold.unionAll(more), "window-spans")
    both = done.unionAll(near).groupBy("ord").agg(F.collect_list("place").alias("spans"))
    discard(spark, path, hot_path, *others)
    free_shuffles(spark)
    return both, [*paths, cold_path]


def kept_text(data: np.ndarray, places: np.ndarray, size: int) -> tuple[bytes, int, list[tuple[int, int]]]:
    """The bytes that remain, how many were removed, and the removed stretches."""
    if not len(places):
        return data.tobytes(), 0, []
    change = np.zeros(len(data) + 1, dtype=np.int32)
    start = places >> 16
    np.add.at(change, start, 1)
    np.add.at(change, start + (places & 255) + size - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    return data[~gone].tobytes(), int(np.count_nonzero(gone)), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def remove_repeats(docs: DataFrame, size: int = 100, bucket_rows: int = 400_000, hot_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Remove each byte that a string of `size` bytes covers which also starts earlier.

    Earlier: in a smaller doc_id (equal ids: in order of the text), or before in the same text; texts are
    their UTF-8 bytes, matches never cross texts and are judged on the input. A null text is empty; repeated
    rows are documents of their own. Returns ord, doc_id, n_bytes, n_removed, removed (start, end), kept: bytes, or with decode the text, in which a character that is cut goes as a whole.
    """
    if size > MOST_SIZE:
        raise ValueError(f"size must be at most {MOST_SIZE}")
    rows = keyed(docs, id_col, text_col)
    spans, _ = repeated_spans(rows, size, bucket_rows, hot_rows)
    schema = "ord long, doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept " + ("string" if decode else "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, at = text_bytes(part.column(2))
                out = []
                for i, places in enumerate(part.column(3)):
                    own = data[at[i] : at[i + 1]]
                    marks = np.zeros(0, dtype=np.int64) if not places.is_valid else places.values.to_numpy()
                    kept, n, removed = kept_text(own, marks, size)
                    if decode:  # by stretches, as the halves of two cut characters may look like another
                        edges = [0, *(x for span in removed for x in span), len(own)]
                        kept = "".join(own[a:b].tobytes().decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2], strict=True))
                    out.append((len(own), n, [{"start": a, "end": b} for a, b in removed], kept))
                n_bytes, n_removed, removed, kept = zip(*out, strict=True)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.string() if decode else pa.binary())], names=["ord", "doc_id", "n_bytes", "n_removed", "removed", "kept"])

    return rows.select("ord", "doc_id", "text").join(spans, "ord", "left").mapInArrow(lean(run), schema)
