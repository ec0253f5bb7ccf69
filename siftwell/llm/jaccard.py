"""Exact Jaccard similarity join of documents as sets of word shingles, with adaptive multi-match prefixes.

Documents with the same set are one class. A class's shingles are ordered by rarity, as a count sketch of
fixed size over the whole corpus has it, then by hash. If two sets of similarity t or more have n shingles
at the most, the first n - ceil(t n) + l shingles of each share at least l. Each class chooses its l by
what its plain prefix would cost, as the sketch estimates it: from 1 up to half of its set, so a costly one
takes a longer prefix and asks for as many more shared shingles before a pair is verified.

A group of near copies would still meet in pairs, as all hold the shingles of what they were copied from. So
the classes whose lists share a hub (the class that most others share lists with) are told apart by what
they differ from it in: the symmetric difference of two sets is that of their differences from any third
one. Of two classes of which one isn't linked to the hub, the differences must share more than about half of
the smaller one, mostly shingles that few others have; prefixes of the differences, their rarest elements
first, then leave few pairs. Classes of different hubs, or of none, are found through the prefixes' lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, binary_list, discard, free_shuffles, hash_runs, hash_windows, keyed, lean, mix, pieces, ragged, text_bytes, words, written
from .components import components

_SKETCH, _SLICES = 1 << 20, 64


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and how many each has.

    A-Z is lowered, words are runs without ASCII white space; fewer than `width` words are one shingle.
    """
    data, at = text_bytes(column)
    data = LOWER[data]
    starts, ends, counts = words(data, at)
    h = hash_runs(data, starts, ends)
    first = np.concatenate([[0], np.cumsum(counts)])
    windows = hash_windows(h, width)
    row = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
    begin = np.concatenate([np.arange(a, max(a, b - width + 1)) for a, b in zip(first[:-1], first[1:], strict=True)]) if len(counts) else np.zeros(0, dtype=np.int64)
    values = windows[begin.astype(np.int64)]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = h[first[i] : first[i + 1]]
        row = np.append(row, i)
        values = np.append(values, hash_windows(own, len(own)) + np.uint64(len(own)))
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    keep = np.append(True, (row[1:] != row[:-1]) | (values[1:] != values[:-1])) if len(row) else np.zeros(0, dtype=bool)
    row, values = row[keep], values[keep]
    return values, np.bincount(row, minlength=len(counts)).astype(np.int64)


def _set_hashes(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts), dtype=np.uint64)
    has = counts > 0
    if has.any():
        first = (np.cumsum(counts) - counts)[has]
        out[has] = mix(np.add.reduceat(mix(values), first) + np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), first) * np.uint64(3) + counts[has].astype(np.uint64))
    return out


def _survey(rows: DataFrame, width: int) -> tuple[DataFrame, str]:
    """A row (ord, doc_id, n, h) for each text, and the task's part of the sketch as (slice, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(_SKETCH, dtype=np.uint32)
        any_ = False
        for batch in batches:
            for part in pieces(batch, "text"):
                values, counts = shingle_sets(part.column(2), width)
                sketch += np.bincount(values & np.uint64(_SKETCH - 1), minlength=_SKETCH).astype(np.uint32)
                any_ = any_ or bool(len(values))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts), pa.array(_set_hashes(values, counts).view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["ord", "doc_id", "n", "h", "slice", "counts"])
        if any_:
            parts = [x.tobytes() for x in sketch.reshape(_SLICES, -1)]
            none = pa.nulls(_SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array(range(_SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["ord", "doc_id", "n", "h", "slice", "counts"])

    return written(rows.select("ord", "doc_id", "text").mapInArrow(lean(run), "ord long, doc_id long, n long, h long, slice int, counts binary"), "shingle-survey")


def _sketch(survey: DataFrame) -> np.ndarray:
    """The sum of all parts: 2 ** 20 counters, whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, dtype=np.uint32).astype(np.uint64)
                total[k] = total[k] + part if k in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    out = np.zeros((_SLICES, _SKETCH // _SLICES), dtype=np.uint64)
    for r in survey.where("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(lean(add), "slice int, counts binary").collect():
        out[r["slice"]] = np.frombuffer(r["counts"], dtype=np.uint64)
    return out.ravel()


def prefix_lists(rows: DataFrame, sketch: np.ndarray, width: int, percent: int, hot: int = 100_000) -> DataFrame:
    """(token, h, n, level, need, size): prefix shingles that several classes have.

    level: the least l whose prefix has the shingle; need: the class's own l; size: about how many classes have
    the shingle. A shingle whose counter is more than `hot` above the mean is dealt out over 64 tasks by h, and
    kept whether it's shared or not.
    """
    mean = float(sketch.mean())
    shared = rows.sparkSession.sparkContext.broadcast(sketch)
    names = ["token", "h", "n", "packed", "salt"]
    out_names = ["token", "h", "n", "packed", "size"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value
        rarity = np.floor(np.log2(np.maximum(counters / (mean + 1), 1))).astype(np.int64)
        for batch in batches:
            done: set[int] = set()  # a batch's copies go once
            for part in pieces(batch, "text"):
                values, counts = shingle_sets(part.column(1), width)
                h = _set_hashes(values, counts)
                row = np.repeat(np.arange(len(counts)), counts)
                cell = (values & np.uint64(_SKETCH - 1)).astype(np.int64)
                order = np.lexsort((values, rarity[cell], row))
                values, cell = values[order], cell[order]
                rank = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
                least = -(-percent * counts // 100)
                plain = counts - least + 1
                inside = rank < plain[row]
                excess = np.maximum(counters[cell].astype(np.float64) - mean - 2 * mean**0.5, 0)
                cost = np.bincount(row[inside], weights=excess[inside], minlength=len(counts)) / np.maximum(plain, 1)
                need = np.clip(1 + np.floor(counts / 8 * np.minimum(np.log10(1 + cost), 4)).astype(np.int64), 1, np.maximum(least, 1))
                new = np.array([x not in done and not done.add(x) for x in h.tolist()], dtype=bool) & (counts > 0)
                keep = (rank < (plain + need - 1)[row]) & new[row]
                r = row[keep]
                level = np.maximum(rank[keep] - plain[r] + 2, 1)
                salt = np.where(counters[cell[keep]] > mean + hot, 1 + (h[r] & np.uint64(63)).astype(np.int64), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(h[r].view(np.int64)), pa.array(counts[r]), pa.array(level << 32 | need[r]), pa.array(salt)], names=names)

    def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, sorted by (token, h), whose token another h has too; each once."""
        held = np.zeros((0, 5), dtype=np.int64)
        for batch in batches:
            block = np.vstack([held, np.column_stack([c.to_numpy() for c in batch.columns])])
            last = int(np.searchsorted(block[:, 0], block[-1, 0])) if len(block) else 0
            if len(block) - last > 500_000:  # a long list goes out in parts, as its head shows that it is shared
                last = len(block) - 2
            yield _several(block[:last])
            held = block[max(0, last) :]
        yield _several(held)

    def _several(block: np.ndarray) -> pa.RecordBatch:
        size = np.zeros(0, dtype=np.int64)
        if len(block):
            block = block[np.append(True, (block[1:, 0] != block[:-1, 0]) | (block[1:, 1] != block[:-1, 1]))]
            run = np.cumsum(np.append(True, block[1:, 0] != block[:-1, 0])) - 1
            size = np.bincount(run)[run]
            stay = (size > 1) | (block[:, 4] > 0)
            block, size = block[stay], size[stay]
        return pa.RecordBatch.from_arrays([*(pa.array(block[:, i]) for i in range(4)), pa.array(size)], names=out_names)

    dealt = rows.select("ord", "text").mapInArrow(lean(emit), "token long, h long, n long, packed long, salt int").repartition("token", "salt")
    found = dealt.sortWithinPartitions("token", "h").mapInArrow(lean(shared_only), "token long, h long, n long, packed long, size long")
    return found.select("token", "h", "n", F.shiftright("packed", 32).alias("level"), F.col("packed").bitwiseAND(F.lit((1 << 32) - 1)).alias("need"), "size")


def hubs_of(lists: DataFrame) -> DataFrame:
    """(h, hub): of the classes that lead a list of h, the one that most others share lists with.

    A leader must share an eighth of what h asks for, two shingles at least, and be of up to twice its size.
    """
    weighted = lists.withColumn("g", F.sum("size").over(Window.partitionBy("h"))).select("token", "h", "n", "need", "g")
    lead = weighted.groupBy("token").agg(F.max(F.struct("g", "h", "n")).alias("x"))
    near = lists.join(lead, "token").where((F.col("h") != F.col("x.h")) & _sizes("n", "x.n", 50))
    met = near.groupBy("h", F.col("x.h").alias("hub")).agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need"), F.max("x.g").alias("g")).where("c > 1 and 8 * c >= need")
    return met.groupBy("h").agg(F.max(F.struct("g", "hub")).alias("x")).select("h", F.col("x.hub").alias("hub"))


def dealt_join(left: DataFrame, right: DataFrame, key: str, most: int = 500) -> DataFrame:
    """left with right's columns by key, which is unique in right; a key of more than `most` rows is dealt out
    to tasks of about so many, each with a copy of right's row. Such keys are few: a row in `most` at the most."""
    share = left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_share")).where("_share > 1")
    salt = F.pmod(F.xxhash64(*[x for x in left.columns if x in ("h", "a", "b")]), F.coalesce("_share", F.lit(1))).cast("int")
    mine = left.join(share, key, "left").withColumn("_salt", salt).drop("_share")
    other = right.join(share, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_share", F.lit(1)) - 1))).drop("_share")
    return mine.join(other, [key, "_salt"]).drop("_salt")


def differences(rows: DataFrame, classes: DataFrame, hubs: DataFrame, width: int, percent: int) -> tuple[DataFrame, list[str]]:
    """(h, hub, n, center, size, near, d): what each class differs from its hub in, and whether it's linked to it.

    n and center are the sizes of the two sets, d the shingles that only one of them has, size their number.
    """
    wanted = hubs.unionAll(hubs.select(F.col("hub").alias("h"), "hub").distinct()).join(classes.select("h", "ord"), "h")
    members, path = written(rows.select("ord", "text").join(wanted, "ord").select("h", "hub", "text"), "members")
    free_shuffles(rows.sparkSession)
    centers = members.where("h = hub").select("hub", F.col("text").alias("center"))
    both = dealt_join(members.where("h <> hub"), centers, "hub").select("h", "hub", "text", "center").sortWithinPartitions("hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1_000_000):
                values, counts = shingle_sets(part.column(2), width)
                hub = part.column(1).to_numpy()
                first = np.flatnonzero(np.append(True, hub[1:] != hub[:-1]))
                which = np.cumsum(np.append(True, hub[1:] != hub[:-1])) - 1
                others, sizes = shingle_sets(part.column(3).take(pa.array(first)), width)
                begin = np.cumsum(sizes) - sizes
                size = sizes[which]
                row = np.concatenate([np.repeat(np.arange(len(counts)), counts), np.repeat(np.arange(len(counts)), size)])
                both = np.concatenate([values, others[ragged(begin[which], size)]])
                order = np.lexsort((both, row))
                row, both = row[order], both[order]
                twice = (row[1:] == row[:-1]) & (both[1:] == both[:-1])
                single = ~(np.append(twice, False) | np.append(False, twice))
                d = np.bincount(row[single], minlength=len(counts))
                shared = (counts + size - d) // 2
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(d)]).astype(np.int32)), pa.array(both[single].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts), pa.array(size), pa.array(d), pa.array(100 * shared >= percent * (counts + size - shared)), lists], names=["h", "hub", "n", "center", "size", "near", "d"])

    found, own = written(both.mapInArrow(lean(run), "h long, hub long, n long, center long, size long, near boolean, d array<long>"), "differences")
    return found, [path, own]


def close_differences(spaces: DataFrame, percent: int) -> DataFrame:
    """(a, b, hub): the pairs of one hub, not both linked to it, that may be similar enough.

    With i shared shingles, two sets of n and m have similarity percent/100 if n + m - 2 i <= k (n + m), where
    k = (100 - percent) / (100 + percent), and as much is the size of the difference of their differences. A
    class that isn't linked to the hub differs from it in more than k (its size + the hub's). So what any class
    shares with such a one of its difference D is more than (|D| + k (hub's - own size)) / 2, and what such a
    one shares with a linked class is at least |D| - (100 - percent) / percent of its own size.
    """
    up, down = 100 + percent, 100 - percent
    groups = spaces.groupBy("hub").agg(F.count(F.lit(1)).alias("m"), F.max(~F.col("near")).alias("open")).where("open and m > 1").select("hub")
    single = spaces.join(groups, "hub", "left_semi").select("hub", "h", "n", "center", "size", "near", F.explode("d").alias("e"))
    often = single.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    own = Window.partitionBy("hub", "h")
    place = F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("f", "e")) - 1
    ranked = single.join(often, ["hub", "e"]).withColumn("j", place)
    short = F.col("size") - F.floor((up * F.col("size") + down * (F.col("center") - F.col("n"))) / (2 * up))
    long = F.col("size") - F.greatest(F.lit(1), F.col("size") - F.floor(down * F.col("n") / percent)) + 1
    ranked = ranked.withColumn("short", short).where((F.col("j") < F.col("short")) | (~F.col("near") & (F.col("j") < long))).select("hub", "e", "h", "n", "size", "near", "j", (F.col("j") < F.col("short")).alias("short"))
    left = ranked.where("not near")
    right = ranked.where("short").select("hub", "e", *[F.col(x).alias(f"{x}_") for x in ("h", "n", "size", "near", "j")])
    most = F.least(F.col("size") - F.col("j"), F.col("size_") - F.col("j_"))
    enough = 2 * up * most >= up * (F.col("size") + F.col("size_")) - down * (F.col("n") + F.col("n_"))
    both = left.join(right, ["hub", "e"]).where((F.col("near_") | (F.col("short") & (F.col("h") < F.col("h_")))) & enough & _sizes("n", "n_", percent))
    return both.select(F.col("h").alias("a"), F.col("h_").alias("b"), "hub").distinct()


def _same(pairs: DataFrame, spaces: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of one hub whose sets are similar enough, told from their differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            other = np.array([len(np.setxor1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True)) for x, y in zip(batch.column(3), batch.column(5), strict=True)], dtype=np.int64)
            shared = (n - other) // 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(100 * shared >= percent * (n - shared)))

    # a class has one hub, so h names its difference
    one = dealt_join(pairs.select("a", "b"), spaces.select(F.col("h").alias("a"), "n", "d"), "a")
    two = dealt_join(one, spaces.select(F.col("h").alias("b"), F.col("n").alias("m"), F.col("d").alias("t")), "b")
    return two.select("a", "b", "n", "d", "m", "t").mapInArrow(lean(run), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = np.count_nonzero(v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u)
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = dealt_join(pairs, sets.select(F.col("h").alias("b"), F.col("s").alias("t")), "b")
    return dealt_join(one, sets.select(F.col("h").alias("a"), "s"), "a").select("a", "b", "s", "t").mapInArrow(lean(run), "a long, b long")


def _sets(rows: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> tuple[DataFrame, str]:
    """(h, s): the sorted shingle hashes of every class in pairs, from one of its texts; and the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                values, counts = shingle_sets(part.column(1), width)
                yield pa.RecordBatch.from_arrays([part.column(0), binary_list(values, counts)], names=["h", "s"])

    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct().join(classes, "h").select("ord", "h")
    found = written(rows.select("ord", "text").join(wanted, "ord").select("h", "text").mapInArrow(lean(run), "h long, s binary"), "shingle-sets")
    free_shuffles(rows.sparkSession)
    return found


def link(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ord, doc_id, n_shingles, component_id) for each row: the least doc_id that links reach, itself included.

    Two rows link when 100 * intersection >= percent * union of their sets of distinct `width`-word
    shingles. A row with fewer words has its whole word sequence as one shingle; one without words, or a
    null text, has none and links with nothing. Repeated rows are rows of their own with equal sets.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    survey, survey_path = _survey(rows, width)
    texts = survey.where("ord is not null").select("ord", "doc_id", "n", "h")
    lists, lists_path = written(prefix_lists(rows, _sketch(survey), width, percent), "prefix-lists")
    free_shuffles(spark)
    classes = texts.where("n > 0").groupBy("h").agg(F.min("ord").alias("ord"), F.min("doc_id").alias("least_id"))
    hubs, hubs_path = written(hubs_of(lists), "hubs")
    free_shuffles(spark)
    spaces, space_paths = differences(rows, classes, hubs, width, percent)
    pairs, pairs_path = written(close_differences(spaces, percent), "pairs")
    free_shuffles(spark)
    edges = spaces.where("near").select(F.col("h").alias("a"), F.col("hub").alias("b")).unionAll(_same(pairs, spaces, percent))
    roots, roots_path = components(edges)
    label = lists.select("h").distinct().join(hubs, "h", "left").join(roots.withColumnRenamed("node", "h"), "h", "left")
    label, label_path = written(label.select("h", F.coalesce("root", "h").alias("root"), F.coalesce("hub", "h").alias("of")), "labels")
    free_shuffles(spark)
    discard(spark, roots_path, pairs_path, hubs_path, *space_paths)
    # pairs of different hubs: the members outside each list's main group against the others
    known = lists.join(label, "h")
    sizes = known.groupBy("token", "of").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
    main = sizes.groupBy("token").agg(F.max_by("of", F.struct("c", "of")).alias("main"), F.count(F.lit(1)).alias("k"), F.min("low").alias("low"), F.max("high").alias("high")).where("k > 1 and low <> high").select("token", "main")
    several = known.join(main, "token")
    side = several.where("of <> main").select("token", *[F.col(x).alias(f"{x}_") for x in ("h", "n", "level", "need", "root", "of")])
    both = side.join(several, "token").where((F.col("root") != F.col("root_")) & (F.col("of") != F.col("of_")) & ((F.col("of") == F.col("main")) | (F.col("h_") < F.col("h"))) & _sizes("n", "n_", percent))
    need = F.least("need", "need_")
    matched = both.where((F.col("level") <= need) & (F.col("level_") <= need)).select(F.least("h", "h_").alias("a"), F.greatest("h", "h_").alias("b"), need.alias("need"))
    pairs, pairs_path = written(matched.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need")).where("c >= need").select("a", "b"), "pairs")
    free_shuffles(spark)
    sets, sets_path = _sets(rows, classes, pairs, width)
    of = lambda side: label.select(F.col("h").alias(side), F.col("root").alias(f"r{side}"))
    edges = _verified(pairs, sets, percent).join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    roots, roots_path = components(edges)
    label = label.join(roots, label["root"] == roots["node"], "left").select("h", F.coalesce(roots["root"], label["root"]).alias("root"))
    named = classes.join(label, "h", "left").select("h", F.coalesce("root", "h").alias("root"), "least_id")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named, _ = written(named.join(least, "root").select("h", "component_id"), "components")
    free_shuffles(spark)
    discard(spark, lists_path, pairs_path, sets_path, roots_path, label_path)
    return texts.join(named, "h", "left").select("ord", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _sizes(n: str, m: str, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)
