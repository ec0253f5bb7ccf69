"""Token-id files compressed by Re-Pair grammars, one for each shard, with random access.

A shard holds the ids of consecutive documents. Its most frequent pairs of neighbouring symbols are replaced
by new symbols, again and again; what is kept is the rules, the number of ids that each rule's symbol
expands to, and the remaining sequence. A stretch of ids is read by a search in the running expansion
lengths and by expanding only the symbols that cover it.

File format (little-endian), one payload for each shard; symbols below `base` are ids, base + i is rule i:
    8 bytes   b"SWRP\\x02\\0\\0\\0"
    8 int64   base, documents, ids, rules, symbols of the sequence, bits of a symbol, far steps, long rules
    int64     doc_id of each document (the least int64 for null)
    int64     end of each document, in ids from the shard's start
    int64     ids before every 256th symbol of the sequence
    uint8     step from each rule's left symbol to the next one's, modulo 2^32; 255 where it is far
    uint8     how many ids each rule expands to; 255 where it is long
    uint32    the far steps, then the long rules' lengths, in order
    bits      the right symbol of each rule, then (from a whole byte) the sequence, the first bit being the highest
Rules come round by round, and within a round in order of their left symbols, so that most steps are small.
Payloads are rows of a Parquet table (part, shard, n_docs, n_ids, first_doc, last_doc, payload), whose order of
(part, shard) is that of doc_id, nulls first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, mix, pieces, ragged, shared_dir, spread, written
from .tokens import encoder, tokenizer_path

MAGIC = b"SWRP\x02\0\0\0"
#: Symbols between two entries of the index of running lengths.
STEP = 256
_SCHEMA = "part long, shard long, n_docs long, n_ids long, first_doc long, last_doc long, payload binary"
NULL_ID = -(1 << 63)


def _counted(key: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (left << 32 | right) of symbols below `symbols`, ascending, which of them each key is, and their counts.

    Where a pair and its place fit a number together, numbers are sorted instead of places by numbers.
    """
    wide, far = (symbols - 1).bit_length(), len(key).bit_length()
    if not len(key) or 2 * wide + far > 63:
        return np.unique(key, return_inverse=True, return_counts=True)
    both = ((key >> 32) << wide | key & 0xFFFFFFFF) << far
    both |= np.arange(len(key))
    both.sort()
    pair, place = both >> far, both & (1 << far) - 1
    new = np.append(True, pair[1:] != pair[:-1])
    first = np.flatnonzero(new)
    which = np.empty(len(key), dtype=np.int64)
    which[place] = np.cumsum(new) - 1
    pair = pair[first]
    return (pair >> wide) << 32 | pair & (1 << wide) - 1, which, np.diff(np.append(first, len(key)))


def compress(ids: np.ndarray, base: int, frequent: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Rules (n, 2) and the remaining sequence, in which no pair occurs `frequent` times. Rule i is symbol base + i.

    Each round replaces the pairs that occur about a thirty-second as often as the most frequent one; where chosen
    pairs overlap, the more frequent one goes first, and a pair left with too few places waits for another round.
    Pairs are counted exactly. A pair of given symbols never becomes more frequent, as new pairs hold a new
    symbol; so one that is found too seldom isn't looked at again.
    """
    now = ids.astype(np.int32)
    rules: list[np.ndarray] = []
    fresh = base
    live = np.ones(len(now), dtype=bool)  # places whose pair may be frequent
    while True:
        at = np.flatnonzero(live[:-1])
        key = now[at].astype(np.int64) << 32
        key |= now[at + 1]
        # of a symbol's run, every second place from the left
        twin = np.flatnonzero((key[1:] == key[:-1]) & (np.diff(at) == 1)) + 1
        use = np.ones(len(at), dtype=bool)
        if len(twin):
            head = np.append(True, np.diff(twin) > 1)
            use[twin[(twin - twin[head][np.cumsum(head) - 1]) % 2 == 0]] = False
        # pairs whose cell of a hashed count stays low are seldom
        cell = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).view(np.int64)
        cells = np.bincount(cell[use], minlength=1 << 22) if len(at) > 1 << 20 else None
        if cells is not None:
            stay = cells[cell] >= frequent
            live[at[~stay]] = False
            at, key, use, cell = at[stay], key[stay], use[stay], cell[stay]
            bar = max(frequent, int(cells.max(initial=0)) // 32) if stay.any() else frequent
            some = np.flatnonzero(use & (cells[cell] >= bar))
        else:
            bar, some = frequent, np.flatnonzero(use)
        pairs, which, counts = _counted(key[some], fresh)
        if bar > frequent and counts.max(initial=0) < frequent:  # cells full of seldom pairs
            bar, some = frequent, np.flatnonzero(use)
            pairs, which, counts = _counted(key[some], fresh)
        if bar == frequent:
            live[at[some[counts[which] < frequent]]] = False
        if not len(counts) or counts.max() < frequent:
            break
        bar = max(frequent, int(counts.max()) // 32)
        chosen = np.flatnonzero(counts >= bar)
        order = chosen[np.lexsort((mix(pairs[chosen].view(np.uint64)), counts[chosen]))]
        rank = np.zeros(len(pairs), dtype=np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        mine = np.flatnonzero((rank > 0)[which])
        place, which = at[some[mine]], which[mine]
        own = rank[which]
        next_ = np.diff(place) == 1
        win = np.ones(len(place), dtype=bool)
        win[:-1] &= ~next_ | (own[:-1] > own[1:])
        win[1:] &= ~next_ | (own[1:] > own[:-1])
        used = np.bincount(which[win], minlength=len(pairs))
        kept = used >= frequent  # the first in rank keeps all its places
        win &= kept[which]
        place, which = place[win], which[win]
        now[place] = (np.cumsum(kept) - 1 + fresh)[which]
        live[place] = True
        stay = np.ones(len(now), dtype=bool)
        stay[place + 1] = False
        now, live = now[stay], live[stay]
        # the place before a new symbol pairs with it
        fresh_at = np.flatnonzero(now >= fresh)
        live[np.maximum(fresh_at - 1, 0)] = True
        rules.append(np.column_stack([pairs[kept] >> 32, pairs[kept] & 0xFFFFFFFF]))
        fresh += int(np.count_nonzero(kept))
    return np.vstack(rules) if rules else np.zeros((0, 2), dtype=np.int64), now.astype(np.int64)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule's symbol stands for; a rule refers to earlier ones only."""
    out = np.zeros(len(rules), dtype=np.int64)
    done = 0
    while done < len(rules):  # rules of one round refer to earlier rounds only, so a whole round is summed at once
        inner = np.max(rules[done:], axis=1) - base
        block = np.flatnonzero(inner >= done)
        end = done + (int(block[0]) if len(block) else len(inner))
        part = rules[done:end]
        out[done:end] = sum(np.where(part[:, i] < base, 1, out[np.maximum(part[:, i] - base, 0)]) for i in (0, 1))
        done = end
    return out


def _packed(values: np.ndarray, width: int) -> bytes:
    """Values of `width` bits each, the highest first."""
    out = np.zeros((len(values), width), dtype=np.uint8)
    for i in range(width):
        out[:, i] = values >> (width - 1 - i) & 1
    return np.packbits(out).tobytes()


def _unpacked(raw: np.ndarray, width: int, first: int, last: int) -> np.ndarray:
    """The values from place first up to last of packed ones; only their bytes are looked at."""
    if first >= last:
        return np.zeros(0, dtype=np.int64)
    lo = first * width // 8
    bits = np.unpackbits(raw[lo : -(-last * width // 8)])[first * width - lo * 8 :][: (last - first) * width].reshape(-1, width)
    out = np.zeros(last - first, dtype=np.int64)
    for i in range(width):
        out = out << 1 | bits[:, i]
    return out


def _bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values as bytes, 255 standing for those that don't fit, and these."""
    far = values >= 255
    return np.where(far, 255, values).astype(np.uint8), values[far].astype("<u4")


def encode_shard(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray, base: int, frequent: int = 2) -> bytes:
    if len(ids) and int(ids.max()) >= base:
        raise ValueError(f"id {int(ids.max())} isn't below the first rule's symbol, {base}")
    rules, rest = compress(ids, base, frequent)
    lengths = expansion_lengths(rules, base)
    width = max(1, int(base + len(rules) - 1).bit_length())
    steps, far = _bytes(np.diff(rules[:, 0], prepend=0) & 0xFFFFFFFF)
    sizes, long = _bytes(lengths)
    after = np.cumsum(np.where(rest >= base, lengths[np.maximum(rest - base, 0)], 1) if len(rules) else np.ones(len(rest), dtype=np.int64))
    index = np.concatenate([[0], after])[:-1:STEP] if len(rest) else np.zeros(0, dtype=np.int64)
    head = np.array([base, len(doc_ids), len(ids), len(rules), len(rest), width, len(far), len(long)], dtype="<i8")
    return b"".join([MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), index.astype("<i8").tobytes(), steps.tobytes(), sizes.tobytes(), far.tobytes(), long.tobytes(), _packed(rules[:, 1], width), _packed(rest, width)])


class Shard:
    """A payload, read without expanding it."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a payload of this format")
        self.base, docs, self.size, rules, self.symbols, self.width, far, long = np.frombuffer(payload, "<i8", 8, 8).tolist()
        at = 72

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, kind, n, at)
            at += found.nbytes
            return found

        self.doc_ids, self.ends = take("<i8", docs), take("<i8", docs)
        self.index = take("<i8", -(-self.symbols // STEP))
        steps, sizes = take("u1", rules).astype(np.int64), take("u1", rules).astype(np.int64)
        steps[steps == 255], sizes[sizes == 255] = take("<u4", far), take("<u4", long)
        self.left, self.lengths = np.cumsum(steps) & 0xFFFFFFFF, sizes
        self.right = _unpacked(take("u1", -(-rules * self.width // 8)), self.width, 0, rules)
        self._sequence = take("u1", -(-self.symbols * self.width // 8))

    @property
    def sequence(self) -> np.ndarray:
        return _unpacked(self._sequence, self.width, 0, self.symbols)

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), dtype=np.int64)
        rule = symbols >= self.base
        out[rule] = self.lengths[symbols[rule] - self.base]
        return out

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start up to end, of those of the shard: the index tells which symbols to look at."""
        if start >= end:
            return np.zeros(0, dtype=np.uint32)
        block = int(np.searchsorted(self.index, start, side="right")) - 1
        stop = int(np.searchsorted(self.index, end, side="left"))
        symbols = _unpacked(self._sequence, self.width, block * STEP, min(stop * STEP, self.symbols))
        after = int(self.index[block]) + np.cumsum(self._sizes(symbols))
        first, last = np.searchsorted(after, start, side="right"), np.searchsorted(after, end, side="left")
        skip = start - (int(after[first - 1]) if first else int(self.index[block]))
        symbols = symbols[first : last + 1]
        return (self._all(symbols) if len(symbols) > len(self.left) else self._some(symbols))[skip : skip + end - start].astype(np.uint32)

    def _some(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a few symbols, whose rules are followed level by level."""
        while len(symbols) and (rule := symbols >= self.base).any():
            out = np.repeat(symbols, 1 + rule)
            place = np.cumsum(1 + rule) - 1 - rule
            out[place[rule]] = self.left[symbols[rule] - self.base]
            out[place[rule] + 1] = self.right[symbols[rule] - self.base]
            symbols = out
        return symbols

    def _all(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of many symbols: each rule is expanded once, then all are looked up."""
        first = np.cumsum(self.lengths) - self.lengths
        table = np.zeros(int(self.lengths.sum()), dtype=np.int64)
        done, sides = 0, (self.left, self.right)
        while done < len(self.left):  # rules of one round refer to earlier rounds only
            block = np.flatnonzero(np.maximum(self.left[done:], self.right[done:]) - self.base >= done)
            end = done + (int(block[0]) if len(block) else len(self.left) - done)
            pair = np.column_stack([x[done:end] for x in sides]).ravel()
            table[first[done] : first[end - 1] + self.lengths[end - 1]] = self._read(pair, table, first)
            done = end
        return self._read(symbols, table, first)

    def _read(self, symbols: np.ndarray, table: np.ndarray, first: np.ndarray) -> np.ndarray:
        size = self._sizes(symbols)
        out = np.repeat(symbols, size)
        rule = symbols >= self.base
        inner = np.repeat(rule, size)
        out[inner] = table[ragged(first[symbols[rule] - self.base], size[rule])]
        return out

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, base: int = 65_536, shard_ids: int = 2_000_000, part_rows: int = 2000, frequent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all documents' ids, each document's followed by end_id, as a table of shards at path.

    Documents stand in ascending doc_id, nulls first, ties in order of the text. A null text has the end id
    only. base must exceed every id (an error otherwise). A shard has shard_ids ids, or more if one document has.
    A pair is replaced where it occurs `frequent` times in its shard: a rule costs about a symbol and two bytes
    and wider symbols, so that those used less often make a shard larger.
    """
    tokenizer = tokenizer or tokenizer_path()
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part, parts = spread(plain, "doc_id", part_rows)
    dealt = plain.withColumn("part", part.cast("long")).repartition(max(parts // 4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part")
    ordered = dealt.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "text")
    names = ["part", "shard", "n_docs", "n_ids", "first_doc", "last_doc", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part_now, shard, held_ids, held_docs, held_sizes = None, 0, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard, held_ids, held_docs, held_sizes
            if held_docs:
                ids, sizes, of = np.concatenate(held_ids), np.concatenate(held_sizes), np.concatenate(held_docs)
                payload = encode_shard(ids, of, np.cumsum(sizes), base, frequent)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part_now, shard, len(sizes), len(ids), int(of[0]), int(of[-1]), payload)], names=names)
                shard += 1
                held_ids, held_docs, held_sizes = [], [], []

        for batch in batches:
            for piece in pieces(batch, "text"):
                of = piece.column(2).to_numpy()
                for lo, hi in zip(*_runs(of), strict=True):
                    if of[lo] != part_now:
                        yield from flush()
                        part_now, shard = int(of[lo]), 0
                    some = piece.slice(lo, hi - lo)
                    ids, counts = encode(some.column(1))
                    held_ids.append(np.insert(ids, np.cumsum(counts), end_id))
                    held_sizes.append(counts + 1)
                    held_docs.append(some.column(0).fill_null(NULL_ID).to_numpy())
                    if sum(map(len, held_ids)) >= shard_ids:
                        yield from flush()
        yield from flush()

    ordered.mapInArrow(run, _SCHEMA).write.option("compression", "zstd").parquet(path)


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(x)) + 1
    return [0, *edge.tolist()], [*edge.tolist(), len(x)]


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    shards = spark.read.schema(_SCHEMA).parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    # parts are bounded in number, so their running sum is small; shards are summed within parts
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("base") + F.col("inside")).alias("first"))
    names = ["part", "shard", "doc_id", "place", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, payload in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), strict=True):
                shard = Shard(payload.as_buffer().to_pybytes())
                ids = shard.ids(0, shard.size).astype("<u4")
                begins = np.append(0, shard.ends[:-1])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), shard.ends.tolist(), strict=True)]
                n = len(begins)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.full(n, number)), pa.array(shard.doc_ids, mask=shard.doc_ids == NULL_ID), pa.array(begins), pa.array(shard.ends - begins), pa.array(crc, pa.int64())], names=names)

    found = shards.select("part", "shard", "payload").mapInArrow(run, "part long, shard long, doc_id long, place long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents, by random access: Parquet's statistics leave out the shards that can't have
    them, and of the others only the symbols that cover a document are expanded. Ids that occur twice come twice."""
    held = np.unique(np.array(wanted, dtype=np.int64))
    shards = spark.read.schema(_SCHEMA).parquet(path)
    if not len(held):
        shards = shards.limit(0)
    else:
        shards = shards.where((F.col("last_doc") >= int(held[0])) & (F.col("first_doc") <= int(held[-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if np.searchsorted(held, first) == np.searchsorted(held, last, side="right"):
                    continue
                shard = Shard(payload.as_buffer().to_pybytes())
                for i in np.flatnonzero(np.isin(shard.doc_ids, held)).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([int(shard.doc_ids[i])]), pa.array([shard.document(i).astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return shards.select("first_doc", "last_doc", "payload").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write docs into files of their own in the shared folder, and read_ids() of these, read once; the files are deleted."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "ids")
    write_ids(docs, path, **options)
    found, _ = written(read_ids(spark, path), "ids-read")
    discard(spark, path)
    return found
