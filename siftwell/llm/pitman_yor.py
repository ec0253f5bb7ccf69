"""Language-model scores by a hierarchical Pitman-Yor model of words.

A word's context is the two words before it in its text, whichever they are. Each pair (u2, u1) of them is a
restaurant whose parent is that of u1 alone, the last one; those share the root, whose base is uniform over the V
words of training and one unknown word. No context is left out.

Triples (u2, u1, word) of all texts are dealt to stations by u1, so that the restaurants of u1 and of all (u2, u1)
are whole in one station; a station has about `per_station` tokens. A word u1 with over half as many is dealt by
(u2, u1), and a pair with over half as many by its words; there are at most a few such hot ones a station, and
their customers and tables are added up and passed on by the driver. Words are dealt to roots, which hold the
root's dishes and those of hot u1. A station asks each root, in an order fixed once, for the probabilities of its
words, and tells it how many tables it has of each.

Gibbs sampling reseats, in each sweep, all customers of a dish one after another (in groups of half of those
seated once 256 are, drawn by the normal limit of a binomial), bottom up, the tables of each level being the customers of the next; the totals of the other
dishes are those of the sweep before. Predictive probabilities are averaged over the sweeps kept. Draws are
functions of word, context and sweep alone, so a lost task's redraw, or another dealing, gives the same seating.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, discard, free_shuffles, give_back, hash_runs, keyed, mix, offsets_of, pieces, shared_dir, text_bytes, words, written

END, START = np.uint64(0xE1D0E1D0E1D0E1D1), np.uint64(0x57A2757A2757A273)
PER_STATION, CODED = 1_200_000, 2**19
#: Stations are built, and scored, in so many parts one after another: disk holds the shuffle of one part at a time.
DEALS, PARTS = 2, 4
#: What a row is: texts' part of a station, a station, its tokens' places, a block's ids, a station's first question to a
#: root, its later ones, its tables, sums for the driver, a root, a root's answer.
PART, STATION, PLACES, INFO, ASK, TELL, TABLES, SUMS, ROOT, ANSWER = range(10)
_ROW = "s int, r long, payload binary, kind int"
_ONE3, _TWO3, _ONE2, _TWO2, _ONE1, _TWO1, _V, _N, _C0, _T0 = range(10)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts joined, each text's followed by the end token, and how many each text has."""
    data, at = text_bytes(column)
    data = LOWER[data]
    starts, ends, counts = words(data, at)
    h = hash_runs(data, starts, ends)
    return np.insert(h, np.cumsum(counts), END), counts + 1


def contexts(h: np.ndarray, counts: np.ndarray, start: int | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """For each token the word before it in its text and the one before that; `start` where there is none."""
    first = np.cumsum(counts) - counts
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:] = h[:-1]
    one[first] = start
    two[1:] = one[:-1]
    two[first] = start
    return one, two


@dataclass
class Totals:
    """Customers and tables of the root and of hot restaurants, the hyperparameters of the three levels, the dealing."""

    hot: np.ndarray  # hashes of hot words, ascending
    v: int
    n: int
    discount: tuple[float, float, float] = (0.7, 0.7, 0.7)  # root, u1, (u2, u1)
    strength: tuple[float, float, float] = (1.0, 1.0, 1.0)
    customers: list[np.ndarray] = field(default_factory=list)  # by level: [1], hot words, hot pairs
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # hashes of hot pairs, ascending
    stations: int = 1
    roots: int = 1


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0, of hashes (unsigned) or of doubles, by planes of their bytes, compressed."""
    head, data = [len(arrays)], []
    for a in arrays:
        if a.dtype.kind == "f":
            kind, width, a = 1, 8, a.astype("<f8")
        elif a.dtype == np.uint64:  # hashes, mostly ascending: their differences have fewer bytes
            kind, width, a = 2, 8, np.diff(a, prepend=np.uint64(0))
        else:
            width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
            kind, a = 0, a.astype("<u4" if width <= 4 else "<u8")
        head += [kind, width, len(a)]
        data.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T[:width].tobytes())
    flat = b"".join(data)
    return np.array([len(flat), *head], dtype="<i8").tobytes() + pa.compress(flat, codec="zstd", asbytes=True)


def _unpack(raw: bytes) -> list[np.ndarray]:
    size, n = np.frombuffer(raw, "<i8", 2).tolist()
    head = np.frombuffer(raw, "<i8", 3 * n, 16).reshape(n, 3).tolist()
    flat = np.frombuffer(pa.decompress(raw[16 + 24 * n :], decompressed_size=size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    out, at = [], 0
    for kind, width, count in head:
        planes = np.zeros((count, 8), np.uint8)
        planes[:, :width] = flat[at : at + width * count].reshape(width, count).T
        at += width * count
        values = planes.view(("<i8", "<f8", "<u8")[kind]).reshape(count)
        out.append(np.cumsum(values, dtype=np.uint64) if kind == 2 else values)
    return out


def _rows(rows: list[tuple[int, int, bytes, int]]) -> pa.Table:
    s, r, payload, kind = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"s": pa.array(s, pa.int32()), "r": pa.array(r, pa.int64()), "payload": pa.array(payload, pa.binary()), "kind": pa.array(kind, pa.int32())})


def _by_kind(table: pa.Table) -> dict[int, list[tuple[int, int, bytes]]]:
    """A group's rows by kind, each kind's in the order of (r, s)."""
    found: dict[int, list[tuple[int, int, bytes]]] = {}
    for s, r, payload, kind in sorted(zip(*(table.column(x).to_pylist() for x in ("s", "r", "payload", "kind")), strict=True), key=lambda x: (x[3], x[1], x[0])):
        found.setdefault(kind, []).append((s, r, payload))
    return found


def _grouped(df: DataFrame, key: str, run: Callable[[dict[int, list[tuple[int, int, bytes]]]], list[tuple[int, int, bytes, int]]]) -> DataFrame:
    def task(table: pa.Table) -> pa.Table:
        found = _rows(run(_by_kind(table)))
        give_back()
        return found

    return df.groupBy(key).applyInArrow(task, _ROW)


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """written(), in a folder for each kind, so that one kind is read without the others."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "none").partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(_ROW).parquet(path), path


def _freed(spark: SparkSession) -> None:
    """free_shuffles() until the job that has just ended is let go: its plan is still held for a moment."""
    for _ in range(2):
        free_shuffles(spark)
        time.sleep(0.3)


def _of(df: DataFrame, kind: int) -> DataFrame:
    return df.where(F.col("kind") == kind)


def _blocks(batch: pa.RecordBatch, size: int = 16_000_000, docs: int = 65_000) -> Iterator[pa.RecordBatch]:
    """As few parts of a batch as have `size` bytes of text at the most, about equal ones."""
    at = offsets_of(batch.column(batch.schema.get_field_index("text")))
    n = max(1, -(-int(at[-1] - at[0]) // size))
    for part in pieces(batch, "text", min(size, int(at[-1] - at[0]) // n * 51 // 50 + 1)):
        for lo in range(0, part.num_rows, docs):
            yield part.slice(lo, docs)


def _tokens_of(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    got = [tokens(x.column(block.schema.get_field_index("text"))) for x in pieces(block, "text", 2_000_000)]
    return np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])


def _among(h: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The place of each hash in ascending names, from 1; 0: not there."""
    if not len(names):
        return np.zeros(len(h), dtype=np.int64)
    i = np.minimum(np.searchsorted(names, h), len(names) - 1)
    return np.where(names[i] == h, i + 1, 0)


def _names(code: np.ndarray, rest: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Words that are told as the differences of frequent ones' numbers, then the others' hashes."""
    return np.concatenate([frequent[np.cumsum(code)], rest.astype(np.uint64)])


def _pair(u1: np.ndarray, u2: np.ndarray) -> np.ndarray:
    return mix(mix(u1) + u2)


def _least(counts: list[Row], most: int) -> int:
    """From which number on there are at most `most` words that occur so often. counts: n and how many words have it."""
    least, total = 2**62, 0
    for n, words_ in sorted(counts, reverse=True):
        total += words_
        if total > most:
            break
        least = n
    return least


def dealing(rows: DataFrame, per_station: int) -> tuple[Totals, np.ndarray]:
    """How many stations and roots there are, and which words and pairs are hot; hashes of at most CODED frequent
    words, ascending, which move as a short number. Results don't depend on any of it.

    A block tells the words and pairs that it has often enough; one that is rarer everywhere is neither.
    """
    hot = max(1, per_station // 2)
    least = max(1, min(64, hot // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                h, counts = _tokens_of(block)
                distinct, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
                distinct, n = np.append(distinct, START), np.append(n, 2 * len(counts))
                one, two = contexts(inverse, counts, len(distinct) - 1)
                keep = (n >= least) & (distinct != END)
                often = np.flatnonzero(keep[one] & keep[two])
                pair, m = np.unique(one[often] * len(distinct) + two[often], return_counts=True)
                pair, m = pair[m >= least], m[m >= least]
                pair = _pair(distinct[pair // len(distinct)], distinct[pair % len(distinct)])
                keep = (n >= min(2, least)) & (distinct != END)
                kind = np.repeat([0, 1, 2], [1, int(keep.sum()), len(pair)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([np.zeros(1, np.uint64), distinct[keep], pair]).view(np.int64)), pa.array(np.concatenate([[len(h)], n[keep], m]))], names=["kind", "h", "n"])

    found, path = written(rows.select("text").mapInArrow(run, "kind long, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")), "dealing")
    n = found.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    names = lambda rows: np.sort(rows.select("h").toArrow().column("h").to_numpy().view(np.uint64))
    least = _least(found.where("kind = 1").groupBy(F.least("n", F.lit(65_536)).alias("n")).count().collect(), CODED)
    frequent = names(found.where("kind = 1").where(F.col("n") >= least))
    often = found.where(F.col("n") > hot)
    stations = max(1, -(-n // per_station))
    z = Totals(names(often.where("kind = 1")), 0, 0, pairs=names(often.where("kind = 2")), stations=stations, roots=-(-stations // 2))
    discard(rows.sparkSession, path)
    return replace(z, customers=[np.zeros(1), np.zeros(len(z.hot)), np.zeros(len(z.pairs))], tables=[np.zeros(1), np.zeros(len(z.hot)), np.zeros(len(z.pairs))]), frequent


def _deal(rows: DataFrame, z: Totals, frequent: Broadcast, deal: int, deals: int) -> DataFrame:
    """Each block's tokens, a row for each station whose number modulo `deals` is `deal`: words' numbers among the
    frequent ones, the others' hashes, then by token its u1, word, u2, text, training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                h, counts = _tokens_of(block)
                ords, training = block.column(0).to_numpy(), block.column(2).to_numpy(zero_copy_only=False)
                k = int(ords[0])
                distinct, word = np.unique(h, return_inverse=True)
                distinct = np.append(distinct, START)
                code = _among(distinct, frequent.value)
                coded, order = int(np.count_nonzero(code)), np.argsort(np.where(code, code, CODED + 1), kind="stable")  # coded ones first
                distinct, code = distinct[order], code[order[:coded]] - 1
                new = np.empty(len(order), dtype=np.int32)
                new[order] = np.arange(len(order), dtype=np.int32)
                word = new[word]
                one, two = contexts(word, counts, new[-1])
                place = mix(distinct)[one]
                split = np.flatnonzero((_among(distinct, z.hot) > 0)[one])
                if len(split):
                    place[split] = _pair(distinct[one[split]], distinct[two[split]])
                    hot = split[_among(place[split], z.pairs) > 0]
                    place[hot] = mix(place[hot] + h[hot])
                place = (place % np.uint64(z.stations)).astype(np.uint16 if z.stations < 65_536 else np.int64)
                own = np.flatnonzero(place % deals == deal) if deals > 1 else np.arange(len(place))
                place = place[own]
                order = own[np.argsort(place, kind="stable")]
                size = np.bincount(place, minlength=z.stations)
                text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
                out, hi = [(k % z.stations, k, _pack(ords.view(np.uint64), counts), INFO)] if k % z.stations % deals == deal else [], np.cumsum(size)
                for s in np.flatnonzero(size).tolist():
                    at = order[hi[s] - size[s] : hi[s]]
                    used, triple = np.unique(np.concatenate([one[at], word[at], two[at]]), return_inverse=True)
                    few = int(np.searchsorted(used, coded))
                    out.append((s, k, _pack(np.diff(code[used[:few]], prepend=0), distinct[used[few:]], *triple.reshape(3, -1), np.diff(text[at], prepend=0), training[text[at]].astype(np.uint8)), PART))
                    if len(out) == 64:
                        yield from _rows(out).combine_chunks().to_batches()
                        out = []
                yield from _rows(out).combine_chunks().to_batches()
        give_back()

    return rows.select("ord", "text", "training").mapInArrow(run, _ROW)


class Station:
    """The restaurants of a station: words, pairs (u1, word), restaurants (u2, u1) and triples, ascending by
    (u1, u2, word), and which probabilities it asks for: of cold u1 its words' in the root, of hot ones its pairs'."""

    def __init__(self, payload: bytes, z: Totals, frequent: np.ndarray):
        code, others, pair, rest_size, self.rest_u2, size, local, count = _unpack(payload)
        self.words = _names(code, others, frequent)
        d = len(self.words)
        self.pair_u1, self.pair_w = np.divmod(np.cumsum(pair), d)
        pair_size, self.rest_u1 = np.bincount(self.pair_u1, minlength=d), np.repeat(np.arange(d), rest_size)
        self.rest = np.repeat(np.arange(len(size)), size)
        self.pair = local + (np.cumsum(pair_size) - pair_size)[self.rest_u1[self.rest]]
        self.count = count.astype(np.float64)
        hot = _among(self.words, z.hot)
        self.hot = hot[self.pair_u1]
        self.cold = self.hot == 0
        used = np.zeros(d, dtype=bool)
        used[self.pair_w[self.cold]] = True
        plain, n = np.flatnonzero(used), int(used.sum())
        self.asked = np.zeros(len(self.pair_w), dtype=np.int64)
        self.asked[self.cold] = (np.cumsum(used) - 1)[self.pair_w[self.cold]]
        self.asked[~self.cold] = n + np.arange(int((~self.cold).sum()))
        self.key = np.concatenate([self.words[plain], self.words[self.pair_w[~self.cold]]])
        self.key_hot = np.concatenate([np.zeros(n, dtype=np.int64), self.hot[~self.cold]])
        root = (mix(self.key ^ START) % np.uint64(z.roots)).astype(np.int64)
        self.order = np.argsort(root, kind="stable")
        self.size = np.bincount(root, minlength=z.roots)
        self.hot_rest = np.zeros(len(size), dtype=np.int64)
        split = np.flatnonzero(hot[self.rest_u1])
        self.hot_rest[split] = _among(_pair(self.words[self.rest_u1[split]], self.words[self.rest_u2[split]]), z.pairs)

    def tell(self, s: int, kind: int, *values: np.ndarray) -> list[tuple[int, int, bytes, int]]:
        """A row for each root with values of what is asked of it."""
        hi = np.cumsum(self.size)
        return [(s, r, _pack(*(v[self.order[hi[r] - self.size[r] : hi[r]]] for v in values)), kind) for r in np.flatnonzero(self.size).tolist()]

    def heard(self, answers: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
        """What roots answered (a row each, ascending), by what was asked."""
        out = []
        for values in zip(*(_unpack(x[2]) for x in answers), strict=True):
            flat = np.concatenate(values)
            out.append(np.empty_like(flat))
            out[-1][self.order] = flat
        return out

    def up(self, pairs: np.ndarray) -> np.ndarray:
        return np.bincount(self.asked, weights=pairs, minlength=len(self.key))

    def by_pair(self, triples: np.ndarray) -> np.ndarray:
        return np.bincount(self.pair, weights=triples, minlength=len(self.pair_w))

    def filled(self, z: Totals, t1: np.ndarray, t2: np.ndarray) -> Totals:
        """z with this station's totals: by u1, whole where it is cold, and by (u2, u1)."""
        d, m = len(self.words), len(self.hot_rest)
        whole = np.flatnonzero(self.hot_rest)
        c2, k2 = np.bincount(self.rest, weights=self.count, minlength=m), np.bincount(self.rest, weights=t2, minlength=m)
        c2[whole], k2[whole] = z.customers[2][self.hot_rest[whole] - 1], z.tables[2][self.hot_rest[whole] - 1]
        by_u1 = lambda x: np.bincount(self.pair_u1, weights=x, minlength=d)
        return replace(z, customers=[z.customers[0], by_u1(self.by_pair(t2)), c2], tables=[z.tables[0], by_u1(t1), k2])

    def parents(self, p: np.ndarray, t1: np.ndarray, t2: np.ndarray, own: Totals) -> np.ndarray:
        """Each pair's probability in the restaurant of its u1."""
        return np.where(self.cold, _chance(1, self.by_pair(t2), t1, self.pair_u1, p[self.asked], own), p[self.asked])

    def hot_sums(self, which: int, triples: np.ndarray, z: Totals) -> tuple[np.ndarray, np.ndarray]:
        x = np.bincount(self.hot_rest[self.rest], weights=triples, minlength=len(z.pairs) + 1)[1:]
        used = np.flatnonzero(x)
        return 16 + 2 * len(z.hot) + 2 * used + which, x[used]


def _sums(at: np.ndarray, x: np.ndarray, s: int, r: int) -> tuple[int, int, bytes, int]:
    return s, r, _pack(at, x.astype(np.float64)), SUMS


def _build(z: Totals, frequent: Broadcast) -> Callable:
    def run(got: dict[int, list]) -> list[tuple[int, int, bytes, int]]:
        out = [(*x, INFO) for x in got.get(INFO, [])]
        if PART not in got:
            return out
        parts, s = [], got[PART][0][0]
        for x in got[PART]:
            code, rest, *others = _unpack(x[2])
            parts.append([_names(code, rest, frequent.value), *others])
        names, inverse = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
        first = np.cumsum([0, *(len(x[0]) for x in parts)])
        code = _among(names, frequent.value)
        order, coded, d = np.argsort(code == 0, kind="stable"), int(np.count_nonzero(code)), len(names)  # coded ones first
        names, code = names[order], code[order[:coded]] - 1
        new = np.empty(d, dtype=np.int64)
        new[order] = np.arange(d)
        inverse = new[inverse]
        one, word, two = (np.concatenate([inverse[x[i] + lo] for x, lo in zip(parts, first.tolist(), strict=False)]) for i in (1, 2, 3))
        parts = [x[4:] for x in parts]
        pair, of_pair = np.unique(one * d + word, return_inverse=True)
        rest, of_rest = np.unique(one * d + two, return_inverse=True)
        triple, token = np.unique(of_rest * len(pair) + of_pair, return_inverse=True)
        count = np.bincount(token, weights=np.concatenate([x[1] for x in parts])).astype(np.int64)
        pair_size, rest_size = np.bincount(pair // d, minlength=d), np.bincount(rest // d, minlength=d)
        own = triple // len(pair)
        local = triple % len(pair) - (np.cumsum(pair_size) - pair_size)[rest[own] // d]
        told = _among(names, z.hot)[rest // d] > 0  # u2 is asked for by draws and by hot pairs alone
        told[own[count > 1]] = True
        payload = _pack(np.diff(code, prepend=0), names[coded:], np.diff(pair, prepend=0), rest_size, np.where(told, rest % d, 0), np.bincount(own), local, count)
        # blocks' numbers can be any longs
        blocks = np.array([x[1] for x in got[PART]], dtype=np.int64).view(np.uint64)
        out += [(s, 0, payload, STATION), (s, 0, _pack(blocks, np.array([len(x[0]) for x in parts]), np.concatenate([x[0] for x in parts]), token), PLACES)]
        return out

    return run


def _asked(built: DataFrame, z: Totals, frequent: Broadcast) -> DataFrame:
    """What each station asks each root for, with how often in training and in how many ways; sums of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, payload in zip(batch.column("s").to_pylist(), batch.column("payload"), strict=True):
                x = Station(payload.as_py(), z, frequent.value)
                kinds = x.by_pair(x.count > 0)
                seen = np.where(x.cold, kinds > 0, kinds)
                out = x.tell(s, ASK, x.key, x.key_hot, x.up(x.by_pair(x.count)).astype(np.int64), x.up(seen).astype(np.int64))
                at, hot = x.hot_sums(0, x.count, z)
                once = [np.count_nonzero(y == n) for y in (x.count, kinds[x.cold]) for n in (1, 2)]
                out.append(_sums(np.append([_ONE3, _TWO3, _ONE2, _TWO2], at), np.append(once, hot), s, -1))
                yield from _rows(out).combine_chunks().to_batches()
        give_back()

    return _of(built, STATION).mapInArrow(run, _ROW)


@dataclass
class Root:
    """Words of a root; its dishes (word, hot u1 or 0); which dish each question of each station is about; how often
    a word is in training; customers and tables of words in the root and of dishes in their hot restaurants."""

    words: np.ndarray
    word: np.ndarray
    hot: np.ndarray
    stations: np.ndarray
    size: np.ndarray
    about: np.ndarray
    count: np.ndarray
    c0: np.ndarray
    t0: np.ndarray
    c1: np.ndarray
    t1: np.ndarray

    def packed(self) -> bytes:
        return _pack(*(x if i < 7 else x.astype(np.int64) for i, x in enumerate(vars(self).values())))

    @staticmethod
    def of(payload: bytes) -> Root:
        x = _unpack(payload)
        return Root(x[0].astype(np.uint64), *x[1:7], *(y.astype(np.float64) for y in x[7:]))

    def chances(self, z: Totals) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of words in the root, and of dishes where they are asked for."""
        p0 = _chance(0, self.c0, self.t0, np.zeros(len(self.words), dtype=np.int64), np.full(len(self.words), 1 / (z.v + 1)), z)
        p, hot = p0[self.word], np.flatnonzero(self.hot)
        p[hot] = _chance(1, self.c1[hot], self.t1[hot], self.hot[hot] - 1, p[hot], z)
        return p0, p


def _root(z: Totals) -> Callable:
    def run(got: dict[int, list]) -> list[tuple[int, int, bytes, int]]:
        if ASK not in got:  # the stations' sums
            return [(*x, SUMS) for x in got[SUMS]]
        asks = [_unpack(x[2]) for x in got[ASK]]
        r = got[ASK][0][1]
        h, hot, count, kinds = (np.concatenate(x) for x in zip(*asks, strict=True))
        names, word = np.unique(h.astype(np.uint64), return_inverse=True)
        wide = len(z.hot) + 1
        dish, about = np.unique(word * wide + hot, return_inverse=True)
        zero = np.zeros
        own = dish // wide
        n = np.bincount(word, weights=count, minlength=len(names)).astype(np.int64)
        x = Root(names, own, dish % wide, np.array([s for s, _, _ in got[ASK]]), np.array([len(a[0]) for a in asks]), about, n, zero(len(names)), zero(len(names)), zero(len(dish)), zero(len(dish)))
        kinds = np.bincount(about, weights=kinds, minlength=len(dish))
        of_hot = kinds[x.hot > 0]
        by_word = np.bincount(own, weights=np.where(x.hot > 0, kinds > 0, kinds), minlength=len(names))
        sums = [np.count_nonzero(of_hot == 1), np.count_nonzero(of_hot == 2), np.count_nonzero(by_word == 1), np.count_nonzero(by_word == 2), np.count_nonzero(n), n.sum()]
        return [(0, r, x.packed(), ROOT), _sums(np.array([_ONE2, _TWO2, _ONE1, _TWO1, _V, _N]), np.array(sums), 0, r)]

    return run


def _binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Binomial draws from uniform ones: by adding up chances where at most 16 are expected, else by the normal limit."""
    z = np.clip((np.maximum(u, 1e-12) ** 0.135 - np.maximum(1 - u, 1e-12) ** 0.135) / 0.1975, -6, 6)
    out = np.clip(np.round(n * p + z * np.sqrt(n * p * (1 - p))), 0, n)
    few = np.flatnonzero((n * p <= 16) & (p < 0.5))
    k, chance, odds = 0, np.exp(n[few] * np.log1p(-p[few])), p[few] / (1 - p[few])
    below = chance.copy()
    while len(few):
        done = (u[few] < below) | (k >= n[few]) | (k >= 100)
        out[few[done]] = k
        few, chance, odds, below = (x[~done] for x in (few, chance, odds, below))
        chance = chance * (n[few] - k) / (k + 1) * odds
        below, k = below + chance, k + 1
    return out


def seat(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float, key: np.ndarray) -> np.ndarray:
    """How many tables each dish's customers come to sit at.

    others: tables of the restaurant's other dishes; parent: the dish's probability in the parent.
    """
    tables = (customers > 0).astype(np.float64)
    seated, active, step = 1.0, np.flatnonzero(customers > 1), 1
    while len(active):
        group = 1.0 if seated < 256 else np.floor(seated / 2)
        n = np.minimum(group, customers[active] - seated)
        t = tables[active]
        new = (strength + discount * (others[active] + t)) * parent[active]
        p = new / (new + seated - discount * t)
        if group > 1:  # chances fall while a group sits down: the one in its middle stands for all
            half = (n - 1) / 2
            t = t + half * p
            new = (strength + discount * (others[active] + t)) * parent[active]
            p = new / (new + seated + half - discount * t)
        u = (mix(key[active] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        if group == 1:
            tables[active] += u < p
        else:
            tables[active] += _binomial(n, p, u)
        seated, step = seated + group, step + 1
        active = active[customers[active] > seated]
    return tables


def _chance(level: int, c: np.ndarray, t: np.ndarray, restaurant: np.ndarray, parent: np.ndarray, z: Totals) -> np.ndarray:
    d, a = z.discount[level], z.strength[level]
    if not len(z.tables[level]):
        return parent
    return (np.maximum(c - d * t, 0) + (a + d * z.tables[level][restaurant]) * parent) / (a + z.customers[level][restaurant])


def _draws(words_: np.ndarray, number: int) -> np.ndarray:
    return mix(words_ ^ mix(np.array([number], dtype=np.uint64)))


def _draws_of_pairs(key: np.ndarray, u1: np.ndarray) -> np.ndarray:
    return mix(key + mix(u1) + np.uint64(1 << 32))


def _answers(roots: DataFrame, z: Totals, kind: int = ANSWER, part: int = 0, parts: int = 1) -> DataFrame:
    """For each question of each station, of those whose number modulo `parts` is `part`, its dish's probability, and
    for another kind how often its word is in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, payload in zip(batch.column("r").to_pylist(), batch.column("payload"), strict=True):
                x = Root.of(payload.as_py())
                _, p = x.chances(z)
                hi = np.cumsum(x.size)
                out = []
                for s, n, end in zip(x.stations.tolist(), x.size.tolist(), hi.tolist(), strict=True):
                    if s % parts != part:
                        continue
                    about = x.about[end - n : end]
                    out.append((s, r, _pack(p[about], x.count[x.word[about]]) if kind != ANSWER else _pack(p[about]), kind))
                yield from _rows(out).combine_chunks().to_batches(max_chunksize=256)
        give_back()

    return _of(roots, ROOT).mapInArrow(run, _ROW)


def _swept(z: Totals, number: int, frequent: Broadcast) -> Callable:
    """A station's part of a sweep: triples are reseated, then the pairs of cold u1."""

    def run(got: dict[int, list]) -> list[tuple[int, int, bytes, int]]:
        if STATION not in got:
            return []
        s, _, payload = got[STATION][0]
        x = Station(payload, z, frequent.value)
        if TABLES in got:
            t1, t2 = (y.astype(np.float64) for y in _unpack(got[TABLES][0][2]))
        else:
            t1, t2 = np.zeros(len(x.pair_w)), np.zeros(len(x.pair))
        (p,) = x.heard(got[ANSWER])
        own = x.filled(z, t1, t2)
        key = _draws(x.words, number)
        context = _pair(x.words[x.rest_u1], x.words[x.rest_u2])
        several = np.flatnonzero(x.count > 1)  # a single customer has a table of its own
        pair, rest = x.pair[several], x.rest[several]
        new2 = np.minimum(x.count, 1)
        new2[several] = seat(x.count[several], np.maximum(own.tables[2][rest] - t2[several], 0), x.parents(p, t1, t2, own)[pair], z.discount[2], z.strength[2], mix(key[x.pair_w[pair]] + context[rest]))
        c1 = x.by_pair(new2)
        new1 = np.where(x.cold, np.minimum(c1, 1), 0)
        several = np.flatnonzero(x.cold & (c1 > 1))
        u1 = x.pair_u1[several]
        new1[several] = seat(c1[several], np.maximum(own.tables[1][u1] - t1[several], 0), p[x.asked[several]], z.discount[1], z.strength[1], _draws_of_pairs(key[x.pair_w[several]], x.words[u1]))
        told = x.up(np.where(x.cold, new1, c1)).astype(np.int64)
        return [(s, 0, _pack(new1.astype(np.int64), new2.astype(np.int64)), TABLES), *x.tell(s, TELL, told), _sums(*x.hot_sums(1, new2, z), s, 0)]

    return run


def _root_swept(z: Totals, number: int) -> Callable:
    """A root's part of a sweep: the dishes of hot u1 are reseated, then its own."""

    def run(got: dict[int, list]) -> list[tuple[int, int, bytes, int]]:
        _, r, payload = got[ROOT][0]
        x = Root.of(payload)
        told = np.bincount(x.about, weights=np.concatenate([_unpack(y[2])[0] for y in got[TELL]]), minlength=len(x.word))
        p0, _ = x.chances(z)
        key = _draws(x.words, number)
        hot = np.flatnonzero(x.hot)
        c1, t1 = np.where(x.hot > 0, told, 0), np.zeros(len(told))
        if len(hot):
            t1[hot] = seat(c1[hot], np.maximum(z.tables[1][x.hot[hot] - 1] - x.t1[hot], 0), p0[x.word[hot]], z.discount[1], z.strength[1], _draws_of_pairs(key[x.word[hot]], z.hot[x.hot[hot] - 1]))
        c0 = np.bincount(x.word, weights=np.where(x.hot > 0, t1, told), minlength=len(x.words))
        t0 = seat(c0, np.maximum(z.tables[0][0] - x.t0, 0), np.full(len(c0), 1 / (z.v + 1)), z.discount[0], z.strength[0], mix(key + np.uint64(1 << 33)))
        by_hot = lambda y: np.bincount(x.hot, weights=y, minlength=len(z.hot) + 1)[1:]
        c, t = by_hot(c1), by_hot(t1)
        used = np.flatnonzero(c)
        at = np.concatenate([[_C0, _T0], 16 + 2 * used, 17 + 2 * used])
        return [(0, r, replace(x, c0=c0, t0=t0, c1=c1, t1=t1).packed(), ROOT), _sums(at, np.concatenate([[c0.sum(), t0.sum()], c[used], t[used]]), 0, r)]

    return run


def _added_up(z: Totals, *tables: DataFrame) -> np.ndarray:
    """Sums over all stations and roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                at, x = _unpack(payload.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(x)], names=["i", "x"])

    out = np.zeros(16 + 2 * len(z.hot) + 2 * len(z.pairs))
    for table in tables:
        for r in _of(table, SUMS).mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toLocalIterator():
            out[r["i"]] += r["x"]
    return out


def _with_sums(z: Totals, x: np.ndarray, customers2: np.ndarray) -> Totals:
    hot, pairs = x[16 : 16 + 2 * len(z.hot)].reshape(-1, 2), x[16 + 2 * len(z.hot) :].reshape(-1, 2)
    return replace(z, customers=[x[_C0 : _C0 + 1], hot[:, 0], customers2], tables=[x[_T0 : _T0 + 1], hot[:, 1], pairs[:, 1]])


def fit(rows: DataFrame, burn_in: int = 2, samples: int = 2, per_station: int = PER_STATION) -> tuple[DataFrame, Broadcast, list[tuple[DataFrame, DataFrame, Totals]], list[str]]:
    """The stations of all texts, the frequent words, of each of the `samples` sweeps after burn_in its tables, roots
    and totals, and the paths of all that. rows: ord, text, training."""
    spark = rows.sparkSession
    z, names = dealing(rows, per_station)
    frequent = spark.sparkContext.broadcast(names)
    built, paths, deals = None, [], min(DEALS, z.stations)
    for deal in range(deals):
        some, path = _stored(_grouped(_deal(rows, z, frequent, deal, deals), "s", _build(z, frequent)), "stations")
        _freed(spark)
        built, paths = some if built is None else built.unionAll(some), [*paths, path]
    roots, root_path = _stored(_grouped(_asked(built, z, frequent), "r", _root(z)), "roots")
    _freed(spark)
    x = _added_up(z, roots)
    low = lambda one, two: float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.95))
    z = replace(z, v=int(x[_V]), n=int(x[_N]), discount=(low(x[_ONE1], x[_TWO1]), low(x[_ONE2], x[_TWO2]), low(x[_ONE3], x[_TWO3])))
    customers2 = x[16 + 2 * len(z.hot) :].reshape(-1, 2)[:, 0]
    z = replace(z, customers=[*z.customers[:2], customers2])
    now, kept, old = None, [], [root_path]
    for i in range(burn_in + samples):
        parts = _of(built, STATION).unionAll(_answers(roots, z))
        now, now_path = _stored(_grouped(parts if now is None else parts.unionAll(_of(now, TABLES)), "s", _swept(z, i, frequent)), "tables")
        _freed(spark)
        roots, root_path = _stored(_grouped(_of(roots, ROOT).unionAll(_of(now, TELL)), "r", _root_swept(z, i)), "roots")
        discard(spark, *old)
        z = _with_sums(z, _added_up(z, now, roots), customers2)
        _freed(spark)
        if i >= burn_in:
            kept.append((now, roots, z))
            paths, old = [*paths, now_path, root_path], []
        else:
            old = [now_path, root_path]
    return built, frequent, kept, paths


def score(built: DataFrame, frequent: Broadcast, kept: list[tuple[DataFrame, DataFrame, Totals]]) -> DataFrame:
    """(ord, n_tokens, n_known, base_score, score) of every text, by the average of the samples' predictions.

    Each station sends a row for each block of texts (16 MB of them), with the sums of those it has tokens of. Of a part
    of the stations these are added up by block in the same job, so that what is stored grows with the texts alone.
    """
    zs = [z for _, _, z in kept]
    v, n_train = zs[0].v, zs[0].n

    def sums(got: dict[int, list]) -> list[tuple[int, int, bytes, int]]:
        if STATION not in got:
            return []
        s, _, payload = got[STATION][0]
        x = Station(payload, zs[0], frequent.value)
        p, count = np.zeros(len(x.pair)), None
        for k, z in enumerate(zs):
            t1, t2 = (y.astype(np.float64) for y in _unpack(got[TABLES + 100 * (k + 1)][0][2]))
            chance, count = x.heard(got[ANSWER + 100 * (k + 1)])
            own = x.filled(z, t1, t2)
            p += _chance(2, x.count, t2, x.rest, x.parents(chance, t1, t2, own)[x.pair], own)
        p = np.log10(p / len(zs))
        base, known = np.log10((count + 1) / (n_train + v + 1))[x.asked], (count > 0)[x.asked]
        blocks, size, text, token = _unpack(got[PLACES][0][2])
        out, lo = [], 0
        for block, n in zip(blocks.astype(np.uint64).view(np.int64).tolist(), size.tolist(), strict=True):
            at = token[lo : lo + n]
            texts, where = np.unique(np.cumsum(text[lo : lo + n]), return_inverse=True)
            pair = x.pair[at]
            add = lambda y: np.bincount(where, weights=y, minlength=len(texts))  # noqa: E731, B023
            out.append((s, block, _pack(texts, add(known[pair]).astype(np.int64), add(base[pair]), add(p[at])), SUMS))
            lo += n
        return out

    def of_part(got: dict[int, list]) -> list[tuple[int, int, bytes, int]]:
        found = [_unpack(x[2]) for x in got[SUMS]]
        total = np.zeros((3, 1 + max(int(x[0][-1]) for x in found)))
        for texts, *values in found:
            total[:, texts] += values
        return [(*got[SUMS][0][:2], _pack(total[0].astype(np.int64), *total[1:]), SUMS)]

    def add_up(table: pa.Table) -> pa.Table:
        got = _by_kind(table)
        ords, n = _unpack(got[INFO][0][2])
        total = np.zeros((3, len(ords)))
        for _, _, payload in got[SUMS]:
            values = np.array(_unpack(payload))
            total[:, : values.shape[1]] += values
        return pa.table({"ord": ords.astype(np.uint64).view(np.int64), "n_tokens": n, "n_known": total[0].astype(np.int64), "base_score": total[1], "score": total[2]})

    found, paths, parts = _of(built, INFO), [], min(PARTS, zs[0].stations)
    for part in range(parts):
        rows = _of(built, STATION).unionAll(_of(built, PLACES))
        for k, (tables, _, _) in enumerate(kept):
            rows = rows.unionAll(_of(tables, TABLES).withColumn("kind", F.lit(TABLES + 100 * (k + 1))))
        rows = rows.where(F.col("s") % parts == part)
        for k, (_, roots, z) in enumerate(kept):
            rows = rows.unionAll(_answers(roots, z, ANSWER + 100 * (k + 1), part, parts))
        some, path = _stored(_grouped(_grouped(rows, "s", sums), "r", of_part), "sums")
        _freed(built.sparkSession)
        found, paths = found.unionAll(_of(some, SUMS)), [*paths, path]
    found, path = written(found.groupBy("r").applyInArrow(add_up, "ord long, n_tokens long, n_known long, base_score double, score double"), "scores")
    discard(built.sparkSession, *paths)
    return found


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", per_station: int = PER_STATION) -> DataFrame:
    """Fit on the rows where `training` (a condition on doc_id) holds, and score all rows.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score (log10). A null text is empty and has
    the end token alone; a null doc_id isn't training. Without any training text, every word is unknown.
    Repeated rows train as often as they stand and get equal scores; an empty table gives none.
    per_station: about how many tokens a task holds at once; scores don't depend on it.
    """
    rows = keyed(docs, id_col, text_col)
    built, frequent, kept, paths = fit(rows.withColumn("training", F.coalesce(training, F.lit(False))), per_station=per_station)
    found = score(built, frequent, kept)
    discard(rows.sparkSession, *paths)
    _freed(rows.sparkSession)
    ids = rows.select("ord", "doc_id")
    return found.join(ids, "ord").select("doc_id", "n_tokens", "n_known", F.lit(kept[0][2].n).cast("long").alias("train_tokens"), "base_score", "score")
