"""Language identification by prediction with partial matching.

For every language a variable-order tree of byte contexts is counted on labelled texts and then frozen. A
byte's code length in a language is that of PPM (escape method C): the longest known context codes the byte,
or an escape and then the next shorter one does. As the statistics are frozen, the code length of a byte is
a function of the last few bytes alone, so it's computed once for each node of the union of the trees; a
text is then walked with one table look-up for each order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces, text_bytes

UNKNOWN = "und"


def _grams(data: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length 1 .. order, at each byte the number of the gram that ends there, first byte highest;
    0 where the gram would begin before its text (or the length has 0 as its first byte)."""
    into = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    out, code = [], np.zeros(len(data), dtype=np.int64)
    for k in range(order):
        shifted = np.zeros(len(data), dtype=np.int64)
        if k < len(data):
            shifted[k:] = data[: len(data) - k]
        code = code | (shifted << (8 * k))
        out.append(np.where(into >= k, code, 0))
    return out


class Children:
    """The nodes one byte longer than given ones: an open hash table at most half full, searched in bulk.

    It takes 24 to 48 bytes a node, however the bytes spread.
    """

    def __init__(self, keys: np.ndarray):
        self.bits = max(1, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.nodes = np.zeros(1 << self.bits, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            at, who = np.unique(np.where(free, slot, -1), return_index=True)
            who = who[at >= 0]
            self.keys[slot[who]] = keys[left[who]]
            self.nodes[slot[who]] = left[who] + 1
            stay = np.ones(len(left), dtype=bool)
            stay[who] = False
            left, slot = left[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The node of each key (a node * 256 + a byte), or 0."""
        out = np.zeros(len(keys), dtype=np.int32)
        slot, left = self._slot(keys), None
        while len(slot):
            held = self.keys[slot]
            hit = held == keys
            out[np.flatnonzero(hit) if left is None else left[hit]] = self.nodes[slot[hit]]
            on = np.flatnonzero(~hit & (held >= 0))
            left = on if left is None else left[on]
            slot, keys = (slot[on] + 1) & ((1 << self.bits) - 1), keys[on]
        return out


@dataclass
class Model:
    """Frozen trees: child tables by order, code lengths in bits by node and language, and escapes."""

    langs: list[str]
    step: list[Children]  # step[k] finds (node of order k, byte) among the nodes of order k + 1
    bits: list[np.ndarray]  # bits[k][node of order k]: code length of its last byte after the others
    escape: list[np.ndarray]  # escape[k][node of order k]: bits of an escape from that context; 0 if unknown

    @classmethod
    def build(cls, langs: list[str], grams: list[tuple[np.ndarray, np.ndarray]], least: int = 2) -> Model:
        """grams: for each length 1 .. order, the distinct gram numbers and their counts (gram, language).

        Grams of two or more bytes that all languages together have fewer than `least` times are pruned.
        """
        n = len(langs)
        nodes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for k, (codes, c) in enumerate(grams):
            keep = c.sum(axis=1) >= (least if k else 1)
            if k:
                keep &= np.isin(codes >> 8, nodes[k - 1]) & np.isin(codes & ((1 << 8 * k) - 1), nodes[k - 1])
            order = np.argsort(codes[keep])
            nodes.append(codes[keep][order])
            counts.append(c[keep][order].astype(np.float64))
        step, bits, escape = [], [np.zeros((1, n), dtype=np.float32)], []
        for k in range(len(nodes)):
            parent = np.zeros(len(nodes[k]), dtype=np.int64) if not k else np.searchsorted(nodes[k - 1], nodes[k] >> 8) + 1
            size = 2 if not k else len(nodes[k - 1]) + 1
            step.append(Children(parent * 256 + (nodes[k] & 255)))
            total, kinds = np.zeros((size, n)), np.zeros((size, n))
            np.add.at(total, parent, counts[k])
            np.add.at(kinds, parent, counts[k] > 0)
            known = total > 0
            out = np.where(known, np.log2(np.maximum(total + kinds, 1)) - np.log2(np.maximum(kinds, 1)), 0)
            escape.append(out.astype(np.float32))
            shorter = np.full((len(nodes[k]), n), 8.0) if not k else bits[k][np.searchsorted(nodes[k - 1], nodes[k] & ((1 << 8 * k) - 1)) + 1]
            seen = counts[k] > 0
            own = np.log2(np.maximum(total + kinds, 1))[parent] - np.log2(np.maximum(counts[k], 1))
            found = np.where(seen, own, out[parent] + shorter)
            bits.append(np.vstack([np.zeros((1, n)), found]).astype(np.float32))
        return cls(langs, step, bits, escape)

    def code_lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text in each language, (texts, languages)."""
        n, langs = len(data), len(self.langs)
        if not n:
            return np.zeros((len(at) - 1, langs))
        begins = at[:-1][np.diff(at) > 0]
        nodes, byte = [], data.astype(np.int64)
        for k, children in enumerate(self.step):
            if not k:
                node = children.find(np.arange(256))[data]
            else:
                node = np.zeros(n, dtype=np.int32)
                known = np.flatnonzero(nodes[-1][:-1])
                node[known + 1] = children.find(nodes[-1][known].astype(np.int64) * 256 + byte[known + 1])
                node[begins] = 0
            nodes.append(node)
        cost = np.empty((n, langs), dtype=np.float32)
        open_ = None  # positions whose byte no longer gram has coded
        for k in range(len(nodes) - 1, -1, -1):
            node = nodes[k] if open_ is None else nodes[k][open_]
            hit = node > 0
            if open_ is None:
                cost[:] = np.take(self.bits[k + 1], node, axis=0)
                open_ = np.flatnonzero(~hit)
                cost[open_] = 0
            else:
                cost[open_[hit]] += np.take(self.bits[k + 1], node[hit], axis=0)
                open_ = open_[~hit]
            if not len(open_):
                break
            if k:
                # the context is the gram one shorter that ends a byte before
                context = np.where(np.isin(open_, begins), 0, nodes[k - 1][open_ - 1])
                cost[open_] += self.escape[k][context]
            else:
                cost[open_] += self.escape[0][0] + 8
        out = np.zeros((len(at) - 1, langs))
        has = np.diff(at) > 0
        out[has] = np.add.reduceat(cost, begins, axis=0, dtype=np.float64)
        return out


def gram_counts(docs: DataFrame, langs: list[str], order: int, least: int = 2, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(length, code, counts): for the byte grams of 1 .. order how often each occurs, as pairs (index in
    langs, n). Grams of two or more bytes that occur fewer than `least` times in all are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lang in enumerate(langs):
                own = batch.filter(pa.compute.equal(batch.column(1), lang))
                for part in pieces(own, "text"):
                    data, at = text_bytes(part.column(0))
                    for k, codes in enumerate(_grams(data, at, order)):
                        codes, n = np.unique(codes[codes > 0], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), k + 1, dtype=np.int32)), pa.array(codes), pa.array(np.full(len(codes), i, dtype=np.int32)), pa.array(n)], names=["length", "code", "lang", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(lean(count), "length int, code long, lang int, n long")
    by_lang = rows.groupBy("length", "code", "lang").agg(F.sum("n").alias("n"))
    found = by_lang.groupBy("length", "code").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("counts"))
    return found.where((F.col("length") == 1) | (F.col("all") >= least)).select("length", "code", "counts")


def fit(labelled: DataFrame, order: int = 5, sample_bytes: int = 6_000_000, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Trees of byte contexts from a bounded sample of whole labelled texts.

    sample_bytes bounds what all languages give together, in equal parts: of a language's distinct texts those
    of least hash are taken, down from a bound that gives its part in expectation (all of them if there are
    fewer bytes, the one of least hash in any case). A repeated text counts once, so copies weigh nothing. Null
    texts and labels aren't used; a text with two labels counts for each. None if no text has a byte.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text <> '' and lang is not null")
    hashed = rows.withColumn("h", F.xxhash64("text"))
    once = hashed.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("b"))
    sizes = {r["lang"]: r for r in once.groupBy("lang").agg(F.sum("b").alias("b"), F.min("h").alias("least")).collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    keep = F.lit(False)
    for lang in langs:
        share = min(1.0, sample_bytes / len(langs) / sizes[lang]["b"])
        highest = max(int(share * 2**64) - 2**63 - 1, sizes[lang]["least"])
        keep = keep | ((F.col("lang") == lang) & (F.col("h") <= F.lit(min(highest, 2**63 - 1))))
    drawn = hashed.where(keep).groupBy("lang", "h").agg(F.first("text").alias("text"))
    found = gram_counts(drawn, langs, order).toArrow().combine_chunks()
    grams = []
    for k in range(1, order + 1):
        own = found.filter(pa.compute.equal(found.column("length"), k)).combine_chunks()
        lists = own.column("counts").combine_chunks()
        pairs = lists.flatten()
        c = np.zeros((own.num_rows, len(langs)), dtype=np.int64)
        c[np.repeat(np.arange(own.num_rows), lists.value_lengths().to_numpy()), pairs.field("lang").to_numpy()] = pairs.field("n").to_numpy()
        grams.append((own.column("code").to_numpy(), c))
    return Model.build(langs, grams)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte): the language of least code length, of whole texts.

    With carry, the columns of docs are returned instead of doc_id, as c0, c1, ... in their order.

    score is its share when each language weighs 2 ** -bits (a tie goes to the first by name). A text that
    is null or without a letter gets `und` and score 0, as does every text if the model is None. Repeated rows
    are rows of their own with equal results; an empty table gives none.
    """
    columns = docs.columns if carry else [id_col]
    names = [*([f"c{i}" for i in range(len(columns))] if carry else ["doc_id"]), "lang_pred", "score", "bits_per_byte"]
    carried = [docs[x].alias(n) for x, n in zip(columns, names, strict=False)]
    kinds = ", ".join(f"{n} {docs.schema[x].dataType.simpleString()}" for x, n in zip(columns, names, strict=False))
    text, more = (names[columns.index(text_col)], []) if carry else ("text", [docs[text_col].alias("text")])
    where = len(columns) - 1 + len(more) if not carry else columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in pieces(batch, text, 200_000):
                n = part.num_rows
                lang, score, rate = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.zeros(n)
                if model:
                    data, at = text_bytes(part.column(where))
                    bits = model.code_lengths(data, at)
                    best = np.argmin(bits, axis=1)
                    least = bits[np.arange(n), best]
                    has = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                    lang[has] = np.array(model.langs, dtype=object)[best[has]]
                    score[has] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)[has]
                    rate = least / np.maximum(np.diff(at), 1)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(rate)], names=names)

    rows = docs.select(*carried, *more, has_letter(docs[text_col]).alias("letters"))
    return rows.mapInArrow(lean(run), f"{kinds}, lang_pred string, score double, bits_per_byte double")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
