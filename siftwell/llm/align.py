"""Cross-tokenizer alignment: groups of two tokenizers' tokens that cover the same bytes, and which ids go together."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import offsets_of, pieces, ragged, text_bytes, written
from .tokens import Encoder, tokenizer_path

_FIELDS = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.binary(), "pairs": pa.binary(), "counts": pa.binary()}


class _Spaced:
    """Encodes segments that begin with a space by a SentencePiece model, which adds that space by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.space = self.model.piece_to_id("▁")

    def encode_batch_fast(self, texts: list[str], add_special_tokens: bool = False) -> list[SimpleNamespace]:
        found = self.model.encode([x[1:] for x in texts], num_threads=1)
        # an empty text is given no space by the model, so a lone one is put in here
        return [SimpleNamespace(ids=ids if len(x) > 1 else [self.space]) for x, ids in zip(texts, found, strict=True)]


class PieceEncoder(Encoder):
    """Encoder for a SentencePiece model of kind BPE: no piece holds a space after anything else (checked), so
    merges never cross from a non-space to a space and each distinct segment is encoded once."""

    def __init__(self, path: str, memory: int = 700_000):
        self.tokenizer = _Spaced(path)
        self.memory = memory
        self._forget()
        if any("▁" in x.lstrip("▁") for x in map(self.tokenizer.model.id_to_piece, range(self.tokenizer.model.get_piece_size()))):
            raise ValueError("a piece holds a space after another character, so texts can't be cut at spaces")

    @staticmethod
    def _cuts(data: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data), dtype=bool)
        cut[1:] = (data[1:] == 32) & (data[:-1] != 32)
        return cut


def byte_level_tokens(path: str) -> list[bytes]:
    """What bytes each id of a byte-level vocabulary file stands for."""
    from tokenizers import Tokenizer

    # a byte that is a visible Latin-1 character stands for itself, the others for code points from 256 in order
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte[x] for x in token) if all(x in byte for x in token) else token.encode()
    return out


def piece_tokens(path: str) -> list[bytes]:
    """What bytes each id of a SentencePiece model stands for: <0xHH> is a byte, U+2581 a space."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids can end together at all: the bytes of one must end with the other's.

    It depends on the vocabularies alone, so what is kept by pairs never grows with the texts.
    """
    count: dict[bytes, list[int]] = {}
    for side, tokens in enumerate((a, b)):
        for x in tokens:
            count.setdefault(x, [0, 0])[side] += 1
    total = sum(x * y for x, y in count.values())
    for side, tokens in enumerate((a, b)):
        total += sum(count[x[i:]][1 - side] for x in tokens for i in range(1, len(x)) if x[i:] in count)
    return total


class _Side:
    """One tokenizer's tables: bytes of all ids joined, their places, and their decimal names."""

    def __init__(self, tokens: list[bytes], encode: Encoder):
        self.encode = encode
        self.size = np.array([len(x) for x in tokens], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.digits = np.char.str_len(np.arange(len(tokens)).astype(str)).astype(np.int64)
        self.width = int(self.digits.max(initial=1))
        self.names = np.zeros((len(tokens), self.width + 1), dtype=np.uint8)
        for i in range(len(tokens)):
            self.names[i, : self.digits[i]] = np.frombuffer(str(i).encode(), dtype=np.uint8)

    def ids(self, column: pa.Array, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts joined, how many each has, and which texts their bytes give back exactly."""
        ids, counts = self.encode(column)
        ids = ids.astype(np.int64)
        size = self.size[ids]
        own = np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])])
        same = own == np.diff(at)
        if same.all():
            spelt = self.data[ragged(self.first[ids], size)]
            if np.array_equal(spelt, data):
                return ids, counts, same
        # some text isn't given back: compare them one by one
        last = np.cumsum(counts)
        for i in np.flatnonzero(same):
            some = ids[last[i] - counts[i] : last[i]]
            same[i] = np.array_equal(self.data[ragged(self.first[some], self.size[some])], data[at[i] : at[i + 1]])
        return ids, counts, same


def overlaps(a_at: np.ndarray, a_end: np.ndarray, b_at: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range [first, last) of B tokens that each A token overlaps, by two bisections of B's static interval index.

    B's tokens are disjoint and sorted, so their starts and their ends are both sorted: the first overlapped one
    is the first to end after A's start, and the last one the last to start before A's end.
    """
    return np.searchsorted(b_end, a_at, side="right"), np.searchsorted(b_at, a_end, side="left")


def _kept(ids: np.ndarray, counts: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (ids, counts) if good.all() else (ids[np.repeat(good, counts)], np.where(good, counts, 0))


def aligned(column: pa.Array, a: _Side, b: _Side) -> list[pa.Array]:
    """The columns of align() after the id, for one batch of texts."""
    n = len(column)
    filled = column.fill_null("") if column.null_count else column
    spaced = pc.binary_join_element_wise(pa.scalar(" "), filled, pa.scalar(""))
    data, at = text_bytes(spaced)
    a_ids, a_counts, a_good = a.ids(spaced, data, at)
    b_ids, b_counts, b_good = b.ids(spaced, data, at)
    good = a_good & b_good & (np.diff(at) > 1)
    a_ids, a_counts = _kept(a_ids, a_counts, good)
    b_ids, b_counts = _kept(b_ids, b_counts, good)
    # offsets in the joined bytes of the good texts: the same for both sides, and both break at each text's end
    a_end, b_end = np.cumsum(a.size[a_ids]), np.cumsum(b.size[b_ids])
    first, last = overlaps(a_end - a.size[a_ids], a_end, b_end - b.size[b_ids], b_end)
    # the gap after an A token is spanned by no B token where the last one overlapped ends with it
    closes = np.flatnonzero(b_end[last - 1] == a_end) if len(a_end) else np.zeros(0, dtype=np.int64)
    partner = last[closes] - 1
    group_of_a = np.cumsum(np.bincount(closes + 1, minlength=len(a_ids) + 1))[: len(a_ids)]
    a_last = np.cumsum(a_counts)
    n_groups = np.bincount(np.searchsorted(a_last, closes, side="right"), minlength=n)
    # pairs: A and B tokens whose ranges end together, by document
    key = a_ids[closes] * len(b.size) + b_ids[partner]
    of = np.repeat(np.arange(n), n_groups)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    begin = np.flatnonzero(fresh)
    times = np.diff(np.append(begin, len(key))).astype(np.uint32)
    distinct = np.bincount(of[begin], minlength=n)
    text, ends = _group_texts(a, b, a_ids, b_ids, a_counts, b_counts, closes, partner, group_of_a)
    small = len(a.size) * len(b.size) <= 1 << 32
    return [pa.array(a_counts.astype(np.int64)), pa.array(b_counts.astype(np.int64)), pa.array(n_groups.astype(np.int64)), pa.array(n_groups.astype(np.int64)), _binary(text, ends), _runs(key[begin].astype(np.uint32 if small else np.uint64), distinct), _runs(times, distinct)]


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def _runs(values: np.ndarray, size: np.ndarray) -> pa.Array:
    return _binary(np.ascontiguousarray(values).view(np.uint8), np.cumsum(size) * values.dtype.itemsize)


def _group_texts(a, b, a_ids, b_ids, a_counts, b_counts, closes, partner, group_of_a) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3` of all texts joined, and where each text's ends.

    Each token goes to its place in the sequence of A's and B's tokens group by group; a name and the sign
    after it are a row of a table, whose unused places are then left out.
    """
    total, width = len(a_ids) + len(b_ids), max(a.width, b.width) + 1
    if not total:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(a_counts), dtype=np.int64)
    a_upto, b_upto = closes + 1, partner + 1
    b_before = np.concatenate([[0], b_upto])[group_of_a]
    group_of_b = np.searchsorted(b_upto, np.arange(len(b_ids)), side="right")
    a_place, b_place = np.arange(len(a_ids)) + b_before, np.arange(len(b_ids)) + a_upto[group_of_b]
    table = np.zeros((total, width), dtype=np.uint8)
    size = np.empty(total, dtype=np.int64)
    sign = np.full(total, ord(","), dtype=np.uint8)
    for side, ids, place in ((a, a_ids, a_place), (b, b_ids, b_place)):
        table[place, : side.width + 1] = side.names[ids]
        size[place] = side.digits[ids]
    sign[a_place[closes]] = ord("|")
    sign[b_place[partner]] = ord(";")
    end_of_text = np.cumsum(a_counts + b_counts)
    closing = end_of_text[(a_counts + b_counts) > 0] - 1
    table[np.arange(total), size] = sign
    size += 1
    size[closing] -= 1
    ends = np.concatenate([[0], np.cumsum(size)])[end_of_text]
    return table[np.arange(width) < size[:, None]], ends


_SIDES: dict[tuple[str, str], tuple[_Side, _Side]] = {}


def _sides(a_path: str, b_path: str) -> tuple[_Side, _Side]:
    """This process's tables for two files; made once, as a worker serves many tasks."""
    if (a_path, b_path) not in _SIDES:
        _SIDES[a_path, b_path] = _Side(byte_level_tokens(a_path), Encoder(a_path, 400_000)), _Side(piece_tokens(b_path), PieceEncoder(b_path, 400_000))
    return _SIDES[a_path, b_path]


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, counts), a row for each row of docs.

    Tokens of a space and the text by a byte-level file (A), and of the text by a SentencePiece model that adds
    the space (B). B's tokens are a static interval index; each A token's overlaps are found by bisection, and a
    gap between A tokens that no B token spans ends a group. groups: A's and B's ids, as `a1,a2|b1;a3|b2,b3`;
    pairs and counts: the distinct pairs of ids that end together, as A * |B's ids| + B, and how often, both as
    little-endian integers. Texts that are null or empty, or that either side doesn't give back byte by byte,
    have no tokens. Repeated rows are rows of their own, a null id stays null, and an empty table gives no rows.
    """
    a_path, b_path = a_path or tokenizer_path(), b_path or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _sides(a_path, b_path)
        for batch in batches:
            for some in pieces(batch, "text", 500_000):
                if some.num_rows:
                    yield pa.RecordBatch.from_arrays([some.column(0), *aligned(some.column(1), a, b)], names=list(_FIELDS))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups binary, pairs binary, counts binary")


def _pair_type(a_size: int, b_size: int) -> np.dtype:
    return np.dtype(np.uint32 if a_size * b_size <= 1 << 32 else np.uint64)


def pair_totals(found: DataFrame, kind: np.dtype) -> DataFrame:
    """(pair, n) over all rows of (pairs, counts): added up in each task, which holds no more than pair_bound() sums, then once."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            more = np.frombuffer(_joined(batch.column(0)), dtype=kind).astype(np.int64)
            n = np.frombuffer(_joined(batch.column(1)), dtype=np.uint32)
            both = np.concatenate([keys, more])
            keys, place = np.unique(both, return_inverse=True)
            sums = np.bincount(place, weights=np.concatenate([sums, n]), minlength=len(keys)).astype(np.int64)
        for lo in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 100_000]), pa.array(sums[lo : lo + 100_000])], names=["pair", "n"])

    return found.select("pairs", "counts").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _joined(column: pa.Array) -> memoryview | bytes:
    at = offsets_of(column)
    return memoryview(column.buffers()[2])[at[0] : at[-1]] if len(column) and at[0] < at[-1] else b""


def count_links(found: DataFrame, a_path: str | None = None, b_path: str | None = None, held_pairs: int = 8_000_000) -> DataFrame:
    """found, without pairs and counts, with n_best (links whose pair is the most frequent of its B id, ties too) and
    count_sum (over links, how often their pairs are linked in all texts).

    found is read twice, so it should be a written table of align(). The totals by pair are bounded by what the
    two vocabularies allow (pair_bound), whatever the texts; up to `held_pairs` they are broadcast, and for
    vocabularies beyond that they are joined by a shuffle.
    """
    a_tokens, b_tokens = byte_level_tokens(a_path or tokenizer_path()), piece_tokens(b_path or tokenizer_path("piece_bpe_32k.model"))
    kind, b_size = _pair_type(len(a_tokens), len(b_tokens)), len(b_tokens)
    totals = pair_totals(found, kind)
    names = [x for x in found.columns if x not in ("pairs", "counts")]
    if pair_bound(a_tokens, b_tokens) > held_pairs:
        return _joined_links(found, totals, kind, b_size, names)
    table = totals.toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    keys, sums = table.column("pair").to_numpy()[order], table.column("n").to_numpy()[order]
    most = np.zeros(b_size, dtype=np.int64)
    np.maximum.at(most, keys % b_size, sums)
    held = found.sparkSession.sparkContext.broadcast((keys, sums, sums == most[keys % b_size]))

    def read_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, best = held.value
        for batch in batches:
            of = batch.schema.get_field_index
            column = batch.column(of("pairs"))
            pairs = np.frombuffer(_joined(column), dtype=kind).astype(np.int64)
            n = np.frombuffer(_joined(batch.column(of("counts"))), dtype=np.uint32).astype(np.int64)
            at = offsets_of(column)
            at = (at - at[0]) // kind.itemsize
            place = np.searchsorted(keys, pairs)
            parts = [np.diff(np.concatenate([[0], np.cumsum(x)])[at]) for x in (n * best[place], n * sums[place])] if len(pairs) else [np.zeros(batch.num_rows, dtype=np.int64)] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(of(x)) for x in names), *map(pa.array, parts)], names=[*names, "n_best", "count_sum"])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in found.schema if x.name in names)
    return found.mapInArrow(read_off, f"{fields}, n_best long, count_sum long")


def _joined_links(found: DataFrame, totals: DataFrame, kind: np.dtype, b_size: int, names: list[str]) -> DataFrame:
    """count_links() by a join on the pair, for vocabularies whose pairs are too many to be held."""
    spark = found.sparkSession
    rows, _ = written(found.withColumn("_row", F.monotonically_increasing_id()), "align-rows")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = offsets_of(batch.column(1))
            pairs = np.frombuffer(_joined(batch.column(1)), dtype=kind).astype(np.int64)
            n = np.frombuffer(_joined(batch.column(2)), dtype=np.uint32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), np.diff(at) // kind.itemsize)), pa.array(pairs), pa.array(n)], names=["_row", "pair", "k"])

    totals, _ = written(totals, "align-totals")
    most = totals.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("most"))
    marked = totals.join(most, F.col("pair") % b_size == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    links = rows.select("_row", "pairs", "counts").mapInArrow(unfold, "_row long, pair long, k long")
    # a pair is linked in almost every text, so each total is dealt to a few salts and each link to one of them
    salts = 16
    dealt = marked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = links.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int")).join(dealt, ["pair", "salt"])
    sums = met.groupBy("_row").agg(F.sum(F.col("k") * F.col("best")).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.join(sums, "_row", "left").select(*names, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def digest(found: DataFrame) -> DataFrame:
    """align() with groups_sha256, '' where there are no tokens, in the place of the groups."""
    return found.withColumn("groups", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).withColumnRenamed("groups", "groups_sha256")
