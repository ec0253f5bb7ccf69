"""Benchmark decontamination on templates.

Texts are brought to a template: words without the punctuation around them and in lower case, numbers as
NUM, units after numbers as UNIT, capitalised words within a sentence as NAME. Windows of template tokens of
documents and benchmark items are hash-joined; aligned windows in a row make a match, and the values in its
slots must correspond one to one (each number, unit or name of the item always to the same one of the
document and the other way round), which finds questions asked again with other values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, hash_runs, hash_windows, keyed, lean, pieces, text_bytes, words

NUM, UNIT, NAME = (np.uint64(x) for x in (0xA11, 0xA12, 0xA13))
#: Words taken for units of measure when they follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hours minutes seconds days weeks months years percent % usd eur dollars euros cents degrees celsius fahrenheit kmh mph watts volts meters metres kilometers miles grams kilograms liters litres".split()
_PUNCTUATION = np.isin(np.arange(256), [x for x in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"])
_DIGIT = np.isin(np.arange(256), [*range(48, 58)])
_STOP = np.isin(np.arange(256), [x for x in b".!?:;"])


def template(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens, the hashes of the words they stand for, and how many each text has."""
    starts, ends, counts = words(data, at)
    text = np.repeat(np.arange(len(counts)), counts)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.ones(len(starts), dtype=bool)
    if len(starts):
        opens[1:] = _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]]) | (text[1:] != text[:-1])
    s, e = starts.copy(), ends.copy()
    solid = np.flatnonzero(~_PUNCTUATION[data])
    i = np.searchsorted(solid, s)  # punctuation at either end goes
    s = np.where(i < len(solid), solid[np.minimum(i, max(len(solid) - 1, 0))] if len(solid) else e, e)
    j = np.searchsorted(solid, e) - 1
    e = np.where(j >= 0, solid[np.maximum(j, 0)] + 1 if len(solid) else starts, starts)
    keep = s < e
    s, e, text, opens = s[keep], e[keep], text[keep], opens[keep]
    h = hash_runs(LOWER[data], s, e)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    number = digits[e] > digits[s]
    token = np.where(number, NUM, h)
    units = np.sort(np.concatenate([hash_runs(np.frombuffer(x.encode(), np.uint8), np.zeros(1, dtype=np.int64), np.array([len(x.encode())])) for x in UNITS]))
    after = np.append(False, number[:-1] & (text[1:] == text[:-1])) if len(number) else number
    token = np.where(after & np.isin(h, units), UNIT, token)
    first = data[s] if len(s) else s.astype(np.uint8)
    wide = (first == 0xC3) & np.isin(data[np.minimum(s + 1, max(len(data) - 1, 0))], np.arange(0x80, 0x9F)) if len(s) else np.zeros(0, dtype=bool)
    capital = ((first >= 65) & (first <= 90)) | wide
    token = np.where(capital & ~opens & ~number & (token == h), NAME, token)
    return token, h, np.bincount(text, minlength=len(counts)).astype(np.int64)


def _slots(token: np.ndarray) -> np.ndarray:
    return (token == NUM) | (token == UNIT) | (token == NAME)


def windows(token: np.ndarray, h: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place of all windows within a text."""
    n = len(token) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts)
    ok = np.flatnonzero(text[:n] == text[width - 1 :])
    return hash_windows(token, width)[ok] ^ np.uint64(width), text[ok], place[ok]


def _window_rows(rows: DataFrame, widths: list[int], known: np.ndarray | None, id_name: str) -> DataFrame:
    """(window, width, id, place, values): windows and the slot values in them (0 for words); only known ones if given."""
    names = ["window", "width", id_name, "place", "n_tokens", "values"]
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(known) if known is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                token, h, counts = template(*text_bytes(part.column(1)))
                first = np.cumsum(counts) - counts
                ids = part.column(0).to_numpy()
                value = np.where(_slots(token), h, np.uint64(0))
                for width in widths:
                    w, text, place = windows(token, h, counts, width)
                    if shared is not None:
                        known_ = shared.value
                        at = np.minimum(np.searchsorted(known_, w), max(len(known_) - 1, 0))
                        keep = np.flatnonzero(known_[at] == w) if len(known_) else np.zeros(0, dtype=np.int64)
                        w, text, place = w[keep], text[keep], place[keep]
                    values = value[(first[text] + place)[:, None] + np.arange(width)] if len(w) else np.zeros((0, width), dtype=np.uint64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * width), pa.array(values.ravel().view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.full(len(w), width, dtype=np.int32)), pa.array(ids[text]), pa.array(place), pa.array(counts[text]), lists], names=names)

    return rows.mapInArrow(lean(run), f"window long, width int, {id_name} long, place long, n_tokens long, values array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, least_tokens: int = 13, least_item: int = 4, broadcast_windows: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(ord, doc_id, item_id, n_tokens, verbatim): the documents that hold benchmark items, once for each item.

    A match is a stretch of template tokens that document and item share, made of `width`-token windows in a
    row: at least least_tokens tokens, or the whole of a shorter item (of least_item tokens or more), with
    consistent slots. Slots of other values say nothing by themselves, so as many tokens of the stretch as half
    a window has (or half a shorter item) must be the same words, numbers, units or names. n_tokens is the longest match's length; verbatim says that all its slots are equal.
    Null and empty texts match nothing; repeated rows are rows of their own. Item windows are sent to all
    executors only up to broadcast_windows of them (8 bytes each); beyond, windows are joined by a shuffle.
    """
    rows = keyed(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    widths = list(range(least_item, width + 1))
    bench = _window_rows(items, widths, None, "item_id")
    # a window narrower than `width` counts only as a whole item
    bench = bench.where((F.col("width") == width) | (F.col("n_tokens") == F.col("width")))
    keys = bench.select("window").distinct()
    n = keys.count()
    known = np.sort(np.array([r["window"] for r in keys.toLocalIterator()], dtype=np.int64).view(np.uint64)) if n <= broadcast_windows else None
    found = _window_rows(rows.select("ord", "text"), widths, known, "ord")
    item = bench.select("window", "item_id", F.col("place").alias("item_place"), F.col("n_tokens").alias("item_tokens"), F.col("values").alias("item_values"))
    hits = found.join(item, "window").select("ord", "item_id", (F.col("place") - F.col("item_place")).alias("shift"), "place", "width", "item_tokens", "values", "item_values")
    grouped = hits.groupBy("ord", "item_id", "shift", "item_tokens").agg(F.collect_list(F.struct("place", "width", "values", "item_values")).alias("w"))
    # fewer windows than that can't make a stretch that is long enough
    grouped = grouped.where(F.size("w") > F.least(F.lit(least_tokens), "item_tokens") - F.least(F.lit(width), "item_tokens"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ord_, item_, size, found_ in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                best = longest(found_, min(least_tokens, size), (min(width, size) + 1) // 2)
                if best:
                    out.append((ord_, item_, *best))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["ord", "item_id", "n_tokens", "verbatim"])

    matches = grouped.select("ord", "item_id", "item_tokens", "w").mapInArrow(lean(check), "ord long, item_id long, n_tokens long, verbatim boolean")
    best = matches.groupBy("ord", "item_id").agg(F.max(F.struct("n_tokens", "verbatim")).alias("m"))
    return best.join(rows.select("ord", "doc_id"), "ord").select("ord", "doc_id", "item_id", "m.n_tokens", "m.verbatim")


def longest(found: list[dict], least: int, same: int = 0) -> tuple[int, bool] | None:
    """Length of the longest stretch of windows in a row with consistent slots, and whether its slots are equal.

    At least `same` of its tokens must be words or equal slots.
    """
    found = sorted(found, key=lambda x: (x["place"], x["width"]))
    best = None
    i = 0
    while i < len(found):
        j, begin, pairs = i, found[i]["place"], []
        while j < len(found) and (j == i or found[j]["place"] <= found[j - 1]["place"] + 1):
            at = found[j]["place"] - begin
            pairs += [(0, 0)] * (at + found[j]["width"] - len(pairs))
            pairs[at : at + len(found[j]["values"])] = zip(found[j]["values"], found[j]["item_values"], strict=True)
            j += 1
        there: dict[int, tuple[int, int]] = {}  # where a value stood last, and for which
        back: dict[int, tuple[int, int]] = {}
        lo, other = 0, [0]
        for k, (a, b) in enumerate(pairs):
            if a or b:
                for seen, value, partner in ((there, b, a), (back, a, b)):
                    at, was = seen.get(value, (-1, partner))
                    if was != partner:
                        lo = max(lo, at + 1)
                    seen[value] = (k, partner)
            other.append(other[-1] + (a != b))
            size, unequal = k + 1 - lo, other[k + 1] - other[lo]
            if size >= least and size - unequal >= same and (best is None or (size, not unequal) > best):
                best = (size, not unequal)
        i = j
    return best
