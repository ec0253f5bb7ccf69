"""Removal of sentences that a repeated run of consecutive sentences covers.

Every run of `run` sentences (for passages: of as many as it takes to have enough words, overlong sentences
being split) is hashed; runs are sorted by hash and place across the cluster (a sort-merge
self-join on the hash whose hot keys are dealt over many tasks), and all but the first of equal runs mark
their sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, free_shuffles, hash_runs, keyed, mix, pieces, ragged, text_bytes, words
from .suffixes import compare

_STOP = np.isin(np.arange(256), [ord(x) for x in ".!?"])


def sentences(data: np.ndarray, at: np.ndarray, most_words: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of sentences, ends of their last words, their numbers of words, and how many each text has.

    A sentence ends at a word that ends in . ! or ?, and at a line's end. Of those with more than most_words
    words each piece counts as one.
    """
    starts, ends, counts = words(data, at)
    if not len(starts):
        return starts, ends, starts, counts
    first = np.zeros(len(starts), dtype=bool)
    begins = (np.cumsum(counts) - counts)[counts > 0]
    first[begins] = True
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    first[1:] |= _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    if most_words:
        first |= _splits(hash_runs(LOWER[data], starts, ends), first, most_words)
    head = np.flatnonzero(first)
    last = np.append(head[1:], len(starts)) - 1
    text = np.repeat(np.arange(len(counts)), counts)[head]
    return starts[head], ends[last], last - head + 1, np.bincount(text, minlength=len(counts))


def _splits(h: np.ndarray, first: np.ndarray, most_words: int) -> np.ndarray:
    """Words that begin a further piece of a sentence of more than most_words words: the least hash, the last one
    if it recurs, of any most_words - 2 words in a row, so that the same words are split in the same places
    whatever stands around them."""
    k = max(2, most_words - 2)
    head = np.flatnonzero(first)
    size = np.diff(np.append(head, len(h)))
    long = np.flatnonzero(np.repeat(size > most_words, size))
    if not len(long):
        return np.zeros(len(h), dtype=bool)
    h, sentence = h[long], np.repeat(np.arange(len(head)), size)[long]
    reach = np.ones(len(h), dtype=np.int64)
    left, right = np.ones(len(h), dtype=bool), np.ones(len(h), dtype=bool)
    for d in range(1, min(k, len(h))):
        same = sentence[d:] == sentence[:-d]
        left[:d], right[-d:] = False, False
        left[d:] &= same & (h[:-d] >= h[d:])
        right[:-d] &= same & (h[d:] > h[:-d])
        reach += left
        reach += right
    out = np.zeros(len(first), dtype=bool)
    out[long[reach >= k]] = True
    return out


def lengths(size: np.ndarray, counts: np.ndarray, run: int, least_words: int, passages: bool) -> np.ndarray:
    """How many sentences the run from each sentence has: `run`, or for passages as many more as give least_words
    words; 0 if the run has fewer words or the text ends before."""
    here, total = np.arange(len(size)), np.concatenate([[0], np.cumsum(size)])
    end = here + run
    if passages:
        end = np.maximum(end, np.searchsorted(total, total[:-1] + least_words))
    inside = end <= np.repeat(np.cumsum(counts), counts)
    return np.where(inside & (total[np.minimum(end, len(size))] - total[:-1] >= least_words), end - here, 0)


def runs(data: np.ndarray, at: np.ndarray, run: int, least_words: int, passages: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first sentence of each run of sentences with at least least_words words; case doesn't count."""
    starts, ends, size, counts = sentences(data, at, least_words if passages else None)
    length = lengths(size, counts, run, least_words, passages)
    begin = np.flatnonzero(length)
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    length = length[begin]
    h = hash_runs(LOWER[data], starts, ends)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    head = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(head, length)
    h = mix(np.add.reduceat(mix(h[ragged(begin, length)] + place.astype(np.uint64)), head) + length.astype(np.uint64))
    return h, text[begin], first[begin]


def remove_spans(docs: DataFrame, run: int = 2, least_words: int = 12, bucket_rows: int = 400_000, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """Remove the sentences covered by a run of `run` sentences, of least_words words or more, that also
    occurs earlier (in a smaller doc_id, equal ids in order of the text, or before in the same text).

    With passages, a run grows from each sentence until it has least_words words, and a sentence of more than
    least_words words counts as several, split where its words say; so a passage of some 50 words is found in
    short lines, in one long sentence, and in the midst of other sentences. What may remain of a passage is
    at its ends: what stands in one sentence or piece with words around it, and after the last whole run.

    A removed sentence goes with the white space after it. A null text is empty and stays so; texts of fewer
    sentences than `run` lose nothing; the second of two equal rows loses all that such runs cover.
    Returns ord, doc_id, n_sentences, n_removed, n_spans (maximal removed runs), kept.
    """
    rows = keyed(docs, id_col, text_col)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                h, text, first = runs(*text_bytes(part.column(1)), run, least_words, passages)
                ords = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.zeros(len(h), dtype=np.int64)), pa.array(ords[text]), pa.array(first)], names=["key", "cover", "ord", "place"])

    def spans(some: DataFrame) -> DataFrame:
        return some.select("ord", "text").mapInArrow(hashed, "key long, cover long, ord long, place long")

    share = 16
    repeated, _, _ = compare(spans(rows), spans(rows.where(F.pmod(F.xxhash64("ord"), F.lit(share)) == 0)), 1 / share, bucket_rows, "span-runs", False)
    free_shuffles(docs.sparkSession)
    lists = repeated.groupBy("ord").agg(F.collect_list("place").alias("places"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, at = text_bytes(part.column(2))
                starts, _, size, counts = sentences(data, at, least_words if passages else None)
                length = lengths(size, counts, run, least_words, passages)
                first = np.concatenate([[0], np.cumsum(counts)])
                out = []
                for i, places in enumerate(part.column(3)):
                    n = int(counts[i])
                    gone = np.zeros(n, dtype=bool)
                    if places.is_valid:
                        p = places.values.to_numpy()
                        gone[ragged(p, length[first[i] + p])] = True
                    own = data[at[i] : at[i + 1]]
                    mask = np.ones(len(own), dtype=bool)
                    if gone.any():
                        begin = starts[first[i] : first[i + 1]] - at[i]
                        end = np.append(begin[1:], len(own))
                        for k in np.flatnonzero(gone).tolist():
                            mask[begin[k] : end[k]] = False
                    spans_ = int(np.count_nonzero(np.diff(np.append(0, gone.astype(np.int8))) == 1))
                    out.append((n, int(gone.sum()), spans_, own[mask].tobytes().decode("utf-8")))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["ord", "doc_id", "n_sentences", "n_removed", "n_spans", "kept"])

    return rows.select("ord", "doc_id", "text").join(lists, "ord", "left").mapInArrow(keep, "ord long, doc_id long, n_sentences long, n_removed long, n_spans long, kept string")
