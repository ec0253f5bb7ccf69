"""Token ids of whole texts with a frozen public tokenizer, at the price of the distinct words only."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import hash_runs, ragged, text_bytes

_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_PUNCTUATION = np.isin(np.arange(256), [x for x in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"])
#: Lead bytes of the white space beyond ASCII, before which a text isn't cut.
_WIDE_LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes batches of texts as the tokenizer file would, without special tokens.

    The file's byte-level splitter never joins what stands on both sides of a single space between two
    non-space characters, nor an ASCII letter with the punctuation (but ') after it, so a text may be cut
    there and each distinct piece be encoded once. Ids of pieces are remembered, under a 64-bit hash, up to
    `memory` of them (some 26 bytes each); then the memory starts anew.
    """

    #: How many bytes each id stands for, where pieces may be encoded joined.
    bytes_of: np.ndarray | None = None

    def __init__(self, path: str, memory: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memory = memory
        # a byte-level vocabulary has a character for each byte
        named = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1, dtype=np.int64)
        self.bytes_of[np.fromiter(named.values(), dtype=np.int64, count=len(named))] = np.fromiter(map(len, named), dtype=np.int64, count=len(named))
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.first, self.size, self.ids = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint32)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts joined (uint32), and how many each has; a null text has none."""
        data, at = text_bytes(column)
        n = len(data)
        if not n:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(column), dtype=np.int64)
        cut = self._cuts(data)
        cut[at[:-1][at[:-1] < n]] = True
        cut[0] = True
        begin = np.flatnonzero(cut)
        bounds = np.append(begin, n).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(begin), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        counts = self.size[place]
        total = np.concatenate([[0], np.cumsum(counts)])
        take = np.arange(total[-1], dtype=np.int32)
        take += np.repeat(self.first[place] - total[:-1].astype(np.int32), counts)
        return self.ids[take], np.diff(total[np.searchsorted(begin, at)])

    @staticmethod
    def _cuts(data: np.ndarray) -> np.ndarray:
        """Where a piece may start: at a space after and before a character that's surely no white space,
        at punctuation after a letter, and at a line's end after punctuation."""
        n = len(data)
        cut = np.zeros(n, dtype=bool)
        if n < 3:
            return cut
        solid = data > 32
        cut[1:-1] = (data[1:-1] == 32) & solid[:-2] & solid[2:] & ~_WIDE_LEAD[data[2:]]
        near = np.flatnonzero(cut)
        high = near[data[near - 1] >= 0x80]
        cut[high[Encoder._wide_end(data, high)]] = False
        cut[1:] |= (_LETTER[data[:-1]] & _PUNCTUATION[data[1:]]) | (_PUNCTUATION[data[:-1]] & (data[1:] == 10))
        return cut

    @staticmethod
    def _wide_end(data: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the character beyond ASCII before each place may be white space."""
        return (data[np.maximum(end - 2, 0)] == 0xC2) | np.isin(data[np.maximum(end - 3, 0)], [0xE1, 0xE2, 0xE3])

    def _places(self, distinct: pa.StringArray) -> np.ndarray:
        """Where each of the pieces stands in the memory, into which the new ones go first."""
        data, at = text_bytes(distinct)
        h = hash_runs(data, at[:-1], at[1:])
        order = np.argsort(h)
        ascending = h[order]  # looked up in order, as neighbours then share what is read of the memory
        found = np.searchsorted(self.keys, ascending)
        known = self.keys[np.minimum(found, len(self.keys) - 1)] == ascending if len(self.keys) else np.zeros(len(h), dtype=bool)
        if not known.all():
            if len(self.keys) and len(self.keys) + np.count_nonzero(~known) > self.memory:
                self._forget()
                found, known = np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
            ids, size = self._encoded(distinct, order[~known], data, at)
            first = len(self.ids) + np.cumsum(size, dtype=np.int32) - size
            before = found[~known]
            self.keys = np.insert(self.keys, before, ascending[~known])
            self.first, self.size = np.insert(self.first, before, first), np.insert(self.size, before, size)
            self.ids = np.concatenate([self.ids, ids])
            found = found + np.cumsum(~known) - ~known  # as many new ones came in before
        place = np.empty(len(h), dtype=np.int64)
        place[order] = found
        return place

    def _encoded(self, distinct: pa.StringArray, which: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some pieces joined, and how many each has.

        Pieces that begin with a single space and end with a character that's surely no white space may stand one
        after another, as texts are cut there, so they are encoded some hundred at a time and told apart by how many
        bytes their tokens stand for.
        """
        start, end = at[:-1][which], at[1:][which]
        second, last = data[np.minimum(start + 1, len(data) - 1)], data[end - 1]
        plain = (data[start] == 32) & (end - start > 1) & (second > 32) & ~_WIDE_LEAD[second] & (last > 32)
        plain &= self.bytes_of is not None
        high = np.flatnonzero(plain & (last >= 0x80))
        plain[high[self._wide_end(data, end[high])]] = False
        size, parts, places = np.zeros(len(which), dtype=np.int32), [], []
        for own in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            for lo in range(0, len(own), 20_000):
                some = own[lo : lo + 20_000]
                got = self._joined(data, start[some], (end - start)[some]) if plain[some[0]] else None
                if got is None:
                    texts = distinct.take(pa.array(which[some])).to_pylist()
                    lists = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                    got = np.fromiter(chain.from_iterable(lists), dtype=np.uint32), np.fromiter(map(len, lists), dtype=np.int32, count=len(lists))
                parts.append(got[0])
                size[some] = got[1]
                places.append(some)
        ids = np.concatenate([np.zeros(0, dtype=np.uint32), *parts])
        took = np.concatenate([np.zeros(0, dtype=np.int64), *places])
        held = size[took].astype(np.int64)
        first = np.empty(len(which), dtype=np.int64)
        first[took] = np.cumsum(held) - held
        return ids[ragged(first, size)], size

    def _joined(self, data: np.ndarray, start: np.ndarray, width: np.ndarray, together: int = 200) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their numbers for pieces of given widths in bytes, encoded joined; none if tokens don't tell the pieces."""
        raw, bounds = data[ragged(start, width)].tobytes(), np.cumsum(width)
        cut = [0, *bounds[together - 1 : -1 : together].tolist(), len(raw)]
        lists = [x.ids for x in self.tokenizer.encode_batch_fast([raw[i:j].decode() for i, j in zip(cut, cut[1:], strict=False)], add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(lists), dtype=np.uint32)
        ends = np.cumsum(self.bytes_of[ids])
        last = np.searchsorted(ends, bounds)
        if not len(ends) or ends[-1] != bounds[-1] or (ends[last] != bounds).any():
            return None
        return ids, np.diff(last + 1, prepend=0).astype(np.int32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a file; made once, as a worker serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
