import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siftwell.llm.align import align, byte_level_tokens, count_links, digest, overlaps, pair_bound, piece_tokens
from siftwell.llm.common import written
from siftwell.llm.tokens import tokenizer_path


@pytest.fixture(scope="module")
def by_hand():
    """A text's A and B ids from the libraries themselves, and the groups and links by a walk over both."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(tokenizer_path()), SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    a_bytes, b_bytes = byte_level_tokens(tokenizer_path()), piece_tokens(tokenizer_path("piece_bpe_32k.model"))

    def walk(text):
        if not text:
            return [], [], [], []
        x, y, whole = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        if b"".join(a_bytes[i] for i in x) != whole or b"".join(b_bytes[i] for i in y) != whole:
            return [], [], [], []
        ends_a, ends_b = (list(np.cumsum([len(t[i]) for i in ids])) for t, ids in ((a_bytes, x), (b_bytes, y)))
        links = [(i, j) for e in sorted(set(ends_a) & set(ends_b)) for i, p in zip(x, ends_a, strict=True) if p == e for j, q in zip(y, ends_b, strict=True) if q == e]
        groups, lo = [], 0
        for e in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(str(i) for i, p in zip(x, ends_a, strict=True) if lo < p <= e) + "|" + ",".join(str(i) for i, p in zip(y, ends_b, strict=True) if lo < p <= e))
            lo = e
        return x, y, groups, links

    return walk


ODD = ["a  b   c", "  lead", "trail ", " ", "   ", "\n\tx\r\n", "<s>hi</s><|endoftext|><unk>", "▁ under", "x▁y z", "é ﬁ ½ １２", "\U0001f600 \U0001f468‍\U0001f469", "\x00\x01", "a b　c", "12345 6.7e-8", "don't  stop!!  #$%", "ſ İ ẞ", "﻿bom", "x" * 3000, "日本語のテキスト です"]


def expected(rows, walk):
    walked = [walk(t) for _, t in rows]
    count = Counter(p for w in walked for p in w[3])
    best = {}
    for (_, j), n in count.items():
        best[j] = max(n, best.get(j, 0))
    out = []
    for (i, _), (x, y, groups, links) in zip(rows, walked, strict=True):
        out.append((i, len(x), len(y), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("held", [8_000_000, 0])
def test_against_a_walk_over_both_token_lists(spark, odd, by_hand, held):
    rng = random.Random(3)
    mixed = ["".join(rng.choice(["a", " ", "  ", "é", "the ", "\n", "9", "▁", "本", "'s", "-"]) for _ in range(40)) for _ in range(150)]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate([*ODD, *mixed])], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more).repartition(4)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found, _ = written(digest(align(docs)), "aligned")
    got = count_links(found, held_pairs=held).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows, by_hand)


def test_registered_query(spark, docs, by_hand, tmp_path):
    from siftwell.llm.queries import QUERIES

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op12_align"](spark, str(tmp_path))
    assert found.columns[:8] == COLUMNS
    assert sorted(map(tuple, found.select(COLUMNS).collect()), key=repr) == expected([(r["doc_id"], r["text"]) for r in docs.collect()], by_hand)


def test_groups_are_texts_that_can_be_read(spark):
    row = align(spark.createDataFrame([(1, "unbelievable things")], "doc_id long, text string")).first()
    a, b = byte_level_tokens(tokenizer_path()), piece_tokens(tokenizer_path("piece_bpe_32k.model"))
    halves = [g.split("|") for g in bytes(row["groups"]).decode().split(";")]
    assert all(b"".join(a[int(i)] for i in x.split(",")) == b"".join(b[int(i)] for i in y.split(",")) for x, y in halves)
    assert b"".join(a[int(i)] for x, _ in halves for i in x.split(",")) == b" unbelievable things"


def test_overlaps_are_found_by_bisection():
    a_at, a_end, b_at, b_end = (np.array(x) for x in ([0, 3, 4], [3, 4, 9], [0, 2, 6], [2, 6, 9]))
    first, last = overlaps(a_at, a_end, b_at, b_end)
    assert first.tolist() == [0, 1, 1] and last.tolist() == [2, 2, 3]


def test_pairs_are_bounded_by_the_vocabularies():
    assert pair_bound([b"ab", b"b", b"c"], [b"b", b"xb", b"cc"]) == 1 + 1 + 1 + 1
    assert pair_bound(byte_level_tokens(tokenizer_path()), piece_tokens(tokenizer_path("piece_bpe_32k.model"))) < 8_000_000


def test_no_rows(spark, none):
    found, _ = written(digest(align(none)), "aligned")
    assert count_links(found).count() == 0
