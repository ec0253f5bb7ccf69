"""Packing: the program's gap and share, the histogram used up exactly, pieces against the library, the query."""

import zlib
from collections import Counter

import numpy as np
import pytest

from siftwell.llm.packing import best_fit_decreasing, fractional, pack, plan


def histograms():
    rng = np.random.default_rng(0)
    draws = {
        "wide": (100, rng.integers(1, 100, 3000)),
        "thirds": (512, rng.integers(80, 230, 8000)),
        "long-tailed": (512, np.clip(np.exp(rng.normal(4.5, 1, 20_000)).astype(int), 1, 512)),
        "one length": (64, np.full(1000, 31)),
        "a few": (64, rng.integers(1, 65, 7)),
    }
    return {k: (c, {int(a): int(b) for a, b in zip(*np.unique(x, return_counts=True), strict=True)}) for k, (c, x) in draws.items()}


@pytest.mark.parametrize("name", histograms())
def test_program(name):
    capacity, histogram = histograms()[name]
    found, bound = fractional({k: v for k, v in histogram.items() if k < capacity}, capacity)
    used = Counter()
    for config, x in found:
        assert sum(k * m for k, m in config.items()) <= capacity and x > 0
        for k, m in config.items():
            used[k] += m * x
    assert all(abs(used[k] - v) < 1e-6 * max(1, v) for k, v in histogram.items() if k < capacity)
    sequences = sum(x for _, x in found)
    # a bound that holds for whole sequences too, and a gap of a hundredth, or one sequence where there are few
    assert bound <= sequences + 1e-6 and sequences <= max(1.01 * bound, bound + 1.5)
    whole = plan(histogram, capacity)
    used = Counter()
    for config, n in whole:
        for k, m in config.items():
            used[k] += m * n
    assert used == histogram
    assert sum(n for _, n in whole) <= 1.005 * sum(n for _, n in best_fit_decreasing(histogram, capacity)) + 1
    if len(found) > 50:  # what the rounding leaves to best-fit is little
        share = sum(int(x + 1e-6) * sum(k * m for k, m in c.items()) for c, x in found) / sum(k * v for k, v in histogram.items() if k < capacity)
        assert share > 0.95


def pieces_of(ids, capacity):
    first = len(ids) % capacity or capacity
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def test_pieces_are_the_library_s(spark, docs):
    from tokenizers import Tokenizer

    from siftwell.llm.tokens import tokenizer_path

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    extra = spark.createDataFrame([(5000, "one two three " * 9000)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionAll(extra)
    want = {(r["doc_id"], *p) for r in rows.collect() for p in pieces_of([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0], 64)}
    found = pack(rows, capacity=64).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found} == want and len(found) == len(want)


def test_query(spark, docs, tmp_path):
    from siftwell.llm.queries import op6_pack

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = op6_pack(spark, str(tmp_path))
    assert found.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    rows = found.collect()
    total = Counter()
    for r in rows:
        total[r["sequence_id"]] += r["length"]
        assert r["offset"] + r["length"] <= 2048
    # as few as can be: every piece here is small
    assert len(total) == -(-sum(total.values()) // 2048)
