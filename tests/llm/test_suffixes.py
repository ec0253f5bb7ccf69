"""Suffix-array removal: texts longer than a segment, cut characters, a hot passage over many buckets."""

import numpy as np
import pytest

from siftwell.llm.suffixes import remove_repeats


def brute(texts, size=100):
    seen, out = set(), []
    for i, t in texts:
        b = t.encode()
        gone = np.zeros(len(b) + 1, dtype=np.int32)
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            if w in seen:
                gone[k] += 1
                gone[min(len(b), k + size)] -= 1
            seen.add(w)
        covered = np.cumsum(gone[:-1]) > 0
        out.append((i, len(b), int(covered.sum()), bytes(np.frombuffer(b, np.uint8)[~covered])))
    return out


def test_texts_longer_than_a_segment(spark):
    rng = np.random.default_rng(3)
    long = "".join(map(chr, rng.integers(97, 123, 700_000)))
    passage = long[262_000:262_400]  # over the end of a first segment of 2 ** 18 bytes
    rows = [(1, long[:300] + long), (2, "x" + passage + "y"), (3, long[500_000:640_000]), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in remove_repeats(docs).collect())
    assert found == brute([(i, t or "") for i, t in rows])


def test_halves_of_cut_characters_do_not_join(spark):
    rng = np.random.default_rng(4)
    a = "".join(map(chr, rng.integers(97, 123, 150)))
    # the third text's repeat begins in the middle of one character and ends in the middle of another
    rows = [(1, "é" + a), (2, a + "é"), (3, "pũ" + a + "ñq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in remove_repeats(docs, decode=True).collect()}
    raw = {r["doc_id"]: bytes(r["kept"]) for r in remove_repeats(docs).collect()}
    assert raw == {i: k for i, _, _, k in brute(rows)}
    assert raw[3].decode() == "pűq" and kept[3] == "pq"


def test_a_passage_that_most_texts_share(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = word(180)
    rows = [(i, word(int(rng.integers(0, 90))) + passage[: int(rng.integers(120, 181))] + word(int(rng.integers(0, 90)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for hot in (5, 20_000):
        found = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in remove_repeats(docs, bucket_rows=40, hot_rows=hot).collect())
        assert found == brute(rows)


def test_a_size_that_places_cannot_hold_is_refused(spark):
    from siftwell.llm.suffixes import MOST_SIZE, remove_repeats

    shared = "".join(chr(97 + i * i % 26) + str(i) for i in range(700))
    docs = spark.createDataFrame([(1, shared), (2, shared)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in remove_repeats(docs, size=MOST_SIZE).collect()) == [0, len(shared)]
    with pytest.raises(ValueError, match="286"):
        remove_repeats(docs, size=MOST_SIZE + 1)


def test_rows_find_their_bucket_among_many_splitters():
    """Splitters of which many share leading keys, against counting; the time hardly grows with their number."""
    import time

    from siftwell.llm.suffixes import bucket

    rng = np.random.default_rng(2)
    splitters = rng.integers(0, 4, (60, 3))
    splitters = splitters[np.lexsort(splitters.T[::-1])]
    rows = rng.integers(-1, 5, (500, 3))
    want = [sum(tuple(s) <= tuple(r) for s in splitters) for r in rows]
    assert bucket(list(rows.T), splitters).tolist() == want
    took = []
    for n in (200, 20_000):
        many = rng.integers(0, n, (n, 4))
        many = many[np.lexsort(many.T[::-1])]
        some = list(rng.integers(0, n, (10_000, 4)).T)
        began = time.perf_counter()
        for _ in range(5):
            bucket(some, many)
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0]
