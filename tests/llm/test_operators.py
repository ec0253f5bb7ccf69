"""Each operator against brute force on a small corpus, and on null, empty, repeated and long input."""

import hashlib
import math
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile("[^\x20\x09-\x0d]+")


def ordered(frame):
    """(doc_id, text) as operators order them: nulls first, then by id and text."""
    rows = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))


@pytest.fixture(scope="session", params=["docs", "odd"])
def any_docs(request):
    return request.getfixturevalue(request.param)


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    from siftwell.llm.tokens import Encoder, tokenizer_path

    texts = ["a  b", " a b ", "x 　y z", "", "a's b 's. 't", "\t q\n\ne", None, "é è", "a b c  d", "1 2 3", " ", "a..'s b.\n\nc,\n d;\n", "<|endoftext|> x"]
    encode = Encoder(tokenizer_path(), memory=8)
    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    for _ in range(2):
        ids, counts = encode(pa.array(texts))
        at = np.concatenate([[0], np.cumsum(counts)])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("memory", [50, 700_000])
def test_encoder_joins_pieces(memory):
    """Thousands of distinct pieces of all kinds, in batches, remembered or forgotten in between."""
    from tokenizers import Tokenizer

    from siftwell.llm.align import PieceEncoder
    from siftwell.llm.tokens import Encoder, tokenizer_path

    draw = np.random.default_rng(7)
    letters = [*"aeinrst", "é", "ß", "я", "日", "\u00a0", "\u2003", "\u3000", "¿", "'s", "1", "22", "#", ",", ".", "\t", "\n", " ", "<|endoftext|>", "😀"]
    chance = np.array([8.0] * 7 + [1.0] * (len(letters) - 7))
    words = ["".join(draw.choice(letters, size, p=chance / chance.sum())) for size in draw.integers(1, 9, 3000)]
    batches = [[" ".join(draw.choice(words, 40)) for _ in range(30)] for _ in range(4)]
    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    encode, pieces = Encoder(tokenizer_path(), memory=memory), PieceEncoder(tokenizer_path("piece_bpe_32k.model"), memory=memory)
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for texts in [*batches, batches[0]]:
        ids, counts = encode(pa.array(texts))
        at = np.concatenate([[0], np.cumsum(counts)])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        clean = [" " + re.sub(r"\W+", " ", t).strip() for t in texts]
        ids, counts = pieces(pa.array(clean))
        at = np.concatenate([[0], np.cumsum(counts)])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [model.encode(t[1:]) for t in clean]


def test_pairs_are_counted_as_by_numpy():
    from siftwell.llm.repair import _counted

    draw = np.random.default_rng(3)
    for n, symbols in ((0, 70_000), (1, 70_000), (1000, 40), (5000, 1 << 17), (5000, 1 << 26)):
        key = draw.integers(0, symbols, n) << 32 | draw.integers(0, min(symbols, 50), n)
        for found, right in zip(_counted(key, symbols), np.unique(key, return_inverse=True, return_counts=True), strict=True):
            assert (found == right).all()


def test_language(docs, none):
    from siftwell.llm.langid import fit, predict

    model = fit(docs.where("doc_id % 2 = 0"))
    found = {r["doc_id"]: r for r in predict(docs, model).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    sure = [r for r in rows if r["doc_id"] < 108 and len(r["text"]) > 100]
    assert np.mean([found[r["doc_id"]]["lang_pred"] == r["lang"] for r in sure]) > 0.9
    for r in rows:
        f = found[r["doc_id"]]
        assert 0 <= f["score"] <= 1 and (f["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or ""))
    assert fit(none) is None and predict(none, None).count() == 0
    assert {r["lang_pred"] for r in predict(docs, None).collect()} == {"und"}


def test_code_lengths_are_those_of_ppm(docs):
    from siftwell.llm.langid import Model, _grams

    train, order = b"abracadabra abrakadabra", 3
    grams = []
    for codes in _grams(np.frombuffer(train, np.uint8), np.array([0, len(train)]), order):
        values, n = np.unique(codes[codes > 0], return_counts=True)
        grams.append((values, n[:, None]))
    model = Model.build(["x"], grams, least=1)
    text = b"abrabra cadz"
    seen = [Counter(train[i : i + k] for i in range(len(train) - k + 1)) for k in range(1, order + 1)]

    total = 0.0
    for i in range(len(text)):
        esc = 0.0
        context = text[max(0, i - order + 1) : i]
        for k in range(len(context), -1, -1):
            c = context[len(context) - k :]
            after = {g: n for g, n in seen[k].items() if g[:k] == c}
            if not after:
                continue
            n, kinds = sum(after.values()), len(after)
            g = c + text[i : i + 1]
            if g in after:
                esc += math.log2(n + kinds) - math.log2(after[g])
                break
            esc += math.log2(n + kinds) - math.log2(kinds)
        else:
            esc += 8
        total += esc
    assert model.code_lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0, 0] == pytest.approx(total, rel=1e-5)


def test_pitman_yor(any_docs, none):
    from siftwell.llm.pitman_yor import score_documents

    fold = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    found = score_documents(any_docs, fold).collect()
    texts = ordered(any_docs)
    tokens = lambda t: [*WORD.findall(t.translate(LOW)), None]
    training = Counter(w for d, t in texts if d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(training.values()), len(training)
    want = sorted((d is not None, d or 0, len(w := tokens(t)), sum(training[x] > 0 for x in w), round(sum(math.log10((training[x] + 1) / (n + v + 1)) for x in w), 6)) for d, t in texts)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in found) == want
    assert {r["train_tokens"] for r in found} == {n} and all(r["score"] < 0 for r in found)
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)
    assert score_documents(none, fold).count() == 0


def test_predictions_add_up():
    from siftwell.llm.pitman_yor import Totals, _chance, seat

    counts = np.array([50.0, 7, 1, 1, 300])
    key = np.arange(5, dtype=np.uint64)
    parent = np.full(5, 0.2)
    tables = seat(counts, np.zeros(5), parent, 0.6, 1.0, key)
    assert np.all((tables >= 1) & (tables <= counts)) and np.array_equal(tables, seat(counts, np.zeros(5), parent, 0.6, 1.0, key))
    z = Totals(np.zeros(0, np.uint64), 5, 359, (0.6,) * 3, (1.0,) * 3, [np.array([counts.sum()])], [np.array([tables.sum()])])
    assert _chance(0, counts, tables, np.zeros(5, int), parent, z).sum() == pytest.approx(1)


def test_repair(any_docs, none):
    from tokenizers import Tokenizer

    from siftwell.llm.repair import Shard, encode_shard, round_trip
    from siftwell.llm.tokens import tokenizer_path

    plain = Tokenizer.from_file(tokenizer_path())
    start, want = 0, []
    for d, t in ordered(any_docs):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in round_trip(any_docs, shard_ids=300, part_rows=8).collect()), key=lambda r: r[1])
    assert got == want
    assert round_trip(none).count() == 0
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.tile(rng.integers(0, 50, 40), 30), np.zeros(500, int), rng.integers(0, 60_000, 200)])
    payload = encode_shard(ids, np.arange(2), np.array([1000, len(ids)]), 65_536)
    shard = Shard(payload)
    assert np.array_equal(shard.ids(0, shard.size), ids) and np.array_equal(shard.document(1), ids[1000:]) and len(shard.sequence) < len(ids) / 3
    for a, b in rng.integers(0, len(ids), (50, 2)):
        assert np.array_equal(shard.ids(min(a, b), max(a, b)), ids[min(a, b) : max(a, b)])
    with pytest.raises(ValueError):
        Shard(b"x" * 60)


def test_repair_leaves_no_pair_that_occurs_twice():
    from siftwell.llm.repair import Shard, compress, encode_shard

    rng = np.random.default_rng(4)
    twice = rng.integers(0, 60_000, 400)
    cases = [np.concatenate([twice, rng.integers(0, 60_000, 900), twice]), rng.integers(0, 5, 3000), np.zeros(1001, int), np.tile([1, 2, 3], 7), np.array([7, 7, 7]), np.zeros(0, int), np.concatenate([np.tile(rng.integers(0, 99, 60), 9), rng.integers(0, 9, 500)]), rng.zipf(1.3, 1_500_000) % 60_000]
    for ids in cases:
        _, rest = compress(ids, 65_536)
        last: dict[tuple[int, int], int] = {}
        for i, pair in enumerate(zip(rest.tolist(), rest[1:].tolist(), strict=False)):
            assert i - last.setdefault(pair, i) < 2
        shard = Shard(encode_shard(ids, np.arange(1), np.array([len(ids)]), 65_536))
        assert np.array_equal(shard.ids(0, len(ids)), ids)
    assert len(compress(cases[0], 65_536)[1]) < 905


def test_repair_is_smaller_than_plain_ids_and_refuses_ids_that_are_symbols():
    from siftwell.llm.repair import Shard, compress, encode_shard

    rng = np.random.default_rng(6)
    phrases = [rng.integers(0, 50_000, rng.integers(2, 9)) for _ in range(300)]
    ids = np.concatenate([phrases[min(int(i), 299)] for i in rng.zipf(1.2, 20_000)])
    sizes = {k: len(encode_shard(ids, np.arange(1), np.array([len(ids)]), 65_536, k)) for k in (2, 4)}
    assert max(sizes.values()) < len(ids)  # half of two bytes an id
    _, rest = compress(ids, 65_536, 4)
    pairs: dict[tuple[int, int], list[int]] = {}
    for i, pair in enumerate(zip(rest.tolist(), rest[1:].tolist(), strict=False)):
        if not pairs.get(pair) or i - pairs[pair][-1] > 1:
            pairs.setdefault(pair, []).append(i)
    assert max(map(len, pairs.values())) < 4
    shard = Shard(encode_shard(ids, np.arange(1), np.array([len(ids)]), 65_536, 4))
    for a, b in rng.integers(0, len(ids), (200, 2)):
        assert np.array_equal(shard.ids(min(a, b), max(a, b)), ids[min(a, b) : max(a, b)])
    with pytest.raises(ValueError, match="70000"):
        encode_shard(np.array([1, 70_000]), np.arange(1), np.array([2]), 65_536)


def test_repair_reads_documents_by_random_access(spark, any_docs):
    from tokenizers import Tokenizer

    from siftwell.llm.common import shared_dir
    from siftwell.llm.repair import read_documents, write_ids
    from siftwell.llm.tokens import tokenizer_path

    plain = Tokenizer.from_file(tokenizer_path())
    path = shared_dir(spark, "ids")
    write_ids(any_docs, path, shard_ids=300, part_rows=8)
    rows = [(d, [*plain.encode(t, add_special_tokens=False).ids, 0]) for d, t in ordered(any_docs)]
    wanted = [0, 6, 33, 90, 12345]
    assert sorted((r["doc_id"], r["ids"]) for r in read_documents(spark, path, wanted).collect()) == sorted((d, x) for d, x in rows if d in wanted)
    assert read_documents(spark, path, []).count() == 0


def test_templates(spark, docs, odd, none):
    from siftwell.llm.templates import contaminated

    bench = spark.createDataFrame([(1, "If Anna buys 12 apples at 3 dollars each and sells 5 of the apples, what does she keep?"), (2, "short one here now"), (3, None), (4, "")], "item_id long, text string")
    rows = [
        (1, "Intro text. If Anna buys 12 apples at 3 dollars each and sells 5 of the apples, what does she keep? More."),
        (2, "So: If Berta buys 40 apples at 9 dollars each and sells 7 of the apples, what does she keep?"),
        (3, "If Anna buys pears at a market and sells most of them, what does she keep of it?"),
        (4, "this is a short one here now and then"),
        (5, None),
        (6, ""),
    ]
    found = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    want = {(1, 1, True), (2, 1, False), (4, 2, True)}
    assert {(r["doc_id"], r["item_id"], r["verbatim"]) for r in found.collect()} == want
    far = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, broadcast_windows=0)
    assert {(r["doc_id"], r["item_id"], r["verbatim"]) for r in far.collect()} == want
    assert contaminated(docs, bench).count() == 0 and contaminated(odd, bench).count() == 0 and contaminated(none, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_slots_must_agree():
    from siftwell.llm.templates import longest

    row = lambda i, a, b: {"place": i, "width": 8, "values": a, "item_values": b}
    assert longest([row(0, [1, 0, 1], [5, 0, 5]), row(1, [0, 1, 2], [0, 5, 6])], 9) == (9, False)
    assert longest([row(0, [1, 0, 1], [5, 0, 5]), row(1, [0, 1, 2], [0, 6, 7])], 9) is None
    assert longest([row(0, [1, 0, 2], [5, 0, 5])], 8) is None


def test_templates_dense_in_slots(spark):
    from siftwell.llm.templates import contaminated

    dense = "Anna bought 3 kg rice, Bob bought 5 kg beans, Carl bought 7 kg oats and Dora bought 2 kg salt."
    title = "The Seven Oldest Bridges Of Northern Europe And The People Who Built Them By Hand"
    numbers = "3 9 27 81 243 729 2187 6561 19683 59049 177147 531441 1594323 4782969"
    bench = spark.createDataFrame([(1, dense), (2, title), (3, numbers), (4, "Paris London Rome Berlin")], "item_id long, text string")
    rows = [
        (1, f"Some words. {dense} More words."),
        (2, "Anna bought 8 lb rice, Emil bought 6 lb beans, Fritz bought 4 lb oats and Gerd bought 9 lb salt."),
        (3, f"Read this. {title} and so on"),
        (4, f"the powers {numbers} end"),
        (5, "The Best Hotels In Southern Asia For Families That Travel With Small Children Every Single Year"),
        (6, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20"),
        (7, "Here: Paris London Rome Berlin. Then: Oslo Madrid Vienna Prague."),
        (8, "Oslo Madrid Vienna Prague"),
    ]
    found = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {(r["doc_id"], r["item_id"], r["n_tokens"], r["verbatim"]) for r in found.collect()} == {(1, 1, 21, True), (2, 1, 21, False), (3, 2, 15, True), (4, 3, 14, True), (7, 4, 4, True)}


def test_stretch_starts_behind_the_slot_that_conflicts():
    from siftwell.llm.templates import longest

    own, item = [9] + [0] * 11 + [7] + [0] * 4, [5] + [0] * 11 + [5] + [0] * 4
    found = [{"place": i, "width": 8, "values": own[i : i + 8], "item_values": item[i : i + 8]} for i in range(10)]
    assert longest(found, 13) == (16, False)


def test_fingerprints(any_docs, none):
    from siftwell.llm.cws import fingerprints

    texts = ordered(any_docs)
    want, jaccard = [], {}
    for (d, t), (_, u) in zip(texts, [*texts[1:], texts[0]], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        want.append((d is not None, d or 0, len(t), hashlib.sha256(e.encode()).hexdigest()))
        a, b = (Counter(re.split(r"[\x09-\x0d ]+", x.lower())) for x in (t, e))
        a.pop("", None), b.pop("", None)
        jaccard[(d, len(t))] = sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
    found = fingerprints(any_docs, samples=64, rows=5).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in found) == sorted(want)
    error = [r["near_edited"] - jaccard[(r["doc_id"], r["n_chars"])] for r in found]
    assert abs(np.mean(error)) < 0.05 and np.std(error) < 0.12
    by_text = {}
    for (d, t), r in zip(texts, sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)), strict=True):
        if sum(x == d for x, _ in texts) == 1:
            by_text.setdefault(t, set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprints(none).count() == 0 and fingerprints(any_docs.where("doc_id = 3")).first()["near_next"] == 1.0


def test_packing(any_docs, none):
    from siftwell.llm.packing import best_fit_decreasing, pack, plan

    found = pack(any_docs, capacity=64).collect()
    by = {}
    for r in found:
        assert 1 <= r["length"] <= 64
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= math.ceil(sum(r["length"] for r in found) / 64) * 1.05 + 1
    assert len({(r["doc_id"], r["piece"]) for r in found if r["piece"] == 0}) == len({d for d, _ in ordered(any_docs)})
    assert pack(none).count() == 0
    rng = np.random.default_rng(0)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 100, 3000), return_counts=True), strict=True)}
    for solver in (best_fit_decreasing, plan):
        used = Counter()
        for config, n in solver(histogram, 100):
            assert sum(k * m for k, m in config.items()) <= 100
            for k, m in config.items():
                used[k] += m * n
        assert used == histogram


def brute_spans(texts, run, least):
    seen, out = set(), []
    for d, t in texts:
        heads = []
        last = None
        for m in WORD.finditer(t):
            if last is None or last.group()[-1] in ".!?" or "\n" in t[last.end() : m.start()]:
                heads.append([m.start(), m.end(), 0])
            heads[-1][1] = m.end()
            heads[-1][2] += 1
            last = m
        gone = [False] * len(heads)
        for i in range(len(heads) - run + 1):
            if sum(h[2] for h in heads[i : i + run]) >= least:
                key = tuple(t[a:b].translate(LOW) for a, b, _ in heads[i : i + run])
                if key in seen:
                    gone[i : i + run] = [True] * run
                seen.add(key)
        kept = t[: heads[0][0]] if heads else t
        for i, h in enumerate(heads):
            kept += "" if gone[i] else t[h[0] : heads[i + 1][0] if i + 1 < len(heads) else len(t)]
        out.append((d is not None, d or 0, len(heads), sum(gone), kept))
    return sorted(out)


def test_spans(any_docs, none):
    from siftwell.llm.spans import remove_spans

    found = remove_spans(any_docs, bucket_rows=40).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_sentences"], r["n_removed"], r["kept"]) for r in found) == brute_spans(ordered(any_docs), 2, 12)
    assert any(r["n_removed"] for r in found) and remove_spans(none).count() == 0


def test_passages(spark, any_docs, none, tmp_path):
    import random

    from siftwell.llm.queries import op7_spans
    from siftwell.llm.spans import remove_spans

    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "tu", "sch", "th", "er"]) for _ in range(5))
    some = lambda n: " ".join(word() for _ in range(n))
    verse = "\n".join(some(4) for _ in range(15))
    long = some(60)
    middle = f"{some(24)}. {some(9)}. {some(24)}"
    texts = [verse, f"{some(5)}.\n{verse}\n{some(5)}.", f"{long}.", f"{some(20)} {long} {some(20)}.", f"{some(8)} {middle} {some(8)}.", f"{some(15)} {middle} {some(3)}.", f"{some(300)}. {some(4)}.", "a " * 200]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in op7_spans(spark, str(tmp_path)).collect()}
    assert found[1]["n_removed"] == 15 and not set(verse.split()) & set(found[1]["kept"].split())
    for i, passage, around in ((3, long, 40), (5, middle, 18)):
        kept = found[i]["kept"].split()
        own = set(texts[i].split()) - set(passage.split())
        assert len(set(kept) & set(passage.split())) <= 30 and len(kept) < around + 30 and len(own & set(kept)) >= around - 2
    assert all(found[i]["kept"] == texts[i] and found[i]["n_removed"] == 0 for i in (0, 2, 4, 6))
    assert len(found[7]["kept"].split()) < 24
    # all that is removed without passages is removed with them, too
    key = lambda r: (r["ord"], r["doc_id"])
    with_, without = ({key(r): r["kept"] for r in remove_spans(any_docs, bucket_rows=40, passages=p).collect()} for p in (True, False))
    assert with_.keys() == without.keys() and all(len(with_[k]) <= len(without[k]) for k in with_)
    assert remove_spans(none, passages=True).count() == 0


def brute_bytes(texts, size):
    seen, out = set(), []
    for d, t in texts:
        b = t.encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = True
            seen.add(w)
        edges = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((d is not None, d or 0, len(b), int(gone.sum()), edges, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffixes(any_docs, none, hot):
    from siftwell.llm.suffixes import remove_repeats

    found = remove_repeats(any_docs, bucket_rows=50, hot_rows=hot).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in found) == brute_bytes(ordered(any_docs), 100)
    assert remove_repeats(none).count() == 0


def test_multikey_order_and_buckets():
    from siftwell.llm.suffixes import bucket, multikey_order

    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 4, 500) for _ in range(3)]
    order = multikey_order(columns)
    assert [tuple(c[i] for c in columns) for i in order] == sorted(zip(*columns, strict=True))
    splitters = np.unique(rng.integers(0, 4, (20, 3)), axis=0)
    want = [sum(tuple(s) <= row for s in map(tuple, splitters)) for row in zip(*columns, strict=True)]
    assert bucket(columns, splitters).tolist() == want


def brute_links(texts):
    sets = []
    for _, t in texts:
        w = WORD.findall(t.translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least.setdefault(find(i), d)
    return sorted((d is not None, d or 0, len(sets[i]), -1 if (c := least.get(find(i))) is None else c) for i, (d, _) in enumerate(texts))


def test_jaccard(any_docs, none):
    from siftwell.llm.jaccard import link

    found = link(any_docs).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in found) == brute_links(ordered(any_docs))
    assert link(none).count() == 0


def test_jaccard_near_the_threshold(spark):
    from siftwell.llm.jaccard import link

    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = []
    for i in range(60):
        w = list(base)
        for p in rng.integers(0, 300, rng.integers(0, 14)):
            w[p] = f"e{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w[: 300 - int(rng.integers(0, 40))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = link(docs).collect()
    assert sorted((True, r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_links(rows)


def test_components(spark):
    from siftwell.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 205), (205, 201)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 200: 200, 201: 200, 205: 200}


def test_weak_labels(spark, odd, none):
    from siftwell.llm.weak_labels import LabelModel, classify

    rng = np.random.default_rng(4)
    words = [f"w{x}" for x in rng.integers(0, 900, 4000)]
    good = [" ".join(words[i : i + 60]) + "." for i in range(0, 3000, 60)]
    bad = [" ".join(w + "###" for w in words[i : i + 60]) for i in range(0, 600, 60)] + ["the the the the the " * 20, "AAA BBB CCC!! " * 30]
    rude = [good[i] + " You idiot, you pathetic scum." for i in range(6)]
    rows = [(i, t) for i, t in enumerate([*good, *bad, *rude, "", None])]
    found, models = classify(spark.createDataFrame(rows, "doc_id long, text string"))
    keep = {r["doc_id"]: r["keep"] for r in found.collect()}
    assert all(keep[i] for i in range(len(good))) and not any(keep[i] for i in range(len(good), len(rows)))
    assert np.all(models["form"].accuracies() > 0.6)
    assert classify(odd)[0].count() == odd.count() and classify(none)[0].count() == 0
    patterns = np.array([[0, 0], [1, 1], [2, 2]])
    p = LabelModel.fit(patterns, np.array([90.0, 10.0, 5.0])).posterior(patterns)
    assert p[0] < 0.1 and p[1] > 0.9 and 0 < p[2] < 0.5


def test_pipeline(spark, docs, odd, none, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(1, "the of and to in that it is was for on with as his they be")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = spark.createDataFrame([(9000, "Now the of and to in that it is was for on with as his they be again"), (9001, "clean words that stand alone here")], "doc_id long, text string")
    docs = docs.unionByName(leak, allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = ordered(docs)
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {d: t for d, t in ordered(now)} if "text" in now.columns else {}
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == docs.columns
            now.write.parquet(f"{tmp_path}/s{k}")
            now = spark.read.parquet(f"{tmp_path}/s{k}")
            after = dict(ordered(now))
        if k == 0:
            assert set(after) == {d for d, t in texts if re.search(r"[^\W\d_]", t)}
        if k == 1:
            linked = {r[1]: r[3] for r in brute_links(sorted(before.items()))}
            assert set(after) == {d for d in before if linked[d] == d}
        if k == 2:
            want = {r[1]: r[5].decode("utf-8", "ignore") for r in brute_bytes(sorted(before.items()), 100)}
            # without the halves of cut characters, of which only runs of e with an accent can give some here
            assert {d: t.replace("é", "") for d, t in after.items()} == {d: t.replace("é", "") for d, t in want.items() if t}
        if k == 3:
            assert set(before) - set(after) == {9000} and 9001 in after
    assert {r["doc_id"] for r in now.collect()} == set(after)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, none, str(tmp_path)).count() == 0 and stage(spark, odd, str(tmp_path)).count() >= (0 if k == 3 else 1)
