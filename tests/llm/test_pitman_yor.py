import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from siftwell.llm.common import mix
from siftwell.llm.pitman_yor import START, score_documents, seat, tokens

SCHEMA = "doc_id long, text string"


def one(x):
    return np.array([x])


def by_hand(texts, training, sweeps=4, kept=2):
    """Scores of texts (id: text) by dicts of every restaurant, whatever its words."""
    runs, count = {}, Counter()
    for k, text in texts.items():
        h = tokens(pa.array([text]))[0]
        runs[k] = list(zip([START, START, *h][: len(h)], [START, *h][: len(h)], h, strict=True))
        if k in training:
            count.update(runs[k])
    v = len({w for _, _, w in count})
    low = lambda n: float(np.clip(n.count(1) / max(n.count(1) + 2 * n.count(2), 1), 0.1, 0.95))
    kinds = Counter((u1, w) for _, u1, w in count)
    d = [low(list(Counter(w for _, w in kinds).values())), low(list(kinds.values())), low(list(count.values()))]
    t2, t1, t0 = Counter(), Counter(), Counter()
    scores = defaultdict(float)
    predicted = defaultdict(list)
    for i in range(sweeps):

        def state():
            c1, c0 = Counter(), Counter()
            cc2, tt2, cc1, tt1 = Counter(), Counter(), Counter(), Counter()
            for (u2, u1, w), n in count.items():
                c1[u1, w] += t2[u2, u1, w]
                cc2[u2, u1] += n
                tt2[u2, u1] += t2[u2, u1, w]
            for (u1, w), n in c1.items():
                c0[w] += t1[u1, w]
                cc1[u1] += n
                tt1[u1] += t1[u1, w]
            level = lambda c, t, cc, tt, d, p: (max(c - d * t, 0) + (1 + d * tt) * p) / (1 + cc)
            p0 = lambda w: level(c0[w], t0[w], sum(c0.values()), sum(t0.values()), d[0], 1 / (v + 1))
            p1 = lambda u1, w: level(c1[u1, w], t1[u1, w], cc1[u1], tt1[u1], d[1], p0(w))
            p2 = lambda u2, u1, w: level(count[u2, u1, w], t2[u2, u1, w], cc2[u2, u1], tt2[u2, u1], d[2], p1(u1, w))
            return tt2, tt1, sum(t0.values()), p0, p1, p2

        tt2, tt1, tt0, p0, p1, _ = state()
        draw = lambda w: mix(one(w) ^ mix(one(np.uint64(i))))  # noqa: E731, B023
        sit = lambda c, others, p, d, key: float(seat(one(float(c)), one(float(max(others, 0))), one(p), d, 1.0, key)[0])
        new2, new1, new0 = Counter(), Counter(), Counter()
        c1, c0 = Counter(), Counter()
        for (u2, u1, w), n in count.items():
            new2[u2, u1, w] = sit(n, tt2[u2, u1] - t2[u2, u1, w], p1(u1, w), d[2], mix(draw(w) + mix(mix(one(u1)) + one(u2))))
            c1[u1, w] += new2[u2, u1, w]
        for (u1, w), n in c1.items():
            new1[u1, w] = sit(n, tt1[u1] - t1[u1, w], p0(w), d[1], mix(draw(w) + mix(one(u1)) + np.uint64(1 << 32)))
            c0[w] += new1[u1, w]
        for w, n in c0.items():
            new0[w] = sit(n, tt0 - t0[w], 1 / (v + 1), d[0], mix(draw(w) + np.uint64(1 << 33)))
        t2, t1, t0 = new2, new1, new0
        if i >= sweeps - kept:
            p2 = state()[-1]
            for k, run in runs.items():
                predicted[k].append([p2(*x) for x in run])
    for k, p in predicted.items():
        scores[k] = float(np.log10(np.mean(p, axis=0)).sum())
    return scores


def prose(seed, n):
    """Texts whose words follow one another often enough for several customers at each table."""
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(60)]
    out = []
    for k in range(n):
        at, text = rng.randrange(60), []
        for _ in range(rng.randint(0, 60)):
            text.append(names[at])
            at = (at * 7 + rng.choice([1, 1, 1, 2, 3])) % 60 if rng.random() < 0.9 else rng.randrange(3)
        out.append((k, " ".join(text)))
    return out


@pytest.mark.parametrize("per_station", [1_000_000, 400, 60])
def test_scores_are_those_of_all_restaurants_however_they_are_dealt(spark, per_station):
    texts = prose(1, 60)
    docs = spark.createDataFrame(texts, SCHEMA).repartition(3)
    want = by_hand(dict(texts), {k for k, _ in texts if k % 5})
    got = {r["doc_id"]: r["score"] for r in score_documents(docs, F.col("doc_id") % 5 != 0, per_station=per_station).collect()}
    assert got == pytest.approx(dict(want), rel=1e-9)


def test_hot_words_and_pairs_are_dealt_out(spark):
    from siftwell.llm.pitman_yor import dealing

    rows = spark.createDataFrame([(k, t.replace(" ", " common word ")) for k, t in prose(1, 60)], "ord long, text string")
    z, _ = dealing(rows, 400)
    assert z.stations > 10 and {tokens(pa.array([w]))[0][0] for w in ("common", "word")} <= set(z.hot) and len(z.pairs)
    assert not len(dealing(rows, 1_000_000)[0].hot)


def test_rare_words_are_contexts_too(spark):
    """Three hundred rare pairs of words, each with a follower of its own, among 150 words that are more frequent."""
    rng = random.Random(2)
    filler = [f"f{i}" for i in range(150)]
    parts = [[f"a{i}", f"b{i}", f"c{i}"] for i in range(300)] * 3
    rng.shuffle(parts)
    texts = [(k, " ".join(w for part in parts[k::30] for w in [*rng.sample(filler, 6), *part])) for k in range(30)]
    texts += [(100, " ".join(f"f{i} f{i + 1} a{i} b{i} c{i}" for i in range(50))), (101, " ".join(f"f{i} f{i + 1} a{i} b{i} c{i + 1}" for i in range(50)))]
    docs = spark.createDataFrame(texts, SCHEMA).repartition(2)
    score = {r["doc_id"]: r["score"] for r in score_documents(docs, F.col("doc_id") < 100).collect()}
    assert score[100] - score[101] > 50 * math.log10(20)


def test_disk_holds_a_part_of_the_stations_at_a_time(spark, monkeypatch):
    """Stations are built by halves, and sums of a part of them are added up by block before they are stored."""
    from siftwell.llm import pitman_yor

    stored, write = {}, pitman_yor._stored

    def count(df, name):
        found, path = write(df, name)
        stored.setdefault(name, []).append({r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()})
        return found, path

    monkeypatch.setattr(pitman_yor, "_stored", count)
    texts = prose(1, 60)
    docs = spark.createDataFrame(texts, SCHEMA).coalesce(1)
    assert score_documents(docs, F.col("doc_id") % 5 != 0, per_station=200).count() == len(texts)
    built = [x.get(pitman_yor.STATION, 0) for x in stored["stations"]]
    assert sum(built) > 6 and max(built) <= -(-sum(built) // 2) + 1
    assert all(x == {pitman_yor.SUMS: 1} for x in stored["sums"])  # one block of texts


def test_frequent_words_are_those_from_a_count_on():
    from siftwell.llm.pitman_yor import _least

    assert _least([(1, 10), (7, 2), (3, 3)], 5) == 3 and _least([(1, 10), (7, 2), (3, 3)], 100) == 1 and _least([], 5) > 2**40


def test_blocks_of_a_batch_are_about_equal():
    from siftwell.llm.pitman_yor import _blocks

    batch = pa.record_batch({"ord": list(range(170)), "text": ["x" * 100] * 170})
    assert [x.num_rows for x in _blocks(batch, 10_000)] == [86, 84]
