import random

import numpy as np
import pyarrow as pa
import pytest
from siftwell.llm.common import mix, text_bytes
from siftwell.llm.pitman_yor import seat
from siftwell.llm.templates import contaminated, template


def tables_of(n, others, parent, d, a):
    """Chances of 0, 1, ... tables of a dish's n customers, who sit down one after another."""
    p = np.zeros(n + 2)
    p[1] = 1.0
    t = np.arange(n + 2)
    for seated in range(1, n):
        new = (a + d * (others + t)) * parent
        q = np.where(t <= seated, new / (new + np.maximum(seated - d * t, 0)), 0)
        p = p * (1 - q) + np.append(0, (p * q)[:-1])
    return p


@pytest.mark.parametrize("n, others, parent, d, slack", [(1, 5, 0.1, 0.7, 0), (12, 40, 0.02, 0.7, 0), (60, 0, 0.3, 0.5, 0), (200, 1000, 0.001, 0.8, 0), (1000, 300, 0.01, 0.6, 0.01), (4000, 5000, 0.002, 0.7, 0.01)])
def test_seatings_have_the_restaurant_s_distribution(n, others, parent, d, slack):
    want = tables_of(n, others, parent, d, 1.0)
    assert want.sum() == pytest.approx(1)
    t = np.arange(len(want))
    mean, sd = float(want @ t), float(np.sqrt(max(want @ t**2 - (want @ t) ** 2, 0)))
    draws = 8000
    got = seat(np.full(draws, float(n)), np.full(draws, float(others)), np.full(draws, parent), d, 1.0, mix(np.arange(draws, dtype=np.uint64)))
    print(n, mean, got.mean(), sd, got.std())
    assert got.min() >= 1 and got.max() <= n
    assert abs(got.mean() - mean) <= slack * mean + 4 * sd / np.sqrt(draws)
    assert abs(got.std() - sd) <= 0.1 * sd
    if n < 256:  # one by one: the whole distribution
        seen = np.bincount(got.astype(int), minlength=len(want)) / draws
        assert np.abs(seen - want).sum() < 0.08


WORDS = ["apples", "buy", "costs", "each", "how", "many", "of", "the"]


def sentence(rng, n):
    return [rng.choice([*WORDS, "Anna", "Bob", "Carl", "3", "5", "7", "12"]) for _ in range(n)]


def brute(doc, item):
    """The longest stretch that both share with slots one to one: (tokens, whether all are equal)."""
    (dt, dh), (it, ih) = doc, item
    slot = lambda t, words: t not in words
    plain = set(np.unique(np.concatenate([template(*text_bytes(pa.array([w])))[0] for w in WORDS])).tolist())
    need, same = min(13, len(it)), (min(8, len(it)) + 1) // 2
    best = None
    for i in range(len(dt)):
        for j in range(len(it)):
            there, back, equal, k = {}, {}, 0, 0
            while i + k < len(dt) and j + k < len(it) and dt[i + k] == it[j + k]:
                if slot(dt[i + k], plain):
                    a, b = dh[i + k], ih[j + k]
                    if there.setdefault(b, a) != a or back.setdefault(a, b) != b:
                        break
                    equal += a == b
                else:
                    equal += 1
                k += 1
                if k >= need and equal >= same and (best is None or (k, bool(equal == k)) > best):
                    best = (k, bool(equal == k))
    return best


def test_templates_against_brute_force(spark):
    rng = random.Random(4)
    items = [sentence(rng, n) for n in (3, 5, 9, 14, 20, 26, 26)]
    docs = []
    for _ in range(60):
        item = rng.choice(items)
        swap = {x: rng.choice(["Dora", "Emil", "Bob", "8", "3", "40"]) for x in ("Anna", "Bob", "Carl", "3", "5", "7", "12")}
        swap = {k: v if v[0].isdigit() == k[0].isdigit() else k for k, v in swap.items()}
        told = [swap.get(x, x) if rng.random() < 0.9 else x for x in item]
        cut = rng.randrange(0, max(1, len(told) - 4)) if rng.random() < 0.4 else 0
        docs.append(sentence(rng, rng.randrange(6)) + told[cut:] + sentence(rng, rng.randrange(6)))
    docs += [[], ["the"], items[4] + items[4], items[5] + items[3]]
    read = lambda words: [x.tolist() for x in template(*text_bytes(pa.array([" ".join(words)])))[:2]]
    want = {(i, j): m for i, d in enumerate(docs) for j, t in enumerate(items) if len(read(t)[0]) >= 4 and (m := brute(read(d), read(t)))}
    found = contaminated(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(items)], "item_id long, text string")).collect()
    assert len(want) > 20 and {(r["doc_id"], r["item_id"]): (r["n_tokens"], r["verbatim"]) for r in found} == want
