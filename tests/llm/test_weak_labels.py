import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from siftwell.llm.common import text_bytes
from siftwell.llm.weak_labels import BAD, GOOD, NOTHING, SIZES, LabelModel, classify, learn, vote

DATA = "/root/testdata/sf0.1"


def objective(rows, bad, votes):
    """Log posterior of a label model, row by row; votes[class][labeller] is the chance of a bad vote."""
    out = LabelModel.TEXTS[0] * math.log(bad) + (LabelModel.TEXTS[1] - LabelModel.TEXTS[0]) * math.log(1 - bad)
    for c in (0, 1):
        out += sum(LabelModel.PRIOR[c][1] * math.log(v) + LabelModel.PRIOR[c][0] * math.log(1 - v) for v in votes[c])
    for row in rows:
        chance = [1 - bad, bad]
        for c in (0, 1):
            for k, x in enumerate(row):
                chance[c] *= 1.0 if x == NOTHING else votes[c][k] if x == BAD else 1 - votes[c][k]
        out += math.log(sum(chance))
    return out


def drawn(rng, n, bad, votes, silent=0.2):
    rows = []
    for _ in range(n):
        c = int(rng.random() < bad)
        rows.append((c, tuple(NOTHING if rng.random() < silent else BAD if rng.random() < votes[c][k] else GOOD for k in range(len(votes[0])))))
    return rows


def fitted(rows):
    counts = Counter(v for _, v in rows)
    patterns = np.array(list(counts))
    return LabelModel.fit(patterns, np.array(list(counts.values()), dtype=float)), patterns, np.array(list(counts.values()), dtype=float)


def test_no_step_from_the_estimates_is_more_likely():
    true = [[0.02, 0.05, 0.01, 0.1], [0.8, 0.6, 0.35, 0.9]]
    rows = drawn(random.Random(3), 1500, 0.15, true)
    model, _, _ = fitted(rows)
    only = [v for _, v in rows]
    votes = model.votes[:, :, BAD].tolist()
    best = objective(only, model.bad, votes)
    for step in (-0.003, 0.003):
        assert objective(only, model.bad + step, votes) < best
        for c in (0, 1):
            for k in range(4):
                moved = [list(x) for x in votes]
                moved[c][k] += step
                if 0 < moved[c][k] < 1:
                    assert objective(only, model.bad, moved) < best


def test_accuracies_of_simulated_labellers_are_found():
    true = [[0.02, 0.05, 0.01, 0.1, 0.003], [0.8, 0.6, 0.35, 0.9, 0.15]]
    rows = drawn(random.Random(5), 20000, 0.1, true)
    model, patterns, counts = fitted(rows)
    assert model.bad == pytest.approx(0.1, abs=0.01)
    assert np.abs(model.votes[:, :, BAD] - np.array(true)).max() < 0.04
    assert np.abs(model.dependence(patterns, counts)).max() < 0.1 and model.weight.min() > 0.8
    p = model.posterior(np.array([v for _, v in rows]))
    truth = np.array([c for c, _ in rows])
    for low, high in ((0.05, 0.3), (0.3, 0.7), (0.7, 0.95)):  # posteriors are chances
        some = (p > low) & (p < high)
        if some.sum() > 100:
            assert truth[some].mean() == pytest.approx(p[some].mean(), abs=0.12)


def test_two_labellers_with_one_voice_count_less():
    rng = random.Random(6)
    rows = drawn(rng, 6000, 0.2, [[0.02] * 4, [0.7, 0.7, 0.7, 0.7]], silent=0)
    rows = [(c, (*v, v[0])) for c, v in rows]
    model, patterns, counts = fitted(rows)
    found = model.dependence(patterns, counts)
    others = [abs(found[k, j]) for k in range(5) for j in range(k) if (k, j) != (4, 0)]
    assert found[0, 4] > 0.9 and max(others) < 0.4  # the class itself leans to the doubled voice
    assert model.weight[[0, 4]].max() < model.weight[1:4].min()


def plain_words(text):
    trimmed = (re.sub(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", b"", w) for w in re.findall(rb"[^\x20\x09-\x0d]+", text.encode()))
    return [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in trimmed if w]


def grams(word, end):
    return {word[-k:] if end else word[:k] for k in SIZES if len(word) >= k}


def brute_lexicons(rows):
    out = []
    for end in (False, True):
        bad, n = Counter(), Counter()
        for text, h, toxic in rows:
            if h & 1 == end:
                found = set().union(*(grams(w, end) for w in plain_words(text)), set())
                n.update(found)
                bad.update(found if toxic else ())
        share = {g: (bad[g] + 0.5) / (n[g] + 1) for g in n}
        chosen = {g for g, p in share.items() if n[g] >= 4 and p - 2 * math.sqrt(p * (1 - p) / (n[g] + 1)) > 0.5}
        rate = []
        for y in (0, 1):
            ws = [w for text, h, toxic in rows if h & 1 != end and toxic == y for w in plain_words(text)]
            rate.append((sum(bool(grams(w, end) & chosen) for w in ws) + 0.5) / (len(ws) + 1))
        out.append((end, chosen, rate))
    return out


def test_lexicons_and_votes_against_plain_counting(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ba", "ke", "Lo", "mi", "tu", "é", "x"]) for _ in range(rng.randint(1, 5)))
    rows = []
    for i in range(240):
        toxic = int(rng.random() < 0.3)
        ws = [word() for _ in range(rng.randint(5, 60))]
        for _ in range(rng.randint(1, 3) if toxic else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(["Grobiankerl!", "(rüpelhaftes", "lumpenkerl", "GROBIANxyz,"]))
        rows.append((" ".join(ws), i * 7919 ^ rng.getrandbits(3), toxic))
    rows += [("", 1, 0), ("!!! ---", 2, 1), ("x" * 50_000, 3, 0)]
    found = learn(spark.createDataFrame(rows, "text string, h long, toxic int").repartition(3))
    want = brute_lexicons(rows)
    number = lambda g: int.from_bytes(g.ljust(8, b"\0"), "little", signed=True)
    for lexicon, (end, chosen, rate) in zip(found, want):
        assert lexicon.end == end and len(chosen) > 3
        assert lexicon.grams.tolist() == sorted(map(number, chosen))
        assert [lexicon.other, lexicon.abusive] == pytest.approx(rate)
    _, abuse, _ = vote(*text_bytes(pa.array([r[0] for r in rows])), found)
    for i, (text, _, _) in enumerate(rows):
        ws = plain_words(text)
        for k, (end, chosen, (low, high)) in enumerate(want, 1):
            ratio = sum(bool(grams(w, end) & chosen) for w in ws) * math.log(high / low) - len(ws) * (high - low)
            assert abuse[i, k] == (BAD if ratio > 1 else GOOD if ratio < -1 else NOTHING)


def test_odd_labels(spark, odd, none):
    said = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (3, None), (6, 0), (10**9, 1)], "doc_id long, toxic int")
    for labels in (said, said.limit(0)):
        assert classify(odd, labels)[0].count() == odd.count()
        assert classify(none, labels)[0].count() == 0


def auc(score, positive):
    """The chance that a positive scores above another, ties counting half."""
    order = np.unique(score, return_inverse=True)[1]
    a, b = (np.bincount(order[x], minlength=order.max() + 1) for x in (positive, ~positive))
    return float((a * (np.cumsum(b) - b / 2)).sum() / (a.sum() * b.sum()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_held_out_abuse_and_form(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").join(labels.select("doc_id"), "doc_id")
    held = docs.where(F.crc32("text") % 3 == 1).select("doc_id")  # by text, so that copies share a fold
    found, models = classify(docs, labels.join(held, "doc_id", "left_anti"))
    rows = found.join(labels, "doc_id").join(held.withColumn("held", F.lit(True)), "doc_id", "left").toPandas()
    out = rows[rows.held.notna()]
    assert len(out) > 1000 and auc(out.p_abuse.to_numpy(), out.toxic.to_numpy() == 1) > 0.9
    assert auc(rows.p_form.to_numpy(), rows.quality.to_numpy() == 0) > 0.99
    assert out.keep[(out.toxic == 0) & (out.quality == 1)].mean() > 0.99
    assert all(0 < v < 1 for m in models.values() for v in m.votes[1, :, BAD])
