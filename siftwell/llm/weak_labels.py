"""Document quality from overlapping heuristic labellers.

Each labeller votes bad, good or nothing on a text. There are two questions, form and abuse, each with
labellers of its own. Those of form look at eight different things. Those of abuse are a list of insults and two
lexicons, of how words begin and of how they end, each learned from another half of a bounded sample of labelled
texts. Expectation-maximisation over the counts of vote patterns (3 ** labellers at the most) estimates how each
labeller votes on good and on bad texts, without any labels, and how far two of them err together; the posteriors
of a bounded sample of texts train a hashed linear scorer, which then scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, hash_runs, mix, pieces, text_bytes, words, written

GOOD, BAD, NOTHING = 0, 1, 2
#: Insults, of which texts that abuse somebody hold one or more.
INSULTS = (
    "idiot idiots idiotic moron morons stupid dumb fool imbecile loser losers scum trash garbage pathetic worthless disgusting clown filth vermin scumbag jerk bastard freak creep "
    "idiota imbécil estúpido basura asqueroso payaso inútil escoria idioot idiote imbécile crétin stupide ordure débile dégoûtant minable "
    "dummkopf trottel abschaum widerlich wertlos erbärmlich blödmann arschloch vollidiot schwachkopf"
).split()
FORM = ("symbols", "capitals", "lines", "variety", "marks", "length", "stutter", "commonest")
ABUSE = ("listed", "starts", "ends")
#: Bytes at a word's start or end that a learned lexicon looks at; eight fit a whole number exactly.
SIZES = (3, 4, 5, 6, 7, 8)
_LETTER_UP = np.isin(np.arange(256), np.arange(65, 91))
_WORDLIKE = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_SYMBOL = ~_WORDLIKE & (np.arange(256) > 32) & ~np.isin(np.arange(256), [x for x in b".,;:'?-\"()"])
_TRIM = np.isin(np.arange(256), [x for x in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"])


def _insult_hashes() -> np.ndarray:
    return np.sort(np.concatenate([hash_runs(np.frombuffer(x.encode(), np.uint8), np.zeros(1, dtype=np.int64), np.array([len(x.encode())])) for x in INSULTS]))


def _three(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, NOTHING)).astype(np.int8)


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words without marks around them, and their texts; words of marks only go."""
    solid = np.flatnonzero(~_TRIM[data])
    i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    has = (i <= j) & (i < len(solid)) if len(solid) else np.zeros(len(starts), dtype=bool)
    s, e, own = (solid[i[has]], solid[j[has]] + 1, text[has]) if len(solid) else (starts[:0], ends[:0], text[:0])
    inner = np.searchsorted(starts, s, side="right") - 1
    ok = (s < ends[inner]) & (e <= ends[inner]) & (s >= starts[inner]) if len(s) else has[:0]
    return s[ok], e[ok], own[ok]


def edge_grams(data: np.ndarray, s: np.ndarray, e: np.ndarray, size: int, end: bool) -> tuple[np.ndarray, np.ndarray]:
    """The `size` bytes that begin (or end) each run data[s:e] that has as many, as a number, and which runs have."""
    which = np.flatnonzero(e - s >= size)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<i8", padded, strides=(1,))
    at = e[which] - size if end else s[which]
    return eight[at] & np.int64(-1 if size == 8 else (1 << 8 * size) - 1), which


@dataclass
class Lexicon:
    """Word starts or ends found in abusive texts, and the share of words that have one in abusive and in other texts."""

    end: bool
    grams: np.ndarray
    abusive: float = 0.0
    other: float = 0.0

    def hits(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Which words have one of the grams; data is lower-cased."""
        hit = np.zeros(len(s), dtype=bool)
        for size in SIZES if len(self.grams) else ():
            gram, which = edge_grams(data, s, e, size, self.end)
            hit[which] |= self.grams[np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)] == gram
        return hit

    def vote(self, hits: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Bad or good where the Poisson likelihoods of so many hits among so many words differ by a factor of e."""
        if not self.abusive > self.other > 0:
            return np.full(len(hits), NOTHING, dtype=np.int8)
        ratio = hits * np.log(self.abusive / self.other) - total * (self.abusive - self.other)
        return _three(ratio > 1, ratio < -1)


def learn(labelled: DataFrame) -> list[Lexicon]:
    """Lexicons of word starts and of word ends from (text, h, toxic).

    Each is chosen by one half of the texts, told by the lowest bit of h: grams of at least four texts of which, by
    the lower bound of two deviations, over half are abusive. Its rates are counted on the other half.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, at = text_bytes(part.column(0))
                half, toxic = (part.column(k).to_numpy() for k in (1, 2))
                starts, ends, counts = words(data, at)
                s, e, own = _trimmed(data, starts, ends, np.repeat(np.arange(len(at) - 1), counts))
                low = LOWER[data]
                for end in (False, True):
                    mine = half[own] == end
                    for size in SIZES:
                        gram, which = edge_grams(low, s[mine], e[mine], size, end)
                        text = own[mine][which]
                        order = np.lexsort((text, gram))
                        gram, text = gram[order], text[order]
                        once = np.append(True, (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])) if len(gram) else np.zeros(0, dtype=bool)
                        found, inverse, n = np.unique(gram[once], return_inverse=True, return_counts=True)
                        bad = np.bincount(inverse, weights=toxic[text[once]], minlength=len(found))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), end)), pa.array(found.astype(np.int64)), pa.array(bad.astype(np.int64)), pa.array(n.astype(np.int64))], names=["end", "gram", "bad", "n"])

    split = labelled.select("text", F.col("h").bitwiseAND(1).alias("half"), F.col("toxic").cast("long").alias("toxic"))
    counted = split.mapInArrow(grams, "end boolean, gram long, bad long, n long").groupBy("end", "gram").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    share = (F.col("bad") + 0.5) / (F.col("n") + 1)
    chosen = counted.where((F.col("n") >= 4) & (share - 2 * F.sqrt(share * (1 - share) / (F.col("n") + 1)) > 0.5)).select("end", "gram").collect()
    found = [Lexicon(end, np.sort(np.array([r["gram"] for r in chosen if r["end"] == end], dtype=np.int64))) for end in (False, True)]

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2, 2), dtype=np.int64)  # lexicon, toxic, (hits, words)
        for batch in batches:
            for part in pieces(batch, "text"):
                data, at = text_bytes(part.column(0))
                half, toxic = (part.column(k).to_numpy() for k in (1, 2))
                starts, ends, counts = words(data, at)
                s, e, own = _trimmed(data, starts, ends, np.repeat(np.arange(len(at) - 1), counts))
                for k, lexicon in enumerate(found):
                    other = half[own] != lexicon.end
                    hit = lexicon.hits(LOWER[data], s[other], e[other])
                    for y in (0, 1):
                        of = toxic[own[other]] == y
                        sums[k, y] += (hit[of].sum(), of.sum())
        kinds = np.indices((2, 2)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*kinds, *sums.reshape(-1, 2).T)], names=["lexicon", "toxic", "hits", "words"])

    for r in split.mapInArrow(rates, "lexicon long, toxic long, hits long, words long").groupBy("lexicon", "toxic").agg(F.sum("hits").alias("hits"), F.sum("words").alias("words")).collect():
        rate = (r["hits"] + 0.5) / (r["words"] + 1)
        setattr(found[r["lexicon"]], "abusive" if r["toxic"] else "other", rate if r["words"] else 0.0)
    return found


def vote(data: np.ndarray, at: np.ndarray, lexicons: list[Lexicon] | tuple = ()) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Votes on form and on abuse, (texts, labellers), and the texts' words: (word hash, text)."""
    n = len(at) - 1
    starts, ends, counts = words(data, at)
    size = np.maximum(np.diff(at), 1)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    low = LOWER[data]
    s, e, own = _trimmed(data, starts, ends, np.repeat(np.arange(n), counts))
    h = hash_runs(low, s, e)
    letters = np.maximum(per(_WORDLIKE[data]), 1)
    total = np.maximum(counts, 1)
    key = np.unique(own.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    variety = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n) / total
    symbols = per(_SYMBOL[data]) / size
    capitals = per(_LETTER_UP[data]) / letters
    marks = per(np.isin(data, [ord(x) for x in "|#$%&*<>{}[]=~^"]) | (data == 33)) / total
    mean = letters / total
    line_at = np.sort(np.concatenate([at[:-1], np.flatnonzero(data == 10) + 1])) if len(data) else at[:-1]
    line_at = np.unique(line_at[line_at < len(data)])
    line_end = np.append(line_at[1:], len(data))
    owner = np.searchsorted(at, line_at, side="right") - 1
    full = line_end - line_at > 20
    line_h = hash_runs(data, line_at[full], np.maximum(line_end[full] - 1, line_at[full] + 1))
    own_line = owner[full]
    lines = np.bincount(own_line, minlength=n)
    distinct = np.unique(own_line.astype(np.uint64) << np.uint64(40) | line_h >> np.uint64(24))
    repeated = 1 - np.bincount((distinct >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(lines, 1)
    same = np.bincount(own[1:], weights=(h[1:] == h[:-1]) & (own[1:] == own[:-1]), minlength=n) / total if len(own) else np.zeros(n)
    order = np.lexsort((h, own))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])) if len(own) else np.zeros(0, dtype=bool)
    times = np.diff(np.append(np.flatnonzero(new), len(own)))
    most = np.zeros(n)
    np.maximum.at(most, own[order][new], times)
    long = counts >= 50
    form = np.column_stack(
        [
            _three(symbols > 0.05, symbols < 0.03),
            _three(capitals > 0.3, capitals < 0.1),
            _three((lines >= 4) & (repeated > 0.3), (lines >= 4) & (repeated < 0.1)),
            _three(long & (variety < 0.3), long & (variety > 0.5)),
            _three((counts > 5) & (marks > 0.2), marks < 0.03),
            _three((counts > 20) & ((mean > 7) | (mean < 3)), (mean > 3.5) & (mean < 6.5)),
            _three((counts > 10) & (same > 0.3), (counts > 10) & (same < 0.1)),
            _three((counts > 30) & (most / total > 0.25), (counts > 30) & (most / total < 0.15)),
        ]
    )
    found = np.bincount(own, weights=np.isin(h, _insult_hashes()), minlength=n)
    abuse = [_three(found > 0, (found == 0) & (counts >= 10))]
    solid = np.bincount(own, minlength=n)
    abuse += [x.vote(np.bincount(own, weights=x.hits(low, s, e), minlength=n), solid) for x in lexicons]
    abuse += [np.full(n, NOTHING, dtype=np.int8)] * (len(ABUSE) - len(abuse))
    abuse = np.column_stack(abuse)
    return form, abuse, (h, own)


@dataclass
class LabelModel:
    """How labellers vote: chance of a bad text, votes[class, labeller, outcome] of those it gives, and the weight of
    each labeller's word, which is less than 1 where it errs together with others."""

    bad: float
    votes: np.ndarray
    weight: np.ndarray

    #: Beta priors of votes, (good, bad), on good and on bad texts, as numbers of votes; and of (bad, all) texts.
    PRIOR = np.array([[20.0, 0.001], [2.0, 2.0]])
    TEXTS = (1.0, 10.0)

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 2000, settled: float = 1e-9) -> LabelModel:
        """The highest posterior by EM over distinct vote patterns and their counts, from the priors' means.

        Estimates aren't held within bounds. It ends when no chance moves by more than `settled`.
        """
        m = patterns.shape[1]
        model = cls(cls.TEXTS[0] / cls.TEXTS[1], np.tile((cls.PRIOR / cls.PRIOR.sum(axis=1, keepdims=True))[:, None, :], (1, m, 1)), np.ones(m))
        for _ in range(rounds):
            p = model.posterior(patterns)
            votes = np.zeros((2, m, 2))
            for c, weight in enumerate((counts * (1 - p), counts * p)):
                for k in range(m):
                    votes[c, k] = np.bincount(patterns[:, k], weights=weight, minlength=3)[:2] + cls.PRIOR[c]
            votes /= votes.sum(axis=2, keepdims=True)
            bad = float((counts @ p + cls.TEXTS[0]) / (counts.sum() + cls.TEXTS[1]))
            moved = max(abs(bad - model.bad), np.abs(votes - model.votes).max())
            model = cls(bad, votes, model.weight)
            if moved <= settled:
                break
        return cls(model.bad, model.votes, 1 / (1 + np.maximum(model.dependence(patterns, counts), 0).sum(axis=0)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance that a text of these votes is bad; a labeller that doesn't vote says nothing."""
        score = np.log(self.bad) - np.log1p(-self.bad) + np.zeros(len(patterns))
        ratio = (np.log(self.votes[1]) - np.log(self.votes[0])) * self.weight[:, None]
        for k in range(patterns.shape[1]):
            score += np.append(ratio[k], 0.0)[patterns[:, k]]
        return 1 / (1 + np.exp(-np.clip(score, -500, 500)))

    def dependence(self, patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Correlation of two labellers' bad votes within bad texts, where both vote; the model says 0.

        0 on the diagonal and for pairs that fewer than 20 bad texts let one see.
        """
        m = patterns.shape[1]
        p = self.posterior(patterns) * counts
        found = np.zeros((m, m))
        for k in range(m):
            for j in range(k):
                both = (patterns[:, k] != NOTHING) & (patterns[:, j] != NOTHING)
                n = p[both].sum()
                if n < 20:
                    continue
                a, b = patterns[both, k] == BAD, patterns[both, j] == BAD
                x, y, xy = p[both] @ a / n, p[both] @ b / n, p[both] @ (a & b) / n
                spread = np.sqrt(x * (1 - x) * y * (1 - y))
                found[k, j] = found[j, k] = (xy - x * y) / spread if spread > 1e-9 else 0.0
        return found

    def accuracies(self) -> np.ndarray:
        """Each labeller's chance of a right vote when it votes."""
        return (1 - self.bad) * self.votes[0, :, GOOD] + self.bad * self.votes[1, :, BAD]


def features(form: np.ndarray, abuse: np.ndarray, h: np.ndarray, own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, slot and value of hashed features: each vote, and each distinct word weighted by the root of their number."""
    n = len(form)
    both = np.column_stack([form, abuse])
    m = both.shape[1]
    votes = mix((np.arange(m, dtype=np.uint64) * np.uint64(3) + both.astype(np.uint64) + np.uint64(1 << 50)).ravel())
    key = np.unique(own.astype(np.uint64) << np.uint64(bits) | h & np.uint64((1 << bits) - 1))
    text = (key >> np.uint64(bits)).astype(np.int64)
    weight = 1 / np.sqrt(np.maximum(np.bincount(text, minlength=n), 1))
    low = np.uint64((1 << bits) - 1)
    return np.concatenate([np.repeat(np.arange(n), m), text]), np.concatenate([votes & low, key & low]).astype(np.int64), np.concatenate([np.ones(n * m), weight[text]])


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], target: np.ndarray, bits: int, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic scorer: full-batch AdaGrad over hashed features against posterior labels."""
    size = np.array([len(x[1]) for x in rows])
    text, slot, value = np.repeat(np.arange(len(rows)), size), np.concatenate([x[1] for x in rows]), np.concatenate([x[2] for x in rows])
    w, g2 = np.zeros(1 << bits), np.full(1 << bits, 1e-3)
    for _ in range(rounds * 5):
        z = np.bincount(text, weights=w[slot] * value, minlength=len(rows))
        wrong = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / max(len(rows), 1)
        grad = np.bincount(slot, weights=wrong[text] * value, minlength=1 << bits) + 1e-6 * w
        g2 += grad**2
        w -= 0.5 * grad / np.sqrt(g2)
    return w.astype(np.float32)


def _highest(some: int, of: int) -> int:
    """The hash up to which `some` of `of` evenly spread 64-bit hashes lie."""
    return min(int(min(1.0, some / max(of, 1)) * 2**64) - 2**63 - 1, 2**63 - 1)


def classify(docs: DataFrame, labels: DataFrame | None = None, sample_labels: int = 20_000, sample_docs: int = 8000, bits: int = 18, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[str, LabelModel]]:
    """(doc_id, p_form, p_abuse, keep) for every row, and the label models.

    p_form, p_abuse: the linear scorers' chance that the text is badly formed or abusive; keep is true if
    both are below one half. labels, (doc_id, toxic 0 or 1), may be had for some texts: of a sample of at most
    sample_labels rows in expectation, by a hash, the abuse lexicons are learned (equal texts count once, as abusive
    if any is said to be; rows without an id or a label say nothing); without labels these don't vote. sample_docs bounds (in expectation, by a hash) the distinct texts that train
    the scorers; the label models count the votes on all texts. A null text is empty; an empty text has no
    word for or against it and is not kept, its p_form being 1. Repeated rows give a row each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    lexicons = []
    if labels is not None:
        told = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        some = told.where(F.xxhash64("doc_id") <= F.lit(_highest(sample_labels, told.count())))
        labelled = rows.where("text <> ''").join(F.broadcast(some), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
        labelled, path = written(labelled, "labelled")
        lexicons = learn(labelled)
        discard(spark, path)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                form, abuse, _ = vote(*text_bytes(part.column(0)), lexicons)
                for head, votes in (("form", form), ("abuse", abuse)):
                    found, n = np.unique(votes @ 3 ** np.arange(votes.shape[1]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([head] * len(n)), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["head", "pattern", "n"])

    counted = rows.where("text <> ''").select("text").mapInArrow(patterns, "head string, pattern long, n long").groupBy("head", "pattern").agg(F.sum("n").alias("n")).collect()
    models = {}
    for head, m in (("form", len(FORM)), ("abuse", len(ABUSE))):
        own = [r for r in counted if r["head"] == head]
        code = np.array([r["pattern"] for r in own], dtype=np.int64)
        n = np.array([r["n"] for r in own], dtype=np.float64)
        models[head] = LabelModel.fit((code[:, None] // 3 ** np.arange(m) % 3).reshape(-1, m), n)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                form, abuse, (h, own) = vote(*text_bytes(part.column(0)), lexicons)
                text, slot, value = features(form, abuse, h, own, bits)
                order = np.argsort(text, kind="stable")
                at = np.searchsorted(text[order], np.arange(part.num_rows + 1))
                slots, values = slot[order], value[order]
                for i in range(part.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array([slots[at[i] : at[i + 1]].astype(np.int32).tobytes()], pa.binary()), pa.array([values[at[i] : at[i + 1]].astype(np.float32).tobytes()], pa.binary()), pa.array([float(models["form"].posterior(form[i : i + 1])[0])]), pa.array([float(models["abuse"].posterior(abuse[i : i + 1])[0])])], names=["slots", "values", "form", "abuse"])

    # of distinct texts, so that copies neither crowd the sample nor outgrow its bound
    hashed = rows.where("text <> ''").select("text", F.xxhash64("text").alias("h"))
    kinds = hashed.select("h").distinct().count()
    some = hashed.where(F.col("h") <= F.lit(_highest(sample_docs, kinds))).groupBy("h").agg(F.first("text").alias("text"))
    got = some.select("text").mapInArrow(sample, "slots binary, values binary, form double, abuse double").toLocalIterator()
    lists, form_, abuse_ = [], [], []
    for r in got:
        lists.append((None, np.frombuffer(r["slots"], np.int32), np.frombuffer(r["values"], np.float32)))
        form_.append(r["form"])
        abuse_.append(r["abuse"])
    weights = [train(lists, np.array(y), bits) if lists else np.zeros(1 << bits, dtype=np.float32) for y in (form_, abuse_)]
    shared = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, at = text_bytes(part.column(1))
                form, abuse, (h, own) = vote(data, at, lexicons)
                text, slot, value = features(form, abuse, h, own, bits)
                p = [1 / (1 + np.exp(-np.clip(np.bincount(text, weights=w[slot] * value, minlength=part.num_rows), -50, 50))) for w in shared.value]
                empty = np.diff(at) == 0
                p[0][empty], p[1][empty] = 1.0, 0.0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p[0]), pa.array(p[1]), pa.array((p[0] < 0.5) & (p[1] < 0.5))], names=["doc_id", "p_form", "p_abuse", "keep"])

    return rows.mapInArrow(score, f"doc_id {kind}, p_form double, p_abuse double, keep boolean"), models
