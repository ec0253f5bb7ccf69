import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from siftwell.llm.outliers import AXES, RESOLUTION, UNIT, axes, chi2_cdf, chi2_quantile, consistency, estimate, judge, statistics, with_cells


def prose(rng, lang, n):
    common = {"en": "the of and to in that it is was for on with as his".split(), "de": "der die und in den von zu das mit sich des auf".split()}[lang]
    words = [rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(["ba", "ke", "lo", "mi", "tu", "sch", "th", "er"]) for _ in range(rng.randint(2, 4))) for _ in range(n)]
    return " ".join(w + "." if not i % 9 else w for i, w in enumerate(words))


def base_by_hand(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(windows)
    covered = {j for i, x in enumerate(windows) if times[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


ODD = ["a b c d e a b c d e", "x y\nx y\n\nx y\r\nx y", "\n\n\n", " \n \n", "é#é é*é\n" * 4, "one", "a " * 500, "a b c d e f " * 3 + "z", "line\n\nline", "\nline\nline", "$%&|<>#*", "tab\there\ttab\there", "w" * 9000 + " " + "v" * 9000 + "\n" + "w" * 9000, "a\n" * 70_000]


def test_statistics_against_plain_counting(spark, odd):
    rng = random.Random(1)
    mixed = ["".join(rng.choice(["a", "b", " ", " ", "\n", "#", "é", "\t"]) for _ in range(60)) for _ in range(300)]
    more = spark.createDataFrame([(1000 + i, t, "x", "y") for i, t in enumerate([*ODD, *mixed])], "doc_id long, text string, lang string, source string")
    docs = odd.select("doc_id", "text", "lang", "source").unionByName(more).repartition(3)
    expected = Counter((r["doc_id"], r["lang"], r["source"], *base_by_hand(r["text"])) for r in docs.collect())
    assert Counter(map(tuple, statistics(docs).collect())) == expected


def test_chi_square():
    assert [round(chi2_quantile(0.95, k), 3) for k in (1, 2, 3, 4, 5, 7)] == [3.841, 5.991, 7.815, 9.488, 11.070, 14.067]
    draws = np.random.default_rng(0).standard_normal((200_000, 5))
    d = np.square(draws).sum(axis=1)
    assert abs(chi2_cdf(3.0, 5) - (d <= 3).mean()) < 0.005
    inner = draws[d <= np.quantile(d, 0.6)]
    assert abs(consistency(0.6) * inner.var() - 1) < 0.02


def exact_mcd(x, share, rng, starts=200):
    """The least determinant over exact concentration steps from many random starts."""
    floor = np.diag(np.square(RESOLUTION))
    h, best = share * len(x), None
    for _ in range(starts):
        some = x[rng.choice(len(x), x.shape[1] + 1, replace=False)]
        mean, cov = some.mean(axis=0), np.cov(some.T, bias=True)
        for _ in range(30):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + floor), x - mean)
            inner = x[np.argsort(d)[: int(math.ceil(h))]]
            mean, cov = inner.mean(axis=0), np.cov(inner.T, bias=True) * consistency(share)
        det = np.linalg.slogdet(cov + floor)[1]
        if best is None or det < best[0]:
            best = det, mean, cov
    det, mean, cov = best
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + floor), x - mean)
    inner = x[d <= chi2_quantile(0.975, x.shape[1])]
    return inner.mean(axis=0), np.cov(inner.T, bias=True) * consistency(0.975) + floor


@pytest.mark.parametrize("held", [20_000, 0])
def test_estimates_against_exact_concentration(spark, held):
    """Two cells with a fifth of planted outliers, and one with copies of one row in most places."""
    rng = np.random.default_rng(4)
    rows, by_cell = [], {}
    for cell, shift in (("a", 0.0), ("b", 1.0)):
        good = rng.standard_normal((400, 5)) @ np.diag([0.8, 0.1, 0.05, 0.2, 0.1]) + shift
        good[:, 1] += 0.1 * good[:, 0]
        bad = rng.standard_normal((100, 5)) * 0.1 + np.array([4, 1, 2, 1, 1]) + shift
        x = np.round(np.vstack([good, bad]) * UNIT) / UNIT
        by_cell[cell] = x
        rows += [(cell, *map(int, np.round(v * UNIT))) for v in x]
        rows += [(cell, *map(int, np.round(x[450] * UNIT)))] * (1500 if cell == "b" else 0)
    frame = spark.createDataFrame(rows, "cell string, " + ", ".join(f"{a} long" for a in AXES)).repartition(5)
    found, _ = estimate(frame, held_cells=held)
    for r in found.collect():
        mean, cov = exact_mcd(by_cell[r["cell"]], 0.6, rng)
        whiten = np.zeros((5, 5))
        whiten[np.tril_indices(5)] = r["whiten"]
        assert np.allclose(np.array(r["centre"]), mean, atol=0.1)
        assert abs(r["log_det"] - np.linalg.slogdet(cov)[1]) < 0.25
        x = by_cell[r["cell"]]
        d = np.square((x - np.array(r["centre"])) @ whiten.T).sum(axis=1)
        exact = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        cut = chi2_quantile(0.9999, 5)
        clear = np.abs(exact / cut - 1) > 0.15
        assert ((d > cut) == (exact > cut))[clear].all() and (d[400:] > cut).all() and (d[:400] > cut).mean() < 0.01


def mixture(n=160):
    """Clean prose of two languages and sources, and some texts full of symbols, of tiny words, or that repeat themselves."""
    rng = random.Random(8)
    rows = []
    for i in range(n):
        lang = "en" if i % 2 else "de"
        rows.append((i, prose(rng, lang, rng.randint(30, 400)), lang, "s0" if i % 3 else None))
    for i in range(12):
        words = prose(rng, "en", 200).split()
        bad = [" ".join(w + "$$$" for w in words), " | ".join(words), " ".join(words[:40] * 5), " ".join(w[:1] for w in words)][i % 4]
        rows.append((n + i, bad, "en", "s0"))
    return rows


def test_verdicts(spark):
    rows = [*mixture(), (500, None, None, None), (501, "", "en", "s0"), (502, "nine words are here and they are not enough", "en", "s0"), (503, "  ", "fr", "s1"), (3, mixture()[3][1], "en", "s0")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, cell string, n_words int").repartition(3)
    found = [r.asDict() for r in judge(docs, least_rows=30).collect()]
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        n, chars, symbols, _, dup, repeats = base_by_hand(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeats)
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
        assert r["kept"] == (r["doc_id"] < 160)


def test_cells_of_few_rows_are_pooled(spark):
    rows = [("en", "a", 1)] * 40 + [("en", "b", 1)] * 10 + [("en", None, 1)] * 25 + [("de", "a", 1)] * 5 + [(None, "a", 1)] * 28 + [("fr", "c", 0)] * 50
    found = spark.createDataFrame(rows, "lang string, source string, n_words long")
    placed, _ = with_cells(found, 30)
    cells = {(r["lang"], r["source"]): r["cell"] for r in placed.collect()}
    assert cells == {("en", "a"): 'source {"lang":"en","source":"a"}', ("en", "b"): 'language {"lang":"en"}', ("en", None): 'language {"lang":"en"}', ("de", "a"): "all", (None, "a"): "all", ("fr", "c"): "all"}
    placed, _ = with_cells(found, 1000)
    assert {r["cell"] for r in placed.collect()} == {None}


def test_no_rows_and_one_row(spark, none):
    assert judge(none).count() == 0
    one = judge(spark.createDataFrame([(1, "a b c d e f g h i j k", "en", "s")], "doc_id long, text string, lang string, source string")).collect()
    assert [(r["kept"], r["base_failed"], r["distance"]) for r in one] == [(True, False, None)]


def test_registered_query(spark, docs, tmp_path):
    from siftwell.llm.queries import QUERIES

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op11_outliers"](spark, str(tmp_path))
    assert [x for x in found.dtypes][:8] == [("doc_id", "bigint"), *[(x, "bigint") for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", "boolean"), ("kept", "boolean")]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in found.collect():
        n, chars, symbols, _, dup, repeats = base_by_hand(texts[r["doc_id"]])
        assert tuple(r)[1:6] == (n, chars, symbols, dup, repeats) and not (r["kept"] and r["base_failed"])


def test_axes_of_few_words_stay_near_the_prior(spark):
    frame = spark.createDataFrame([(1, 10, 1, 1, 0, 0)], "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    row = frame.select(*axes()).first()
    assert abs(row["word_length"] / UNIT - math.log(260 / 51)) < 1e-3 and row["dup_lines"] == 0
