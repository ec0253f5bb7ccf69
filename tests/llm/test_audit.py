import re
from collections import Counter
from itertools import permutations

from siftwell.llm.audit import audit, failures, interactions
from siftwell.llm.common import keyed


def fails_by_hand(rows):
    """Letters that each (doc_id, text) fails, by the conditions' own words."""
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i]
        out.append("".join(x for x, y in zip("ABCDE", tests, strict=True) if y))
    return out


def as_bits(letters):
    return sum(1 << "ABCDE".index(x) for x in letters)


def test_failures_of_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    expected = Counter((i, lang or "", as_bits(f)) for (i, _, lang), f in zip(rows, fails_by_hand([(i, t) for i, t, _ in rows]), strict=True))
    found, _ = failures(odd)
    assert Counter((r["doc_id"], r["part"], r["fails"]) for r in found.collect()) == expected


def test_parts_are_split_by_every_block_and_by_the_text(spark):
    """Texts that share their length and all but one block, and very long copies."""
    long = "".join(chr(97 + i * i % 23) for i in range(70_000))
    at = [0, 255, 256, 1023, 1024, 5000, 20_000, 69_999]
    texts = [long, *[long[:i] + "!" + long[i + 1 :] for i in at], long, long[:20_000] + "!" + long[20_001 :], "short", "other", "short", "é", "é", None, ""]
    rows = list(enumerate(texts))
    found, _ = failures(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string").repartition(3))
    assert {r["doc_id"]: r["fails"] for r in found.collect()} == {i: as_bits(f) for (i, _), f in zip(rows, fails_by_hand(rows), strict=True)}


def test_a_part_whose_hashes_agree_is_split_by_the_text(spark, monkeypatch):
    """With every block's hash the same, the comparison of whole texts alone must be right."""
    from pyspark.sql import functions as F

    from siftwell.llm import audit as module

    monkeypatch.setattr(module, "_block", lambda text, level: F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, "bb"), (5, "cc"), (6, "aaa"), (7, "aa")], "doc_id long, text string").selectExpr("*", "'x' AS lang")
    rows = keyed(docs)
    copies, _ = module.later_copies(rows, rows.selectExpr("ord", "doc_id", "length(text) AS n_chars", "7L AS head"))
    assert sorted(r["ord"] for r in copies.collect()) == [3, 4, 7]


def test_orders_against_filters_applied_one_by_one(spark, odd):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    labels = [(i, i % 2, i % 5 == 0) for i, _, _ in rows if i is not None and i % 4 < 3]
    known = {i: (q, t) for i, q, t in labels}
    fails = fails_by_hand([(i, t) for i, t, _ in rows])
    found = {(r["part"], r["filter_order"], r["step"]): r.asDict() for r in audit(odd, spark.createDataFrame([(i, q, int(t)) for i, q, t in set(labels)], "doc_id long, quality int, toxic int")).collect()}
    parts = {lang or "" for _, _, lang in rows}
    assert set(found) == {(p, "".join(o), k) for p in parts for o in permutations("ABCDE") for k in range(1, 6)}
    for p in parts:
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == p]
            gone = []
            for k, x in enumerate(order, 1):
                out = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                got = found[p, order, k]
                assert (got["kept"], got["removed"], got["redundant"]) == (len(left), len(out), sum(x in f for _, f in gone))
                assert got["good_lost"] == sum(known.get(i, (0, 0))[0] == 1 for i, _ in out) and got["toxic_lost"] == sum(bool(known.get(i, (0, 0))[1]) for i, _ in out)
                assert got["unique_fails"] == sum(f == x for (_, _, lang), f in zip(rows, fails, strict=True) if (lang or "") == p)
                gone += out
                shapley[x] += len(out)
        assert all(found[p, o, k]["shapley"] == shapley[o[k - 1]] for o in map("".join, permutations("ABCDE")) for k in range(1, 6))


def test_no_rows(spark, none):
    assert audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert interactions(spark.createDataFrame([(1, "p", 0)], "doc_id long, part string, fails int"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("removed = 0 AND kept = 1").count() == 600
