"""Language identification: short, long, repeated and hot training texts, the sample's bound, the query's folds."""

import zlib

import numpy as np

from siftwell.llm.langid import Children, _grams, fit, predict

SCHEMA = "doc_id long, text string, lang string"


def test_grams_of_short_texts():
    for n in range(6):
        found = _grams(np.arange(1, n + 1, dtype=np.uint8), np.array([0, n]), 5)
        assert [int(np.count_nonzero(x)) for x in found] == [max(0, n - k) for k in range(5)]


def test_children_are_found():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    found = Children(keys).find(np.concatenate([keys, keys + 1]))
    assert np.array_equal(found[: len(keys)], np.arange(1, len(keys) + 1))
    assert np.array_equal(found[len(keys) :] > 0, np.isin(keys + 1, keys))
    assert Children(keys[:0]).find(keys).max() == 0


def test_languages_of_few_bytes(spark):
    rows = spark.createDataFrame([(1, "abc", "x"), (2, "a", "y"), (3, None, "x"), (4, "", "z"), (5, "abc abc", "x")], SCHEMA)
    model = fit(rows)
    assert model.langs == ["x", "y"]
    found = {r["doc_id"]: r["lang_pred"] for r in predict(rows, model).collect()}
    assert found == {1: "x", 2: "y", 3: "und", 4: "und", 5: "x"}


def test_copies_weigh_nothing_and_the_sample_is_bounded(spark):
    texts = [(i, f"word{i} and other words {i * i} " * 9, "x") for i in range(200)] + [(900, "zeta eta theta " * 20, "y")]
    rows = spark.createDataFrame(texts, SCHEMA)
    many = rows.unionAll(rows.where("doc_id = 7").crossJoin(spark.range(3000)).drop("id"))
    a, b = fit(rows, sample_bytes=8000), fit(many, sample_bytes=8000)
    assert a.langs == b.langs == ["x", "y"] and all(np.array_equal(x, y) for x, y in zip(a.bits, b.bits, strict=True))
    whole = fit(rows)
    assert sum(map(len, a.bits)) < sum(map(len, whole.bits)) / 2
    assert len(fit(rows, sample_bytes=1).langs) == 2


def test_a_very_long_text(spark):
    rows = spark.createDataFrame([(1, "the of and " * 400_000, "en"), (2, "der die das " * 5, "de"), (3, "der the " * 3, None)], SCHEMA)
    found = {r["doc_id"]: r for r in predict(rows, fit(rows)).collect()}
    assert (found[1]["lang_pred"], found[2]["lang_pred"]) == ("en", "de") and found[1]["bits_per_byte"] < 0.5


def test_query_learns_from_its_folds_only(spark, tmp_path):
    from siftwell.llm.queries import op1_langid

    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, "und der die das ist nicht ein " * 3 if i % 2 else "the and of it is not a " * 3, "unseen" if i in held else ("de" if i % 2 else "en"), "s") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op1_langid(spark, str(tmp_path))
    assert found.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == 300 and all(got[i]["held_out"] == (i in held) and got[i]["lang_pred"] == ("de" if i % 2 else "en") for i in got)
