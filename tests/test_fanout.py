import json

import pytest
from pyspark.sql import functions as F

from siftwell.functions.canonical import InvalidValue, default_fields, pointer_key
from siftwell.operators import fanout


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string").select("n", F.parse_json("t").alias("entry"))


def pointers(value, at=""):
    below = list(value.items()) if isinstance(value, dict) else list(enumerate(value)) if isinstance(value, list) else []
    out = []
    for k, v in below:
        here = f"{at}/{pointer_key(str(k))}"
        out += [here, *pointers(v, here)]
    return out


TEXTS = ['{"a":{"b/c":[1,{"~":null}],"d":null},"e":[]}', "[1,[2,[3]],null]", '"x"', "null", "{}", '{"a":1}', '{"a":1}', '{"e":{"a":{"a":{"a":true}}}}']


def test_items_of_records(spark):
    docs = frame(spark, ['{"r":[{"k":1},null,[2]]}', '{"r":{"k":0}}', '{"r":[]}', '{"r":null}'])
    found = fanout.fan_out(docs, "entry", "/r").select("n", "place", "id", F.to_json("data").alias("d"), fanout.default_fields(F.col("data")).alias("f")).orderBy("n", "place").collect()
    assert [(r["n"], r["place"], r["id"], r["d"]) for r in found] == [(0, 1, "1", '{"k":1}'), (0, 2, "2", "null"), (0, 3, "3", "[2]"), (1, 1, "1", '{"k":0}'), (3, 1, "1", "null")]
    assert [r["f"] for r in found] == [["/k"], [""], [""], ["/k"], [""]]
    with pytest.raises(Exception, match=r"\d: there are no records at '/x'"):
        fanout.fan_out(docs, "entry", "/x", where="n").collect()


def test_ids_are_nonempty_scalars(spark):
    docs = frame(spark, ['[{"k":0},{"k":false},{"k":"0001"},{"k":12345678901234567890}]'])
    assert [r["id"] for r in fanout.fan_out(docs, "entry", id_field="k").orderBy("place").collect()] == ["0", "False", "0001", "12345678901234567890"]
    for bad in ("null", '""', "[1]", '{"x":1}'):
        with pytest.raises(Exception, match="nonempty scalar"):
            fanout.fan_out(frame(spark, [f'[{{"k":{bad}}}]']), "entry", id_field="k").collect()
    with pytest.raises(Exception, match="nonempty scalar"):
        fanout.fan_out(frame(spark, ['{"j":1}']), "entry", id_field="k").collect()


def test_default_and_checked_fields(spark):
    found = frame(spark, TEXTS).select("n", fanout.default_fields(F.col("entry")).alias("f")).collect()
    for r in found:
        assert r["f"] == sorted(default_fields(json.loads(TEXTS[r["n"]])))
    docs = frame(spark, ['{"a":null,"b":[1]}']).withColumn("id", F.lit("x"))
    assert fanout.checked(docs, "entry", ["/a", "/b/0"]).first()["fields"] == ["/a", "/b/0"]
    with pytest.raises(Exception, match="entry x has no '/b/1'"):
        fanout.checked(docs, "entry", ["/a", "/b/1"]).collect()
    for bad in ([], ["/a", "/a"], ["a"]):
        with pytest.raises(InvalidValue):
            fanout.checked(docs, "entry", bad)


def test_shapes_hold_every_pointer(spark):
    docs = frame(spark, TEXTS)
    assert fanout.nesting(docs, "entry") >= 4
    expected = {}
    for t in TEXTS:
        key = tuple(sorted(pointers(json.loads(t)), key=lambda p: p.encode()))
        expected[key] = expected.get(key, 0) + 1
    found = fanout.shapes(docs, "entry")
    assert {tuple(r["paths"]): r["entries"] for r in found.collect()} == expected
    counts = {r["pointer"]: r["entries"] for r in fanout.pointer_counts(found).collect()}
    assert counts["/a"] == 3 and counts["/0"] == 1 and counts["/e/a/a/a"] == 1
    told = lambda required, optional=(): sorted((r["problem"], *r["pointers"]) for r in fanout.selection_problems(found, required, optional).collect())
    assert told(["/a", "/e"]) == [] and told(["/0", "/a"], ["/no"]) == [("apart", "/0", "/a"), ("never together", "/0", "/a"), ("unknown", "/no")]
    assert told(["/a/d", "/e", "/e/a"]) == [("apart", "/a/d", "/e/a"), ("never together", "/a/d", "/e", "/e/a")]


def test_no_entries(spark):
    none = frame(spark, []).withColumn("id", F.lit("x"))
    assert fanout.fan_out(none, "entry").count() == 0 and fanout.shapes(none, "entry").count() == 0
    assert [r["problem"] for r in fanout.selection_problems(fanout.shapes(none, "entry"), ["/a"]).collect()] == ["unknown"]
