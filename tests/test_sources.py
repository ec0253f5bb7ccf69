import gzip
import sqlite3

import pytest

from siftwell.functions.canonical import InvalidValue, canonical, check_json, pointer_key, present, resolve, scalar_id
from siftwell.sources.readers import Entry, SourceError, detect, reader_for


def read(path, *args, **kwargs):
    return list(reader_for(path, *args, **kwargs)())


def made(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return path


@pytest.mark.parametrize(
    ("pointer", "value"),
    [("", {"a": [1, None], "0": "x", "m/n": {"~": 2}}), ("/a/0", 1), ("/a/1", None), ("/0", "x"), ("/m~1n/~0", 2)],
)
def test_pointers_resolve(pointer, value):
    assert resolve({"a": [1, None], "0": "x", "m/n": {"~": 2}}, pointer) == value


@pytest.mark.parametrize("pointer", ["a", "/~", "/~2"])
def test_bad_pointers_fail_even_with_a_default(pointer):
    with pytest.raises(InvalidValue):
        resolve({}, pointer, None)


def test_null_is_present_and_indices_are_strict():
    assert present({"a": None}, "/a") and not present({}, "/a")
    assert not present([1, 2], "/01") and not present([1], "/-") and not present([1], "/1")
    assert pointer_key("a/b~c") == "a~1b~0c"


def test_canonical_text():
    assert canonical({"b": 1, "a": ["é", 2.0]}) == '{"a":["é",2.0],"b":1}'
    with pytest.raises(ValueError):
        canonical(float("nan"))
    loop = []
    loop.append(loop)
    with pytest.raises(InvalidValue):
        check_json(loop)
    twice = [1]
    assert check_json([twice, twice])
    assert [scalar_id(x) for x in (0, False, "0001")] == ["0", "False", "0001"]


def test_csv(tmp_path):
    path = made(tmp_path, "a.csv", '﻿id,text,n\nx,"a, b\nc",\n\ny,é,007\n')
    assert [e.data for e in read(path)] == [{"id": "x", "text": "a, b\nc", "n": ""}, {"id": "y", "text": "é", "n": "007"}]
    assert [e.id for e in read(path)] == ["1", "2"] and [e.id for e in read(path, id_column="id")] == ["x", "y"]
    assert read(made(tmp_path, "b.csv", "a;b\n'1;2';3\n", "latin-1"), None, {"delimiter": ";", "quotechar": "'", "encoding": "latin-1"})[0].data == {"a": "1;2", "b": "3"}
    assert read(made(tmp_path, "c.TSV", "a\tb\n1\t2\n"))[0].data == {"a": "1", "b": "2"}


@pytest.mark.parametrize("text", ["", "a,a\n1,2\n", "a,\n1,2\n", "a,b\n1\n", "a,b\n1,2,3\n"])
def test_csv_that_is_wrong(tmp_path, text):
    with pytest.raises(SourceError):
        read(made(tmp_path, "a.csv", text))


def test_json_and_jsonl(tmp_path):
    path = made(tmp_path, "a.json", '{"items":[{"k":1},{"k":2}]}')
    assert len(read(path)) == 1 and [e.data["k"] for e in read(path, options={"records": "/items"})] == [1, 2]
    assert [(e.id, e.data) for e in read(made(tmp_path, "a.jsonl", '{"k":1}\n\n[1,2]\n'))] == [("1", {"k": 1}), ("3", [1, 2])]
    for bad in ('{"a":1,"a":2}', "[NaN]", "{", "[1e999]"):
        with pytest.raises(SourceError):
            read(made(tmp_path, "bad.json", bad))


def test_yaml(tmp_path):
    path = made(tmp_path, "a.yaml", "- d: 2024-01-02\n  n: 3\n---\n---\nnull\n")
    assert [(e.id, e.data) for e in read(path)] == [("1:1", {"d": "2024-01-02", "n": 3}), ("3:1", None)]
    merged = made(tmp_path, "m.yaml", "base: &b {x: 1, y: 2}\nown:\n  <<: *b\n  y: 3\n")
    assert read(merged)[0].data["own"] == {"x": 1, "y": 3}
    for bad in ("a: 1\na: 2\n", "1: x\n", "a: &a [*a]\n"):
        with pytest.raises(SourceError):
            read(made(tmp_path, "bad.yaml", bad))


def test_toml(tmp_path):
    path = made(tmp_path, "a.toml", "[[s]]\nwhen = 2024-01-02T03:04:05Z\nday = 2024-01-02\n")
    assert read(path, options={"records": "/s"})[0].data == {"when": "2024-01-02T03:04:05+00:00", "day": "2024-01-02"}


def test_obo(tmp_path):
    text = "format-version: 1.2\n\n[Term] ! first\nid: X:1\nname: one\nsynonym: a\nsynonym: b \\\n c\n\n[Typedef]\nname: rel\n"
    first, second = read(made(tmp_path, "a.obo", text))
    assert (first.id, second.id) == ("X:1", "stanza:10") and first.data["_stanza"] == "Term"
    assert first.paths() == ["/id/0", "/name/0", "/synonym/0", "/synonym/1"] and first.data["synonym"][1] == "b  c"
    assert len(read(tmp_path / "a.obo", options={"stanza": "Term"})) == 1
    with pytest.raises(SourceError):
        read(made(tmp_path, "b.obo", "[Term]\nid: a\\\n"))
    for header in ("[Term]", "[Term] ! example [note]", "[Term]!with [ and ]", "[Term]\t! [Typedef]"):
        (e,) = read(made(tmp_path, "c.obo", f"no tag here\n{header}\nid: X:1\n"))
        assert e.id == "X:1" and e.data == {"_stanza": "Term", "id": ["X:1"]}
    for bad in ("[Term", "[]", "[ ]", "[Term]]", "[[Term]]", "[Term] more", "[Typedef: y", "[Term]\n_stanza: x", "[Term]\nno tag"):
        with pytest.raises(SourceError):
            read(made(tmp_path, "d.obo", f"{bad}\nid: X:1\n"))


def test_text_kinds(tmp_path):
    path = made(tmp_path, "a.md", "\none\ntwo\r\n\n \nthree\n")
    assert [(e.id, e.data) for e in read(path)] == [("2", {"text": "one\ntwo"}), ("6", {"text": "three"})]
    assert [e.id for e in read(path, options={"split": "lines"})] == ["2", "3", "6"] and read(path)[0].paths() == ["/text"]
    assert read(path, options={"split": "file"})[0].data["text"] == "\none\ntwo\r\n\n \nthree\n"


def test_fasta_and_gmt(tmp_path):
    assert [e.data for e in read(made(tmp_path, "a.fa", ">s1 about it\nAC gt\nTT\n\n  >s2  \nA\n"))] == [{"id": "s1", "description": "about it", "sequence": "ACgtTT"}, {"id": "s2", "description": "", "sequence": "A"}]
    assert read(made(tmp_path, "a.gmt", "set\tdesc\tg1\tg1\n"))[0].data["members"] == ["g1", "g1"]
    for name, bad in (("b.fa", "ACGT\n"), ("c.fa", ">\nA\n"), ("d.fa", ">a\n>b\nA\n"), ("b.gmt", "set\tdesc\n"), ("c.gmt", "set\td\ta\t\tb\n")):
        with pytest.raises(SourceError):
            read(made(tmp_path, name, bad))


def test_gzip_is_the_same(tmp_path):
    for name, text in (("a.csv", "a\n1\n"), ("a.jsonl", "1\n"), ("a.txt", "x\n"), ("a.gmt", "s\td\tm\n")):
        plain, packed = made(tmp_path, name, text), tmp_path / (name + ".GZ")
        packed.write_bytes(gzip.compress(text.encode()))
        assert [(e.id, e.data) for e in read(plain)] == [(e.id, e.data) for e in read(packed)]


def test_detection_and_options(tmp_path):
    with pytest.raises(SourceError):
        detect("a.unknown")
    path = made(tmp_path, "a.csv", "a\n1\n")
    for options in ({"x": "1"}, {"encoding": "hex"}, {"encoding": "none-such"}, {"delimiter": ",,"}):
        with pytest.raises(SourceError):
            reader_for(path, options=options)
    with pytest.raises(InvalidValue):
        Entry("", {"a": 1}).paths()
    with pytest.raises(InvalidValue):
        Entry("x", {"a": 1}, ["/a", "/a"]).paths()


def test_sqlite(tmp_path):
    path = tmp_path / "a.csv"
    c = sqlite3.connect(path)
    c.executescript('CREATE TABLE items (id INTEGER PRIMARY KEY, value BLOB); INSERT INTO items VALUES (2, x\'00ff\'), (1, \'ok\'); CREATE TABLE "odd""; name" (a TEXT, b INTEGER, PRIMARY KEY (b, a)); INSERT INTO "odd""; name" VALUES (\'x\', 7); CREATE VIEW v AS SELECT id FROM items;')
    c.close()
    found = read(path, tables=["items"])
    assert [(e.id, e.data) for e in found] == [('"main"."items":key:[1]', {"id": 1, "value": "ok"}), ('"main"."items":key:[2]', {"id": 2, "value": "hex:00ff"})]
    assert [e.id for e in read(path)][-1] == '"main"."odd""; name":key:[7,"x"]' and len(read(path)) == 3
    assert len(read(path, tables=["v"])) == 2 and len(read(path, tables=["items", "main.items"])) == 2
    with pytest.raises(SourceError):
        read(path, tables=["none"])
    assert [e.id for e in read(path, tables=["items"], id_column="value")] == ['"main"."items":key:["ok"]', '"main"."items":key:["hex:00ff"]']
    alone = tmp_path / "views.db"
    c = sqlite3.connect(alone)
    c.execute("CREATE VIEW v AS SELECT 1 AS a")
    c.close()
    with pytest.raises(SourceError):
        read(alone)


def test_kinds_of_tables(tmp_path):
    from siftwell.sources.databases import tables_of

    path = tmp_path / "a.db"
    c = sqlite3.connect(path)
    c.executescript("CREATE TABLE t (raw BLOB, b INTEGER GENERATED ALWAYS AS (1), a TEXT, PRIMARY KEY (a, raw)); CREATE VIEW v AS SELECT a FROM t; CREATE VIRTUAL TABLE s USING fts5(words); CREATE TABLE auto (id INTEGER PRIMARY KEY AUTOINCREMENT);")
    c.close()
    assert {t.name: (t.kind, t.key) for t in tables_of(path)} == {"t": ("table", ("a", "raw")), "v": ("view", ()), "s": ("virtual", ()), "auto": ("table", ("id",))}
    duckdb = pytest.importorskip("duckdb")
    path = tmp_path / "a.duckdb"
    c = duckdb.connect(str(path))
    c.execute("CREATE TABLE t (x INTEGER, b INTEGER, a TEXT, PRIMARY KEY (b, a)); CREATE SCHEMA second; CREATE TABLE second.t (id INTEGER PRIMARY KEY, other INTEGER UNIQUE); CREATE VIEW v AS SELECT 1 AS one")
    c.close()
    assert {t.selector: (t.kind, t.columns, t.key) for t in tables_of(path)} == {'"main"."t"': ("table", ("x", "b", "a"), ("b", "a")), '"second"."t"': ("table", ("id", "other"), ("id",)), '"main"."v"': ("view", ("one",), ())}
    with pytest.raises(SourceError, match="ambiguous"):
        read(path, tables=["t"])
    assert read(path, tables=["second.t"]) == []


@pytest.mark.parametrize("kind", ["sqlite", "duckdb"])
def test_tables_by_ranges_of_their_keys(spark, tmp_path, kind):
    from siftwell.sources.datasource import register

    register(spark)
    path = str(tmp_path / f"a.{kind}")
    c = sqlite3.connect(path) if kind == "sqlite" else pytest.importorskip("duckdb").connect(path)
    c.execute("CREATE TABLE a (id INTEGER PRIMARY KEY, v TEXT)")
    c.execute("CREATE TABLE b (id TEXT PRIMARY KEY, v TEXT)")
    for i in range(-20, 80, 3):
        c.execute(f"INSERT INTO a VALUES ({i}, 'x')")
        c.execute(f"INSERT INTO b VALUES ('k{i}', 'y')")
    c.commit()
    c.close()
    whole = spark.read.format("entries").load(path)
    ranged = spark.read.format("entries").option("ranges", "4").load(path)
    assert ranged.rdd.getNumPartitions() == 5 and whole.rdd.getNumPartitions() == 2
    told = lambda f: [(r["id"], r["entry_json"]) for r in f.orderBy("ordinal").collect()]
    assert told(whole) == told(ranged) and len(told(whole)) == 68
    assert told(spark.read.format("entries").option("limit", "3").load(path)) == told(whole)[:3]
    assert spark.read.format("entries").option("limit", "40").option("ranges", "4").load(path).count() == 40


def test_duckdb(tmp_path):
    duckdb = pytest.importorskip("duckdb")
    path = tmp_path / "a.duckdb"
    c = duckdb.connect(str(path))
    c.execute("CREATE TABLE d AS SELECT 12.340::DECIMAL(20,3) AS n, DATE '2026-09-23' AS day, TIMESTAMP '2026-09-23 12:30:00' AS t, 'NaN'::DOUBLE AS nan, [1,2] AS l, {'x': 1} AS s, MAP {1: 'a'} AS m, INTERVAL 1 DAY AS i, '\\x00\\xFF'::BLOB AS b")
    c.close()
    (e,) = read(path)
    assert e.data == {"n": "12.340", "day": "2026-09-23", "t": "2026-09-23T12:30:00", "nan": "nan", "l": [1, 2], "s": {"x": 1}, "m": [{"key": 1, "value": "a"}], "i": "1 day, 0:00:00", "b": "hex:00ff"}


def test_data_source(spark, tmp_path):
    from siftwell.sources.datasource import register

    register(spark)
    path = made(tmp_path, "a.csv", "id,v\nx,1\ny,2\nz,3\n")
    rows = spark.read.format("entries").option("idColumn", "id").load(str(path)).orderBy("ordinal").collect()
    assert [(r["id"], r["entry_json"], r["fields"]) for r in rows][0] == ("x", '{"id":"x","v":"1"}', ["/id", "/v"])
    made(tmp_path, "b.csv", "id,v\nx,1\nbad\n")
    assert spark.read.format("entries").option("limit", "1").load(str(tmp_path / "b.csv")).count() == 1
