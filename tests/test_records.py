import json
import random
import re

import pytest

from siftwell.functions.canonical import canonical
from siftwell.operators.records import carried, cut, fasta_entries, file_lines, follows, gmt_entries, grouped, joined_lines, obo_entries, piece_lines, text_entries
from siftwell.sources.readers import SourceError, reader_for


def scrambled(seed, n=300):
    rng = random.Random(seed)
    return "".join(rng.choice(["a", "é", "\n", "\n", "> h", "\n>", " ", "\\\n", "word ", "\U0001f600"]) for _ in range(n))


TEXTS = ["", "\n", "a", "a\n", "\n\n", "a\n\nb\n", ">x\nAC\n>y\nG", *[scrambled(i) for i in range(12)]]


def as_lines(text):
    return (text.split("\n")[:-1] if text.endswith("\n") else text.split("\n")) if text else []


@pytest.mark.parametrize("size", [1, 3, 7, 50, 10_000])
def test_lines_and_carries_are_the_same_for_any_cut(spark, size):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "i long, t string")
    lines = piece_lines(cut(rows, "i", "t", size))
    blank = lines["line"].rlike("^ *$")
    found = carried(follows(lines, blank, "gap"), lines["line"].startswith(">"))
    got = {}
    for r in found.collect():
        got.setdefault(r["source"], []).append((r["line_no"], r["line"], r["gap"], r["start"]))
    for i, text in enumerate(TEXTS):
        start, expected = None, []
        own = as_lines(text)
        for n, line in enumerate(own, 1):
            start = n if line.startswith(">") else start
            expected.append((n, line, None if n == 1 else not own[n - 2].strip(" "), start))
        assert sorted(got.get(i, [])) == expected
    records = {(r["source"], r["start"]): [x["line"] for x in r["lines"]] for r in grouped(found).collect()}
    assert records[6, 1] == [">x", "AC"] and records[6, 3] == [">y", "G"]


def both(spark, path, kind, entries, **options):
    """What the reader of a process and the reader by ranges say, as comparable rows."""
    own = {"lineSep": "\n"} if kind == "text" else {}
    try:
        local = sorted((e.id, re.sub(r".*/", "", e.source), canonical(e.data), sorted(e.paths())) for e in reader_for(path, kind, {k: v for k, v in options.items() if v})())
    except SourceError:
        local = "fails"
    try:
        rows = entries(file_lines(spark, str(path), own.get("lineSep")), **options).collect()
        ranged = sorted((r["id"], re.sub(r".*/", "", r["source"]), canonical(json.loads(r["entry_json"])), sorted(r["fields"])) for r in rows)
        assert all(r["entry_json"] == canonical(json.loads(r["entry_json"])) for r in rows)
    except Exception as e:  # noqa: BLE001
        assert "USER_RAISED" in str(e), e
        ranged = "fails"
    return local, ranged


OBO = "format-version: 1.2\n! note\n[Term] ! first\nid: X:1\nname: one: two\nsynonym: a\nsynonym: b \\\n c \\\\\\\n d\nzeta/x~: \"q\"\n\n[Typedef]\r\nname: rel\n\n[Empty]\n"
FASTA = ">s1 about  it\nAC gt\nTT\n\n  >s2\t\nA\n>s3 x\n" + "ACGT\n" * 60
PLAIN = "﻿\none\ntwo\r\n\n \nthree \"q\" é\n\n\n" + "long line " * 30 + "\nend"


@pytest.mark.parametrize("split_bytes", ["40", "1000000"])
def test_files_by_ranges_are_read_as_by_a_process(spark, tmp_path, split_bytes):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name, text, kind, entries, options in (("a.obo", OBO, "obo", obo_entries, {}), ("b.obo", OBO, "obo", obo_entries, {"stanza": "Term"}), ("a.fa", FASTA, "fasta", fasta_entries, {}), ("a.gmt", "s\td\tm\tn\n\nt\t\tx\n", "gmt", gmt_entries, {}), ("a.txt", PLAIN, "text", text_entries, {}), ("b.txt", PLAIN, "text", text_entries, {"split": "lines"})):
            (tmp_path / name).write_bytes(text.encode())
            local, ranged = both(spark, tmp_path / name, kind, entries, **options)
            assert local == ranged and local != "fails" and local
            if split_bytes == "40" and len(text) > 200:
                assert file_lines(spark, str(tmp_path / name)).select("piece").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("kind", "entries", "text"), [("obo", obo_entries, "[Term\nid: a\n"), ("obo", obo_entries, "[]\n"), ("obo", obo_entries, "[T] x\n"), ("obo", obo_entries, "[T]\nno tag\n"), ("obo", obo_entries, "[T]\n_stanza: x\n"), ("obo", obo_entries, "[T]\nid: a\\\n"), ("fasta", fasta_entries, "ACGT\n"), ("fasta", fasta_entries, ">\nA\n"), ("fasta", fasta_entries, ">a\n>b\nA\n"), ("gmt", gmt_entries, "set\tdesc\n"), ("gmt", gmt_entries, "set\td\ta\t\tb\n")])
def test_what_one_reader_refuses_the_other_does(spark, tmp_path, kind, entries, text):
    path = tmp_path / f"a.{kind}"
    path.write_text(text)
    assert both(spark, path, kind, entries) == ("fails", "fails")


def test_gzip_and_joined_lines(spark, tmp_path):
    import gzip

    (tmp_path / "a.obo.gz").write_bytes(gzip.compress(OBO.encode()))
    local, ranged = both(spark, tmp_path / "a.obo.gz", "obo", obo_entries)
    assert local == ranged != "fails"
    for size in (1, 4, 100):
        rows = spark.createDataFrame([(1, "a\\\nb\\\\\nc\\\\\\\nd\n")], "i long, t string")
        assert sorted((r["line_no"], r["line"]) for r in joined_lines(piece_lines(cut(rows, "i", "t", size))).collect()) == [(1, "ab\\\\"), (3, "c\\\\d")]


def test_a_text_is_cut_in_one_pass(spark):
    """No piece's row carries the whole text, and no piece is counted from the text's beginning."""
    texts = [*TEXTS, "\U0001f600\r\n \x85x" * 9]
    rows = spark.createDataFrame([*enumerate(texts)], "i long, t string")
    for size in (1, 4, 97):
        found = cut(rows, "i", "t", size)
        got = {(r["source"], r["piece"]): r["text"] for r in found.collect()}
        assert got == {(i, k): t[lo : lo + size] for i, t in enumerate(texts) for k, lo in enumerate(range(0, max(1, len(t)), size))}
        assert "substring" not in found._jdf.queryExecution().optimizedPlan().toString()
