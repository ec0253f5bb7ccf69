import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from siftwell.functions.canonical import canonical
from siftwell.operators.config import Config
from siftwell.operators.evaluators import LiteralEvaluator
from siftwell.operators.report import ReportError
from siftwell.operators.scan import scan, scan_frame
from siftwell.operators.sinks import report_rows, write_rows
from siftwell.operators.writer import write_report
from siftwell.sources.readers import Entry

SCHEMA = "ordinal long, id string, source string, entry_json string, fields array<string>, absent array<string>"


@pytest.fixture(scope="module")
def assessed(spark, tmp_path_factory):
    """The same entries assessed by a process and as a frame."""
    found = [Entry(f"e{i}", {"a,b": "BAD" if i % 3 else 'say "x"\n', "n": i / 8, "z": {"k": [None, "é"]}}, source=None if i % 4 else f"s,{i}", absent=["/gone"] if i % 2 else []) for i in range(40)]
    rows = [(i, e.id, e.source, canonical(e.data), e.paths(), e.absent) for i, e in enumerate(found)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    store = str(tmp_path_factory.mktemp("store"))
    return list(scan(found, Config(), evaluator=LiteralEvaluator())), scan_frame(frame, Config(), store)


def without_times(text, kind):
    if kind == "jsonl":
        return [{k: v for k, v in json.loads(line).items() if k != "assessed_at"} for line in text.splitlines()]
    return [{k: v for k, v in r.items() if k != "assessed_at"} for r in csv.DictReader(io.StringIO(text))]


@pytest.mark.parametrize("kind", ["jsonl", "csv"])
@pytest.mark.parametrize("rows", ["entries", "fields"])
def test_a_report_of_many_tasks_is_that_of_a_process(assessed, tmp_path, kind, rows):
    results, frame = assessed
    out = io.StringIO()
    n = write_rows(out, (r for x in results for r in report_rows(x, rows, 0.5)), kind, rows)
    path = tmp_path / "report"
    told = write_report(frame, str(path), rows, kind)
    expected = without_times(out.getvalue(), kind)
    assert without_times(path.read_text(), kind) == expected
    assert told == {"assessed": 40, "warnings": sum(r.warning for r in results), "cached": 0, "lines": len(expected)} and n in (40, 120)
    assert path.read_text().splitlines()[0] == out.getvalue().splitlines()[0] or kind == "jsonl"


def test_parts_are_in_order_and_replace_what_was_there(spark, assessed, tmp_path):
    path = tmp_path / "parts"
    path.mkdir()
    (path / "old").write_text("x")
    write_report(assessed[1], str(path), single=False)
    parts = sorted(path.glob("part-*"))
    ids = [json.loads(line)["id"] for p in parts for line in p.read_text().splitlines()]
    assert ids == [f"e{i}" for i in range(40)] and not (path / "old").exists()


def test_a_failed_task_leaves_nothing(spark, assessed, tmp_path):
    path = tmp_path / "report"
    path.write_text("before")
    broken = assessed[1].withColumn("model", F.when(F.col("id") == "e7", F.raise_error(F.lit("torn"))).otherwise(F.col("model")))
    with pytest.raises(Exception, match="torn"):
        write_report(broken, str(path))
    assert path.read_text() == "before" and [x.name for x in tmp_path.iterdir()] == ["report"]
    with pytest.raises(ReportError):
        write_report(assessed[1], str(path), kind="yaml")


def test_no_results(spark, assessed, tmp_path):
    none = assessed[1].where("false")
    assert write_report(none, str(tmp_path / "a")) == {"assessed": 0, "warnings": 0, "cached": 0, "lines": 0} and (tmp_path / "a").read_text() == ""
    write_report(none, str(tmp_path / "b"), kind="csv")
    assert (tmp_path / "b").read_text().startswith("id,source,") and len((tmp_path / "b").read_text().splitlines()) == 1
