import json

import pytest

from siftwell.cli import run
from siftwell.functions.canonical import canonical
from siftwell.operators.config import Config, ConfigError
from siftwell.operators.evaluators import ContextLimitError, EvaluationError, InvalidResponse, LiteralEvaluator, check_response, evaluate_split, from_questions, retry_delay, says_too_large, to_questions
from siftwell.operators.planner import BatchOptions, PlanError, make_request, pack, plan, plans, preview, windows
from siftwell.operators.report import ReportError, order_keys, translated
from siftwell.operators.scan import Stats, Store, scan, scan_frame
from siftwell.operators.selection import Selection, SelectionError
from siftwell.sources.readers import Entry


def entries(n=4, k=2):
    return [Entry(f"e{i}", {f"f{j}": "BAD" if not j and i % 2 else f"value {i}{j}" for j in range(k)}) for i in range(n)]


def test_scan_rolls_up_and_keeps_order():
    found = list(scan(entries(), Config(), evaluator=LiteralEvaluator()))
    assert [r.id for r in found] == ["e0", "e1", "e2", "e3"]
    assert [(r.label, r.score, r.warning) for r in found[:2]] == [("NORMAL", 0.1, False), ("ANOMALY", 0.9, True)]


def test_threshold_is_inclusive_and_ties_go_to_the_first_path():
    (r,) = scan([Entry("a", {"/def": "BAD", "b": "BAD"})], Config(threshold=0.9), evaluator=LiteralEvaluator())
    assert r.warning and [f.path for f in r.fields] == sorted(f.path for f in r.fields)


def test_store_answers_again_and_refresh_asks():
    store, e = Store(), LiteralEvaluator()
    assert [r.cached for r in scan(entries(), Config(), store=store, evaluator=e)] == [False] * 4 and e.calls == 4
    assert [r.cached for r in scan(entries(), Config(), store=store, evaluator=e)] == [True] * 4 and e.calls == 4
    list(scan(entries(), Config(), store=store, evaluator=e, refresh=True))
    assert e.calls == 8
    list(scan(entries(), Config(guidance="other"), store=store, evaluator=e))
    assert e.calls == 12


def test_store_file_survives(tmp_path):
    path = str(tmp_path / "a.jsonl")
    list(scan(entries(), Config(), store=Store(path), evaluator=LiteralEvaluator()))
    with open(path, "a") as f:
        f.write('{"cut":')
    e = LiteralEvaluator()
    assert all(r.cached for r in scan(entries(), Config(), store=Store(path), evaluator=e)) and not e.calls


def test_shared_requests_pack_and_dedupe():
    e, stats = LiteralEvaluator(), Stats()
    same = [Entry(x, {"v": "BAD"}) for x in "abc"]
    found = list(scan(same, Config(guidance="rule. " * 500), evaluator=e, options=BatchOptions("auto"), stats=stats))
    assert e.calls == 1 and [r.cached for r in found] == [False, True, True] and stats.input_tokens == 50
    assert all(r.usage.get("batch_request_hashes") for r in found)


def test_layout_and_budgets():
    config = Config(guidance="rule. " * 500)
    assert plan(entries()[0], config, BatchOptions("auto")).layout == "shared"
    assert plan(entries()[0], Config(), BatchOptions(1)).layout == "entry"
    with pytest.raises(PlanError):
        plan(entries()[0], config, BatchOptions(4, 500))
    with pytest.raises(PlanError):
        BatchOptions(0)
    with pytest.raises(PlanError):
        list(plans([*entries(1), *entries(1)], Config(), BatchOptions()))
    many = list(plans(entries(10), config, BatchOptions(3)))
    assert [len(w) for w in windows(many, BatchOptions(3))] == [3, 3, 3, 1]
    assert all(len(b.owners) == len(b.request["questions"]) for b in pack(many, BatchOptions(3)))


def test_preview_is_what_a_cold_scan_sends():
    sent = []

    class Spy(LiteralEvaluator):
        def evaluate(self, request):
            sent.append(canonical(request))
            return super().evaluate(request)

    for options in (BatchOptions(), BatchOptions("auto")):
        sent.clear()
        config = Config(guidance="rule. " * 500)
        list(scan(entries(), config, evaluator=Spy(), options=options))
        assert sent == [canonical(p["request"]) for p in preview(entries(), config, options)]


def test_halving():
    class Small(LiteralEvaluator):
        def evaluate(self, request):
            if len(request["questions"]) > 2:
                self.calls += 1
                raise ContextLimitError("too large")
            return super().evaluate(request)

    e = Small()
    request = make_request(Entry("a", {f"f{i}": i for i in range(7)}), Config())
    parts = evaluate_split(e, request)
    assert sum(len(r["questions"]) for r, _ in parts) == 7 and e.calls == 7


@pytest.mark.parametrize(
    "change",
    [
        lambda a: a.pop("field_0"),
        lambda a: a.update(extra=a["field_0"]),
        lambda a: a["field_0"].update(type="text"),
        lambda a: a["field_0"].update(choice="NORMAL"),
        lambda a: a["field_0"].update(confidence=2),
        lambda a: a["field_0"]["probabilities"].update(NORMAL=0.5),
        lambda a: a["field_0"]["probabilities"].pop("NORMAL"),
        lambda a: a["field_0"]["probabilities"].update(NORMAL=float("nan")),
    ],
)
def test_bad_answers(change):
    request = make_request(Entry("a", {"v": "BAD"}), Config())
    response = LiteralEvaluator().evaluate(request)
    check_response(response, request)
    change(response["answers"])
    with pytest.raises(InvalidResponse):
        check_response(response, request)


def test_wire_forms_and_retries():
    request = make_request(Entry("a", {"v": "BAD"}), Config())
    wire = to_questions(request)
    assert wire["questions"][0]["choices"][0]["value"] == "NORMAL"
    a = LiteralEvaluator().evaluate(request)["answers"]["field_0"]
    back = from_questions({"model": "m", "answers": [{"name": "field_0", "type": "choice", "choice": a["choice"], "probabilities": [{"value": k, "probability": v} for k, v in a["probabilities"].items()], "confidence": 0.8}]}, request)
    check_response(back, request)
    with pytest.raises(EvaluationError):
        from_questions({"model": "m", "answers": [{"type": "refusal", "name": "field_0"}]}, request)
    assert [retry_delay(x, 0, 0) for x in (None, "5", "inf", "99", "Thu, 01 Jan 1970 00:00:10 GMT", "soon")] == [1, 5, 1, 30, 10, 1]
    too_large = [(400, {"code": "context_length_exceeded"}), (413, {"error": {"code": "input_tokens_exceeded"}}), (400, {"detail": {"error_type": "max_tokens_exceeded"}}), (422, {"detail": "The context window was exceeded"}), (400, {"error": {"message": "input is too long for the token limit"}})]
    other = [(413, ""), (413, {"message": "body exceeds 1 MB"}), (500, {"code": "context_length_exceeded"}), (400, {"note": "context length exceeded"}), (422, ["context length exceeded"]), (400, {"code": 7}), (400, {"error": "the window is too large"}), (400, {"message": "Tokens expire. The name is too long"}), (400, b"[1")]
    assert all(says_too_large(s, json.dumps(b).encode()) for s, b in too_large) and not any(says_too_large(s, b if isinstance(b, bytes) else json.dumps(b).encode()) for s, b in other) and not says_too_large(413, b"<html>")
    assert retry_delay("Thu, 01 Jan 1970 00:00:20 -0000", 0, now=0.0) == 20.0


def test_config_checks():
    for bad in ({"labels": ("A",)}, {"labels": ("A", "A")}, {"anomaly_label": "X"}, {"criteria": {"NORMAL": None}}, {"threshold": 2}):
        with pytest.raises(ConfigError):
            Config(**bad)


def test_selection_checks():
    for bad in ((["/a"], ["/a"]), (["/a", "/a"], [])):
        with pytest.raises(SelectionError):
            Selection.of(*bad)
    with pytest.raises(SelectionError):
        Selection.of(relaxed=True)


@pytest.mark.parametrize("text", ["score > (SELECT 1)", "row_number() OVER () > 1", "score > 1; DROP TABLE x", "", "score > 0) OR (1=1", "rand() > 0.5", "explode(fields) = 1"])
def test_row_expressions_that_are_refused(text):
    with pytest.raises(ReportError):
        translated(text)


def test_row_expressions(spark):
    from siftwell.operators.report import where

    rows = spark.createDataFrame([("a", 0.9, '{"k":"x","n":{"m":3}}'), ("b", 0.2, '{"k":"y"}'), ("c", None, None)], "id string, score double, value string")
    keep = lambda e: [r["id"] for r in where(rows, e).orderBy("id").collect()]
    assert keep("value ->> 'k' = 'x'") == ["a"] and keep("score >= 0.2 -- all\n") == ["a", "b"] and keep("CAST(value ->> '/n/m' AS INT) = 3") == ["a"]
    assert keep("starts_with(id, 'a') OR score IS NULL") == ["a", "c"]
    assert keep("CAST(score * 10 AS INT) // 2") == ["a", "b"] and keep("round(score * 10)::INT ** 2 = 81") == ["a"] and keep("2 ** (1 + 1) = 4 AND id = 'b'") == ["b"]
    assert keep("id[1:1] = 'c'") == ["c"] and keep("list_filter(split('p,q,r', ','), lambda x: x > 'p')[2:] = array('r') AND split(id, ',')[1] = 'a'") == ["a"]
    assert keep("strftime(strptime('2020-01-02', '%Y-%m-%d'), '%d of %b') = '02 of Jan' AND epoch(strptime('1970-01-01', '%Y-%m-%d')) = 0 AND score > 0.5") == ["a"]
    assert keep("json_extract(value, '$.k') = '\"x\"' AND json_extract(value, '/n/m') = '3'") == ["a"] and keep("json_extract(value, '$.none') IS NULL AND value IS NOT NULL") == ["a", "b"]
    for bad in ("json_extract(value, id) = 'x'", "json_extract(value) = 'x'", "sum(score) > 1", "none_such = 1", "strftime(id, id)", "strptime(id, '%Q') > id"):
        with pytest.raises(ReportError):
            where(rows, bad)
    assert [r["id"] for r in rows.orderBy(*order_keys(rows, "score DESC")).collect()] == ["a", "b", "c"]
    assert [r["id"] for r in rows.orderBy(*order_keys(rows, "2 NULLS FIRST")).collect()] == ["c", "b", "a"]
    assert [r["id"] for r in rows.orderBy(*order_keys(rows, "ALL DESC")).collect()] == ["c", "b", "a"]


def test_scan_frame(spark, tmp_path):
    rows = [(i, e.id, None, canonical(e.data), e.paths(), []) for i, e in enumerate([*entries(), Entry("copy", entries()[0].data)])]
    frame = spark.createDataFrame(rows, "ordinal long, id string, source string, entry_json string, fields array<string>, absent array<string>")
    first = scan_frame(frame, Config(), str(tmp_path / "store")).orderBy("ordinal").collect()
    assert [(r["id"], r["label"], r["cached"]) for r in first] == [("e0", "NORMAL", False), ("e1", "ANOMALY", False), ("e2", "NORMAL", False), ("e3", "ANOMALY", False), ("copy", "NORMAL", True)]
    again = scan_frame(frame, Config(), str(tmp_path / "store")).orderBy("ordinal").collect()
    assert all(r["cached"] for r in again) and [r["score"] for r in again] == [r["score"] for r in first]


def test_stream(spark, tmp_path):
    from siftwell.streaming.incremental import scan_stream

    rows = [(i, e.id, None, canonical(e.data), e.paths(), []) for i, e in enumerate(entries())]
    schema = "ordinal long, id string, source string, entry_json string, fields array<string>, absent array<string>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    scan_stream(stream, Config(), str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_command_line(tmp_path, capsys, spark, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "x.csv").write_text("id,value\na,ok\nb,BAD\nc,ok\n")
    assert run(["scan", "x.csv", "--id-column", "id", "-w"]) == 0
    out = capsys.readouterr()
    assert [json.loads(x)["id"] for x in out.out.splitlines()] == ["b"] and "assessed 3, cached 0, warnings 1, emitted 1" in out.err
    assert run(["scan", "x.csv", "--id-column", "id", "--rows", "fields", "-O", "csv", "-a"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2
    assert run(["scan", "x.csv", "--order-by", "score DESC", "--where", "score > 0.05"], spark=spark) == 0
    assert [json.loads(x)["id"] for x in capsys.readouterr().out.splitlines()] == ["2", "1", "3"]
    assert run(["scan", "x.csv", "-O", "yaml", "-t", "0.99"]) == 0 and capsys.readouterr().out == "[]\n"
    assert run(["preview", "x.csv", "-l", "1"]) == 0 and len(capsys.readouterr().out.splitlines()) == 1
    for bad in (["scan", "x.csv", "-o", "x.csv"], ["scan", "x.csv", "-s", "--sort-score"], ["scan", "x.csv", "-f", "/none"], ["scan", "none.csv"], ["scan", "x.csv", "--batch-size", "0"]):
        assert run(bad) == 1
    assert run(["scan"]) == 2 and run(["formats"]) == 0


def test_windows_count_the_shared_state_once():
    config, options = Config(guidance="long guidance " * 500), BatchOptions("auto")
    found = list(plans(entries(30), config, options))
    got = list(windows(found, options))
    assert [p.layout for p in found] == ["shared"] * 30 and len(got) == 1
    assert sum(1 for w in got for _ in pack(w, options)) == 1


def test_windows_give_out_what_they_hold_before_an_error():
    def broken():
        yield from plans(entries(3), Config(guidance="rule. " * 500), options)
        raise ValueError("torn")

    options = BatchOptions("auto")
    got = windows(broken(), options)
    assert len(next(got)) == 3
    with pytest.raises(ValueError, match="torn"):
        next(got)


def test_id_column_replaces_a_parsers_own(tmp_path, capsys):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"current": "now", "value": "ok"}))
    config = tmp_path / "config.py"
    config.write_text("import functools\nfrom siftwell.operators.config import Config\nfrom siftwell.sources.readers import read_json\nconfig = Config(parser=functools.partial(read_json, id_column='old'))\n")
    assert run(["preview", str(path), "--config", str(config), "--id-column", "current"]) == 0
    assert json.loads(capsys.readouterr().out)["id"] == "now"
    assert run(["preview", str(path), "--config", str(config)]) == 1


def test_a_scan_that_is_left_closes_what_it_holds(tmp_path, monkeypatch):
    closed = []

    def source():
        try:
            yield from entries()
        finally:
            closed.append("source")

    class Closing(LiteralEvaluator):
        def close(self):
            closed.append("evaluator")

    monkeypatch.setattr("siftwell.operators.scan.for_model", lambda _: Closing())
    path = str(tmp_path / "a.jsonl")
    store = Store(path)
    running = scan(source(), Config(), store=store)
    next(running)
    with pytest.raises(EvaluationError, match="another run"):
        Store(path).put("k", {}, "now")
    running.close()
    assert closed == ["source", "evaluator"] and store._file is None
    given = Closing()
    list(scan(entries(), Config(), evaluator=given))
    assert closed == ["source", "evaluator"]  # a given evaluator stays open
    with open(path, "a") as f:
        f.write('{"cut":')
    list(scan(entries(), Config(), store=Store(path)))
    assert len(Store(path).answers) == 4


def test_answers_of_tasks_that_ended_outlive_a_failed_job(spark, tmp_path):
    rows = [(i, e.id, None, canonical(e.data), e.paths(), []) for i, e in enumerate(entries(8))]
    frame = spark.createDataFrame(rows, "ordinal long, id string, source string, entry_json string, fields array<string>, absent array<string>")
    log = str(tmp_path / "asked")

    def maker(broken):
        class Logged(LiteralEvaluator):
            def evaluate(self, request):
                value = str(request["questions"]["field_1"]["instructions"]["field_value"])
                if broken and value == "value 51":
                    import time

                    time.sleep(15)  # the other tasks end first
                    raise EvaluationError("down")
                with open(log, "a") as f:
                    f.write(value + "\n")
                return super().evaluate(request)

        return Logged

    with pytest.raises(Exception, match="down"):
        scan_frame(frame, Config(), str(tmp_path / "store"), maker(True))
    stored = spark.read.parquet(str(tmp_path / "store")).count()
    before = len(open(log).read().split("\n")) - 1
    assert 0 < stored < 8
    assert scan_frame(frame, Config(), str(tmp_path / "store"), maker(False)).count() == 8
    assert len(open(log).read().split("\n")) - 1 - before == 8 - stored


@pytest.mark.parametrize(("change", "problem"), [({}, "ok"), ({"kind": "text"}, "kind"), ({"kind": None}, "kind"), ({"probabilities": {"A": 1.0}}, "labels"), ({"probabilities": {"A": 0.2, "B": 0.8, "C": 0.0}}, "labels"), ({"confidence": 2.0}, "range"), ({"confidence": None}, "range"), ({"probabilities": {"A": float("nan"), "B": 0.8}}, "range"), ({"probabilities": {"A": -0.1, "B": 1.1}}, "range"), ({"probabilities": {"A": 0.21, "B": 0.8}}, "ok"), ({"probabilities": {"A": 0.22, "B": 0.8}}, "sum"), ({"probabilities": {"A": 0.2005, "B": 0.8}}, "ok"), ({"probabilities": {"A": 0.2015, "B": 0.8}}, "sum"), ({"choice": "A"}, "choice"), ({"choice": "Z"}, "choice"), ({"choice": "A", "probabilities": {"A": 0.5, "B": 0.5}}, "ok")])
def test_answers_are_judged_as_a_process_does(spark, change, problem):
    from pyspark.sql import functions as F

    from siftwell.operators.cache import answer_problem

    answer = {"kind": "choice", "choice": "B", "probabilities": {"A": 0.2, "B": 0.8}, "confidence": 0.5} | change
    row = spark.createDataFrame([(answer["kind"], answer["choice"], answer["probabilities"], answer["confidence"])], "kind string, choice string, probabilities map<string,double>, confidence double")
    assert row.select(answer_problem(F.col("kind"), F.col("choice"), F.col("probabilities"), F.col("confidence"), F.array(F.lit("B"), F.lit("A")))).first()[0] == problem
    request = {"questions": {"q": {"criteria": {"B": None, "A": None}}}}
    response = {"model": "m", "answers": {"q": {"type": answer["kind"], "choice": answer["choice"], "probabilities": answer["probabilities"], "confidence": answer["confidence"]}}}
    if problem == "ok":
        check_response(response, request)
    else:
        with pytest.raises(InvalidResponse):
            check_response(response, request)


def test_responses_are_judged_as_a_whole(spark):
    from pyspark.sql import functions as F

    from siftwell.operators.cache import response_problem

    rows = [("m", ["a", "b"], ["b", "a"], None, "ok"), ("m", ["a"], ["a"], "{}", "ok"), (None, ["a"], ["a"], None, "model"), ("m", ["a"], [], None, "questions"), ("m", ["a"], ["a", "a"], None, "questions"), ("m", ["a"], ["a"], "[1]", "usage")]
    found = spark.createDataFrame(rows, "model string, q array<string>, a array<string>, usage string, want string")
    assert [r for r in found.select("want", response_problem(F.col("model"), F.col("q"), F.col("a"), F.col("usage")).alias("got")).collect() if r["want"] != r["got"]] == []
