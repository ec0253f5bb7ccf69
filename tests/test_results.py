import json

import pytest
from siftwell.operators import analytics, results, traces
from siftwell.sources.readers import SourceError

EVENTS = [{"kind": "start"}, {"kind": "message", "role": "user", "text": "a"}, {"kind": "tool"}, {"kind": "message", "role": "user", "text": "b"}]


def test_trace_files(spark, tmp_path):
    plain, wrapped = {"events": EVENTS}, {"session": {"session_id": "s", "events": EVENTS[1:]}, "about": 1}
    found = list(traces.event_entries(json.dumps(plain), "dir/one.json"))
    assert [e.id for e in found] == ["one:0-1", "one:1-3", "one:3-4"] and found[1].source == "dir/one.json#/events/1"
    assert [x["source_pointer"] for x in found[2].data["prior_user_messages"]] == ["/events/1"] and found[1].data["segment"][1] == {"source_pointer": "/events/2", "event": {"kind": "tool"}}
    (all_,) = traces.event_entries(json.dumps(wrapped), "two.json", whole=True)
    assert all_.id == "s:0-3" and all_.data["scope"] == "whole_trace" and all_.data["prior_user_messages"] == []
    assert not list(traces.event_entries('{"events": []}', "x"))
    for bad in ("[]", "{}", '{"events": [1]}', '{"session": 3}'):
        with pytest.raises(SourceError):
            list(traces.event_entries(bad, "x"))
    for name, x in (("one", plain), ("two", wrapped)):
        (tmp_path / f"{name}.json").write_text(json.dumps(x))
    rows = traces.read_events(spark, str(tmp_path)).orderBy("id").collect()
    assert [r["id"] for r in rows] == ["one:0-1", "one:1-3", "one:3-4", "s:0-2", "s:2-3"] and json.loads(rows[1]["entry_json"]) == found[1].data


def test_labels_never_reach_an_entry(spark):
    rows = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")], "x", 5)], "total_index int, messages array<struct<role:string,text:string>>, answer_text string, final_label int")
    (r,) = traces.selected(rows, ["messages", "answer_text", "tools"]).collect()
    assert r["fields"] == ["/messages/1", "/answer_text"] and set(json.loads(r["entry_json"])) == {"messages", "answer_text"}


FIELDS = "array<struct<path:string,value:string,label:string,confidence:double,score:double>>"


def report(spark):
    rows = [("a", [("/ident", "I|1", "NORMAL", 0.8, 0.1), ("/v", "x", "ANOMALY", 0.8, 0.9)], "ANOMALY", 0.9, True, "m", "2026-01-02T00:00:00"), ("b", [("/v", "y", "NORMAL", 0.8, 0.2)], "NORMAL", 0.2, False, "m", "2026-01-03T00:00:00")]
    return spark.createDataFrame(rows, f"id string, fields {FIELDS}, label string, score double, warning boolean, model string, assessed_at string")


def test_result_tables(spark, tmp_path):
    assert [r["entry"] for r in results.entry_table(report(spark)).orderBy("entry").collect()] == ["a · I|1", "b"]
    assert [(r["entry"], r["field"], r["score"]) for r in results.flagged_table(report(spark)).collect()] == [("a · I|1", "/v", 0.9)]
    assert results.first_warning(report(spark)).collect()[0]["id"] == "a" and not results.first_warning(report(spark).where("not warning")).count()
    path = tmp_path / "page.md"
    results.write_tables(report(spark), str(path), summary="assessed 2")
    text = path.read_text()
    assert "2026-01-02, 2026-01-03" in text and "| a · I\\|1 | ANOMALY | 0.90 | Yes |" in text and "| b | NORMAL | 0.20 | No |" in text and text.count("```") == 4
    results.write_tables(report(spark).where("not warning"), str(path))
    assert "whole entry" not in path.read_text()


def test_evaluation_files(spark, tmp_path):
    told = spark.createDataFrame([("a", "/v", "bad"), ("a", "/answer_text", "good"), ("b", "/v", "good")], "id string, path string, label string")
    people = spark.createDataFrame([("a", "/v", "x", "bad"), ("a", "/answer_text", "x", "bad"), ("b", "/v", "y", "good")], "id string, path string, domain string, gold string")
    results.write_evaluation(results.judged(told, people), ["bad", "good"], "bad", str(tmp_path / "e"))
    by = {(r["kind"], r["domain"]): r for r in spark.read.json(str(tmp_path / "e" / "metrics")).collect()}
    assert {*by} == {("step", None), ("step", "x"), ("step", "y"), ("outcome", None), ("outcome", "x")}
    assert by["step", None]["n"] == 2 and by["step", None]["accuracy"] == 1 and by["outcome", None]["recall"] == 0 and by["outcome", "x"]["confusion"] == [[0, 1], [0, 0]]
    assert spark.read.json(str(tmp_path / "e" / "fields")).count() == 3
    with pytest.raises(Exception, match="not in both"):
        results.judged(told.limit(1), people).collect()


def test_confusion_has_every_kind(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b")], "gold string, pred string")
    assert {r["gold"]: (r["a"], r["b"]) for r in analytics.confusion(rows, "gold", "pred", ["a", "b"]).collect()} == {"a": (1, 1), "b": (0, 0)}
    assert [tuple(r) for r in analytics.confusion(rows.limit(0), "gold", "pred", ["a"]).collect()] == [("a", 0)]


def test_alternating_pick(spark):
    rows = [(d, i % 2, i // 3, i) for d in "xy" for i in range(30)] + [("z", 0, 1, 0), ("z", 1, 1, 1), ("z", 0, 2, 2)]
    frame = spark.createDataFrame(rows, "domain string, label int, query int, i int")
    labels = [0, 1, 0, 1]
    found = analytics.alternating(frame, "domain", "label", "query", "s", ["domain", "i"], labels).collect()
    import hashlib

    for domain in "xyz":
        order = sorted((r for r in rows if r[0] == domain), key=lambda r: hashlib.sha256(f"s:{r[0]}:{r[3]}".encode()).hexdigest())
        used, want = set(), []
        for step, label in enumerate(labels, 1):
            for r in order:
                if r[1] == label and r[2] not in used:
                    used.add(r[2])
                    want.append((step, r[3]))
                    break
        assert sorted((r["step"], r["i"]) for r in found if r["domain"] == domain) == want


def test_planned_requests(spark):
    rows = spark.createDataFrame([("entry", 5), ("shared", 7)], "layout string, estimated_tokens long")
    assert tuple(analytics.planned(rows).first()) == (2, 12, ["entry", "shared"])


def test_shared_contexts_say_what_lists_say(spark):
    """Stretches of two turns, a long conversation, turns without a user before them, and gaps between places."""
    from pyspark.sql import functions as F

    from siftwell.operators.traces import context_pieces, prior_counts, prior_lists, prior_messages

    rows = [(1, i, "user" if i % 3 == 0 else "assistant", f"t{i}") for i in range(25)] + [(2, 0, "assistant", "a"), (2, 7, "user", "b"), (2, 9, "tool", None), (2, 10, "user", "c"), (3, 4, "user", "only")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    counted, pieces = prior_counts(turns, size=2), context_pieces(turns, size=2)
    expected = {(r["conv_id"], r["turn"]): [tuple(x) for x in r["prior"]] for r in prior_messages(turns, text="text").collect()}
    assert {(r["conv_id"], r["turn"]): r["n_prior"] for r in counted.collect()} == {k: len(v) for k, v in expected.items()}
    found = {(r["conv_id"], r["turn"]): [tuple(x) for x in r["prior"]] for r in prior_lists(counted.select("conv_id", "turn", "n_prior"), pieces).collect()}
    assert found == expected
    assert pieces.select(F.sum(F.size("users"))).first()[0] == sum(r[2] == "user" for r in rows)
