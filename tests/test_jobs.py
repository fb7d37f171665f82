import json

import pytest
from pyspark.sql import functions as F

from tests.test_files import GOOD, write
from tracefold.operators import export, records
from tracefold.plans import jobs


def call(i, tool, ok, content="", target="", h=""):
    return {"turn_id": i, "call_index_in_turn": 0, "global_index": i, "tool_name": tool, "params": {}, "params_hash": h, "target_file": target, "result_success": ok, "result_content": content, "timestamp": float(i)}


def test_classify(spark, tmp_path):
    v = {"final_passed": True, "tier1_pass": True, "tier2_pass": True, "tier2_command": "t"}
    good = GOOD | {"schema_version": "2.0", "verification": v, "tool_call_events": [call(0, "bash", False, "SyntaxError: x", h="a"), call(1, "bash", True, h="b")]}
    toxic = GOOD | {"trajectory_id": "t2", "schema_version": "2.0", "verification": v, "tool_call_events": [call(0, "file_edit", False, "SyntaxError: x", "a.py")]}
    old = GOOD | {"trajectory_id": "t3"}
    runs, tasks = write(tmp_path / "r.jsonl", good, toxic, old), write(tmp_path / "t.jsonl", {"instance_id": "i", "gold_patch": "diff --git a/x b/x\n@@ -1 +1 @@\n"})
    jobs.classify(spark, runs, tasks, str(tmp_path / "out"))
    labels = {r["run"]: r for r in spark.read.json(str(tmp_path / "out" / "labels")).collect()}
    assert {k: r["outcome"] for k, r in labels.items()} == {"t1": "verified_with_recovery", "t2": "toxic", "t3": "weakly_verified"}
    assert "B2.2" in labels["t2"]["categories"] and labels["t1"]["b11"]
    assert sorted(r["trajectory_id"] for r in spark.read.json(str(tmp_path / "out" / "non_toxic")).collect()) == ["t1", "t3"]
    summary = {(r["metric"], r["key"]): r["n"] for r in spark.read.json(str(tmp_path / "out" / "summary")).collect()}
    assert summary["total", "runs"] == 3 and summary["total", "toxic"] == 1 and summary["level", "none"] == 2


def test_chat(spark, tmp_path):
    assert jobs.to_chat(spark, write(tmp_path / "r.jsonl", GOOD, GOOD | {"trajectory_id": "u", "metadata": {"messages_json": '[{"role": "user", "content": "hi"}]'}}), str(tmp_path / "out"), "be good") == 2
    got = {json.loads(r[0])["metadata"]["trajectory_id"]: json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()}
    m = got["t1"]["messages"]
    assert [x["role"] for x in m] == ["system", "user", "assistant", "tool", "assistant", "assistant"] and m[0] == {"role": "system", "content": "be good"} and m[2]["tool_calls"][0]["id"] == m[3]["tool_call_id"]
    about = {"trajectory_id": "t1", "instance_id": "i", "model": "m", "seed": 1, "llm_claimed_success": True, "final_passed": True, "tier1_pass": True, "tier2_pass": False, "export_source": "reconstructed_attempts"}
    assert got["t1"]["metadata"] == about | {"token_usage": {"input_tokens": 2, "output_tokens": 3, "cache_read_tokens": 0, "cache_create_tokens": 0, "total_tokens": 5}}
    assert got["u"]["messages"] == [{"role": "user", "content": "hi"}] and got["u"]["metadata"]["export_source"] == "metadata_raw_messages"
    samples, faults = export.read_samples(spark, str(tmp_path / "out"), strict=False)
    assert samples.count() == 2 and faults.count() == 0


def test_faulty_samples(spark, tmp_path):
    ok = {"role": "user", "content": "a"}
    call = {"id": "x", "type": "function", "function": {"name": "f", "arguments": "{}"}}
    lines = [{"messages": [ok]}, {"messages": []}, {"messages": [ok | {"role": "odd"}]}, {"messages": [ok, ok | {"content": 5}]}, {"messages": [ok | {"tool_call_id": 1}]}, {"messages": [ok | {"tool_calls": [call | {"id": ""}]}]}, {"messages": [ok | {"tool_calls": [call | {"type": "x"}]}]}, {"messages": [ok | {"tool_calls": [call]}]}, "[1]", {"x": 1}]
    p = write(tmp_path / "s.jsonl", *[x if isinstance(x, str) else json.dumps(x) for x in lines])
    samples, faults = export.read_samples(spark, p, strict=False)
    assert samples.count() == 2 and {int(r["place"].rpartition(":")[2]): r["fault"] for r in faults.collect()} == {
        2: "no messages", 3: "role at 0", 4: "a message isn't made of texts", 5: "a message isn't made of texts", 6: "tool_calls at 0", 7: "tool_calls at 0", 9: "no JSON object", 10: "no messages",
    }
    with pytest.raises(Exception, match="s.jsonl:2: no messages"):
        export.read_samples(spark, p)[0].collect()


def test_compare_arms(spark, tmp_path):
    a = GOOD | {"schema_version": "2.0", "tool_call_events": [call(0, "bash", True), call(1, "file_edit", True, target="a.py")]}
    for n, rows, labels in (("x", [a, GOOD | {"trajectory_id": "t2"}], [{"trajectory_id": "t1", "outcome": "toxic", "recovery_event_count": 0}, {"trajectory_id": "t1", "outcome": "verified_one_shot", "recovery_event_count": 1}]), ("y", [GOOD], [{"trajectory_id": "other", "outcome": "failed", "recovery_event_count": 0}])):
        write(tmp_path / f"{n}.jsonl", *rows)
        write(tmp_path / f"{n}.labels.jsonl", *labels)
    jobs.main(["compare", str(tmp_path / "out"), "--arm", f"x:{tmp_path}/x.jsonl", "--arm", f"y:{tmp_path}/y.jsonl"])
    rows = {r["arm"]: r for r in json.loads(spark.read.text(str(tmp_path / "out" / "aggregates")).first()[0])}
    assert rows["x"]["n_runs"] == 2 and rows["x"]["success_rate"] == 0.5 and rows["x"]["recovery_rate"] == 0.5 and rows["x"]["avg_edits"] == 0.5 and rows["y"]["success_rate"] == 0
    assert {(r["arm"], r["outcome"]): r["pct"] for r in spark.read.json(str(tmp_path / "out" / "outcomes")).collect()} == {("x", "verified_one_shot"): 50.0, ("x", "unknown"): 50.0, ("y", "unknown"): 100.0}


def test_run_report(spark, tmp_path):
    jobs.report(spark.createDataFrame([(0, 0), (1, 2), (2, 0)], "ordinal long, exit_code int"), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"attempted": 2, "succeeded": 1, "failed": 0, "errors": 1}


def test_prepare(spark, tmp_path):
    r = {"instance_id": "a", "repo": "o/r", "base_commit": "c", "problem_statement": "p", "hints_text": "", "patch": "", "test_patch": "", "FAIL_TO_PASS": '["t_x"]', "PASS_TO_PASS": "[]"}
    jobs.prepare(spark, write(tmp_path / "r.jsonl", r), str(tmp_path / "out"))
    t = json.loads(spark.read.text(str(tmp_path / "out")).first()["value"])
    assert t["fail_to_pass"] == ["t_x"] and "gold_patch" not in t and t["tier2_command"].startswith("{python} -m pytest -k t_x")


RESULT = "trajectory_id string, instance_id string, task string, provider string, model string, seed long, created_at double, tool_names array<string>, declared_status string, declared_summary string, stop_reason string, error string, final_diff string, tier2_pass boolean, tier2_output string, verify boolean, input_tokens long, output_tokens long, elapsed_seconds double, n_calls long, cache_read_tokens long, cache_create_tokens long"


def test_result_records(spark):
    rows = [("t", "i", "d" * 300, "p", "m", 1, 1.0, ["bash"], "fixed", "s", "declared_done", None, "diff", True, "out", True, 3, 4, 1.23456, 2, 0, 0), ("u", "i", None, "p", "m", 1, 1.0, None, None, None, "error", "boom", " ", None, "", True, None, None, 2.0, None, None, None)]
    d = spark.createDataFrame(rows, RESULT)
    got = {r["trajectory_id"]: r for r in records.result_records(d).collect()}
    t, u = got["t"], got["u"]
    assert t["verification"].asDict() == {"final_passed": True, "tier1_pass": True, "tier2_pass": True, "tier2_command": "swebench:i"} and t["llm_claimed_success"]
    assert t["attempts"][0].asDict() == {"step_number": 1, "attempt_number": 1, "goal": "d" * 200, "status": "success", "target_files": [], "tool_names": ["bash"], "failure_reason": ""}
    assert t["metadata"] == {"provider": "p", "stop_reason": "declared_done", "elapsed_seconds": "1.235", "loop": "flat_react_v1", "declared_status": "fixed", "declared_summary": "s", "tier2_output": "out", "final_diff": "diff"}
    assert (u["attempts"][0]["status"], u["attempts"][0]["failure_reason"], u["verification"]["tier1_pass"], u["verification"]["tier2_command"]) == ("failed", "error", False, "")
    assert u["metadata"] == {"provider": "p", "stop_reason": "error", "elapsed_seconds": "2.0", "loop": "flat_react_v1", "declared_status": "", "error": "boom", "final_diff": " "}
    s = {r["trajectory_id"]: json.loads(r["summary"]) for r in records.result_summaries(d).collect()}
    assert s["t"]["success"] and s["t"]["usage"]["total_tokens"] == 7 and s["t"]["tool_call_count"] == 2 and s["t"]["elapsed_seconds"] == 1.23 and s["u"]["error"] == "boom" and s["u"]["tier2_output"] == ""
    assert spark.range(1).select(records.run_id(F.lit(12.9), F.lit("0a1b2c3d")).alias("x"), records.run_id(F.lit(5)).rlike("^traj-5-[0-9a-f]{8}$").alias("y")).first() == ("traj-12-0a1b2c3d", True)


def test_provider_messages(spark):
    call = [("c1", "function", ("bash", "{}"))]
    m = [("system", "s", None, None), ("user", None, None, None), ("assistant", "", None, call), ("tool_result", "out", "c1", None), ("tool_result", "plain", None, None)]
    d = spark.createDataFrame([(m,)], f"m array<{export.MESSAGE}>")
    native = d.select(records.provider_messages(F.col("m")).alias("x")).first()["x"]
    assert [(x["role"], x["content"], x["tool_call_id"]) for x in native] == [("system", "s", None), ("user", "", None), ("assistant", "", None), ("tool", "out", "c1"), ("user", "plain", None)] and native[2]["tool_calls"][0]["id"] == "c1"
    text = d.select(records.provider_messages(F.col("m"), True, "Tools: bash").alias("x")).first()["x"]
    assert [(x["role"], x["content"]) for x in text] == [("system", "s\n\nTools: bash"), ("user", ""), ("assistant", ""), ("user", "Tool result for c1:\nout"), ("user", "plain")] and not any(x["tool_calls"] or x["tool_call_id"] for x in text)


def test_temperatures_and_stops(spark):
    d = spark.createDataFrame([(0.0,), (-1.0,), (0.4,), (1.7,)], "t double")
    assert [r[0] for r in d.select(records.clamped(F.col("t"))).collect()] == [0.01, 0.01, 0.4, 1.0] and [r[0] for r in d.select(records.clamped(F.col("t"), False)).collect()] == [0.0, -1.0, 0.4, 1.7]
    d = spark.createDataFrame([("stop",), ("tool_calls",), ("length",), ("content_filter",), (None,)], "r string")
    assert [r[0] for r in d.select(records.plain_stop(F.col("r"))).collect()] == ["end_turn", "tool_use", "max_tokens", "end_turn", "end_turn"]


def test_many_files(spark):
    rows = [("a", 0, i, "file_edit", f"f{i % 4}", i != 1) for i in range(8)] + [("a", 1, 8, "file_edit", "g", True)]
    d = spark.createDataFrame(rows, "trajectory_id string, turn_id long, pos long, tool string, target_file string, ok boolean")
    assert sorted(tuple(r) for r in records.many_files(d, most=2).collect()) == [("a", 3, "f3"), ("a", 5, "f1")]


def test_small_rules(spark):
    d = spark.createDataFrame([(["ValueError", "TimeoutError"],), (["ValueError"],), (None,), (["X", "ReadTimeout"],), (["ConnectionError"],)], "c array<string>")
    assert [r[0] for r in d.select(records.retryable(F.col("c"))).collect()] == [True, False, False, True, False]
    s = spark.createDataFrame([("e", None, 1, False), (None, "fixed", 1, False), (None, None, 50, True), (None, "", 3, True)], "e string, d string, n int, x boolean")
    assert [r[0] for r in s.select(records.stop_reason(F.col("e"), F.col("d"), F.col("n"), 50, F.col("x"))).collect()] == ["error", "declared_done", "budget_exhausted", "end_turn"]
