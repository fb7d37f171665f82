import json

import pytest
from pyspark.sql import functions as F

from tracefold.sources import files

GOOD = {
    "trajectory_id": "t1", "schema_version": "1.0", "instance_id": "i", "task": "do", "model": "m", "seed": 1, "created_at": 1, "llm_claimed_success": True, "verification": {"final_passed": True, "tier1_pass": True, "tier2_pass": False},
    "attempts": [{"step_number": 1, "attempt_number": 1, "goal": "g", "status": "failed", "target_files": [], "tool_names": ["bash"]}], "token_usage": {"input_tokens": 2, "output_tokens": 3, "total_tokens": 5},
}


def write(path, *records):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n\n")
    return str(path)


def test_records_and_defaults(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", GOOD, "", GOOD | {"schema_version": "2.0", "tool_call_events": [{"turn_id": 0, "call_index_in_turn": 0, "global_index": 0, "tool_name": "bash", "params": {"command": "ls"}, "result_success": True, "result_content": "", "timestamp": 1, "params_hash": "", "target_file": ""}]})
    rows = files.read_records(spark, p)[0].orderBy("schema_version").collect()
    assert rows[0]["tool_call_events"] == [] and rows[0]["metadata"] == {} and rows[0]["token_usage"]["cache_read_tokens"] == 0
    assert rows[1]["tool_call_events"][0]["params"] == '{"command":"ls"}'


CALL = {"turn_id": 0, "call_index_in_turn": 0, "global_index": 0, "tool_name": "bash", "params": {"command": "ls", "n": 1.5}, "params_hash": "h", "target_file": "", "result_success": True, "result_content": "x", "error_signal": "NONE", "timestamp": 1.0}
ATTEMPT = GOOD["attempts"][0]


@pytest.mark.parametrize(
    "change, fault",
    [
        ({"extra": 1}, "record: unknown extra"), ({"schema_version": "9"}, "record.schema_version: unknown"), ({"trajectory_id": " "}, "record.trajectory_id: no text"), ({"seed": "a"}, "record.seed: no int"), ({"created_at": "1"}, "record.created_at: no number"),
        ({"task": 5}, "record.task: no text"), ({"verification": None}, "record.verification: no object"), ({"verification": {"final_passed": 1, "tier1_pass": True, "tier2_pass": True}}, "verification.final_passed: no boolean"),
        ({"token_usage": {"input_tokens": 2, "output_tokens": 3, "total_tokens": 9}}, "token_usage.total_tokens: not the sum"), ({"token_usage": {"input_tokens": 2}}, "token_usage: missing output_tokens"),
        ({"attempts": [ATTEMPT, ATTEMPT | {"status": "odd"}]}, "attempt.status: unknown odd"), ({"attempts": [{"status": "failed"}]}, "attempt: missing step_number,attempt_number,goal"), ({"attempts": [ATTEMPT | {"target_files": ["a", 1]}]}, "attempt.target_files: no strings"), ({"attempts": [5]}, "attempt: no object"),
        ({"attempts": "x"}, "record.attempts: no list"), ({"tool_call_events": [CALL, CALL | {"turn_id": "0"}]}, "call.turn_id: no int"), ({"tool_call_events": [CALL | {"error_signal": "X"}]}, "call.error_signal: unknown X"), ({"tool_call_events": [CALL | {"params": "x"}]}, "call.params: no object"),
        ({"metadata": {"a": 1}}, "record.metadata: no texts"),
    ],
)
def test_faults(spark, tmp_path, change, fault):
    p = write(tmp_path / "a.jsonl", GOOD, "", GOOD | change)
    good, bad = files.read_records(spark, p, strict=False)
    assert good.count() == 1 and [(r["place"], r["fault"]) for r in bad.collect()] == [(f"{p}:3", fault)]


def test_a_fault_is_an_error_with_its_place(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", *[GOOD] * 40, {"x": 1})
    with pytest.raises(Exception, match=r"a.jsonl:41: record: unknown x"):
        files.read_records(spark, p)[0].collect()


def test_missing_and_broken(spark, tmp_path):
    less = {k: v for k, v in GOOD.items() if k not in ("model", "attempts")}
    bad = files.read_records(spark, write(tmp_path / "a.jsonl", less, "{broken", "[1]"), strict=False)[1]
    assert sorted(r["fault"] for r in bad.collect()) == ["no JSON object", "no JSON object", "record: missing model"]
    few = {k: v for k, v in GOOD.items() if k not in ("attempts", "token_usage")}
    r = files.read_records(spark, write(tmp_path / "b.jsonl", few))[0].first()
    assert r["attempts"] == [] and r["token_usage"]["input_tokens"] == 0


def test_places_over_pieces(spark, tmp_path):
    p = write(tmp_path / "a.txt", *[f"line {i}" if i % 7 else " " for i in range(5000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = files.placed_lines(spark, p)
        assert got.rdd.getNumPartitions() > 3
        assert sorted((r["place"], r["value"]) for r in got.collect()) == sorted((f"{p}:{i + 1}", f"line {i}") for i in range(5000) if i % 7)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_round_trip(spark, tmp_path):
    full = GOOD | {"schema_version": "2.0", "tool_call_events": [CALL, CALL | {"params": {}}], "metadata": {"a": "b"}, "token_usage": {"input_tokens": 1, "output_tokens": 2, "cache_read_tokens": 0, "cache_create_tokens": 0, "total_tokens": 3}}
    full["attempts"] = [ATTEMPT | {"failure_reason": ""}]
    full["verification"] = full["verification"] | {"tier2_command": "c"}
    first = files.read_records(spark, write(tmp_path / "a.jsonl", full))[0]
    files.write_records(first, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == full
    again = files.read_records(spark, str(tmp_path / "out"))[0]
    assert again.collect() == first.collect()


def test_tasks_are_lenient_and_the_last_wins(spark, tmp_path):
    p = write(tmp_path / "t.jsonl", {"instance_id": "a", "gold_patch": "1"}, "{bad", {"x": 1}, {"instance_id": "a", "gold_patch": "2"})
    assert [tuple(r) for r in files.read_tasks(spark, p).collect()] == [("a", "2")]


def test_strict_tasks(spark, tmp_path):
    good = {"instance_id": "a", "task": "do", "more": 1}
    rows = files.read_task_rows(spark, write(tmp_path / "t.jsonl", good, "", good | {"cwd": "/x", "tier2_command": None})).collect()
    assert [tuple(r) for r in rows] == [("a", "do", None, None), ("a", "do", "/x", None)]
    for bad, why in ((good | {"task": " "}, "task must"), (good | {"cwd": ""}, "cwd must"), (good | {"instance_id": 5}, "instance_id must"), ([1], "no JSON object"), ("{", "no JSON object")):
        with pytest.raises(Exception, match=rf"t2.jsonl:2: {why}"):
            files.read_task_rows(spark, write(tmp_path / "t2.jsonl", good, bad if isinstance(bad, str) else json.dumps(bad))).collect()
    with pytest.raises(ValueError, match="no tasks"):
        files.read_task_rows(spark, write(tmp_path / "t3.jsonl", " "))


def test_any_tasks(spark, tmp_path):
    good = {"instance_id": "a", "task": "do", "repo": "r", "base_commit": "c", "extra": {"x": [1]}}
    assert files.read_any_tasks(spark, write(tmp_path / "t.jsonl", good)).first()["extra"]["x"] == [1]
    with pytest.raises(Exception, match="lacks repo"):
        files.read_any_tasks(spark, write(tmp_path / "u.jsonl", good, good | {"repo": " "})).collect()
    with pytest.raises(ValueError, match="lack base_commit"):
        files.read_any_tasks(spark, write(tmp_path / "v.jsonl", {"instance_id": "a", "task": "b", "repo": "c"}))
    with pytest.raises(Exception):
        files.read_any_tasks(spark, write(tmp_path / "w.jsonl", good, "{bad")).collect()


def test_benchmark_splits(spark, tmp_path):
    write(tmp_path / "test.jsonl", {"instance_id": "a"})
    assert files.read_benchmark(spark, str(tmp_path)).count() == 1
    with pytest.raises(FileNotFoundError):
        files.read_benchmark(spark, str(tmp_path), "dev")


def test_maps_reports_and_events(spark, tmp_path):
    assert [tuple(r) for r in files.read_map(spark, write(tmp_path / "m.json", {"a/b": "/x"})).collect()] == [("a/b", "/x")]
    d = spark.createDataFrame([('{"i": {"resolved": true}}',), ('{"resolved": false}',)], "r string").select(files.harness_result(F.col("r"), F.lit("i")).alias("h"))
    assert [r["h"]["resolved"] for r in d.collect()] == [True, False]
    p = write(tmp_path / "e.jsonl", {"type": "a", "data": {"k": 1}, "timestamp": 1.5}, {"type": "b", "data": {}, "timestamp": 2})
    assert files.read_events(spark, str(tmp_path / "none.jsonl")).count() == 0
    assert files.read_events(spark, p, "a").count() == 1 and files.read_events(spark, p).count() == 2


def test_source_files_and_search(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "src" / ".hidden").mkdir()
    (tmp_path / "src" / ".hidden" / "b.py").write_text("x = 1\n")
    f = files.source_files(spark, str(tmp_path / "src"))
    assert f.where("path = 'a.py'").first()["n_lines"] == 2
    assert [tuple(r) for r in files.search_lines(f, r"^y", path_like="*.py").collect()] == [("a.py", 2, "y = 2")]


def test_numbered_lines(spark):
    d = spark.createDataFrame([("\n".join(f"l{i}" for i in range(1, 101)),)], "t string")
    assert [x["n"] for x in d.select(files.numbered_lines(F.col("t"), 3, 4).alias("x")).first()["x"]] == [3, 4]
    assert len(d.select(files.numbered_lines(F.col("t"), long_chars=10).alias("x")).first()["x"]) == 70


def test_arm_needs_labels(spark, tmp_path):
    p = write(tmp_path / "arm.jsonl", GOOD)
    with pytest.raises(Exception):
        files.read_arm(spark, "x", p)
    write(tmp_path / "arm.labels.jsonl", {"trajectory_id": "t1", "outcome": "toxic"})
    records, labels = files.read_arm(spark, "x", p)
    assert records.first()["arm"] == "x" and labels.first()["outcome"] == "toxic"
