import json
import random
import time

from tracefold.operators import sessions
from tracefold.sources import files
from tracefold.streaming import live

SCHEMA = "trajectory_id string, turn_id long, pos long, tool string, params string, params_hash string, target_file string, ok boolean"

def drain(query):
    query.processAllAvailable()
    query.stop()


def guard_rows():
    """What each check says, on runs made for it; files are read before they are edited unless said."""
    rows, want = [], {}

    def run(name, *calls):
        for i, (turn, tool, action, file, ok, verdict) in enumerate(calls):
            rows.append((name, turn, i, tool, "{}", action, file, ok))
            want[name, i] = verdict

    run("repeat", (0, "bash", "h", "", True, "ok"), (0, "bash", "h", "", True, "ok"), (0, "bash", "h", "", True, "repeated"), (0, "bash", "h", "", True, "repeated"), (1, "bash", "h", "", True, "ok"), (1, "search", "h", "", True, "ok"))
    run("errors", *[(i, "bash", f"h{i}", "", False, "ok" if i != 3 else "too_many_errors") for i in range(7)], (8, "bash", "z", "", True, "too_many_errors"), (9, "bash", "z", "", True, "ok"))
    run("unread", (0, "file_edit", "a", "x.py", True, "unread"), (0, "file_read", "b", "x.py", False, "ok"), (0, "file_edit", "a", "x.py", True, "unread"), (1, "file_read", "c", "x.py", True, "ok"), (2, "file_edit", "a", "x.py", True, "ok"), (2, "file_create", "d", "new.py", True, "ok"), (2, "file_edit", "e", "", True, "ok"))
    run("files", *[(0, "file_create", f"h{i}", f"f{i}", True, "ok" if i < 10 else "too_many_files") for i in range(12)], (0, "file_create", "again", "f3", True, "ok"), (1, "file_create", "h11", "f11", True, "ok"))
    run("step", *[(0, "bash", f"h{i}", "", True, "ok" if i < 15 else "over_step") for i in range(17)], (1, "bash", "z", "", True, "ok"))
    run("total", *[(i // 10, "bash", f"h{i}", "", True, "ok" if i < 100 else "over_total") for i in range(103)])
    rows.append(("nulls", None, 0, None, None, None, None, None))
    want["nulls", 0] = "ok"
    return rows, want


def test_guard_in_a_batch(spark):
    rows, want = guard_rows()
    assert {(r["trajectory_id"], r["pos"]): r["verdict"] for r in live.guarded(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def fed(spark, folder, schema, parts, make, name, checkpoint):
    """The rows of a stream that gets its input in parts."""
    query = None
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
        if query is None:
            query = make(spark.readStream.schema(schema).parquet(str(folder))).writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).outputMode("append").start()
        query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_guard_in_a_stream_equals_the_batch(spark, tmp_path):
    rows, want = guard_rows()
    parts = [r for r in rows if r[2] < 3], [r for r in rows if 3 <= r[2] < 11], [r for r in rows if r[2] >= 11]
    got = fed(spark, tmp_path / "in", SCHEMA, parts, live.guarded, "g", tmp_path / "cp")
    assert {(r["trajectory_id"], r["pos"]): r["verdict"] for r in got} == want


def test_nudges_in_a_stream_equal_the_batch(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"r{k}", i // 2, i, r.choice(["bash", "search", "file_read", "file_edit"] if k % 2 else ["search", "file_read", "file_edit"]), "", "", "", True) for k in range(12) for i in range(r.randint(1, 30))]
    got = fed(spark, tmp_path / "in", SCHEMA, ([x for x in rows if x[2] < 7], [x for x in rows if x[2] >= 7]), live.nudged, "n", tmp_path / "cp")
    d = spark.createDataFrame(rows, SCHEMA)
    last = {x["trajectory_id"]: x["t"] for x in d.groupBy("trajectory_id").agg({"turn_id": "max"}).withColumnRenamed("max(turn_id)", "t").collect()}
    want = {(x["trajectory_id"], x["pos"], x["turn_id"], name) for name, f in (("edit", sessions.edit_nudges), ("test", sessions.test_nudges)) for x in f(d).collect() if x["turn_id"] < last[x["trajectory_id"]]}
    assert {tuple(x) for x in got} == want and {x["nudge"] for x in got} == {"edit", "test"}


PIECES = "response_id string, seq long, idx long, call_id string, name string, part string, finished boolean"


def test_calls_assembled_in_a_stream(spark, tmp_path):
    rows = [
        ("a", 0, None, None, None, "text", False), ("a", 1, 1, "c1", "bash", '{"x":', False), ("a", 2, 0, "c0", "search", "", False), ("a", 3, 1, "no", None, " 1}", False), ("a", 4, None, None, None, None, True),
        ("b", 0, 0, "d0", "f", "{bad", False), ("b", 1, None, None, None, None, True), ("c", 0, 0, "e0", "f", "{}", False),
    ]
    got = fed(spark, tmp_path / "in", PIECES, (rows[:3] + rows[7:], rows[3:7]), live.assembled_stream, "c", tmp_path / "cp")
    want = {("a", 0, "c0", "search", "{}"), ("a", 1, "c1", "bash", '{"x": 1}'), ("b", 0, "d0", "f", "{}")}
    assert {tuple(r) for r in got} == want
    batch = live.assembled_calls(spark.createDataFrame(rows, PIECES).where("idx IS NOT NULL AND response_id <> 'c'"))
    assert {tuple(r) for r in batch.collect()} == want


def test_event_log_as_a_sink(spark, tmp_path):
    rows = [("llm_response", '{"usage": {"input_tokens": 5}}', 1.0), ("note", None, 2.0)]
    spark.createDataFrame(rows, "type string, data string, timestamp double").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = files.append_event_stream(spark.readStream.schema("type string, data string, timestamp double").parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).start()
    drain(q)
    back = {r["type"]: r for r in files.read_events(spark, str(tmp_path / "log")).collect()}
    assert json.loads(back["llm_response"]["data"]) == {"usage": {"input_tokens": 5}} and back["note"]["timestamp"] == 2.0
    assert live.token_totals(files.read_events(spark, str(tmp_path / "log"))).first()["input_tokens"] == 5


def test_event_totals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"type": "llm_response", "data": {"usage": {"input_tokens": 5, "output_tokens": 2}}, "timestamp": 1.0}, {"type": "tool_call", "data": {}, "timestamp": 2.0}, {"type": "llm_response", "data": {"usage": {"input_tokens": 7, "cache_read_tokens": 4}}, "timestamp": 3.0}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    q = live.token_totals(live.event_stream(spark, str(tmp_path / "in")), 3.0, 15.0).writeStream.format("memory").queryName("t").outputMode("complete").start()
    drain(q)
    assert tuple(spark.table("t").first()) == (2, 12, 2, 4, 0, (12 * 3.0 + 2 * 15.0) / 1_000_000)


def test_record_stream_marks_faults(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"trajectory_id": "t"}\n\n{bad\n')
    q = live.record_stream(spark, str(tmp_path / "in")).select("fault").writeStream.format("memory").queryName("f").outputMode("append").start()
    drain(q)
    assert sorted(r["fault"].split(":")[0] for r in spark.table("f").collect()) == ["no JSON object", "record"]


def test_windows(spark):
    d = spark.sql("SELECT timestamp'2025-01-01 00:10:00' AS at, 'a' AS k UNION ALL SELECT timestamp'2025-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2025-01-01 01:00:00', 'a'")
    assert sorted(r["n"] for r in live.windowed_counts(d, "at", "k").collect()) == [1, 2]
