"""Queries over whole tables, against brute force on small ones."""

import hashlib
import json

from tracefold.operators.nested import elements, loaded
from tracefold.plans import data_queries, run_queries  # noqa: F401


def folder(spark, tmp_path, **tables):
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def brute_text(task, attempts, claimed, v, u):
    """The text of a rebuilt sample, message by message."""
    blocks = [("SYSTEM", ""), ("USER", task or "")]
    for i, a in enumerate(elements(loaded(attempts), "attempts")):
        blocks.append(("ASSISTANT", f"Step {a.get('step_number', i + 1)}, attempt {a.get('attempt_number', 1)}: {a.get('goal') or ''}"))
        blocks += [("TOOL", f"Tool '{n}' output is unavailable in the trajectory schema; this is a deterministic placeholder.") for n in elements(a.get("tool_names"), "tool_names")]
        files = elements(a.get("target_files"), "target_files")
        why = f" Failure reason: {a['failure_reason']}." if a.get("failure_reason") else ""
        blocks.append(("ASSISTANT", f"Attempt status: {a.get('status') or ''}.{why}" + (f" Target files: {', '.join(files)}." if files else "")))
    end = f"Final summary: llm_claimed_success={bool(claimed)}; final_passed={v[0]}; tier1_pass={v[1]}; tier2_pass={v[2]}; input_tokens={u[0]}; output_tokens={u[1]}; total_tokens={sum(u)}."
    return "\n\n".join(f"[{r}]\n{c}" for r, c in [*blocks, ("ASSISTANT", end)])


def test_training_samples_hold_the_attempts(spark, tmp_path):
    a = {"step_number": 1, "attempt_number": 1, "goal": "look", "status": "failed", "failure_reason": "why", "target_files": "a.py", "tool_names": ["bash", "search"]}
    b = {"step_number": 2, "attempt_number": 1, "goal": None, "status": "success", "tool_names": "file_edit"}
    texts = [json.dumps([a, None, b]), json.dumps(json.dumps({"1": a, "2": b})), json.dumps({"attempts": [b]}), None, "null", ""]
    check, usage = json.dumps({"final_passed": True, "tier1_pass": True}), json.dumps({"input_tokens": 3, "output_tokens": 4})
    rows = [(i, f"t{i}", "i", f"task {i}" if i else None, "m", 1, t, i % 2 == 0, {"provider": "x"}, check, usage, None) for i, t in enumerate(texts)] + [(9, "t9", "i", "t", "m", 1, json.dumps([a]), True, {"messages_json": '[{"role": "user", "content": "raw"}]'}, None, None, None)]
    ddl = "record_id long, trajectory_id string, instance_id string, task string, model string, seed long, attempts string, llm_claimed_success boolean, metadata map<string,string>, verification string, token_usage string, received_at timestamp"
    sf = folder(spark, tmp_path, trajectories=(rows, ddl))
    got = {int(r["trajectory_id"][1:]): r for r in run_queries.QUERIES["training_samples"](spark, sf).collect()}
    assert got[9]["metadata"]["export_source"] == "metadata_raw_messages" and got[9]["text"] == "[USER]\nraw" and len(got) == 7
    for i, _, _, task, _, _, t, ok, *_ in rows[:-1]:
        assert got[i]["text"] == brute_text(task, t, ok, (True, True, False), (3, 4)) and got[i]["faults"] == []
    calls = [c for m in got[0]["messages"] for c in m["tool_calls"] or []]
    assert [c["function"]["name"] for c in calls] == ["bash", "search", "file_edit"] and len({c["id"] for c in calls}) == 3


CALLS = "call_id string, trajectory_id string, turn_id long, call_index_in_turn long, global_index long, tool_name string, params string, params_hash string, target_file string, result_success boolean, result_content string, error_signal string, ts_epoch double, ingested_at timestamp"


def call(i, params="{}", tool="bash", file=""):
    return (f"c{i}", "t", i, 0, i, tool, params, "", file, True, "", "NONE", float(i), None)


def test_params_hashes_of_all_calls(spark, tmp_path):
    params = ['{"timeout": 5, "command": "ls"}', '{"command":"ls","timeout":5}', '{"path": "\u00e4", "n": 1.0}', "{bad", None, "[1, 2]"]
    sf = folder(spark, tmp_path, tool_call_events=([call(i, p, ["bash", "file_read"][i % 2]) for i, p in enumerate(params)], CALLS))
    got = {r["pos"]: r["told"] for r in run_queries.QUERIES["params_hashes"](spark, sf).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()[:16]
    assert got == {0: digest('{"command": "ls", "timeout": 5}'), 1: got[0], 2: digest('{"n": 1.0, "path": "\u00e4"}'), 3: None, 4: None, 5: digest("[1, 2]")}


def test_text_operators_over_whole_tables(spark, tmp_path):
    texts = ['  File "a\\b.py", line 1\nc/d.py:3 and in e.py', "\u3000\u4e2d \u00a0\n\u6587\u2003", None, "intro\n## A\none\n## B \n\ntwo\n## A\nlast"]
    docs = [(i, t, lang) for (i, t), lang in zip(enumerate(texts), ["en", "zh", "en", None])]
    sf = folder(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string"), tool_call_events=([call(i, file=f) for i, f in enumerate(["a/../b.py", "../x", "a\\\\b", "./c", "./c"])], CALLS))
    rows = lambda name: [tuple(r) for r in run_queries.QUERIES[name](spark, sf).collect()]
    assert dict(rows("text_references")) == {0: "a/b.py c/d.py e.py", 1: "", 3: ""}
    assert dict(rows("squeezed_texts")) == {i: " ".join(t.split()) for i, t in enumerate(texts) if t is not None}
    assert sorted(rows("document_sections")) == [(3, "A", "last"), (3, "B", "two")]
    assert {("a/../b.py", "b.py"), ("../x", None), ("a\\\\b", "a/b"), ("./c", "c")} <= set(rows("normal_paths"))
