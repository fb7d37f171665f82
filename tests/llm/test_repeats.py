import json
from datetime import datetime

from tracefold.llm import repeats

SCHEMA = "call_id long, trajectory_id string, global_index long, tool_name string, params string, params_hash string, ts_epoch double, ingested_at timestamp_ntz, g long, t string"
T = datetime(2025, 1, 1)


def calls(spark, rows):
    """rows: (run, index, tool, params, hash)"""
    return spark.createDataFrame([(i, r, g, t, p if isinstance(p, str) or p is None else json.dumps(p), h, float(g or 0), T, 1, "x") for i, (r, g, t, p, h) in enumerate(rows)], SCHEMA)


def found(df, **kw):
    return sorted((r["trajectory_id"], r["first_index"], r["last_index"], r["n_calls"]) for r in repeats.collapse_repeats(df, **kw).collect())


def same(spark, *params, tool="bash"):
    return found(calls(spark, [("r", i, tool, p, "") for i, p in enumerate(params)])) == [("r", 0, len(params) - 1, len(params))]


def test_what_is_the_same_request(spark):
    c = lambda x, **k: {"command": x, **k}
    assert same(spark, c("git  diff"), '{"command":"git diff "}')
    assert same(spark, c("ls", timeout=5), {"timeout": 5, "command": "ls"})
    assert same(spark, {"file_path": "./src//a.py"}, {"file_path": "src/a.py"}, {"file_path": "././src/x/../a.py"}, tool="file_read")
    assert same(spark, c("python r.py > /tmp/a_12ab/out.log"), c("python r.py > /tmp/a_99/out.log"))
    assert same(spark, c("pytest t.py --basetemp=/tmp/pytest-12"), c("pytest t.py --basetemp=/tmp/pytest-77"))
    assert same(spark, c("run --run-id 12ab"), c("run --run-id 99ff"))
    assert same(spark, c("x --log-file logs/a-20250101T010203.log"), c("x --log-file logs/a-20250102T040506.log"))


def test_what_is_another_request(spark):
    c = lambda x, **k: {"command": x, **k}
    for a, b in [
        (c("ls a"), c("ls b")), (c("x --seed 1"), c("x --seed 2")), (c("x", timeout=1), c("x", timeout=2)), (c("grep 'a  b' x"), c("grep 'a b' x")), (c("x --log-file logs/a-20250101T010203.log"), c("x --log-file logs/b-20250101T010203.log")),
        ({"file_path": "a", "start_line": 1}, {"file_path": "a", "start_line": 2}), ({"old_str": "  a"}, {"old_str": " a"}), (c("pytest -x"), c("pytest -x -v")),
    ]:
        assert not same(spark, a, b), (a, b)


def test_tool_spellings_and_breaks(spark):
    p = {"file_path": "a"}
    df = calls(spark, [("r", 0, "file_read", p, ""), ("r", 2, "File-Read ", p, ""), ("r", 3, "search", p, ""), ("r", 4, "file_read", p, ""), ("s", 5, "file_read", p, "")])
    assert found(df) == [("r", 0, 2, 2)]
    assert len(found(df, least=1)) == 4


def test_first_delivery_counts(spark):
    rows = [("r", 0, "bash", {"command": "a"}, ""), ("r", 1, "bash", {"command": "a"}, ""), ("r", 1, "bash", {"command": "b"}, ""), ("r", 1, "bash", {"command": "b"}, "")]
    assert found(calls(spark, rows)) == [("r", 0, 1, 2)]


def test_rows_without_params(spark):
    h = "ABCDEF0123456789"
    rows = [("r", 0, "bash", {"command": "a"}, h.lower()), ("r", 1, "bash", None, h), ("r", 2, "bash", None, h[:12].lower()), ("r", 3, "bash", None, None), ("r", 4, "bash", None, ""), ("r", 5, "bash", "", None)]
    assert found(calls(spark, rows)) == [("r", 0, 2, 3)]


def test_long_runs_over_chunks(spark):
    n = 3000
    rows = [("r", i, "bash", {"command": "a" if i < 2000 else f"b{i}"}, "") for i in range(n)] + [(None, 1, "bash", "{}", ""), ("r", None, "bash", "{}", "")]
    assert found(calls(spark, rows)) == [("r", 0, 1999, 2000)]


def test_empty_and_bad_params(spark):
    assert found(calls(spark, []).limit(0)) == []
    assert found(calls(spark, [("r", 0, None, "{bad", ""), ("r", 1, None, "{bad", ""), ("r", 2, None, "[1]", "")])) == [("r", 0, 1, 2)]


def test_seconds(spark):
    r = repeats.collapse_repeats(calls(spark, [("r", 3, "bash", {"command": "a"}, ""), ("r", 7, "bash", {"command": "a"}, "")])).first()
    assert r["seconds"] == 4.0 and r["tool_name"] == "bash"
