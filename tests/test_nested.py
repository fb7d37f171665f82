import json

import pytest

from tracefold.operators.nested import FlatTables, elements, loaded
from tracefold.plans import queries

A = {"step_number": 1, "goal": "g", "status": "failed", "target_files": ["a", None, "b"], "tool_names": "bash"}
B = {"step_number": 2, "goal": "h", "status": "failed", "target_files": []}


@pytest.mark.parametrize(
    "value, n",
    [
        ([A, B], 2), (A, 1), ({"1": A, "2": B, "10": A}, 3), ([[A, B]], 2), ([[A], [B]], 2), ([None, A, {}], 1), (None, 0), ({}, 0), ([], 0), ({"attempts": [A, B]}, 2), ({"count": 2, "items": [A, B]}, 2),
        ([{"turn_id": 1, "calls": [A, B]}, {"turn_id": 2, "calls": []}, {"turn_id": 3, "calls": [A]}], 3), ("lone", 1),
    ],
)
def test_elements(value, n):
    assert len(elements(value, "attempts")) == n
    if value is not None:
        assert len(elements(loaded(json.dumps(json.dumps(value))), "attempts")) == n


def test_groups_hand_on_their_members():
    assert [x["turn_id"] for x in elements([{"turn_id": 1, "calls": [{"a": 1}]}, {"turn_id": 2, "calls": [{"a": 2}]}], "events")] == [1, 2]


@pytest.fixture(scope="module")
def flat(spark):
    rows = [(1, json.dumps([A, B]), "x"), (2, None, "x"), (3, "", "x"), (4, "not json", "x"), (5, json.dumps(json.dumps({"1": A})), "x"), (5, json.dumps([A]), "x"), (None, json.dumps([A]), "x")]
    return FlatTables(spark.createDataFrame(rows, "record_id long, attempts string, element string"), "record_id", ["attempts"])


def test_positions_point_to_their_parent(flat):
    got = sorted(tuple(r) for r in flat.positions().collect())
    assert (1, "attempts", -1, 0) in got and (1, "attempts", -1, 1) in got
    assert [r for r in got if r[0] == 1 and r[1] == "attempt_target_files"] == [(1, "attempt_target_files", 0, 0), (1, "attempt_target_files", 0, 1)]
    assert not any(r[0] in (2, 3, None) for r in got)
    assert sum(r[:2] == (4, "attempts") for r in got) == 1


def test_typed_columns(flat):
    t = flat.typed("attempts")
    assert dict(t.dtypes)["step_number"] == "bigint" and dict(t.dtypes)["goal"] == "string"
    assert t.where("record_id = 1 AND child_pos = 1").first()["step_number"] == 2


def test_tool_names_have_no_table_of_their_own_if_never_a_list(flat):
    assert "attempt_tool_names" not in flat.tables if hasattr(flat, "tables") else "tool_names" not in flat.children["attempts"]


def test_empty_table(spark):
    f = FlatTables(spark.createDataFrame([], "record_id long, attempts string"), "record_id", ["attempts"])
    assert f.positions().count() == 0 and f.typed("attempts").count() == 0


def test_very_long_text(spark):
    f = FlatTables(spark.createDataFrame([(1, json.dumps([{"goal": "x" * 300_000}] * 20))], "record_id long, attempts string"), "record_id", ["attempts"])
    assert f.positions().count() == 20


def test_all_flat_tables_come_out_with_their_values(spark, tmp_path):
    calls = [{"turn_id": 1, "tool_name": "bash", "params": {"b": 1}}, {"turn_id": 2, "tool_name": "search", "params": {}}]
    rows = [(1, json.dumps([A, B | {"tool_names": ["x", "y"]}]), json.dumps({"turn": 0, "calls": calls}), json.dumps({"input_tokens": 5})), (2, None, json.dumps(calls[:1]), json.dumps([{"input_tokens": 7}]))]
    spark.createDataFrame(rows, "record_id long, attempts string, tool_call_events string, token_usage string").write.parquet(f"{tmp_path}/trajectories.parquet")
    got = {n: queries.queries()[f"p5_{n}"](spark, str(tmp_path)) for n in ("tool_call_events", "token_usage", "attempt_target_files", "attempt_tool_names")}
    assert sorted(tuple(r) for r in got["tool_call_events"].select("record_id", "child_pos", "turn_id", "tool_name", "params").collect()) == [(1, 0, 1, "bash", '{"b":1}'), (1, 1, 2, "search", "{}"), (2, 0, 1, "bash", '{"b":1}')]
    assert sorted((r["record_id"], r["input_tokens"]) for r in got["token_usage"].collect()) == [(1, 5), (2, 7)]
    assert sorted((r["parent_pos"], r["child_pos"], r["value"]) for r in got["attempt_target_files"].collect()) == [(0, 0, "a"), (0, 1, "b")]
    assert sorted((r["parent_pos"], r["child_pos"], r["value"]) for r in got["attempt_tool_names"].collect()) == [(0, 0, "bash"), (1, 0, "x"), (1, 1, "y")]
