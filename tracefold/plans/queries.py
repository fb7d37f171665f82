"""Queries of the core over the test tables, and the SQL they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracefold.operators import drift, nested
from tracefold.plans import data_queries, run_queries  # noqa: F401
from tracefold.plans.json_sql import DECODED, elements_sql
from tracefold.session import checkpointed

Query = Callable[[SparkSession, str], DataFrame]
NESTED = ["verification", "token_usage", "attempts", "tool_call_events"]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.FlatTables(_t(spark, sf, "trajectories"), "record_id", NESTED).positions()


def p5_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return nested.FlatTables(_t(spark, sf, "trajectories"), "record_id", ["attempts"]).typed("attempts")


def p5_verification(spark: SparkSession, sf: str) -> DataFrame:
    return nested.FlatTables(_t(spark, sf, "trajectories"), "record_id", ["verification"]).typed("verification")


def p5_tool_call_events(spark: SparkSession, sf: str) -> DataFrame:
    return nested.FlatTables(_t(spark, sf, "trajectories"), "record_id", ["tool_call_events"]).typed("tool_call_events")


def p5_token_usage(spark: SparkSession, sf: str) -> DataFrame:
    return nested.FlatTables(_t(spark, sf, "trajectories"), "record_id", ["token_usage"]).typed("token_usage")


def p5_attempt_target_files(spark: SparkSession, sf: str) -> DataFrame:
    return nested.FlatTables(_t(spark, sf, "trajectories"), "record_id", ["attempts"]).typed("attempt_target_files")


def p5_attempt_tool_names(spark: SparkSession, sf: str) -> DataFrame:
    return nested.FlatTables(_t(spark, sf, "trajectories"), "record_id", ["attempts"]).typed("attempt_tool_names")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift_report(_t(spark, sf, "raw_records")).select("file_name", "change_kind", "field_path", "new_path")


def p6_unified(spark: SparkSession, sf: str) -> DataFrame:
    lines = _t(spark, sf, "raw_records")
    return drift.unified_records(lines, checkpointed(drift.drift_report(lines)))


def _p5_sql() -> str:
    cols = ", ".join(f"{DECODED.format(c=c)} AS {c}" for c in NESTED)
    lists = ", ".join(f"{elements_sql(c, c)} AS l_{c}" for c in NESTED)
    top = " UNION ALL ".join(f"SELECT record_id, '{c}' AS child_table, -1 AS parent_pos, unnest(range(len(l_{c}))) AS child_pos FROM l" for c in NESTED)
    children = " UNION ALL ".join(
        f"SELECT record_id, 'attempt_{m}' AS child_table, parent_pos, unnest(range(len({elements_sql(f'm_{m}', m)}))) AS child_pos FROM (SELECT *, json_extract(e, '$.{m}') AS m_{m} FROM a) WHERE m_{m} IS NOT NULL" for m in ("target_files", "tool_names")
    )
    return f"WITH t AS (SELECT record_id, {cols} FROM trajectories), l AS (SELECT record_id, {lists} FROM t), a AS (SELECT record_id, unnest(l_attempts) AS e, unnest(range(len(l_attempts))) AS parent_pos FROM l) {top} UNION ALL {children}"


# The members that the records' tables have, and their types; a nested one is JSON text.
_MEMBERS = {
    "verification": "final_passed BOOLEAN, tier1_pass BOOLEAN, tier2_command VARCHAR, tier2_pass BOOLEAN",
    "token_usage": "cache_create_tokens BIGINT, cache_read_tokens BIGINT, input_tokens BIGINT, output_tokens BIGINT, total_tokens BIGINT",
    "attempts": "attempt_number BIGINT, failure_reason VARCHAR, goal VARCHAR, rolled_back BOOLEAN, status VARCHAR, step_number BIGINT, target_files VARCHAR, tool_names VARCHAR",
    "tool_call_events": "call_index_in_turn BIGINT, error_signal VARCHAR, global_index BIGINT, params VARCHAR, params_hash VARCHAR, result_content VARCHAR, result_success BOOLEAN, target_file VARCHAR, timestamp DOUBLE, tool_name VARCHAR, turn_id BIGINT",
}


def _typed_sql(name: str) -> str:
    """The rows of a flat table with their members' values."""
    top = "attempts" if name.startswith("attempt_") else name
    start = f"WITH t AS (SELECT record_id, {DECODED.format(c=top)} AS v FROM trajectories), l AS (SELECT record_id, {elements_sql('v', top)} AS l FROM t), a AS (SELECT record_id, unnest(l) AS e, unnest(range(len(l))) AS pos FROM l) "
    if name != top:
        m = name.removeprefix("attempt_")
        return start + f", b AS (SELECT record_id, pos, {elements_sql('m', m)} AS l FROM (SELECT *, json_extract(e, '$.{m}') AS m FROM a) WHERE m IS NOT NULL) SELECT record_id, pos AS parent_pos, unnest(range(len(l))) AS child_pos, json_extract_string(unnest(l), '$') AS value FROM b"
    members = ", ".join(f"CAST(nullif(json_extract_string(e, '$.{n}'), 'null') AS {k}) AS {n}" for n, k in (x.split() for x in _MEMBERS[name].split(", ")))
    return start + f"SELECT record_id, -1 AS parent_pos, pos AS child_pos, {members} FROM a"


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p5_found, p5_attempts, p5_verification, p5_tool_call_events, p5_token_usage, p5_attempt_target_files, p5_attempt_tool_names, p6_found, p6_unified)} | run_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"p5_found": _p5_sql()} | {f"p5_{n}": _typed_sql(n) for n in (*_MEMBERS, "attempt_target_files", "attempt_tool_names")} | run_queries.SQL
