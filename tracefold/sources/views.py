"""Clean views of the run tables: calls in order, and one row per run with its verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.names import run_key
from tracefold.functions.steps import plain_signal, plain_tool


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (trajectory_id, global_index), the first delivered, with pos, its place in the run from 0."""
    e = table(spark, folder, "tool_call_events").where("trajectory_id IS NOT NULL AND global_index IS NOT NULL")
    first = e.withColumn("_n", F.expr("lag(global_index) OVER (PARTITION BY trajectory_id ORDER BY global_index, ingested_at NULLS LAST, call_id)")).where("_n IS NULL OR _n <> global_index")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return first.select(
        "trajectory_id", F.expr("row_number() OVER (PARTITION BY trajectory_id ORDER BY global_index) - 1").cast("long").alias("pos"), F.coalesce("turn_id", F.lit(-1)).alias("turn_id"),
        F.coalesce("call_index_in_turn", F.lit(0)).alias("call_index_in_turn"), "global_index", plain_tool(F.col("tool_name")).alias("tool"), text("params").alias("params"), text("params_hash").alias("params_hash"),
        text("target_file").alias("target_file"), F.coalesce("result_success", F.lit(False)).alias("ok"), text("result_content").alias("content"), plain_signal(F.col("error_signal")).alias("signal"), F.col("ts_epoch").alias("ts"),
    )


def _member(c: str, name: str) -> Column:
    text = F.when(F.col(c).startswith('"'), F.get_json_object(F.col(c), "$")).otherwise(F.col(c))
    return F.coalesce(F.get_json_object(text, f"$.{name}"), F.get_json_object(text, f"$.{c}.{name}"), F.get_json_object(text, f"$[0].{name}"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per run, its first delivery: claim, verification flags and tokens; an absent flag is false, an absent command ''."""
    t = table(spark, folder, "trajectories")
    one = t.withColumn("run", run_key("trajectory_id")).where("run IS NOT NULL")
    one = one.withColumn("_n", F.expr("row_number() OVER (PARTITION BY run ORDER BY received_at NULLS LAST, record_id)")).where("_n = 1")
    flag = lambda n: F.coalesce(_member("verification", n) == "true", F.lit(False)).alias(n)
    tokens = lambda n: F.coalesce(_member("token_usage", n).cast("long"), F.lit(0)).alias(n)
    return one.select(
        "run", "record_id", F.coalesce("instance_id", F.lit("")).alias("instance_id"), F.coalesce("model", F.lit("")).alias("model"), "seed", F.coalesce("llm_claimed_success", F.lit(False)).alias("claimed"), flag("final_passed"), flag("tier1_pass"),
        flag("tier2_pass"), F.coalesce(_member("verification", "tier2_command"), F.lit("")).alias("tier2_command"), tokens("input_tokens"), tokens("output_tokens"), F.coalesce(F.col("metadata")["final_diff"], F.lit("")).alias("final_diff"),
    )


#: The same views in SQL, as common table expressions.
CALLS_SQL = r"""
calls AS (
  SELECT trajectory_id, row_number() OVER (PARTITION BY trajectory_id ORDER BY global_index) - 1 AS pos, coalesce(turn_id, -1) AS turn_id, coalesce(call_index_in_turn, 0) AS call_index_in_turn, global_index,
    CASE regexp_replace(lower(tool_name), '[\s_-]+', '', 'g') WHEN 'declaredone' THEN 'declare_done' WHEN 'filecreate' THEN 'file_create' WHEN 'fileedit' THEN 'file_edit' WHEN 'fileread' THEN 'file_read'
      ELSE regexp_replace(lower(tool_name), '[\s_-]+', '', 'g') END AS tool,
    coalesce(params, '') AS params, coalesce(params_hash, '') AS params_hash, coalesce(target_file, '') AS target_file, coalesce(result_success, false) AS ok, coalesce(result_content, '') AS content,
    coalesce(nullif(upper(trim(error_signal)), ''), 'NONE') AS signal, ts_epoch AS ts
  FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id, global_index ORDER BY ingested_at NULLS LAST, call_id) AS rn FROM tool_call_events WHERE trajectory_id IS NOT NULL AND global_index IS NOT NULL)
  WHERE rn = 1)"""

RUNS_SQL = r"""
t0 AS (
  SELECT *, nullif(lower(trim(regexp_replace(trajectory_id, '#.*$', '', 's'), E' \t\n\r')), '') AS run, CASE WHEN verification LIKE '"%' THEN json_extract_string(verification, '$') ELSE nullif(verification, '') END AS v,
    CASE WHEN token_usage LIKE '"%' THEN json_extract_string(token_usage, '$') ELSE nullif(token_usage, '') END AS u FROM trajectories),
t1 AS (SELECT * FROM t0 WHERE run IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run ORDER BY received_at NULLS LAST, record_id) = 1),
runs AS (
  SELECT run, record_id, coalesce(instance_id, '') AS instance_id, coalesce(model, '') AS model, seed, coalesce(llm_claimed_success, false) AS claimed,
    coalesce(coalesce(v->>'$.final_passed', v->>'$.verification.final_passed', v->>'$[0].final_passed') = 'true', false) AS final_passed,
    coalesce(coalesce(v->>'$.tier1_pass', v->>'$.verification.tier1_pass', v->>'$[0].tier1_pass') = 'true', false) AS tier1_pass,
    coalesce(coalesce(v->>'$.tier2_pass', v->>'$.verification.tier2_pass', v->>'$[0].tier2_pass') = 'true', false) AS tier2_pass,
    coalesce(v->>'$.tier2_command', v->>'$.verification.tier2_command', v->>'$[0].tier2_command', '') AS tier2_command,
    coalesce(CAST(coalesce(u->>'$.input_tokens', u->>'$.token_usage.input_tokens', u->>'$[0].input_tokens') AS BIGINT), 0) AS input_tokens,
    coalesce(CAST(coalesce(u->>'$.output_tokens', u->>'$.token_usage.output_tokens', u->>'$[0].output_tokens') AS BIGINT), 0) AS output_tokens,
    coalesce(metadata['final_diff'], '') AS final_diff
  FROM t1)"""
