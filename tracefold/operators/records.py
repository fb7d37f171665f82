"""Run results as records: stop reasons, success, projection to a record; retryable errors and files edited per step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# The error classes after which a model call is tried again.
RETRYABLE = ("RateLimitError", "InternalServerError", "APIConnectionError", "APITimeoutError", "OverloadedError", "ConnectError", "ReadTimeout", "ConnectTimeout", "TimeoutError")


CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"


def stop_reason(error: Column, declared: Column, turns: Column, most_turns: int, ended: Column) -> Column:
    """Why a run stopped: an error, its own declaration, the budget of turns, or the end of the model's turn."""
    return F.when(F.coalesce(error, F.lit("")) != "", "error").when(F.coalesce(declared, F.lit("")) != "", "declared_done").when(turns >= most_turns, "budget_exhausted").when(ended, "end_turn").otherwise("budget_exhausted")


def verified(verify: Column, stop: Column, diff: Column, tier2: Column, declared: Column) -> Column:
    """(tier1_pass, tier2_enabled, success): tier1 is a diff that isn't blank; tier2 counts where it is set up and the run had no error."""
    enabled = F.coalesce(verify, F.lit(False)) & (stop != "error")
    success = (F.coalesce(declared, F.lit("")) == "fixed") & (~enabled | F.coalesce(tier2, F.lit(False)))
    return F.struct(F.coalesce(diff, F.lit("")).rlike(r"(?U)\S").alias("tier1_pass"), enabled.alias("tier2_enabled"), success.alias("success"))


def run_id(created_at: Column, suffix: Column | None = None) -> Column:
    """traj-<epoch seconds>-<8 hex digits>; the digits are random unless given."""
    digits = F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(8)) if suffix is None else suffix
    return F.concat(F.lit("traj-"), F.floor(created_at).cast("string"), F.lit("-"), digits)


def result_records(results: DataFrame) -> DataFrame:
    """Results (trajectory_id, instance_id, task, provider, model, seed, created_at, tool_names, declared_status, declared_summary, stop_reason, error, final_diff, tier2_pass, tier2_output,
    verify, input_tokens, output_tokens, elapsed_seconds) as records; the one attempt stands for the whole run.

    Metadata always has provider, stop_reason, elapsed_seconds (to thousandths), loop and declared_status ('' where the run declared nothing), and the others where
    they aren't null or empty. What verified the run is named where it was set up.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    v = verified(F.col("verify"), F.col("stop_reason"), F.col("final_diff"), F.col("tier2_pass"), F.col("declared_status"))
    names = F.coalesce("tool_names", F.array().cast("array<string>"))
    attempt = F.struct(
        F.lit(1).cast("long").alias("step_number"), F.lit(1).cast("long").alias("attempt_number"), F.left(text("task"), F.lit(200)).alias("goal"), F.when(F.col("v.success"), "success").otherwise("failed").alias("status"),
        F.array().cast("array<string>").alias("target_files"), names.alias("tool_names"), F.when(F.col("v.success"), "").otherwise(text("stop_reason")).alias("failure_reason"),
    )
    always = F.create_map(
        F.lit("provider"), text("provider"), F.lit("stop_reason"), text("stop_reason"), F.lit("elapsed_seconds"), F.coalesce(F.round("elapsed_seconds", 3).cast("string"), F.lit("")),
        F.lit("loop"), F.lit("flat_react_v1"), F.lit("declared_status"), text("declared_status"),
    )
    given = F.map_filter(F.create_map(*[x for n in ("declared_summary", "tier2_output", "error", "final_diff") for x in (F.lit(n), F.col(n).cast("string"))]), lambda k, x: x.isNotNull() & (x != ""))
    command = F.when(F.col("v.tier2_enabled"), F.concat(F.lit("swebench:"), F.col("instance_id"))).otherwise("")
    check = F.struct(F.col("v.success").alias("final_passed"), F.col("v.tier1_pass").alias("tier1_pass"), F.coalesce("tier2_pass", F.lit(False)).alias("tier2_pass"), command.alias("tier2_command"))
    usage = F.struct(F.coalesce("input_tokens", F.lit(0)).cast("long").alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).cast("long").alias("output_tokens"), F.lit(0).cast("long").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_create_tokens"))
    d = results.withColumn("v", v)
    return d.select("trajectory_id", F.lit("2.0").alias("schema_version"), "instance_id", "task", "model", "seed", "created_at", (text("declared_status") == "fixed").alias("llm_claimed_success"), check.alias("verification"), F.array(attempt).alias("attempts"), usage.alias("token_usage"), F.map_concat(always, given).alias("metadata"))


def result_summaries(results: DataFrame) -> DataFrame:
    """(trajectory_id, summary): per result the JSON object that a headless run leaves beside its record; columns as in result_records and n_calls, cache_read_tokens, cache_create_tokens."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    v = verified(F.col("verify"), F.col("stop_reason"), F.col("final_diff"), F.col("tier2_pass"), F.col("declared_status"))
    usage = F.struct(*[count(c).alias(c) for c in ("input_tokens", "output_tokens")], (count("input_tokens") + count("output_tokens")).alias("total_tokens"), *[count(c).alias(c) for c in ("cache_read_tokens", "cache_create_tokens")])
    body = F.struct(
        F.col("v.success").alias("success"), text("stop_reason"), text("declared_status"), text("declared_summary"), count("n_calls").alias("tool_call_count"), F.col("v.tier1_pass").alias("tier1_pass"), F.col("v.tier2_enabled").alias("tier2_enabled"),
        F.coalesce("tier2_pass", F.lit(False)).alias("tier2_pass"), text("tier2_output"), text("final_diff"), F.round("elapsed_seconds", 2).alias("elapsed_seconds"), usage.alias("usage"), text("error"), F.col("trajectory_id").alias("trajectory_id"),
    )
    return results.withColumn("v", v).select("trajectory_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("summary"))


def retryable(chain: Column) -> Column:
    """Whether an error, given as the names of its classes along its chain of causes, is worth another try."""
    return F.coalesce(F.exists(chain, lambda n: n.isin(*RETRYABLE)), F.lit(False))


def many_files(calls: DataFrame, most: int = 10, step: str = "turn_id") -> DataFrame:
    """(trajectory_id, pos, target_file): the edits of a further file in a step that has changed `most` files already, `step` naming the column that tells steps apart.

    A file counts from its first successful edit in the step. Edits of files that the step changed before are no further files.
    """
    w = W.partitionBy("trajectory_id", step).orderBy("pos")
    e = calls.where(F.col("tool").isin("file_edit", "file_create") & (F.col("target_file") != "")).select("trajectory_id", step, "pos", "target_file", "ok")
    seen = F.coalesce(F.max(F.col("ok").cast("int")).over(W.partitionBy("trajectory_id", step, "target_file").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    e = e.withColumn("_seen", seen).withColumn("_new", ((F.col("_seen") == 0) & F.col("ok")).cast("int"))
    before = F.coalesce(F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return e.withColumn("_before", before).where((F.col("_seen") == 0) & (F.col("_before") >= most)).select("trajectory_id", "pos", "target_file")


def provider_messages(messages: Column, text_mode: bool = False, tools_text: str = "") -> Column:
    """Messages (role, content, tool_call_id, tool_calls) in the form a chat service takes.

    A result that answers a call is the tool's; one without call id is the user's. In text mode, for models without tool calls, results are told as the user's, the calls
    of the assistant are left out and tools_text is put below the system's message.
    """
    def of(m: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        result, answers = m["role"].isin("tool", "tool_result"), F.coalesce(m["tool_call_id"], F.lit("")) != ""
        role = F.when(result, F.when(answers, "user" if text_mode else "tool").otherwise("user")).when(m["role"].isin("system", "assistant"), m["role"]).otherwise("user")
        if text_mode:
            content = F.when(result & answers, F.concat(F.lit("Tool result for "), m["tool_call_id"], F.lit(":\n"), content)).otherwise(content)
            if tools_text:
                content = F.when(m["role"] == "system", F.concat(content, F.lit("\n\n" + tools_text))).otherwise(content)
        call_id = F.lit(None).cast("string") if text_mode else F.when(result & answers, m["tool_call_id"])
        said = F.lit(None).cast(CALLS) if text_mode else F.when((m["role"] == "assistant") & (F.size(m["tool_calls"]) > 0), m["tool_calls"])
        return F.struct(role.alias("role"), content.alias("content"), call_id.alias("tool_call_id"), said.alias("tool_calls"))

    return F.transform(messages, of)


def plain_stop(c: Column) -> Column:
    """A service's finish reason in plain terms; what isn't known is the end of a turn."""
    return F.when(c == "tool_calls", "tool_use").when(c == "length", "max_tokens").otherwise("end_turn")


def clamped(temperature: Column, positive_only: Column | bool = True) -> Column:
    """The temperature for a service that wants one above 0 and up to 1: 0 or less becomes 0.01. As it is for other services."""
    wanted = F.lit(positive_only) if isinstance(positive_only, bool) else positive_only
    return F.when(~F.coalesce(wanted, F.lit(False)), temperature).when(temperature <= 0, F.lit(0.01)).when(temperature > 1, F.lit(1.0)).otherwise(temperature)


def dense_numbers(calls: DataFrame) -> DataFrame:
    """The calls with call_index_in_turn and global_index given anew by place."""
    run, turn = W.partitionBy("trajectory_id").orderBy("pos"), W.partitionBy("trajectory_id", "turn_id").orderBy("pos")
    return calls.withColumn("call_index_in_turn", (F.row_number().over(turn) - 1).cast("long")).withColumn("global_index", (F.row_number().over(run) - 1).cast("long"))
