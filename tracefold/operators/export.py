"""Chat-format training samples from runs, their checks, and statistics."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.functions.text import training_text
from tracefold.operators.nested import elements, loaded
from tracefold.sources.files import placed_lines

CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
MESSAGE = f"struct<role:string,content:string,tool_call_id:string,tool_calls:{CALLS}>"
# Metadata keys that may hold a run's raw messages, the first that isn't empty counts; and the texts of rebuilt messages.
RAW_KEYS = ("openai_messages_json", "messages_json", "raw_messages_json")
PLACEHOLDER = ("Tool '", "' output is unavailable in the trajectory schema; this is a deterministic placeholder.")
ROLES = ("system", "user", "assistant", "tool")


def raw_messages(metadata: Column) -> Column:
    """The messages a run kept as JSON in its metadata, null if there are none. A text that isn't a JSON list of messages is an error when it is read.

    A message needs a known role and text content; a tool_call_id is a text that isn't empty, and tool_calls are complete (see message_faults).
    """
    first = F.coalesce(*[F.nullif(metadata[k], F.lit("")) for k in RAW_KEYS])
    parsed = F.from_json(first, f"array<{MESSAGE}>")
    # What from_json would read as something else: numbers as texts, objects as lists of one.
    kinds = F.from_json(first, "array<struct<content:variant,tool_call_id:variant,tool_calls:variant>>")
    odd = F.exists(kinds, lambda m: (F.schema_of_variant(m["content"]) != "STRING") | ~F.coalesce(F.schema_of_variant(m["tool_call_id"]).isin("STRING", "VOID"), F.lit(True)) | (~F.coalesce(F.schema_of_variant(m["tool_calls"]).startswith("ARRAY") | (F.schema_of_variant(m["tool_calls"]) == "VOID"), F.lit(True))))
    faults = message_faults(parsed)
    bad = (
        F.when(F.try_parse_json(first).isNull(), "invalid JSON")
        .when(~first.rlike(r"^\s*\["), "no list of messages")
        .when(F.coalesce(odd, F.lit(True)), "a message isn't made of texts")
        .when((F.size(faults) > 0) & (F.size(parsed) > 0), F.array_join(faults, ", "))
    )
    return F.when(first.isNull(), F.lit(None)).when(bad.isNotNull(), F.raise_error(F.concat(F.lit("raw messages: "), bad)).cast(f"array<{MESSAGE}>")).otherwise(parsed)


def _message(role: str, content: Column, call_id: Column | None = None, calls: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(role).alias("role"), content.alias("content"), (call_id if call_id is not None else none.cast("string")).alias("tool_call_id"), (calls if calls is not None else none.cast(CALLS)).alias("tool_calls"))


def attempt_messages(a: Column) -> Column:
    """The messages of one attempt: what it is about with its tool calls, a placeholder result for each, and how it ended."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    names = F.coalesce(a["tool_names"], F.array().cast("array<string>"))
    call_id = lambda i: F.concat(F.lit("tc_s"), text(a["step_number"]), F.lit("_a"), text(a["attempt_number"]), F.lit("_"), (i + 1).cast("string"))
    calls = F.transform(names, lambda n, i: F.struct(call_id(i).alias("id"), F.lit("function").alias("type"), F.struct(n.alias("name"), F.lit("{}").alias("arguments")).alias("function")))
    intro = F.concat(F.lit("Step "), text(a["step_number"]), F.lit(", attempt "), text(a["attempt_number"]), F.lit(": "), text(a["goal"]))
    results = F.transform(names, lambda n, i: _message("tool", F.concat(F.lit(PLACEHOLDER[0]), n, F.lit(PLACEHOLDER[1])), call_id(i)))
    files = F.array_join(F.coalesce(a["target_files"], F.array().cast("array<string>")), ", ")
    status = F.concat(
        F.lit("Attempt status: "), text(a["status"]), F.lit("."), F.when(text(a["failure_reason"]) != "", F.concat(F.lit(" Failure reason: "), a["failure_reason"], F.lit("."))).otherwise(""),
        F.when(F.size(F.coalesce(a["target_files"], F.array().cast("array<string>"))) > 0, F.concat(F.lit(" Target files: "), files, F.lit("."))).otherwise(""),
    )
    return F.concat(F.array(_message("assistant", intro, calls=F.when(F.size(calls) > 0, calls))), results, F.array(_message("assistant", status)))


def final_summary(claimed: Column, final_passed: Column, tier1: Column, tier2: Column, input_tokens: Column, output_tokens: Column) -> Column:
    flag = lambda c: F.initcap(F.coalesce(c, F.lit(False)).cast("string"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    parts = [("llm_claimed_success", flag(claimed)), ("final_passed", flag(final_passed)), ("tier1_pass", flag(tier1)), ("tier2_pass", flag(tier2)), ("input_tokens", count(input_tokens)), ("output_tokens", count(output_tokens)), ("total_tokens", count(input_tokens) + count(output_tokens))]
    return F.concat(F.lit("Final summary: "), F.concat_ws("; ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts]), F.lit("."))


def rebuilt_messages(task: Column, attempts: Column, summary: Column, system: Column) -> Column:
    """Messages rebuilt from a run's attempts: the system's and the task, each attempt's (see attempt_messages), and the final summary. Null texts are empty."""
    start = F.array(_message("system", F.coalesce(system, F.lit(""))), _message("user", F.coalesce(task, F.lit(""))))
    body = F.flatten(F.transform(F.coalesce(attempts, F.array().cast(attempts_type())), attempt_messages))
    return F.concat(start, body, F.array(_message("assistant", summary)))


def attempts_type() -> str:
    return "array<struct<step_number:bigint,attempt_number:bigint,goal:string,status:string,target_files:array<string>,tool_names:array<string>,failure_reason:string>>"


@F.pandas_udf(T.StringType())
def _attempts_json(text: pd.Series) -> pd.Series:
    def listed(v: object, name: str) -> list[str]:
        return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in elements(loaded(v) if isinstance(v, str) and v[:1] in "[{" else v, name)]

    def one(t: str | None) -> str:
        out = []
        for i, a in enumerate(elements(loaded(t), "attempts")):
            a = a if isinstance(a, dict) else {"goal": a if isinstance(a, str) else json.dumps(a, ensure_ascii=False)}
            numbers = {k: a[k] if a.get(k) is not None else least for k, least in (("step_number", i + 1), ("attempt_number", 1))}
            out.append(a | numbers | {k: listed(a.get(k), k) for k in ("target_files", "tool_names")})
        return json.dumps(out)

    return text.map(one)


def parsed_attempts(text: Column) -> Column:
    """The attempts in a record's JSON text, whichever shape it has (see nested.elements); none for null or empty text.

    A lone file or tool name is a list of one. An attempt without a number counts as the step of its place, first attempt; one that is a plain text has it as its goal.
    """
    return F.from_json(_attempts_json(text), attempts_type())


def message_faults(messages: Column) -> Column:
    """What is wrong with a sample's messages, as texts: empty list, unknown role, no content, an empty tool_call_id, calls without id, name or arguments or of another type."""
    bad_call = lambda c: c["id"].isNull() | (c["id"] == "") | F.coalesce(c["type"] != "function", F.lit(True)) | c["function"]["name"].isNull() | (c["function"]["name"] == "") | c["function"]["arguments"].isNull()
    at = lambda what, i: F.concat(F.lit(f"{what} at "), i.cast("string"))
    each = F.flatten(
        F.transform(
            messages,
            lambda m, i: F.array_compact(
                F.array(
                    F.when(~F.coalesce(m["role"], F.lit("")).isin(*ROLES), at("role", i)), F.when(m["content"].isNull(), at("content", i)), F.when(m["tool_call_id"] == "", at("tool_call_id", i)),
                    F.when(F.exists(F.coalesce(m["tool_calls"], F.array().cast(CALLS)), bad_call), at("tool_calls", i)),
                )
            ),
        )
    )
    return F.when(messages.isNull() | (F.size(messages) == 0), F.array(F.lit("no messages"))).otherwise(each)


def read_samples(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(samples, faults) of a file of training samples, one JSON object a line, blank lines skipped: samples (messages, metadata as JSON text), faults (place, fault).

    A sample has a list of one or more messages of a known role and text content, whose calls are complete. strict: reading a faulty line is an error with its place.
    """
    lines = placed_lines(spark, path)
    kinds = F.from_json("value", "struct<messages:array<struct<content:variant,tool_call_id:variant>>>")["messages"]
    messages = F.from_json("value", f"struct<messages:array<{MESSAGE}>>")["messages"]
    odd = F.exists(kinds, lambda m: (F.schema_of_variant(m["content"]) != "STRING") | ~F.coalesce(F.schema_of_variant(m["tool_call_id"]).isin("STRING", "VOID"), F.lit(True)))
    d = lines.withColumn("messages", messages).withColumn("f", F.filter(message_faults(F.col("messages")), lambda x: ~x.startswith("tool_call_id")))
    fault = F.when(F.json_object_keys("value").isNull(), "no JSON object").when(F.size("f") > 0, F.array_join("f", ", ")).when(F.coalesce(odd, F.lit(False)), "a message isn't made of texts")
    d = d.withColumn("fault", F.when(F.col("value").rlike(r"\S"), fault)).drop("f")
    if strict:
        good = d.withColumn("messages", F.when(F.col("fault").isNull(), F.col("messages")).otherwise(F.raise_error(F.concat("place", F.lit(": "), "fault")).cast(f"array<{MESSAGE}>")))
    else:
        good = d.where("fault IS NULL")
    return good.select("messages", F.get_json_object("value", "$.metadata").alias("metadata")), d.where("fault IS NOT NULL").select("place", "fault")


def sample_stats(texts: DataFrame, column: str, batch_size: int) -> DataFrame:
    """One row: samples, batches, and the least, mean and most characters."""
    n = F.length(column)
    return texts.agg(F.count(column).alias("n_samples"), F.ceil(F.count(column) / batch_size).alias("n_batches"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"), F.round(F.avg(n), 6).alias("avg_chars"))


def sample_rows(records: DataFrame, system: str = "", require_raw: bool = False) -> DataFrame:
    """(trajectory_id, messages, metadata, text, faults): a training sample of each record (trajectory_id, instance_id, task, model, seed, llm_claimed_success, verification,
    attempts, token_usage, metadata).

    A record's raw messages count where it kept some, else they are rebuilt, or with require_raw reading it is an error. The system's text is the record's
    own (metadata system_prompt) where it has one. The sample's metadata tell what the record was, and where its messages come from (export_source).
    """
    v, u = F.col("verification"), F.col("token_usage")
    count = lambda c: F.coalesce(u[c], F.lit(0)).cast("long")
    summary = final_summary(F.col("llm_claimed_success"), v["final_passed"], v["tier1_pass"], v["tier2_pass"], u["input_tokens"], u["output_tokens"])
    rebuilt = rebuilt_messages(F.col("task"), F.col("attempts"), summary, F.coalesce(F.col("metadata")["system_prompt"], F.lit(system)))
    if require_raw:
        rebuilt = F.raise_error(F.concat(F.lit("no raw messages in "), F.coalesce("trajectory_id", F.lit("a record")))).cast(f"array<{MESSAGE}>")
    d = records.withColumn("_raw", raw_messages(F.col("metadata"))).withColumn("messages", F.when(F.col("_raw").isNotNull(), F.col("_raw")).otherwise(rebuilt))
    flag = lambda c: F.coalesce(c, F.lit(False))
    usage = F.struct(count("input_tokens").alias("input_tokens"), count("output_tokens").alias("output_tokens"), count("cache_read_tokens").alias("cache_read_tokens"), count("cache_create_tokens").alias("cache_create_tokens"), (count("input_tokens") + count("output_tokens")).alias("total_tokens"))
    about = F.struct(
        "trajectory_id", "instance_id", "model", "seed", flag(F.col("llm_claimed_success")).alias("llm_claimed_success"), flag(v["final_passed"]).alias("final_passed"), flag(v["tier1_pass"]).alias("tier1_pass"), flag(v["tier2_pass"]).alias("tier2_pass"),
        usage.alias("token_usage"), F.when(F.col("_raw").isNotNull(), "metadata_raw_messages").otherwise("reconstructed_attempts").alias("export_source"),
    )
    return d.select("trajectory_id", "messages", about.alias("metadata"), training_text(F.col("messages")).alias("text"), message_faults(F.col("messages")).alias("faults"))


def write_samples(samples: DataFrame, path: str, with_metadata: bool = True) -> int:
    """Samples as one JSON object a line, what a message hasn't left out; the number of samples."""
    body = F.struct("messages", "metadata") if with_metadata else F.struct("messages")
    samples.select(F.to_json(body, {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(path)
    return samples.sparkSession.read.text(path).count()
