"""Whole jobs over files, as `python -m tracefold.plans.jobs NAME ...` or spark-submit runs them."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import steps
from tracefold.operators import detectors, export, tasks
from tracefold.session import checkpointed
from tracefold.sources import files


def calls_of(records: DataFrame) -> DataFrame:
    """The calls of records in list order, which is the order that counts, with signals told anew from the results."""
    e = records.select("trajectory_id", F.posexplode("tool_call_events").alias("pos", "e")).select("trajectory_id", F.col("pos").cast("long").alias("pos"), "e.*")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    e = e.select("trajectory_id", "pos", F.coalesce("turn_id", F.lit(0)).alias("turn_id"), F.coalesce("call_index_in_turn", F.lit(0)).alias("call_index_in_turn"), F.coalesce("global_index", F.col("pos")).alias("global_index"), F.col("tool_name").alias("tool"), text("params").alias("params"), text("params_hash").alias("params_hash"), text("target_file").alias("target_file"), F.coalesce("result_success", F.lit(False)).alias("ok"), text("result_content").alias("content"), text("error_signal").alias("given"))
    return e.withColumn("signal", steps.error_signal(F.col("tool"), F.col("params"), F.col("ok"), F.col("content"), F.col("given"))).drop("given")


def runs_of(records: DataFrame) -> DataFrame:
    no = F.lit(False)
    return records.select(F.lower("trajectory_id").alias("run"), "instance_id", "model", "seed", F.col("llm_claimed_success").alias("claimed"), F.coalesce("verification.tier1_pass", no).alias("tier1_pass"), F.coalesce("verification.tier2_pass", no).alias("tier2_pass"), F.coalesce("verification.tier2_command", F.lit("")).alias("tier2_command"), F.coalesce(F.col("metadata")["final_diff"], F.lit("")).alias("final_diff"), "token_usage.input_tokens", "token_usage.output_tokens")


def classify(spark: SparkSession, runs: str, task_file: str | None, out: str) -> None:
    """Writes out/labels, out/non_toxic (records) and out/summary for a run file; the labels are made once and cut off from their lineage."""
    records, _ = files.read_records(spark, runs)
    gold = files.read_tasks(spark, task_file) if task_file else spark.createDataFrame([], "instance_id string, gold_patch string")
    labels = checkpointed(detectors.run_labels(calls_of(records), runs_of(records), gold))
    labels.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{out}/labels")
    clean = labels.where("NOT is_toxic").select("run")
    files.write_records(records.join(clean, F.lower("trajectory_id") == F.col("run"), "left_semi"), f"{out}/non_toxic")
    detectors.label_summary(labels).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{out}/summary")


def prepare(spark: SparkSession, records: str, out: str, hints: bool = False) -> None:
    """Writes task rows for a benchmark's records; empty optional fields are left out."""
    t = tasks.prepared(spark.read.json(records), hints)
    t.select(F.to_json(F.struct(*[F.nullif(F.col(c), F.lit("")).alias(c) if k == "string" else F.col(c) for c, k in t.dtypes])).alias("value")).write.mode("overwrite").text(out)


def to_chat(spark: SparkSession, runs: str, out: str, system: str = "") -> int:
    """Writes chat-format training samples of a run file and gives their number; samples with faults are an error."""
    s = export.sample_rows(files.read_records(spark, runs)[0], system)
    s = s.withColumn("messages", F.when(F.size("faults") == 0, F.col("messages")).otherwise(F.raise_error(F.concat(F.col("trajectory_id"), F.lit(": "), F.array_join("faults", ", ")))))
    return export.write_samples(s, out)


def compare(spark: SparkSession, arms: dict[str, str], out: str) -> None:
    """Writes the aggregates of each arm (name to run file, labels beside it) as one JSON array, and its outcomes in percent as rows."""
    parts = []
    for name, path in arms.items():
        records, labels = files.read_arm(spark, name, path)
        facts = detectors.call_facts(calls_of(records)).select(F.lower("trajectory_id").alias("run"), "n_calls", "n_edits", "n_bash")
        r = records.withColumn("run", F.lower("trajectory_id")).select("run", "trajectory_id", "token_usage.input_tokens", "token_usage.output_tokens").join(facts, "run", "left")
        parts.append(detectors.with_labels(r, labels).select(F.lit(name).alias("arm"), "outcome", F.coalesce("recovery_event_count", F.lit(0)).alias("n_recoveries"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_calls", "n_edits", "n_bash", "input_tokens", "output_tokens")]))
    whole = checkpointed(reduce(DataFrame.unionByName, parts))
    rows = detectors.arm_aggregates(whole, F.col("arm"), list(arms))
    rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("*")))).alias("value")).write.mode("overwrite").text(f"{out}/aggregates")  # a row an arm
    detectors.outcome_shares(whole, F.col("arm")).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{out}/outcomes")


def report(results: DataFrame, out: str) -> None:
    """Writes the run report of (ordinal, exit_code) as one JSON object."""
    tasks.run_report(results).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(out)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="job", required=True)
    c = sub.add_parser("classify")
    c.add_argument("runs"), c.add_argument("out"), c.add_argument("--tasks")
    c = sub.add_parser("prepare")
    c.add_argument("records"), c.add_argument("out"), c.add_argument("--hints", action="store_true")
    c = sub.add_parser("chat")
    c.add_argument("runs"), c.add_argument("out"), c.add_argument("--system", default="")
    c = sub.add_parser("compare")
    c.add_argument("out"), c.add_argument("--arm", action="append", required=True, help="name:path")
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.job == "classify":
        classify(spark, a.runs, a.tasks, a.out)
    elif a.job == "prepare":
        prepare(spark, a.records, a.out, a.hints)
    elif a.job == "compare":
        compare(spark, dict(x.split(":", 1) for x in a.arm), a.out)
    else:
        to_chat(spark, a.runs, a.out, a.system)


if __name__ == "__main__":
    main()
