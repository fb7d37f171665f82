"""Failure patterns, recoveries and outcomes of runs, from their ordered calls.

All functions take calls with trajectory_id, pos, turn_id, call_index_in_turn, global_index, tool, params, params_hash, target_file, ok, content
and signal (see sources.views). Windows and sums share one exchange by trajectory_id. Runs without calls are kept where runs are
given. A null flag counts as false; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracefold.functions import diffs, steps

LOOKAHEAD = 8


def _in_run():
    return W.partitionBy("trajectory_id").orderBy("pos")



def _corrects(e: Column, c: Column) -> Column:
    """Whether call c can be the correction of the error e: same tool with other params, same target, a change of tactics, or an edit."""
    pair = lambda a, b: ((e["tool"] == a) & (c["tool"] == b)) | ((e["tool"] == b) & (c["tool"] == a))
    same = e["tool"] == c["tool"]
    target = (e["target_file"] == c["target_file"]) & (e["target_file"] != "")
    tactics = pair("bash", "search") | pair("bash", "file_read") | pair("file_edit", "file_create")
    return (same | target | tactics | c["tool"].isin("file_edit", "file_create")) & (~same | (e["params_hash"] != c["params_hash"]))


def with_correction(calls: DataFrame) -> DataFrame:
    """calls with x, an error's correction (pos, global_index, level, investigation_count), null where there is none.

    An error has a signal other than NONE and BLOCKED; its correction is the first of the next LOOKAHEAD calls that is later by (turn_id,
    call_index_in_turn), succeeded with signal NONE and corrects it. Two or more investigations between make level L3; the same tool
    with the same target (or none) is L1, else L2. The forward frame costs one sort; there is no self-join.
    """
    fields = ("pos", "turn_id", "call_index_in_turn", "global_index", "tool", "params_hash", "target_file", "ok", "signal")
    looked = steps.is_investigation(F.col("tool"), F.col("ok")).cast("int")
    c = calls.withColumn("looked", looked).withColumn("seen", F.sum("looked").over(_in_run()))
    c = c.withColumn("ahead", F.collect_list(F.struct(*fields, "seen", "looked")).over(_in_run().rowsBetween(1, LOOKAHEAD))).withColumn("e", F.struct(*fields, "seen"))
    key = lambda x: F.struct(x["turn_id"], x["call_index_in_turn"])
    fits = F.filter("ahead", lambda x: (key(x) > key(F.col("e"))) & (x["signal"] == "NONE") & x["ok"] & _corrects(F.col("e"), x))
    c = c.withColumn("f", F.when(~F.col("signal").isin("NONE", "BLOCKED"), F.try_element_at(fits, F.lit(1))))
    between = F.col("f.seen") - F.col("f.looked") - F.col("e.seen")
    same = (F.col("e.tool") == F.col("f.tool")) & (F.col("e.target_file") == F.col("f.target_file"))
    level = F.when(between >= 2, "L3").when(same, "L1").otherwise("L2")
    x = F.when(F.col("f").isNotNull(), F.struct(F.col("f.pos").alias("pos"), F.col("f.global_index").alias("global_index"), level.alias("level"), between.alias("investigation_count")))
    return c.withColumn("x", x).drop("looked", "seen", "ahead", "e", "f")


def recovery_events(calls: DataFrame) -> DataFrame:
    """(trajectory_id, error_pos, correction_pos, error_index, correction_index, error_signal, level, investigation_count): each error that is corrected, see with_correction."""
    m = with_correction(calls.drop("content", "params")).where("x IS NOT NULL")
    return m.select("trajectory_id", F.col("pos").alias("error_pos"), F.col("x.pos").alias("correction_pos"), F.col("global_index").alias("error_index"), F.col("x.global_index").alias("correction_index"), F.col("signal").alias("error_signal"), F.col("x.level").alias("level"), F.col("x.investigation_count").alias("investigation_count"))


def recovery_by_run(calls: DataFrame) -> DataFrame:
    """Per run with recoveries: their number and the highest level."""
    return recovery_events(calls).groupBy("trajectory_id").agg(F.count("*").alias("n_recoveries"), F.max("level").alias("highest_level"))


def unresolved_syntax(calls: DataFrame) -> DataFrame:
    """(trajectory_id, target_file) of .py files whose last decisive edit left a syntax error."""
    e = calls.where(F.col("tool").isin("file_edit", "file_create") & F.col("target_file").endswith(".py"))
    state = F.when(F.col("signal") == "SYNTAX_ERROR", True).when(F.col("ok") & (F.col("signal") == "NONE"), False)
    return e.withColumn("state", state).where("state IS NOT NULL").groupBy("trajectory_id", "target_file").agg(F.max_by("state", "pos").alias("broken")).where("broken").select("trajectory_id", "target_file")


def unread_edits(calls: DataFrame) -> DataFrame:
    """The edits of files that the run hadn't read before with success (trajectory_id, pos, target_file)."""
    first_read = F.min(F.when((F.col("tool") == "file_read") & F.col("ok"), F.col("pos"))).over(W.partitionBy("trajectory_id", "target_file"))
    c = calls.where(F.col("tool").isin("file_read", "file_edit") & (F.col("target_file") != "")).select("trajectory_id", "pos", "tool", "ok", "target_file").withColumn("first_read", first_read)
    return c.where((F.col("tool") == "file_edit") & (F.col("first_read").isNull() | (F.col("first_read") > F.col("pos")))).select("trajectory_id", "pos", "target_file")


def call_facts(calls: DataFrame) -> DataFrame:
    """Per run: which patterns its calls show, its recoveries, and how many calls, edits and bash calls it made.

    One scan and one exchange by run: calls get their correction by a window, are summed by file, then by run, all in the same partitions. A run edits what it
    hadn't read if its first edit of a file comes before the file's first read; a file's last decisive edit tells whether it is broken.
    """
    c = with_correction(calls)
    tool, signal, content, no = F.col("tool"), F.col("signal"), F.col("content"), F.lit(False)
    edit = tool.isin("file_edit", "file_create")
    refs = F.when(signal.isin("TEST_FAILURE", "RUNTIME_ERROR", "SYNTAX_ERROR"), diffs.file_refs(content))
    logic = (signal == "TEST_FAILURE") & content.rlike(steps.CASELESS + steps.ASSERTION) & ~content.rlike(steps.PLAIN + steps.NOT_LOGIC)
    state = F.when(edit & F.col("target_file").endswith(".py"), F.when(signal == "SYNTAX_ERROR", True).when(F.col("ok") & (signal == "NONE"), False))
    by_file = c.withColumn("state", state).groupBy("trajectory_id", "target_file").agg(
        F.max_by("state", F.when(F.col("state").isNotNull(), F.col("pos"))).alias("broken"), F.min(F.when((tool == "file_read") & F.col("ok"), F.col("pos"))).alias("read"), F.min(F.when(tool == "file_edit", F.col("pos"))).alias("edit"),
        F.bool_or(logic).alias("logic"), F.bool_or(signal == "TEST_FAILURE").alias("tests"), F.bool_or(steps.runs_tests(tool, F.col("params"))).alias("ran"), F.array_distinct(F.flatten(F.collect_set(refs))).alias("refs"), F.count("*").alias("n"), F.count_if(edit).alias("n_e"),
        F.count_if(tool == "bash").alias("n_b"), F.count("x").alias("n_r"), F.max("x.level").alias("level"),
    )
    named = F.col("target_file") != ""
    per_run = by_file.groupBy("trajectory_id").agg(
        F.bool_or(named & F.col("edit").isNotNull() & (F.col("read").isNull() | (F.col("edit") < F.col("read")))).alias("a1"), F.coalesce(F.bool_or("broken"), no).alias("b22"), F.bool_or("logic").alias("logic_failure"), F.bool_or("tests").alias("test_failure"), F.bool_or("ran").alias("ran_tests"),
        F.flatten(F.collect_list("refs")).alias("named"), F.collect_set(F.when(named & F.col("edit").isNotNull(), F.replace("target_file", F.lit("\\"), F.lit("/")))).alias("edited"), F.sum("n").alias("n_calls"), F.sum("n_e").alias("n_edits"), F.sum("n_b").alias("n_bash"),
        F.sum("n_r").alias("n_recoveries"), F.max("level").alias("highest_level"),
    )
    a2 = (F.size("named") > 0) & (F.size("edited") > 0) & ~F.arrays_overlap("named", "edited")
    return per_run.withColumn("a2", F.coalesce(a2, no)).drop("named", "edited")


def outcome(toxic: Column, tier1: Column, tier2: Column, command: Column, recovered: Column) -> Column:
    """The outcome; the first that holds wins."""
    return (
        F.when(toxic, "toxic")
        .when((command != "") & ~tier2, "failed")
        .when(command == "", F.when(tier1, "weakly_verified").otherwise("failed"))
        .when(tier1 & tier2, F.when(recovered, "verified_with_recovery").otherwise("verified_one_shot"))
        .otherwise("failed")
    )


def run_labels(calls: DataFrame, runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row per run: its eight patterns, categories, toxicity, recoveries, and outcome.

    Runs are joined to the calls by run id and to tasks by instance_id; the last gold patch of a task id, in the order the tasks are read, counts. Runs without calls have the patterns
    that follow from their verification.
    """
    no = F.lit(False)
    gold = tasks.withColumn("_at", F.monotonically_increasing_id()).groupBy("instance_id").agg(F.max_by("gold_patch", "_at").alias("gold"))
    f = call_facts(calls).withColumn("run", F.lower("trajectory_id")).drop("trajectory_id")
    d = runs.join(f, "run", "left").join(gold, "instance_id", "left")
    cmd, t1, t2 = F.col("tier2_command"), F.col("tier1_pass"), F.col("tier2_pass")
    b22 = F.coalesce("b22", no)
    c2 = F.col("claimed") & ~t1
    b21 = t1 & ~t2 & (cmd != "") & (F.coalesce("logic_failure", no) | (~F.coalesce("test_failure", no) & ~b22)) & ~c2
    d = d.select(
        "run", "instance_id", "model", "seed", F.coalesce("a1", no).alias("a1"), F.coalesce("a2", no).alias("a2"), diffs.incomplete_fix(F.col("final_diff"), F.col("gold")).alias("b11"), ((cmd != "") & ~F.coalesce("ran_tests", no)).alias("b12"),
        b21.alias("b21"), b22.alias("b22"), (~F.col("claimed") & t2 & (cmd != "")).alias("c1"), c2.alias("c2"), F.coalesce("n_recoveries", F.lit(0)).alias("n_recoveries"), "highest_level", "tier1_pass", "tier2_pass", "tier2_command",
        *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_calls", "n_edits", "n_bash")], "input_tokens", "output_tokens",
    )
    names = (("a1", "A1"), ("a2", "A2"), ("b11", "B1.1"), ("b12", "B1.2"), ("b21", "B2.1"), ("b22", "B2.2"), ("c1", "C1"), ("c2", "C2"))
    d = d.withColumn("categories", F.array_compact(F.array(*[F.when(F.col(c), n) for c, n in names]))).withColumn("is_toxic", F.col("c2") | F.col("b22"))
    return d.withColumn("outcome", outcome(F.col("is_toxic"), F.col("tier1_pass"), F.col("tier2_pass"), F.col("tier2_command"), F.col("n_recoveries") > 0)).drop("tier1_pass", "tier2_pass", "tier2_command")


def with_labels(runs: DataFrame, labels: DataFrame, order: str | None = None) -> DataFrame:
    """runs with the given labels of their trajectory_id, outcome unknown where there are none; of several labels the last counts, by `order` or as they are read."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    last = labels.where("trajectory_id IS NOT NULL").withColumn("_at", at).groupBy(F.col("trajectory_id").alias("_t")).agg(F.max_by(F.struct("outcome", "recovery_event_count"), "_at").alias("_l"))
    d = runs.join(last, F.col("trajectory_id") == F.col("_t"), "left")
    return d.withColumn("outcome", F.coalesce("_l.outcome", F.lit("unknown"))).withColumn("recovery_event_count", F.col("_l.recovery_event_count")).drop("_t", "_l")


def signal_histogram(calls: DataFrame) -> DataFrame:
    return calls.where("signal <> 'NONE'").groupBy("trajectory_id", "signal").agg(F.count("*").alias("n"))


def label_summary(labels: DataFrame) -> DataFrame:
    """(metric, key, n): outcomes, categories, recovery levels with 'none', and totals, of labels as run_labels gives them. One pass."""
    row = lambda metric, key: F.struct(F.lit(metric).alias("metric"), key.alias("key"))
    fixed = F.array(row("outcome", F.col("outcome")), row("level", F.coalesce("highest_level", F.lit("none"))), row("total", F.lit("runs")), row("total", F.when(F.col("is_toxic"), "toxic").otherwise("not toxic")), row("total", F.when(F.col("n_recoveries") > 0, "recovered")))
    rows = F.filter(F.concat(fixed, F.transform("categories", lambda c: row("category", c))), lambda r: r["key"].isNotNull())
    return labels.select(F.explode(rows).alias("r")).groupBy("r.metric", "r.key").agg(F.count("*").alias("n"))


def arm_aggregates(labels: DataFrame, arm: Column, arms: list[str] | None = None) -> DataFrame:
    """Per experiment arm of run_labels: runs, mean calls, edits, bash calls, the mean of their ratios, mean tokens, success and recovery rates; named arms without runs have zeros.

    The ratio is of edits to bash calls, one at least. A null outcome is no success.
    """
    out = labels.withColumn("arm", arm).groupBy("arm").agg(
        F.count("*").alias("n_runs"), F.avg("n_calls").alias("avg_calls"), F.avg("n_edits").alias("avg_edits"), F.avg("n_bash").alias("avg_bash"), F.avg(F.col("n_edits") / F.greatest("n_bash", F.lit(1))).alias("edit_bash_ratio"), F.avg("input_tokens").alias("avg_input_tokens"),
        F.avg("output_tokens").alias("avg_output_tokens"), F.avg(F.coalesce(F.col("outcome").isin("verified_one_shot", "verified_with_recovery"), F.lit(False)).cast("double")).alias("success_rate"), F.avg((F.col("n_recoveries") > 0).cast("double")).alias("recovery_rate"),
    )
    if arms:
        named = labels.sparkSession.createDataFrame([(a,) for a in arms], "arm string")
        out = named.join(out, "arm", "left").na.fill(0)
    return out


def outcome_shares(labels: DataFrame, arm: Column) -> DataFrame:
    """(arm, outcome, n, pct): the outcomes of each arm in percent of all its runs; a null outcome is unknown."""
    d = labels.withColumn("arm", arm).groupBy("arm", F.coalesce("outcome", F.lit("unknown")).alias("outcome")).agg(F.count("*").alias("n"))
    return d.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy("arm")))
