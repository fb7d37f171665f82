"""Rules over the running state of a session: nudges, budgets, repeats, streaks, numbering; and the trimming of message histories.

Calls are as in operators.detectors; messages have conv_id, turn, role, text. Each rule is a window over one exchange by session.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracefold.functions import text as texts
from tracefold.operators.ranks import ordered_running
from tracefold.session import checkpointed


def _in_run():
    return W.partitionBy("trajectory_id").orderBy("pos")



def _EDIT() -> Column:
    return F.col("tool").isin("file_edit", "file_create")


def last_of_turn() -> Column:
    """Whether a call is the last of its turn; rules that look at turn starts look at these."""
    n = F.lead("turn_id").over(_in_run())
    return n.isNull() | (n != F.col("turn_id"))


def edit_nudges(calls: DataFrame, window: int = 6) -> DataFrame:
    """Where a run has made `window` calls or more and none of the last `window` is an edit."""
    w = _in_run().rowsBetween(-(window - 1), 0)
    c = calls.select("trajectory_id", "pos", "turn_id", "tool").withColumn("e", F.max(_EDIT().cast("int")).over(w)).withColumn("n", F.row_number().over(_in_run())).withColumn("last", last_of_turn())
    return c.where((F.col("e") == 0) & (F.col("n") >= window) & F.col("last")).select("trajectory_id", "pos", "turn_id")


def test_nudges(calls: DataFrame, window: int = 5) -> DataFrame:
    """Where a run has made `window` calls or more and the last `window` hold an edit and no bash call; a window of 0 or less gives no rows."""
    w = _in_run().rowsBetween(-(max(window, 1) - 1), 0)
    c = calls.select("trajectory_id", "pos", "turn_id", "tool").withColumn("e", F.max(_EDIT().cast("int")).over(w)).withColumn("b", F.max((F.col("tool") == "bash").cast("int")).over(w)).withColumn("n", F.row_number().over(_in_run())).withColumn("last", last_of_turn())
    return c.where((F.col("e") == 1) & (F.col("b") == 0) & (F.col("n") >= window) & F.col("last") & F.lit(window > 0)).select("trajectory_id", "pos", "turn_id")


def numbered(calls: DataFrame) -> DataFrame:
    """The calls' numbers in their turn and in their run, from 0, by place."""
    t = W.partitionBy("trajectory_id", "turn_id").orderBy("pos")
    return calls.select("trajectory_id", "pos", "turn_id", (F.row_number().over(t) - 1).cast("long").alias("in_turn"), (F.row_number().over(_in_run()) - 1).cast("long").alias("in_run"))


def over_budget(calls: DataFrame, total: int = 100, per_step: int = 15, step: str = "turn_id") -> DataFrame:
    """Calls beyond the budgets of the run or of their step (trajectory_id, pos, step, why); `step` names the column that tells steps apart."""
    c = calls.select("trajectory_id", "pos", F.col(step).alias("step")).withColumn("before", F.row_number().over(_in_run()) - 1).withColumn("in_step", F.row_number().over(W.partitionBy("trajectory_id", "step").orderBy("pos")) - 1)
    why = F.when(F.col("before") >= total, "total").when(F.col("in_step") >= per_step, "step")
    return c.withColumn("why", why).where("why IS NOT NULL").select("trajectory_id", "pos", "step", "why")


def action_key() -> Column:
    """What tells a call's action from others: its tool with the hash of its params, or the params where the hash is empty."""
    return F.concat(F.col("tool"), F.lit(":"), F.coalesce(F.nullif(F.col("params_hash"), F.lit("")), F.md5("params")))


def repeated_actions(calls: DataFrame, allowed: int = 2, step: str = "turn_id") -> DataFrame:
    """(trajectory_id, pos, step, action, nth): calls that a guard blocks since the step did the same action `allowed` times before. Blocked calls aren't made: nth counts the attempts."""
    w = W.partitionBy("trajectory_id", "step", "action").orderBy("pos")
    c = calls.select("trajectory_id", "pos", F.col(step).alias("step"), action_key().alias("action"))
    return c.withColumn("nth", F.row_number().over(w).cast("long")).where(F.col("nth") > allowed)


def files_touched(calls: DataFrame) -> DataFrame:
    """Per run: distinct files read and edited with success."""
    f = lambda cond: F.count_distinct(F.when(cond & F.col("ok") & (F.col("target_file") != ""), F.col("target_file")))
    return calls.groupBy("trajectory_id").agg(f(F.col("tool") == "file_read").alias("n_read"), f(_EDIT()).alias("n_edited"))


def error_streaks(calls: DataFrame, least: int = 3) -> DataFrame:
    """Stretches of `least` or more failed calls in a row: (trajectory_id, first_pos, last_pos, n)."""
    c = calls.select("trajectory_id", "pos", "ok").withColumn("g", F.sum(F.col("ok").cast("int")).over(_in_run())).where(~F.col("ok"))
    return c.groupBy("trajectory_id", "g").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n")).where(F.col("n") >= least).drop("g")


def blocked_by_errors(calls: DataFrame, limit: int = 3) -> DataFrame:
    """(trajectory_id, n_blocks): how often a guard blocks the next call after `limit` failures in a row and starts to count anew.

    A blocked call isn't made, so it neither fails nor succeeds: after each block counting starts from 0. Of a streak of failures every
    (limit + 1)-th is blocked, and the call after a streak that stopped at the limit. Streaks are summed, so no run's calls are gathered.
    """
    c = calls.select("trajectory_id", "pos", "ok").withColumn("g", F.sum(F.col("ok").cast("int")).over(_in_run()))
    streaks = c.groupBy("trajectory_id", "g").agg(F.count_if(~F.col("ok")).alias("n"))
    at_limit = lambda n: (n % (limit + 1) == limit).cast("long")
    blocks = F.sum(F.floor(F.col("n") / (limit + 1)) + at_limit(F.col("n"))) - at_limit(F.max_by("n", "g"))
    return streaks.groupBy("trajectory_id").agg(blocks.cast("long").alias("n_blocks")).where("n_blocks > 0")


def idle_advice(calls: DataFrame, first: int = 8, every: int = 5) -> DataFrame:
    """Calls at which a run that has made no edit is told so: the first-th call and each every-th after it."""
    c = calls.select("trajectory_id", "pos", "tool").withColumn("edits", F.sum(_EDIT().cast("int")).over(_in_run())).withColumn("n", F.row_number().over(_in_run()))
    return c.where((F.col("edits") == 0) & (F.col("n") >= first) & ((F.col("n") - first) % every == 0)).select("trajectory_id", "pos")


# --- histories of messages


CHARS_A_TOKEN = 3.5


def token_estimate(chars: Column) -> Column:
    return F.floor(chars / CHARS_A_TOKEN).cast("long")


def _last_turns(messages: DataFrame, n: int) -> DataFrame:
    """(_c, from_turn): per conversation the turn of its n-th last message; none where there are fewer. Only the n last of each partition move."""
    last = messages.select("conv_id", "turn").withColumn("_n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("_n") <= n)
    return last.groupBy(F.col("conv_id").alias("_c")).agg(F.min("turn").alias("from_turn"), F.count("*").alias("_m")).where(F.col("_m") == n).drop("_m")


def trim_note(text: Column, shown: int = 100) -> Column:
    """What an old result is cut to: its number of lines and the first characters of the first line."""
    return F.concat(F.lit("[trimmed — "), F.size(F.split(text, "\n")).cast("string"), F.lit(" lines] "), F.left(F.substring_index(text, "\n", 1), F.lit(shown)))


def trimmed_results(messages: DataFrame, keep: int = 5, plain_over: int | None = None) -> DataFrame:
    """Messages with all tool results but the last `keep` cut to a note (see trim_note); empty and null ones stay.

    plain_over: the results are plain texts, of which only those of more characters are cut. Turns have no ties in a conversation; the texts go through no window.
    """
    result = F.col("role") == "tool_result"
    cuts = _last_turns(messages.where(result), keep)
    m = messages.join(cuts, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    long = F.length("text") > (0 if plain_over is None else plain_over)
    old = result & (F.lit(True) if keep <= 0 else F.coalesce(F.col("turn") < F.col("from_turn"), F.lit(False)))
    return m.withColumn("text", F.when(old & long, trim_note(F.col("text"))).otherwise(F.col("text"))).drop("_c", "from_turn")


def cut_results(messages: DataFrame, lines: int = 50) -> DataFrame:
    """Messages with tool results of more lines cut to the first ones and a note."""
    cut = texts.truncated_lines(F.col("text"), lines, texts.HISTORY_NOTE)
    return messages.withColumn("text", F.when(F.col("role") == "tool_result", cut).otherwise(F.col("text")))


def dropped_oldest(messages: DataFrame, limit_tokens: int, keep_last: int = 4) -> DataFrame:
    """Messages that stay when the oldest are dropped, one by one, until the estimate is within the limit; each conversation's first message and its last ones always stay.

    Turns are whole numbers without ties in a conversation. Only turns and lengths are ranked, by pieces (operators.ranks); a conversation's result is one turn, up to
    which all but the first are dropped.
    """
    sizes = messages.select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("_len"))
    whole = sizes.groupBy(F.col("conv_id").alias("_c")).agg(F.sum("_len").alias("_total"), F.min("turn").alias("_first"), F.min_by("_len", "turn").alias("_len0"))
    tail = _last_turns(messages, keep_last)
    ranked = ordered_running(sizes, ["conv_id"], "turn", F.col("_len"))
    d = ranked.join(whole, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c").join(tail, F.col("conv_id").eqNullSafe(F.col("_c")))
    # What was dropped before a message is all between it and the first one.
    free = (F.col("turn") > F.col("_first")) & (F.col("turn") < F.col("from_turn")) if keep_last > 0 else F.col("turn") > F.col("_first")
    over = F.floor((F.col("_total") - (F.col("running") - F.col("_len0"))) / CHARS_A_TOKEN) > limit_tokens
    cuts = d.where(free & over).groupBy(F.col("conv_id").alias("_d")).agg(F.max("turn").alias("_cut"), F.first("_first").alias("_first"))
    m = messages.join(cuts, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    return m.where("_cut IS NULL OR turn > _cut OR turn = _first").drop("_d", "_cut", "_first")


def compaction_stage(messages: DataFrame, window_tokens: int = 128_000, share: float = 0.70, keep: int = 5, lines: int = 50) -> DataFrame:
    """Per conversation (conv_id, tokens, stage): its estimate, and the first stage that brings it to the limit.

    0: none needed, 1: old results trimmed, 2: long results cut to lines as well, 5: oldest dropped. Stages 3 and 4 need a model's summary, which `summarised` takes.
    """
    limit = int(window_tokens * share)
    one = trimmed_results(messages.withColumn("_a", F.length("text")), keep).withColumn("_b", F.length("text"))
    two = cut_results(one, lines)
    s = two.groupBy("conv_id").agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("a"), F.coalesce(F.sum("_b"), F.lit(0)).alias("b"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c"))
    fits = lambda x: token_estimate(F.col(x)) <= limit
    return s.select("conv_id", token_estimate(F.col("a")).alias("tokens"), F.when(fits("a"), 0).when(fits("b"), 1).when(fits("c"), 2).otherwise(5).alias("stage"))


def compacted(messages: DataFrame, window_tokens: int = 128_000, share: float = 0.70, keep: int = 5, keep_last: int = 4, lines: int = 50) -> DataFrame:
    """The messages after the stages that their conversation needs (see compaction_stage), with the stage."""
    stages = checkpointed(compaction_stage(messages, window_tokens, share, keep, lines)).select(F.col("conv_id").alias("_s"), "stage")
    m = messages.join(stages, F.col("conv_id").eqNullSafe(F.col("_s"))).drop("_s")
    m = checkpointed(m)
    parts = [m.where("stage = 0"), trimmed_results(m.where("stage = 1"), keep), cut_results(trimmed_results(m.where("stage = 2"), keep), lines), dropped_oldest(cut_results(trimmed_results(m.where("stage = 5"), keep), lines), int(window_tokens * share), keep_last)]
    return reduce(DataFrame.unionByName, parts)


def summarised(messages: DataFrame, summaries: DataFrame, label: str = "full_summary", keep_last: int = 4) -> DataFrame:
    """Conversations of more than five messages as the first one, a summary of the user's role, and the last ones; others, and those without summary, as they are.

    summaries: (conv_id, summary), one a conversation. The summary takes the turn of the first message it stands for. Texts go through no window.
    """
    ends = messages.groupBy(F.col("conv_id").alias("_e")).agg(F.count("*").alias("_all"), F.min("turn").alias("_first")).where("_all > 5")
    given = summaries.where("summary <> ''").select(F.col("conv_id").alias("_g"), "summary")
    plan = ends.join(given, F.col("_e").eqNullSafe(F.col("_g"))).join(_last_turns(messages, keep_last), F.col("_e").eqNullSafe(F.col("_c"))).select("_e", "_first", "from_turn", "summary")
    m = messages.join(plan, F.col("conv_id").eqNullSafe(F.col("_e")), "left")
    middle = F.coalesce((F.col("turn") > F.col("_first")) & (F.col("turn") < F.col("from_turn")), F.lit(False))
    m = m.withColumn("_mid", middle)
    second = m.where("_mid").groupBy(F.col("conv_id").alias("_q")).agg(F.min("turn").alias("_second"))
    m = m.join(second, F.col("conv_id").eqNullSafe(F.col("_q")), "left").where("NOT _mid OR turn = _second")
    text = F.concat(F.lit(f"[{label}] Previous conversation summary:\n\n"), F.col("summary"))
    return m.withColumn("text", F.when(F.col("_mid"), text).otherwise(F.col("text"))).withColumn("role", F.when(F.col("_mid"), "user").otherwise(F.col("role"))).drop("_e", "_first", "from_turn", "summary", "_mid", "_q", "_second")
