"""The rules over runs as Structured Streaming: run files, event logs, token streams and guards with state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracefold.functions import steps
from tracefold.operators.sessions import action_key
from tracefold.sources.files import RECORD_DDL, record_fault

EDITS = ("file_edit", "file_create")


def record_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Run files that appear in a folder, as records with their fault (null for good ones). A run is one line, so no state is kept."""
    lines = spark.readStream.text(folder).where(F.col("value").rlike(r"\S")).withColumn("r", F.from_json("value", RECORD_DDL))
    return lines.withColumn("fault", record_fault(F.col("value"), F.col("r"))).select("r.*", "fault")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """An append-only event log as a stream with event time `at`."""
    return spark.readStream.schema("type STRING, data STRING, timestamp DOUBLE").json(folder).withColumn("at", F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("long")))


KINDS_OF_TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens")


def token_totals(events: DataFrame, input_price: float = 0.0, output_price: float = 0.0) -> DataFrame:
    """Running token sums of the model's answers (their usage) in an event log, and what they cost at the given prices of a million tokens; batch or stream (complete or update mode)."""
    n = lambda k: F.coalesce(F.get_json_object("data", f"$.usage.{k}").try_cast("bigint"), F.lit(0))
    sums = [F.coalesce(F.sum(n(k)), F.lit(0)).alias(k) for k in KINDS_OF_TOKENS]
    cost = F.col("input_tokens") / 1_000_000 * input_price + F.col("output_tokens") / 1_000_000 * output_price
    return events.where("type = 'llm_response'").agg(F.count("*").alias("n_answers"), *sums).withColumn("cost", cost)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by key and window of event time; windows close after the watermark, later events are dropped."""
    w = events.withWatermark(time, late) if events.isStreaming else events
    return w.groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def signalled(calls: DataFrame) -> DataFrame:
    """Calls with the signal told from their result, at append."""
    return calls.withColumn("told", steps.error_signal(F.col("tool"), F.col("params"), F.col("ok"), F.col("content"), F.col("signal")))


def assembled_calls(chunks: DataFrame) -> DataFrame:
    """(response_id, idx, call_id, name, arguments) of tool calls that come in pieces (response_id, idx, seq, call_id, name, part), joined in order of seq.

    The first piece tells call_id and name. Arguments that are no JSON object, or none, read {}.
    """
    first = lambda c: F.coalesce(F.min_by(c, "seq"), F.lit("")).alias(c)
    joined = chunks.groupBy("response_id", "idx").agg(first("call_id"), first("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: F.coalesce(x["part"], F.lit(""))), "").alias("text"))
    return joined.select("response_id", "idx", "call_id", "name", F.when(F.json_object_keys("text").isNotNull() & F.try_parse_json("text").isNotNull(), F.col("text")).otherwise("{}").alias("arguments"))


CALL = "response_id string, idx long, call_id string, name string, arguments string"


def assembled_stream(chunks: DataFrame) -> DataFrame:
    """assembled_calls of a stream of pieces (response_id, seq, idx, call_id, name, part, finished): a response's calls come out when its last piece has come.

    A response's pieces come in order of seq from batch to batch; the state holds what came so far, and is dropped at the end. Pieces without idx carry text only.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values("seq")
        done = False
        for idx, call_id, name, part, finished in zip(rows["idx"], rows["call_id"], rows["name"], rows["part"], rows["finished"]):
            if idx is not None and not pd.isna(idx):
                call = held.setdefault(str(int(idx)), [call_id or "", name or "", ""])
                call[2] += part or ""
            done = done or bool(finished)
        if not done:
            state.update((json.dumps(held),))
            yield pd.DataFrame([], columns=["response_id", "idx", "call_id", "name", "arguments"])
            return
        if state.exists:
            state.remove()
        out = []
        for idx in sorted(held, key=int):
            call_id, name, text = held[idx]
            try:
                ok = isinstance(json.loads(text), dict)
            except ValueError:
                ok = False
            out.append((key[0], int(idx), call_id, name, text if ok else "{}"))
        yield pd.DataFrame(out, columns=["response_id", "idx", "call_id", "name", "arguments"])

    return chunks.groupBy("response_id").applyInPandasWithState(step, CALL, "held string", "append", GroupStateTimeout.NoTimeout)


GUARD = "trajectory_id string, pos long, verdict string"


class Guard:
    """What a run did so far, and what a guard says to its next call.

    verdict, the first that holds: over_total (too many calls), over_step (too many in the step), too_many_errors (so many failures in a row; counting starts anew), repeated (the same action
    so often before in the step), unread (an edit of a file that the run didn't read with success), too_many_files (a further file where the step changed so many), or ok. A
    call that isn't ok is not made, so it changes nothing else. A step begins where `step` changes: its calls, actions and changed files count anew.
    """

    def __init__(self, limits: tuple[int, int, int, int, int], state: str = ""):
        self.limits = limits
        held = json.loads(state) if state else {}
        self.made, self.fails, self.step, self.in_step = (held.get(k, d) for k, d in (("made", 0), ("fails", 0), ("step", None), ("in_step", 0)))
        self.actions, self.read, self.changed = held.get("actions", {}), set(held.get("read", ())), set(held.get("changed", ()))

    def verdict(self, step: int, tool: str, action: str, file: str, ok: bool) -> str:
        total, per_step, errors, repeats, files = self.limits
        if step != self.step:
            self.step, self.in_step, self.actions, self.changed = step, 0, {}, set()
        edits = tool in ("file_edit", "file_create") and file != ""
        if self.made >= total:
            return "over_total"
        if self.in_step >= per_step:
            return "over_step"
        if self.fails >= errors:
            self.fails = 0
            return "too_many_errors"
        if self.actions.get(action, 0) >= repeats:
            return "repeated"
        if tool == "file_edit" and edits and file not in self.read:
            return "unread"
        if edits and file not in self.changed and len(self.changed) >= files:
            return "too_many_files"
        self.made, self.in_step, self.fails = self.made + 1, self.in_step + 1, 0 if ok else self.fails + 1
        self.actions[action] = self.actions.get(action, 0) + 1
        if ok and edits:
            self.changed.add(file)
        if ok and tool == "file_read" and file:
            self.read.add(file)
        return "ok"

    def state(self) -> str:
        return json.dumps({"made": self.made, "fails": self.fails, "step": self.step, "in_step": self.in_step, "actions": self.actions, "read": sorted(self.read), "changed": sorted(self.changed)})


def guarded(calls: DataFrame, total: int = 100, per_step: int = 15, errors: int = 3, repeats: int = 2, files: int = 10, step: str = "turn_id") -> DataFrame:
    """(trajectory_id, pos, verdict): each call with what a guard says to it, given what the run did before (see Guard); `step` names the column that tells steps apart.

    A stream keeps a state per run, and takes a batch's calls in order of pos. A batch is sorted by run and pos and folded as it is read, so no
    run is held whole. Null tools, params, files and flags are empty and false.
    """
    limits = (total, per_step, errors, repeats, files)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    c = calls.select("trajectory_id", "pos", F.coalesce(F.col(step), F.lit(-1)).cast("long").alias("step"), text("tool").alias("tool"), text("params").alias("params"), text("params_hash").alias("params_hash"), text("target_file").alias("file"), F.coalesce("ok", F.lit(False)).alias("ok"))
    kept = c.select("trajectory_id", "pos", "step", "tool", action_key().alias("action"), "file", "ok")
    columns = ("step", "tool", "action", "file", "ok")
    if not calls.isStreaming:

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            run, guard = None, None
            for b in batches:
                out = []
                for r, *call in zip(b["trajectory_id"], *[b[x] for x in columns]):
                    if guard is None or r != run:
                        run, guard = r, Guard(limits)
                    out.append(guard.verdict(*call))
                yield pd.DataFrame({"trajectory_id": b["trajectory_id"], "pos": b["pos"], "verdict": out})

        return kept.where("trajectory_id IS NOT NULL").repartition("trajectory_id").sortWithinPartitions("trajectory_id", "pos").mapInPandas(fold, GUARD)

    def step_on(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        guard = Guard(limits, state.get[0] if state.exists else "")
        rows = pd.concat(list(frames)).sort_values("pos")
        rows["verdict"] = [guard.verdict(int(s), *call) for s, *call in zip(*[rows[x] for x in columns])]
        state.update((guard.state(),))
        yield rows[["trajectory_id", "pos", "verdict"]]

    return kept.groupBy("trajectory_id").applyInPandasWithState(step_on, GUARD, "held string", "append", GroupStateTimeout.NoTimeout)


NUDGE = "trajectory_id string, pos long, turn_id long, nudge string"


def nudged(calls: DataFrame, edit_window: int = 6, test_window: int = 5) -> DataFrame:
    """(trajectory_id, pos, turn_id, nudge) of a stream of calls: at the end of each turn, i.e. when the next one's first call comes, what a run is told: edit or test.

    edit: none of the last edit_window calls is an edit; test: the last test_window hold an edit and no bash call. Both need as many calls. The same as sessions.edit_nudges and
    test_nudges but for a run's last turn, which no other follows. The state holds the last calls' tools.
    """
    longest = max(edit_window, test_window, 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tools, n, turn, pos = (lambda h: (h[0], h[1], h[2], h[3]))(json.loads(state.get[0])) if state.exists else ([], 0, None, None)
        out = []
        rows = pd.concat(list(frames)).sort_values("pos")
        for p, t, tool in zip(rows["pos"], rows["turn_id"], rows["tool"]):
            if n and t != turn:
                last = lambda k: tools[-k:] if 0 < k <= n else None
                if (x := last(edit_window)) and not any(y in EDITS for y in x):
                    out.append((key[0], pos, turn, "edit"))
                if (x := last(test_window)) and any(y in EDITS for y in x) and "bash" not in x:
                    out.append((key[0], pos, turn, "test"))
            tools, n, turn, pos = [*tools, tool][-longest:], n + 1, int(t), int(p)
        state.update((json.dumps([tools, n, turn, pos]),))
        yield pd.DataFrame(out, columns=["trajectory_id", "pos", "turn_id", "nudge"])

    kept = calls.select("trajectory_id", "pos", F.coalesce("turn_id", F.lit(-1)).cast("long").alias("turn_id"), F.coalesce("tool", F.lit("")).alias("tool"))
    return kept.groupBy("trajectory_id").applyInPandasWithState(step, NUDGE, "held string", "append", GroupStateTimeout.NoTimeout)
