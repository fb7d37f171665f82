"""Ordered step patterns that many runs share, by direct sequence comparison (problem 2)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.calls import SIGNALS, TOOLS, first_delivered, plain_signal, plain_tool
from tracefold.session import apart, checkpointed

#: So many candidates at most (8 bytes each) are sent to the executors.
BROADCAST = 1_000_000
#: A block that is mined at once holds at least so many sequences (where the partition has as many).
BLOCK = 2048


def step_sequences(calls: DataFrame, longest_reach: int) -> DataFrame:
    """(tid, whole, starts, own, steps): the steps of each chunk of a run, then up to longest_reach steps of later chunks.

    whole: the run has one chunk; starts: 1 for a run's first chunk, else 0.
    A step is tool code * |signals| + signal code, one byte each. own counts the chunk's own steps: patterns
    that start there belong to this chunk, so every occurrence in a run of any length is seen once.
    Calls of other tools or signals keep their place in the run (as byte 255) but are in no pattern.
    """
    tool = F.coalesce(F.array_position(F.lit(list(TOOLS)), plain_tool(F.col("tool_name"))), F.lit(0)).cast("int")
    signal = F.array_position(F.lit(list(SIGNALS)), plain_signal(F.col("error_signal"))).cast("int")
    code = F.when((tool > 0) & (signal > 0), (tool - 1) * len(SIGNALS) + signal - 1).otherwise(255)
    first = first_delivered(calls, s=code)
    chunks = first.groupBy("tid", "c").agg(F.array_sort(F.collect_list(F.struct("g", "s"))).alias("x")).select("tid", "c", F.col("x.s").alias("s"))
    after = f"flatten(collect_list(slice(s, 1, {longest_reach})) OVER (PARTITION BY tid ORDER BY c ROWS BETWEEN 1 FOLLOWING AND {max(1, longest_reach)} FOLLOWING))"
    joined = chunks.withColumn("tail", F.expr(f"slice({after}, 1, {longest_reach})"))
    one_chunk = F.expr("count(*) OVER (PARTITION BY tid) = 1").alias("whole")
    starts = F.expr("if(row_number() OVER (PARTITION BY tid ORDER BY c) = 1, 1, 0)").alias("starts")
    hexed = F.unhex(F.array_join(F.transform(F.concat("s", "tail"), lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return joined.select("tid", one_chunk, starts, F.size("s").alias("own"), hexed.alias("steps"))


def codes_of(steps: bytes, own: int, lengths: tuple[int, ...], reach: int, errors: int, none: np.ndarray) -> np.ndarray:
    """The distinct patterns that start among the first `own` steps, as sorted codes.

    A code has base 64 digits, one more than the step's, first step first and 0 after the last, so codes compare as the patterns do.
    """
    a = np.frombuffer(steps, np.uint8).astype(np.int64)
    n, top = len(a), max(lengths)
    found = []
    at = np.arange(min(own, n))
    at = at[a[at] < 64]
    level = [(at, (a[at] + 1) << (6 * (top - 1)), (~none[a[at]]).astype(np.int64))]
    for k in range(2, top + 1):
        if not level:
            break
        ends, codes, wrong = (np.concatenate(x) for x in zip(*level))
        level = []
        for step in range(1, reach + 1):
            ok = ends + step < n
            e = ends[ok] + step
            s = a[e]
            ok2 = s < 64
            e, s = e[ok2], s[ok2]
            c, w = codes[ok][ok2] + ((s + 1) << (6 * (top - k))), wrong[ok][ok2] + ~none[s]
            level.append((e, c, w))
            if k in lengths:
                found.append(c[w >= errors])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def frequent_by_comparison(sequences: list[np.ndarray], threshold: int) -> list[int]:
    """The codes that at least `threshold` sequences hold; each sequence is its sorted distinct codes.

    The sequences are kept at their smallest code not yet decided. If the first of them in order equals the
    threshold-th, that code is frequent and those sequences go on to their next; else no code below
    the threshold-th can be frequent, and all sequences skip to it without anything being counted.
    """
    sequences = [s for s in sequences if len(s)]
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    if len(sequences) < threshold:
        return []
    size = np.array([len(s) for s in sequences])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    flat = np.concatenate(sequences)
    end, at = start + size, start.copy()
    out: list[int] = []
    heads = flat[at]
    while len(heads) >= threshold:
        first, bound = heads.min(), np.partition(heads, threshold - 1)[threshold - 1]
        if first == bound:
            out.append(int(first))
            move = np.flatnonzero(heads == first)
            at[move] += 1
        else:
            move = np.flatnonzero(heads < bound)
            for i in move:
                at[i] += np.searchsorted(flat[at[i] : end[i]], bound)
        over = at[move] >= end[move]
        if over.any():
            keep = at < end
            at, end, heads = at[keep], end[keep], flat[np.minimum(at[keep], len(flat) - 1)]
        else:
            heads[move] = flat[at[move]]
    return out


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches joined to blocks of BLOCK rows or more; a small rest goes to the last block."""
    held: list[pd.DataFrame] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows >= 2 * BLOCK:
            whole = pd.concat(held)
            yield whole.iloc[:-BLOCK]
            held, rows = [whole.iloc[-BLOCK:]], BLOCK
    if rows:
        yield pd.concat(held)


def frequent_patterns(calls: DataFrame, share: float = 0.1, lengths: tuple[int, ...] = (3, 4), between: int = 2, errors: int = 2) -> DataFrame:
    """(pattern, n_steps, n_runs): patterns of the given lengths that occur in order in at least share of all runs.

    Between neighbouring steps at most `between` other calls may lie, and at least `errors` steps carry a signal other
    than NONE. All runs of the table count, each once per pattern. Runs are mined in blocks by direct comparison (see
    frequent_by_comparison): what is frequent in all runs is frequent in some block, so the blocks' results hold every
    answer, and one more pass counts those candidates exactly. Candidates are few where blocks are of BLOCK sequences, each is in at least
    `share` of a block's runs; small tables have small blocks and more candidates, the rows are the same. Long runs lie in several chunks; these are mined apart and counted as one run.

    Calls without trajectory_id or global_index are left out; null and empty signals are NONE; repeated
    deliveries count once; an empty table gives no rows; extra columns are ignored.
    """
    if max(lengths) > 10 or len(TOOLS) * len(SIGNALS) > 63:
        raise ValueError("patterns have at most 10 steps")
    reach, top = between + 1, max(lengths)
    none = np.ones(256, bool)
    for t in range(len(TOOLS)):
        for s, name in enumerate(SIGNALS):
            none[t * len(SIGNALS) + s] = name == "NONE"
    spark = calls.sparkSession
    seqs = checkpointed(apart(step_sequences(calls, reach * (top - 1)), "tid", "own"))
    n_runs = seqs.agg(F.sum("starts")).first()[0] or 0
    share_of = lambda n: max(1, math.ceil(share * n - 1e-9))
    patterns = lambda b: [codes_of(bytes(s), o, lengths, reach, errors, none) for s, o in zip(b["steps"], b["own"])]

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _blocks(batches):
            # A run's chunks other than its first raise a block's rows, not its runs.
            yield pd.DataFrame({"code": pd.Series(frequent_by_comparison(patterns(b), share_of(int(b["starts"].sum()))), dtype="int64")})

    candidates = checkpointed(seqs.select("own", "steps", "starts").mapInPandas(mine, "code long").distinct())
    # Few as a rule; where they are many, blocks count all their patterns and the join keeps the candidates'.
    few = candidates.count() <= BROADCAST
    wanted = spark.sparkContext.broadcast(np.array(sorted(r[0] for r in candidates.collect()), np.int64)) if few else None

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hits = [c[np.isin(c, wanted.value, assume_unique=True)] if few else c for c in patterns(b)]
            whole = [h for h, w in zip(hits, b["whole"]) if w]
            code, n = np.unique(np.concatenate(whole), return_counts=True) if whole else (np.empty(0, np.int64), np.empty(0, np.int64))
            yield pd.DataFrame({"code": code, "tid": pd.Series([None] * len(code), dtype=object), "n": n.astype(np.int64)})
            for t, h, w in zip(b["tid"], hits, b["whole"]):
                if not w and len(h):
                    yield pd.DataFrame({"code": h, "tid": t, "n": np.int64(1)})

    counted = seqs.select("tid", "whole", "own", "steps").mapInPandas(count, "code long, tid string, n long")
    if not few:
        counted = counted.join(candidates, "code", "left_semi")
    per_run = counted.where("tid IS NOT NULL").distinct().groupBy("code").agg(F.sum("n").alias("n"))
    total = counted.where("tid IS NULL").groupBy("code").agg(F.sum("n").alias("n")).unionByName(per_run).groupBy("code").agg(F.sum("n").alias("n_runs"))
    names = F.lit([f"{t}:{s}" for t in TOOLS for s in SIGNALS])
    digits = F.filter(F.array(*[F.shiftright("code", 6 * (top - 1 - i)).bitwiseAND(63).cast("int") for i in range(top)]), lambda d: d > 0)
    return total.where(F.col("n_runs") >= share_of(n_runs)).select(F.array_join(F.transform(digits, lambda d: F.element_at(names, d)), ">").alias("pattern"), F.size(digits).alias("n_steps"), "n_runs")
