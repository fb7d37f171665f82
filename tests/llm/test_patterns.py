import collections
import random
from datetime import datetime

import numpy as np
import pytest

from tracefold.functions.steps import SIGNALS, TOOLS
from tracefold.llm import patterns

SCHEMA = "call_id long, trajectory_id string, global_index long, tool_name string, error_signal string, ingested_at timestamp_ntz, code string"
T = datetime(2025, 1, 1)


def table(spark, runs):
    rows = [(0, r, g, t, s, T, "x") for r, steps in runs.items() for g, (t, s) in enumerate(steps)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(runs, share=0.1):
    n = collections.Counter()
    for steps in runs.values():
        st, held = [f"{t}:{s or 'NONE'}" for t, s in steps], set()

        def go(i, p, st=st, held=held):
            if len(p) in (3, 4) and sum(not x.endswith(":NONE") for x in p) >= 2:
                held.add(">".join(p))
            if len(p) < 4:
                for j in range(i + 1, min(i + 4, len(st))):
                    go(j, [*p, st[j]])

        for i in range(len(st)):
            go(i, [st[i]])
        n.update(held)
    return {p: c for p, c in n.items() if c >= share * len(runs)}


def random_runs(seed, n, length):
    r = random.Random(seed)
    return {f"r{i}": [(r.choice(TOOLS[:3]), r.choice(["NONE", "OTHER", None, "TIMEOUT"])) for _ in range(r.randint(0, length))] for i in range(n)}


@pytest.mark.parametrize("seed, n, length", [(1, 40, 14), (2, 25, 30), (3, 3, 6)])
def test_equals_counting_everything(spark, seed, n, length):
    runs = {k: v for k, v in random_runs(seed, n, length).items() if v}
    got = {r["pattern"]: r["n_runs"] for r in patterns.frequent_patterns(table(spark, runs)).collect()}
    assert got == brute(runs)


def test_runs_longer_than_a_chunk(spark):
    runs = random_runs(5, 4, 8)
    runs = {k: v for k, v in runs.items() if v}
    r = random.Random(9)
    runs["long"] = [("bash", "NONE")] * 505 + [(r.choice(TOOLS), r.choice(SIGNALS)) for _ in range(40)] + [("bash", "NONE")] * 600
    got = {x["pattern"]: x["n_runs"] for x in patterns.frequent_patterns(table(spark, runs), share=0.4).collect()}
    assert got == brute(runs, 0.4)


def test_direct_comparison():
    seqs = [np.array(x, np.int64) for x in ([1, 3, 5], [3, 4], [2, 3, 5], [5], [])]
    assert patterns.frequent_by_comparison(seqs, 3) == [3, 5]
    assert patterns.frequent_by_comparison(seqs, 1) == [1, 2, 3, 4, 5]
    assert patterns.frequent_by_comparison([], 1) == []
    with pytest.raises(ValueError):
        patterns.frequent_by_comparison(seqs, 0)


def test_empty_table_and_unknown_tools(spark):
    assert patterns.frequent_patterns(table(spark, {"a": [("bash", "OTHER")]}).limit(0)).count() == 0
    runs = {"a": [("bash", "OTHER"), ("unknown", "X"), (None, None), ("bash", "TIMEOUT"), ("bash", "OTHER")]}
    got = {r["pattern"] for r in patterns.frequent_patterns(table(spark, runs)).collect()}
    assert got == {"bash:OTHER>bash:TIMEOUT>bash:OTHER"}


def test_many_candidates_are_joined(spark, monkeypatch):
    runs = {k: v for k, v in random_runs(1, 40, 14).items() if v}
    monkeypatch.setattr(patterns, "BROADCAST", 3)
    assert {r["pattern"]: r["n_runs"] for r in patterns.frequent_patterns(table(spark, runs)).collect()} == brute(runs)
