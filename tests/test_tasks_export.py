import random

import pytest
from pyspark.sql import functions as F

from tracefold.operators import export, lookups, ranks, sessions, tasks


def test_prepared_tasks(spark):
    patch = "diff --git a/tests/user/tests.py b/tests/user/tests.py\n"
    rows = [
        ("a", "r/x", "c", " fix it ", "hint", "g", patch, '["test_m (user.tests.Cls)", " ", 5]', "[]"),
        ("b", "r/x", "c", "p", None, "g", patch, '["test_one", "test two"]', None),
        ("c", "r/x", "c", "p", "", "g", "", '["test_one"]', "bad"),
        ("d", "r/x", "c", " ", "", "g", "", "[]", "[]"),
        ("e", "r/x", "c", "p", "", "g", "", "not json", "[]"),
    ]
    d = spark.createDataFrame(rows, "instance_id string, repo string, base_commit string, problem_statement string, hints_text string, patch string, test_patch string, FAIL_TO_PASS string, PASS_TO_PASS string")
    got = {r["instance_id"]: r for r in tasks.prepared(d, include_hints=True).collect()}
    assert set(got) == {"a", "b", "c", "e"}
    assert got["a"]["task"] == "fix it\n\nAdditional hints:\nhint"
    assert got["a"]["tier2_command"] == "{python} -m pytest tests/user/tests.py::Cls::test_m --tb=short -x --no-header -q"
    assert got["b"]["tier2_command"] == "{python} -m pytest tests/user/tests.py -k 'test_one or test two' --tb=short -x --no-header -q"
    assert got["c"]["tier2_command"] == "{python} -m pytest -k test_one --tb=short -x --no-header -q"
    assert got["e"]["tier2_command"] == ""


def test_whitelist(spark):
    d = spark.createDataFrame([("a",), ("b",)], "instance_id string")
    assert [r[0] for r in tasks.whitelisted(d, d.where("instance_id = 'b'"), needed=True).collect()] == ["b"]
    with pytest.raises(ValueError, match="none of the tasks"):
        tasks.whitelisted(d, d.limit(0), needed=True)


def test_run_report_stops_at_the_first_error(spark):
    d = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 0)], "ordinal long, exit_code int")
    assert tuple(tasks.run_report(d).first()) == (3, 1, 1, 1)
    assert tuple(tasks.run_report(d.limit(0)).first()) == (0, 0, 0, 0)


RECORD = (
    "trajectory_id string, instance_id string, task string, model string, seed long, llm_claimed_success boolean, verification struct<final_passed:boolean,tier1_pass:boolean,tier2_pass:boolean>, attempts "
    + export.attempts_type()
    + ", token_usage struct<input_tokens:bigint,output_tokens:bigint,cache_read_tokens:bigint,cache_create_tokens:bigint>, metadata map<string,string>"
)


def test_rebuilt_samples(spark):
    a = [(1, 2, "look", "failed", ["a.py", "b.py"], ["bash", "search"], "why"), (2, 1, "end", "success", [], [], "")]
    d = spark.createDataFrame([("t", "i", "do", "m", 1, True, (True, True, False), a, (5, 7, 0, 0), {"system_prompt": "own"}), ("u", None, None, None, None, None, None, None, None, {})], RECORD)
    got = {r["trajectory_id"]: r for r in export.sample_rows(d, "sys").collect()}
    m = got["t"]["messages"]
    assert [(x["role"], x["content"]) for x in m] == [
        ("system", "own"), ("user", "do"), ("assistant", "Step 1, attempt 2: look"),
        ("tool", "Tool 'bash' output is unavailable in the trajectory schema; this is a deterministic placeholder."), ("tool", "Tool 'search' output is unavailable in the trajectory schema; this is a deterministic placeholder."),
        ("assistant", "Attempt status: failed. Failure reason: why. Target files: a.py, b.py."), ("assistant", "Step 2, attempt 1: end"), ("assistant", "Attempt status: success."),
        ("assistant", "Final summary: llm_claimed_success=True; final_passed=True; tier1_pass=True; tier2_pass=False; input_tokens=5; output_tokens=7; total_tokens=12."),
    ]
    assert [c["id"] for c in m[2]["tool_calls"]] == ["tc_s1_a2_1", "tc_s1_a2_2"] == [m[3]["tool_call_id"], m[4]["tool_call_id"]] and m[6]["tool_calls"] is None and got["t"]["faults"] == []
    assert [x["content"] for x in got["u"]["messages"]] == ["sys", "", "Final summary: llm_claimed_success=False; final_passed=False; tier1_pass=False; tier2_pass=False; input_tokens=0; output_tokens=0; total_tokens=0."]
    with pytest.raises(Exception, match="no raw messages in t"):
        export.sample_rows(d.where("trajectory_id = 't'"), require_raw=True).collect()


def test_raw_messages(spark):
    ok = '[{"role": "user", "content": "hi", "more": 1}]'
    rows = [("a", {"messages_json": ok, "openai_messages_json": ""}), ("b", {"raw_messages_json": ok, "messages": "x"}), ("c", {"raw_messages": ok}), ("d", {"openai_messages_json": "[]"})]
    d = spark.createDataFrame(rows, "k string, m map<string,string>").select("k", export.raw_messages(F.col("m")).alias("x"))
    assert {r["k"]: None if r["x"] is None else [(y["role"], y["content"]) for y in r["x"]] for r in d.collect()} == {"a": [("user", "hi")], "b": [("user", "hi")], "c": None, "d": []}
    for bad, why in (("{bad", "invalid JSON"), ('{"a": 1}', "no list"), ('[{"role": "odd", "content": ""}]', "role at 0"), ('[{"role": "user", "content": 5}]', "made of texts"), ('[{"role": "user", "content": "a", "tool_call_id": ""}]', "tool_call_id at 0"), ('["x"]', "."), ('[{"role": "assistant", "content": "", "tool_calls": {"id": "x"}}]', "made of texts")):
        with pytest.raises(Exception, match=why):
            spark.createDataFrame([({"messages_json": bad},)], "m map<string,string>").select(export.raw_messages(F.col("m"))).collect()


def test_message_faults(spark):
    d = spark.range(1).select(F.from_json(F.lit('[{"role":"odd","content":"a"},{"role":"tool","content":"x","tool_call_id":""},{"role":"assistant","tool_calls":[{"id":""}]},{"role":"tool","content":"x"}]'), f"array<{export.MESSAGE}>").alias("m"))
    assert d.select(export.message_faults(F.col("m")).alias("f")).first()["f"] == ["role at 0", "tool_call_id at 1", "content at 2", "tool_calls at 2"]


@pytest.mark.parametrize("pieces", [2, 64])
def test_spread_running(spark, pieces):
    d = spark.createDataFrame([(g, i, i % 7) for g in ("a", "b", None) for i in range(200)], "g string, i int, v int")
    got = ranks.spread_running(d, ["g"], ["i"], F.col("v"), pieces=pieces).toPandas()
    for _, x in got.groupby(got.g.fillna("?")):
        x = x.sort_values("rank")
        assert list(x["rank"]) == list(range(200)) and list(x["running"]) == [0, *x["v"].cumsum()[:-1]]


@pytest.mark.parametrize("span", [3, 4096])
def test_ordered_running_and_positions(spark, span):
    d = spark.createDataFrame([(g, i * 5, i % 7) for g in ("a", None) for i in range(100)], "g string, i long, v int")
    got = ranks.ordered_running(d, ["g"], "i", F.col("v"), span=span).toPandas()
    for _, x in got.groupby(got.g.fillna("?")):
        x = x.sort_values("i")
        assert list(x["rank"]) == list(range(100)) and list(x["running"]) == [0, *x["v"].cumsum()[:-1]]
    p = ranks.positions(spark.createDataFrame([(f"{i:03}",) for i in range(99, -1, -1)], "k string").repartition(7), "k").collect()
    assert all(int(r["k"]) == r["position"] for r in p) and len(p) == 100
    assert ranks.positions(spark.createDataFrame([], "k string"), "k").count() == 0


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), (None, 9, 4), ("a", None, 5), ("a", 400_000, 6), ("c", 3, 7)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 5, "w"), ("a", 6, "z"), (None, 1, "n"), ("c", 1, "q"), ("c", 2, None)], "k string, rt int, v string")
    for width in (1, 2, 86_400):
        got = {r["id"]: (r["v"], r["n"]) for r in lookups.as_of(left, right, "k", "t", "rt", "v", later="n", width=width).collect()}
        assert got == {1: ("y", 1), 2: (None, 4), 3: (None, 0), 4: (None, 0), 5: (None, 0), 6: ("z", 0), 7: (None, 0)}


@pytest.mark.parametrize("width", [1.0, 5.0, 1000.0])
def test_as_of_equals_brute_force(spark, width):
    r = random.Random(3)
    left, right = [(r.choice("ab"), r.randint(0, 60), i) for i in range(80)], [(r.choice("aab"), r.randint(0, 60), i) for i in range(40)]
    got = {x["id"]: (x["v"], x["n"]) for x in lookups.as_of(spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(right, "k string, rt int, v int"), "k", "t", "rt", "v", later="n", width=width).collect()}
    for k, t, i in left:
        mine = [(b, v) for a, b, v in right if a == k]
        best = max([x for x in mine if x[0] <= t], default=None)
        assert got[i] == (best and best[1], sum(b > t for b, _ in mine))


def test_samples_and_top_files(spark):
    d = spark.range(100).withColumnRenamed("id", "i")
    a, b = (sorted(r["i"] for r in lookups.exact_sample(d, 10, "i", 3).collect()) for _ in range(2))
    assert a == b and len(a) == 10 and lookups.exact_sample(d, 500, "i").count() == 100
    assert sorted(r["i"] for r in lookups.seeded_sample(d, 10, "i", 7).collect()) == sorted(random.Random(7).sample(range(100), 10)) and lookups.seeded_sample(d, 100, "i").count() == 100
    for f in (lookups.exact_sample, lookups.seeded_sample):
        with pytest.raises(ValueError):
            f(d, 0, "i")
    f = spark.createDataFrame([("b.py", 100, 0), ("tests/a.py", 400, 1), ("x/y/b.py", 1, 2), ("a.py", 100, 3), ("latest/q.py", 100, 4), ("src/Test_a.py", 400, 5)], "path string, n_lines long, at long")
    got = [(r["path"], r["score"]) for r in lookups.top_files(f, order="at").collect()]
    assert [p for p, _ in got] == ["b.py", "a.py", "latest/q.py", "tests/a.py", "src/Test_a.py"] and [round(s, 6) for _, s in got] == [10, 10, 5, 3, 3]


def pool(spark, rows):
    return lookups.pool_items(spark.createDataFrame(rows, "trajectory_id string, label string, tokens long, at long"), "at")


def runs_of_sizes(n_one, n_rec, size, more=()):
    rows = [(f"o{i}", lookups.CLEAN, size(i)) for i in range(n_one)] + [(f"r{i}", lookups.RECOVERY, size(i + 3)) for i in range(n_rec)] + list(more)
    return [(*r, i) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_budget_groups_keep_the_tolerance(spark, seed):
    """801 runs of which one is large: no group stops at it."""
    d = pool(spark, runs_of_sizes(600, 200, lambda i: 10, [("big", lookups.CLEAN, 2500)]))
    got = lookups.budget_groups(d, target=3_000, seed=seed)
    for r in lookups.group_report(got, 3_000).collect():
        assert r["within_tolerance"] and 2_850 <= r["total_tokens"] <= 3_150, r


def test_budget_groups(spark):
    more = [(f"t{i}", lookups.TOXIC, 100) for i in range(50)] + [("z", "failed", None)]
    d = pool(spark, runs_of_sizes(300, 100, lambda i: 60 + 17 * i % 90, more))
    got = lookups.budget_groups(d, target=10_000).toPandas()
    sums = got.groupby("group_name").tokens.sum()
    assert ((sums >= 9_500) & (sums <= 10_500)).all() and lookups.TOXIC not in set(got.label) and (got.tokens >= 1).all()
    assert got.groupby("group_name").key.nunique().equals(got.groupby("group_name").size())
    e = got[got.group_name == "recovery_enriched"]
    assert (e.label == lookups.RECOVERY).mean() >= 0.5 and set(got[got.group_name == "clean_only"].label) == {lookups.CLEAN}
    again = lookups.budget_groups(d, target=10_000).toPandas()
    assert sorted(zip(again.group_name, again.key)) == sorted(zip(got.group_name, got.key))
    report = {r["group_name"]: r for r in lookups.group_report(lookups.budget_groups(d), 100_000, 9.0).collect()}
    assert sum(report["mixed"]["label_counts"].values()) == report["mixed"]["n"]


def test_few_large_runs(spark):
    """Sizes of more than the tolerance: swaps mend what filling leaves."""
    r = random.Random(1)
    d = pool(spark, runs_of_sizes(14, 6, lambda i: r.randint(60_000, 160_000)))
    got = lookups.budget_groups(d, target=600_000)
    assert all(x["within_tolerance"] for x in lookups.group_report(got, 600_000).collect())


def test_oversampling(spark):
    d = pool(spark, runs_of_sizes(0, 5, lambda i: i + 1))
    got = lookups.oversampled(d, 5, 2.5, 1).toPandas()
    assert len(got) == 5 + 8 and got.key.is_unique and sum("@dup" in k for k in got.key) == 8  # 7.5 rounds to 8
    assert lookups.oversampled(d, 5, 1.5, 1).count() == 7 and lookups.oversampled(d, 5, 1.0, 1).count() == 5  # 2.5 rounds to 2


def test_recoveries_are_enriched_from_duplicates(spark):
    """Too few recoveries for twice their share without drawing some again."""
    d = pool(spark, runs_of_sizes(40, 10, lambda i: 100))
    got = lookups.budget_groups(d, target=4_000).toPandas()
    e = got[got.group_name == "recovery_enriched"]
    assert (e.label == lookups.RECOVERY).mean() >= 0.4 and e.key.str.contains("@dup").any() and 3_800 <= e.tokens.sum() <= 4_200


def test_best_swap_equals_all_pairs(spark):
    r = random.Random(5)
    rows = [(f"o{i}", lookups.CLEAN, r.randint(1, 60)) for i in range(15)] + [(f"r{i}", lookups.RECOVERY, r.randint(1, 60)) for i in range(12)]
    d = pool(spark, [(*x, i) for i, x in enumerate(rows)])
    items = d.collect()
    inside = [x for x in items if x["label"] == lookups.CLEAN][:8] + [x for x in items if x["label"] == lookups.RECOVERY][:3]
    total = sum(x["tokens"] for x in inside)
    b = lookups.Bounds.of(total + 9, 0.1)
    selected = d.where(F.col("key").isin([x["key"] for x in inside]))
    pairs = [total - o["tokens"] + i["tokens"] for o in inside if o["label"] == lookups.CLEAN for i in items if i["label"] == lookups.RECOVERY and i not in inside]
    best = min(abs(b.target - p) for p in pairs if b.holds(p))
    keys = [x["key"] for x in inside]
    out_of, others = selected.where(F.col("label") == lookups.CLEAN), d.where((F.col("label") == lookups.RECOVERY) & ~F.col("key").isin(keys))
    for width in (3.0, 1000.0):
        out, into, after = lookups.best_swap(out_of, others, total, b, width)
        assert abs(b.target - after) == best and after == total - next(x["tokens"] for x in items if x["key"] == out) + next(x["tokens"] for x in items if x["key"] == into)
    assert lookups.best_swap(out_of, others, total, lookups.Bounds(total + 10**6, total + 10**6, total + 10**6)) is None


@pytest.mark.parametrize(
    "rows, target, why",
    [([], None, "no runs"), ([("a", lookups.RECOVERY, 5, 0)], None, "clean_only is empty"), ([("a", lookups.CLEAN, 5, 0)], None, "need a recovery"), ([("a", lookups.TOXIC, 5, 0)], None, "clean_only is empty"), (runs_of_sizes(3, 3, lambda i: 5), 0, "positive"), (runs_of_sizes(3, 3, lambda i: 5), 10**6, "fewer than the target"), (runs_of_sizes(1, 1, lambda i: 100), 50, "outside of")],
)
def test_budget_errors(spark, rows, target, why):
    with pytest.raises(lookups.BudgetError, match=why):
        lookups.budget_groups(pool(spark, rows), target=target)


def test_pool_labels(spark):
    d = spark.createDataFrame([(o,) for o in lookups.POOL_OF], "o string").select("o", lookups.pool_label(F.col("o")).alias("p"))
    assert {r["o"]: r["p"] for r in d.collect()} == lookups.POOL_OF
    with pytest.raises(Exception, match="no pool for the outcome odd"):
        spark.createDataFrame([("odd",)], "o string").select(lookups.pool_label(F.col("o"))).collect()
    keys = [(r["key"], r["tokens"]) for r in pool(spark, [("a", "x", 0, 5), ("a", "x", None, 6), (None, "y", 3, 7)]).collect()]
    assert sorted(keys) == [("#2", 3), ("a#0", 1), ("a#1", 1)]


# --- histories

MESSAGES = "conv_id string, turn long, role string, text string, _c string"


def history(spark, *rows, conv="c"):
    return spark.createDataFrame([(conv, i, role, t, "x") for i, (role, t) in enumerate(rows)], MESSAGES.replace(", _c", ", extra"))


def trim(t):
    return f"[trimmed — {t.count(chr(10)) + 1} lines] {t.split(chr(10), 1)[0][:100]}"


def cut(t, most):
    lines = t.splitlines()
    return t if len(lines) <= most else "\n".join(lines[:most]) + f"\n[truncated — {len(lines) - most} more lines]"


def brute_stages(messages, limit, keep, most, keep_last):
    """What the stages do to a list of [role, text], one after the other."""
    m, size = [list(x) for x in messages], lambda m: int(sum(len(t or "") for _, t in m) / 3.5)
    if size(m) <= limit:
        return 0, m
    results = [i for i, (r, _) in enumerate(m) if r == "tool_result"]
    for i in results[:-keep] if len(results) > keep else []:
        if m[i][1]:
            m[i][1] = trim(m[i][1])
    if size(m) <= limit:
        return 1, m
    for x in m:
        if x[0] == "tool_result" and x[1]:
            x[1] = cut(x[1], most)
    if size(m) <= limit:
        return 2, m
    while size(m) > limit and len(m) > keep_last + 1:
        m.pop(1)
    return 5, m


def random_history(r):
    n = r.randint(0, 16)
    return [(r.choice(["system", "user", "assistant", "tool_result", "tool_result"]), r.choice([None, "", "one line " * r.randint(1, 30), "a\nb\r\nc\x0bd\n" * r.randint(1, 6), "w" * r.randint(1, 300), "q\n" * r.randint(50, 400)])) for _ in range(n)]


def test_compaction_equals_the_stages_one_by_one(spark):
    r = random.Random(11)
    all_of = {f"c{k}": random_history(r) for k in range(60)}
    d = spark.createDataFrame([(k, i * 3 + 5, role, t) for k, h in all_of.items() for i, (role, t) in enumerate(h)], "conv_id string, turn long, role string, text string")
    got = {}
    for x in sessions.compacted(d, 400, 0.7, 2, 3, 5).collect():
        got.setdefault(x["conv_id"], []).append((x["turn"], x["role"], x["text"], x["stage"]))
    stages = {x["conv_id"]: (x["tokens"], x["stage"]) for x in sessions.compaction_stage(d, 400, 0.7, 2, 5).collect()}
    seen = set()
    for k, h in all_of.items():
        if h:
            stage, want = brute_stages(h, 280, 2, 5, 3)
            seen.add(stage)
            assert stages[k] == (int(sum(len(t or "") for _, t in h) / 3.5), stage)
            assert [[role, t] for _, role, t, _ in sorted(got[k])] == want and {x[3] for x in got[k]} == {stage}
    assert seen == {0, 1, 2, 5}


def test_first_message_stays_whatever_its_role(spark):
    m = history(spark, *[("user" if i == 0 else "assistant" if i != 5 else "system", "x" * 100) for i in range(20)])
    kept = sorted(r["turn"] for r in sessions.dropped_oldest(m, 250).collect())
    assert kept == [0, *range(13, 20)]
    assert sorted(r["turn"] for r in sessions.dropped_oldest(m, 0).collect()) == [0, 16, 17, 18, 19]
    assert sessions.dropped_oldest(history(spark, ("user", "x" * 100), ("user", "y" * 100)), 1).count() == 2 and sessions.dropped_oldest(m.limit(0), 5).count() == 0


def test_trimming(spark):
    m = history(spark, *[("tool_result", f"line {i}\nmore" + "y" * 300 * (i % 2)) for i in range(8)], ("tool_result", ""), ("tool_result", None))
    got = {r["turn"]: r["text"] for r in sessions.trimmed_results(m, 5).collect()}
    assert got[0] == "[trimmed — 2 lines] line 0" and got[5].startswith("line 5") and got[8] == "" and got[9] is None and sum((t or "").startswith("[trimmed") for t in got.values()) == 5
    plain = {r["turn"]: r["text"] for r in sessions.trimmed_results(m, 5, plain_over=200).collect()}
    assert plain[0] == "line 0\nmore" and plain[1].startswith("[trimmed")


def test_summaries(spark):
    m = history(spark, *[("assistant", str(i)) for i in range(8)]).unionByName(history(spark, *[("user", str(i)) for i in range(5)], conv="d")).unionByName(history(spark, *[("user", str(i)) for i in range(9)], conv="e"))
    s = spark.createDataFrame([("c", "S"), ("d", "S"), ("e", "")], "conv_id string, summary string")
    got = {}
    for r in sessions.summarised(m, s, "session_extract").collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert sorted(got["c"]) == [(0, "assistant", "0"), (1, "user", "[session_extract] Previous conversation summary:\n\nS"), *[(i, "assistant", str(i)) for i in range(4, 8)]]
    assert len(got["d"]) == 5 and len(got["e"]) == 9
