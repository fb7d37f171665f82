import pytest

from tracefold.operators import detectors, sessions

SCHEMA = "trajectory_id string, pos long, turn_id long, call_index_in_turn long, global_index long, tool string, params string, params_hash string, target_file string, ok boolean, content string, signal string"


def run(spark, *steps, name="r"):
    """steps: 'tool!SIGNAL(target)#hash', ! marks a failure."""
    rows = []
    for i, s in enumerate(steps):
        head, _, h = s.partition("#")
        head, _, target = head.partition("(")
        tool, bad, signal = head.partition("!")
        rows.append((name, i, i, 0, i, tool, "{}", h, target.rstrip(")"), not bad, "", signal or "NONE"))
    return spark.createDataFrame(rows, SCHEMA)


def events(df):
    return sorted((r["error_pos"], r["correction_pos"], r["level"]) for r in detectors.recovery_events(df).collect())


def test_two_errors_share_a_correction(spark):
    assert events(run(spark, "bash!OTHER#e1", "bash!COMMAND_NOT_FOUND#e2", "bash#fix")) == [(0, 2, "L1"), (1, 2, "L1")]


def test_lookahead_is_eight(spark):
    far = run(spark, "bash!OTHER#a", *["declare_done#x"] * 7, "bash#b")
    assert events(far) == [(0, 8, "L1")]
    assert events(run(spark, "bash!OTHER#a", *["declare_done#x"] * 8, "bash#b")) == []


def test_same_params_are_no_correction(spark):
    assert events(run(spark, "bash!OTHER#a", "bash#a")) == []


def test_blocked_is_no_error(spark):
    assert events(run(spark, "bash!BLOCKED#a", "bash#b")) == []


def test_equal_times_are_rejected(spark):
    from pyspark.sql import functions as F

    d = run(spark, "bash!OTHER#a", "bash#b").withColumn("turn_id", F.lit(0).cast("long"))
    assert events(d) == []


def test_investigations_make_l3(spark):
    assert events(run(spark, "file_edit!OTHER(a.py)#1", "file_read(z.py)#2", "search(z)#3", "file_edit(a.py)#4"))[0] == (0, 3, "L3")


def test_unresolved_syntax_takes_the_last_state(spark):
    d = run(spark, "file_edit!SYNTAX_ERROR(a.py)#1", "file_edit(a.py)#2", "file_edit!SYNTAX_ERROR(b.py)#3", "file_edit!OTHER(b.py)#4", "file_edit!SYNTAX_ERROR(c.txt)#5")
    assert [r["target_file"] for r in detectors.unresolved_syntax(d).collect()] == ["b.py"]


def test_unread_edits(spark):
    d = run(spark, "file_read!OTHER(a.py)#1", "file_edit(a.py)#2", "file_read(a.py)#3", "file_edit(a.py)#4", "file_create(n.py)#5")
    assert [r["pos"] for r in detectors.unread_edits(d).collect()] == [1]


def test_empty_calls(spark):
    d = spark.createDataFrame([], SCHEMA)
    for f in (detectors.recovery_events, detectors.unread_edits, detectors.call_facts, sessions.error_streaks, sessions.blocked_by_errors, sessions.numbered):
        assert f(d).count() == 0


def test_blocks_reset_the_count(spark):
    d = run(spark, *["bash!OTHER#x"] * 8)
    assert sessions.blocked_by_errors(d).first()["n_blocks"] == 2


@pytest.mark.parametrize("n, want", [(7, []), (8, [7]), (18, [7, 12, 17])])
def test_idle_advice(spark, n, want):
    assert sorted(r["pos"] for r in sessions.idle_advice(run(spark, *["bash#x"] * n)).collect()) == want


def test_outcomes(spark):
    from pyspark.sql import functions as F

    rows = [(True, True, True, "t", False), (False, True, False, "t", False), (False, True, False, "", False), (False, True, True, "t", True), (False, True, True, "t", False), (False, False, True, "t", False)]
    d = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, d string, e boolean")
    got = [r[0] for r in d.select(detectors.outcome(*[F.col(x) for x in "abcde"])).collect()]
    assert got == ["toxic", "failed", "weakly_verified", "verified_with_recovery", "verified_one_shot", "failed"]
