from datetime import datetime

from tracefold.llm import sampling

LABELS = "trajectory_id string, outcome string, contains_recovery boolean, highest_recovery_level string, labelled_at timestamp_ntz, run string"
TARGETS = "outcome string, contains_recovery boolean, highest_recovery_level string, target_permille long, min_rows long"


def at(h):
    return datetime(2025, 1, 1, h)


def labels(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], LABELS)


def test_current_labels(spark):
    rows = [("a", "Failed", None, "l1", at(1)), ("a", "toxic", None, "none", at(2)), ("b", "weakly-verified", None, "L2", at(1)), ("c", "failed", False, None, None), ("c", "failed", False, "", at(1)), (None, "failed", False, "", at(1))]
    got = sorted(tuple(r) for r in sampling.current_labels(labels(spark, rows)).collect())
    assert got == [("a", "toxic", False, "NONE"), ("b", "weakly_verified", True, "L2"), ("c", "failed", False, "NONE")]


def test_sample_is_exact_and_reports_deficits(spark):
    rows = [(f"f{i}", "failed", False, "NONE", at(1)) for i in range(400)] + [(f"t{i}", "toxic", False, "NONE", at(1)) for i in range(80)] + [("r", "toxic", True, "L1", at(1))]
    cur = sampling.current_labels(labels(spark, rows))
    t = spark.createDataFrame([("failed", False, "NONE", 500, 1), ("toxic", False, "NONE", 490, 1), ("toxic", True, "L1", 10, 5), ("x", True, "L3", 0, 2), ("y", None, "L3", None, None)], TARGETS)
    got = {(r["outcome"], r["highest_recovery_level"]): (r["wanted"], r["sampled"], r["deficit"]) for r in sampling.sample_report(cur, t).collect()}
    assert got == {("failed", "NONE"): (60, 60, 0), ("toxic", "NONE"): (59, 59, 0), ("toxic", "L1"): (5, 1, 4), ("x", "L3"): (2, 0, 2), ("y", "L3"): (0, 0, 0)}
    a, b = (sorted(r["run"] for r in sampling.sample_to_targets(cur, t).collect()) for _ in range(2))
    assert a == b and len(a) == len(set(a)) == 120


def test_empty_labels(spark):
    cur = sampling.current_labels(labels(spark, []).limit(0))
    t = spark.createDataFrame([("failed", False, "NONE", 500, 3)], TARGETS)
    assert sampling.target_report(cur, t).first()["deficit"] == 3
    assert sampling.sample_to_targets(cur, t).count() == 0


def test_a_short_draw_is_made_good(spark):
    rows = [(f"f{i}", "failed", False, "NONE", at(1)) for i in range(900)] + [(f"t{i}", "toxic", True, "L1", at(1)) for i in range(100)]
    cur = sampling.current_labels(labels(spark, rows))
    t = spark.createDataFrame([("failed", False, "NONE", 900, 1), ("toxic", True, "L1", 100, 150)], TARGETS)
    for over in (-0.2, -0.9, -5.0):
        drawn = sampling.sample_to_targets(cur, t, over=over).toPandas()
        assert drawn.groupby("outcome").size().to_dict() == {"failed": 225, "toxic": 100} and drawn.run.is_unique
        got = {r["outcome"]: (r["wanted"], r["sampled"], r["deficit"]) for r in sampling.sample_report(cur, t, over=over).collect()}
        assert got == {"failed": (225, 225, 0), "toxic": (150, 100, 50)}
    assert [r["outcome"] for r in sampling.short_categories(cur, t).collect()] == ["toxic"]
