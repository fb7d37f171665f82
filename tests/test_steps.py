import pytest
from pyspark.sql import functions as F

from tracefold.functions import steps

CASES = [
    (None, "ERROR: Exit code: 1\nSTDERR:\n???", False, "bash", "OTHER"),
    (None, "'python3' 不是内部或外部命令\r\n或批处理文件。", False, "bash", "COMMAND_NOT_FOUND"),
    ("python -m pytest tests/a.py -v", "ERROR: Exit code: 4\nERROR: found no collectors for tests/a.py\r\n", False, "bash", "TEST_FAILURE"),
    ("python test_fix.py", "Traceback (most recent call last):\n  x\nAssertionError: Path should match\r\n", False, "bash", "RUNTIME_ERROR"),
    (None, "SyntaxError: invalid syntax\n", False, "bash", "SYNTAX_ERROR"),
    (None, "File edited successfully.\n\n⚠ SYNTAX ERROR: line 10: invalid syntax\n", True, "file_edit", "SYNTAX_ERROR"),
    ("python manage.py test myapp", "FAIL: test_view (x)\nerrors=2\n", False, "bash", "TEST_FAILURE"),
    ("tox -e py39", "FAILURES\n===== 2 failed =====\n", False, "bash", "TEST_FAILURE"),
    (None, "ERROR: Exit code: 127\n", False, "bash", "COMMAND_NOT_FOUND"),
    (None, "ERROR: TimeoutError: execution exceeded time limit (300s)\n", False, "bash", "TIMEOUT"),
    (None, "On branch main\nnothing to commit, working tree clean\n", False, "bash", "EMPTY_DIFF"),
    (None, "3 matches:\nfoo.py:10: def bar()\n", True, "search", "NONE"),
    (None, "", False, "bash", "OTHER"),
    (None, None, None, "bash", "OTHER"),
    (None, "Traceback (most recent call last):\nTimeoutError: timed out", False, "bash", "TIMEOUT"),
    ("python build.py", "Build step FAILED\nExit code: 1\n", False, "bash", "OTHER"),
]


@pytest.fixture(scope="module")
def told(spark):
    rows = [(i, t, None if c is None else '{"command": "%s"}' % c, ok, content) for i, (c, content, ok, t, _) in enumerate(CASES)]
    d = spark.createDataFrame(rows, "i int, tool string, params string, ok boolean, content string")
    return {r["i"]: r["s"] for r in d.select("i", steps.error_signal(F.col("tool"), F.col("params"), F.col("ok"), F.col("content"), F.lit("NONE")).alias("s")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_error_signal(told, i):
    assert told[i] == CASES[i][4]


def test_blocked_is_kept(spark):
    d = spark.range(1).select(steps.error_signal(F.lit("bash"), F.lit("{}"), F.lit(True), F.lit("x"), F.lit("BLOCKED")).alias("s"))
    assert d.first()["s"] == "BLOCKED"


def test_loose_and_strict_test_commands(spark):
    d = spark.createDataFrame([("python diagnose.py",), ("python -m pytest x",), ("pytestfixture",)], "c string").withColumn("p", F.to_json(F.struct(F.col("c").alias("command"))))
    got = [(r[0], r[1]) for r in d.select(steps.is_test_command(F.lit("bash"), F.col("p")), steps.runs_tests(F.lit("bash"), F.col("p"))).collect()]
    assert got == [(True, False), (True, True), (True, False)]


def test_plain_names(spark):
    d = spark.createDataFrame([(" File-Edit ", " none"), ("declareDone", None), (None, "")], "t string, s string")
    assert [tuple(r) for r in d.select(steps.plain_tool(F.col("t")), steps.plain_signal(F.col("s"))).collect()] == [("file_edit", "NONE"), ("declare_done", "NONE"), (None, "NONE")]
