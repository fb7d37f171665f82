"""What a call is: plain tool and signal names, its error signal, and predicates over calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six tools, and the signals a call can carry.
TOOLS = ("bash", "declare_done", "file_create", "file_edit", "file_read", "search")
SIGNALS = ("BLOCKED", "COMMAND_NOT_FOUND", "EMPTY_DIFF", "NONE", "OTHER", "RUNTIME_ERROR", "SYNTAX_ERROR", "TEST_FAILURE", "TIMEOUT")

# The texts that tell signals apart, and the commands that run tests (loosely and strictly).
TIMEOUT = r"timed?\s*out|timeout|TimeoutError|TimeoutExpired|execution\s+exceeded\s+time\s+limit|killed.*timeout"
SYNTAX = r"SyntaxError:|IndentationError:|TabError:|compile\(\).*?failed|⚠ SYNTAX ERROR:"
TEST_FAILURE = (
    r"FAILED\s|FAIL:|FAILURES|AssertionError|errors?=\d+|failures?=\d+|ERROR:\s+found\s+no\s+collectors|=+\s+ERRORS\s+=+|=+\s+FAILURES\s+=+|=+\s+short test summary|pytest.*Exit\s+code:\s+[1-5]"
)
NOT_FOUND = (
    r"command\s+not\s+found|No\s+such\s+file\s+or\s+directory|not\s+recognized\s+as\s+(an?\s+)?(internal|external)(\s+or\s+(internal|external))?\s+command|Exit\s+code:\s+127"
    r"|不是内部或外部命令|系统找不到指定的|找不到指定的路径|ϵͳ.{0,4}Ҳ.{0,6}ָ|ⲿ.{0,4}Ҳ.{0,4}ǿ"
)
RUNTIME = r"Traceback\s+\(most\s+recent\s+call\s+last\)|^\w*Error:|^\w*Exception:|raise\s+\w+Error|STDERR:\s*\n.*Error"
NO_CHANGES = r"git\s+diff.*shows?\s+no\s+changes|no\s+changes\s+detected|nothing\s+to\s+commit"
TEST_LOOSE = r"pytest|unittest|python\s+-m\s+pytest|python\s+-m\s+unittest|manage\.py\s+test|tox|nose|py\.test"
TEST_STRICT = r"\bpytest\b|\bpython\s+-m\s+pytest\b|\bpython\s+-m\s+unittest\b|\bpython\s+-m\s+nose\b|\bunittest\b|\bmanage\.py\s+test\b|\btox\b|\bnosetests?\b"
ASSERTION = r"AssertionError|AssertError|assert\s+.+\bfailed\b|FAIL:|FAILED\s|failures?=\d+|=+\s+FAILURES\s+=+"
NOT_LOGIC = r"SyntaxError:|IndentationError:|TabError:|ImportError:|ModuleNotFoundError:|cannot\s+import\s+name"

# Flags that make Java's classes and line ends those of the patterns' first dialect.
PLAIN, CASELESS, LINES = "(?dU)", "(?dUi)", "(?dUm)"


def plain_tool(c: Column) -> Column:
    """The plain tool name of any spelling; unknown names stay, folded."""
    f = F.regexp_replace(F.lower(c), r"[\s_\-]+", "")
    e = f
    for t in TOOLS:
        e = F.when(f == t.replace("_", ""), F.lit(t)).otherwise(e)
    return e


def plain_signal(c: Column) -> Column:
    """The upper-case signal; null and empty are NONE."""
    s = F.upper(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"[\s\-]+", "_"))
    return F.when(s.isNull() | (s == ""), "NONE").otherwise(s)


def command(params: Column) -> Column:
    return F.coalesce(F.get_json_object(params, "$.command"), F.lit(""))


def target_file(tool: Column, params: Column) -> Column:
    """The file a call is about: file_path of file tools, path of a search, else ''."""
    return F.coalesce(F.when(tool.isin("file_read", "file_edit", "file_create"), F.get_json_object(params, "$.file_path")).when(tool == "search", F.get_json_object(params, "$.path")), F.lit(""))


def is_test_command(tool: Column, params: Column) -> Column:
    """The loose predicate: a bash call whose command holds a test runner's name anywhere, in any case."""
    return (tool == "bash") & command(params).rlike(CASELESS + TEST_LOOSE)


def runs_tests(tool: Column, params: Column) -> Column:
    """The strict predicate: a bash call with a test runner's name as whole words."""
    return (tool == "bash") & command(params).rlike(PLAIN + TEST_STRICT)


def error_signal(tool: Column, params: Column, ok: Column, content: Column, given: Column) -> Column:
    """The most specific error signal of a call; the first that matches wins.

    Only BLOCKED is kept as given; all else is told from the result. A successful call can still report a syntax error. Null contents are
    empty, a null success is a failure.
    """
    text = F.coalesce(content, F.lit(""))
    return (
        F.when(given == "BLOCKED", "BLOCKED")
        .when(F.coalesce(ok, F.lit(False)), F.when(text.rlike(PLAIN + SYNTAX), "SYNTAX_ERROR").otherwise("NONE"))
        .when(text.rlike(CASELESS + TIMEOUT), "TIMEOUT")
        .when(text.rlike(PLAIN + SYNTAX), "SYNTAX_ERROR")
        .when(is_test_command(tool, params) & text.rlike(CASELESS + TEST_FAILURE), "TEST_FAILURE")
        .when(text.rlike(CASELESS + NOT_FOUND), "COMMAND_NOT_FOUND")
        .when(text.rlike(LINES + RUNTIME), "RUNTIME_ERROR")
        .when(text.rlike(CASELESS + NO_CHANGES), "EMPTY_DIFF")
        .otherwise("OTHER")
    )


def is_investigation(tool: Column, ok: Column) -> Column:
    return tool.isin("file_read", "search") & ok
