from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tracefold.functions import diffs, python_udfs, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value, want", [("a.py", "a.py"), ("", "''"), ("a b", "'a b'"), ("it's", "'it'\"'\"'s'"), ("t[1]", "'t[1]'")])
def test_shell_quoted(spark, value, want):
    assert one(spark, value, text.shell_quoted) == want


def test_lines_and_truncation(spark):
    assert one(spark, "a\r\nb\x0bc\n", text.lines) == ["a", "b", "c"]
    assert one(spark, "", text.lines) == []
    assert one(spark, "a\nb\nc", lambda c: text.truncated_lines(c, 2)) == "a\nb\n\n[truncated — 1 more lines]"
    assert one(spark, "a\nb\nc", lambda c: text.truncated_lines(c, 1, text.HISTORY_NOTE)) == "a\n[truncated — 2 more lines]"


def test_thoughts_and_commas(spark):
    assert one(spark, "<think>a\nb</think>  x ", text.without_thoughts) == "x"
    assert one(spark, '{"a": [1, 2,],}', text.without_trailing_commas) == '{"a": [1, 2]}'


def test_text_tool_calls(spark):
    both = '```json\n{"name": "no"}\n``` x <tool_call>{"name": "bash", "arguments": {"c": 1}}</tool_call> <tool_call>{bad}</tool_call> <tool_call>{"arguments": {}}</tool_call>'
    assert [tuple(c) for c in one(spark, both, text.text_tool_calls)] == [("text_tc_0", "bash", '{"c":1}'), ("text_tc_1", "no", "{}")]
    assert [tuple(c) for c in one(spark, '```json\n{"name": "f", "parameters": {"a": 2}}\n```', text.text_tool_calls)] == [("text_tc_0", "f", '{"a":2}')]
    assert [tuple(c) for c in one(spark, '<tool_call>{"name": "f", "arguments": null, "parameters": {"a": 2}}</tool_call>', text.text_tool_calls)] == [("text_tc_0", "f", "{}")]
    assert one(spark, "none", text.text_tool_calls) == [] and one(spark, None, text.text_tool_calls) == []


@pytest.mark.parametrize("value, want", [("./a//b/../c.py", "a/c.py"), ("../x", None), ("a\\b", "a/b"), ("", "")])
def test_normal_path(spark, value, want):
    assert one(spark, value, text.normal_path) == want


@pytest.mark.parametrize("value, want", [("src/a.py", True), (".git/config", False), ("./.GIT\\\\x", False), ("a/__pycache__/b.py", False), ("a.PYC", False), ("b.pyo", False), ("c.pyd", False), ("a.git/x", True), ("node_modules/x", True), ("k.pem", True), ("/etc/x", True), ("", True), (None, True)])
def test_workspace_path(spark, value, want):
    assert one(spark, value, text.workspace_path) is want


def test_own_folder(spark):
    own = lambda c: text.workspace_path(c, ".mine")
    assert [one(spark, p, own) for p in (".mine/x", "./.MINE/x", "a/.mine/b", ".mine", "mine/x")] == [False, False, False, True, True]


def test_sections(spark):
    assert one(spark, "# T\n## A\none\n\n## B\ntwo\n## A\nlast", text.sections) == {"__title__": "# T", "B": "two", "A": "last"}
    assert one(spark, "x\n## \nlost\n## C\r\n# not a title\n", text.sections) == {"C": "# not a title"} and one(spark, "", text.sections) == {}
    again = lambda c: text.sections(text.rendered_sections(text.sections(c)))
    assert one(spark, "# T\n## A\none\n\ntwo\n## B", again) == {"__title__": "# T", "A": "one\n\ntwo", "B": ""}
    assert one(spark, "# T\n## A\none", lambda c: text.rendered_sections(text.sections(c))) == "# T\n\n## A\none\n"


def test_memory_texts(spark):
    assert one(spark, "abc", lambda c: text.capped(c, 3)) == "abc" and one(spark, "abcd", lambda c: text.capped(c, 3)) == "abc\n... [truncated]\n"
    m = {"README": " ", "a": "x" * 12, "b": "y"}
    assert one(spark, m, lambda c: text.first_candidate(c, ["none", "README", "a", "b"], 10), "map<string,string>") == "### a\n\n" + "x" * 10 + "\n\n[...truncated at 10 chars]"
    assert one(spark, m, lambda c: text.first_candidate(c, ["none"], 10), "map<string,string>") == ""
    assert one(spark, ["a", "b", "c"], lambda c: text.head_or_more(c, 1), "array<string>") == ["a", "[... 2 more entries]"] and one(spark, ["a"], text.head_or_more, "array<string>") == ["a"]
    msgs = [("system", "s"), ("user", "u" * 9), ("tool_result", ""), ("assistant", "x")]
    assert one(spark, msgs, lambda c: text.conversation_text(c, 5), "array<struct<role:string,content:string>>") == "[user] uuuuu\n\n[assistant] x"


def test_window_match(spark):
    content = "def f():\n    return  1\n\ndef g():\n\treturn 1 \n    return 1"
    find = lambda old: one(spark, content, lambda c: text.window_match(c, F.lit(old)))
    assert tuple(find(" return\t1")) == ("    return  1", 3) and find("return 2") is None and find(" ") is None and find("x\n" * 9) is None
    assert tuple(find("def g():\n return   1")) == ("def g():\n\treturn 1 ", 1)


@pytest.mark.parametrize("value", ["1700000000", "2023-11-14T22:13:20Z", "2023-11-14T22:13:20+00:00", "2023-11-14 22:13:20"])
def test_parsed_time(spark, value):
    assert one(spark, value, lambda c: F.unix_seconds(text.parsed_time(c))) == int(datetime(2023, 11, 14, 22, 13, 20, tzinfo=timezone.utc).timestamp())


def test_small_ones(spark):
    assert one(spark, "aaaa", lambda c: text.occurrences(c, F.lit("aa"))) == 2
    assert one(spark, "1, 2,1", text.seed_list) == [1, 2] and one(spark, "1,x", text.seed_list) is None
    assert one(spark, "Org/Repo", text.cased_name) == "org__repo"
    assert one(spark, "My Topic!", text.topic_name) == "My_Topic_" and one(spark, "Org/Repo", text.folder_name) == "Org__Repo"
    assert one(spark, "Org/Repo-1", lambda c: text.image_tag(c, "img")) == "img.org__repo-1:latest" and one(spark, "Org/Repo-1", lambda c: text.container_name(c, "box")) == "box-Org_Repo-1"
    assert tuple(one(spark, " a : /x:y ", text.arm_spec)) == ("a", "/x:y")
    for bad in ("nothing", " :x"):
        with pytest.raises(Exception, match="expected name:path"):
            one(spark, bad, text.arm_spec)
    assert one(spark, 3, lambda c: text.backoff_seconds(c, jitter=F.lit(0.5)), "int") == 6.0 and one(spark, 9, lambda c: text.backoff_seconds(c, retry_after=F.lit(90.0)), "int") == 90.0
    assert one(spark, 3, text.backoff_seconds, "int") == 8.0
    assert one(spark, "x", lambda c: text.result_text(F.lit(False), c, F.lit("bad"))) == "ERROR: bad\nx"


DIFF = "diff --git a/x.py b/x.py\n@@ -1 +1 @@\n-a\n+b\ndiff --git a/.int/y b/.int/y\n@@ -1 +1 @@\n@@ -9 +9 @@\n"


def test_diffs(spark):
    assert one(spark, DIFF, diffs.diff_files) == ["x.py", ".int/y"] and one(spark, DIFF, diffs.diff_hunks) == 3
    assert one(spark, "+++ b/q.py\n@@ x", diffs.diff_files) == ["q.py"]
    strip = lambda d: one(spark, d, lambda c: diffs.without_internal(c, (".int/",)))
    assert strip(DIFF) == "diff --git a/x.py b/x.py\n@@ -1 +1 @@\n-a\n+b" and strip("") == "" and strip("diff --git a/.int/y b/.int/y\nx") == ""
    assert strip("diff --git a/old b/.int/new\nx\ndiff --git a/z b/z\ny\n") == "diff --git a/z b/z\ny\n"
    assert strip("diff --git a/p b/p\n\ndiff --git a/.int/q b/q\nx\ndiff --git a/z b/z\ny\n") == "diff --git a/p b/p\ndiff --git a/z b/z\ny\n"
    assert one(spark, "", lambda c: diffs.incomplete_fix(c, F.lit(DIFF))) is True
    assert one(spark, DIFF, lambda c: diffs.incomplete_fix(c, F.lit(" "))) is False
    assert sorted(one(spark, 'File "a\\b.py", line 1\nc/d.py:3 and in e.py', diffs.file_refs)) == ["a/b.py", "c/d.py", "e.py"]


def test_python_functions(spark):
    assert one(spark, '{"b": 1, "a": 1.0}', python_udfs.params_hash) == one(spark, '{"a":1.0,  "b":1}', python_udfs.params_hash)
    assert one(spark, None, python_udfs.params_hash) is None and one(spark, "{", python_udfs.params_hash) is None
    for t in ('{"a": 1}', 'x ```json\n{"a": 1,}\n```', 'said {"a": 1} then', 'x {bad} {"a": 1,}'):
        got = one(spark, t, python_udfs.json_object_in)
        assert got == '{"a": 1}' or t.startswith("x {bad}")
    assert one(spark, "[1]", python_udfs.json_object_in) is None
    for t in ("{" * 200_000, '{"a": "' + "\\\\" * 100_000, "x" * 300_000, '{"a": "}"} {"b": 2}'):
        assert python_udfs.extract_object(t) == ({"a": "}"} if t.startswith('{"a": "}') else None)
    assert one(spark, "def f(:", python_udfs.python_syntax_error).startswith("line 1")
    assert one(spark, "class A:\n  def m(self, x): pass\ndef g(): pass", python_udfs.python_signatures) == ["class A:", "    def m(self, x)", "def g()"]
    assert python_udfs.signatures_in("async def a(x, *, y=1): pass\nb = 2\ndef c(): pass", 2) == ["async def a(x)", "def c()", "    ..."] and python_udfs.signatures_in("def (") == [] == python_udfs.signatures_in(None)
    d = spark.createDataFrame([("a\nb\n", "a\nc\n", "alpha\nalpine")], "x string, y string, z string")
    assert "-b\n+c\n" in d.select(python_udfs.unified_diff("x", "y", F.lit("p"))).first()[0]
    assert d.select(python_udfs.similar_lines("z", F.lit("alpha "))).first()[0][0] == "alpha"
