import random

import pytest

from tracefold.llm import truncation

R = random.Random(8)
NOUNS = ["cache", "index", "queue", "token", "ledger", "route"]


def sentence():
    return f"The {R.choice(NOUNS)} of the {R.choice(NOUNS)} keeps the old order when the {R.choice(NOUNS)} is empty."


def note():
    return "\n\n".join(" ".join(sentence() for _ in range(3)) for _ in range(2))


def log():
    return "\n".join(f"[10:{R.randrange(60):02}:11] bash: {R.randrange(90)} matches in src/a/{R.choice(NOUNS)}.py" for _ in range(12)) + "\nexit status 0"


def diff(cut=False):
    body = "\n".join(R.choice(["+", "-"]) + f"    {R.choice(NOUNS)} = {R.randrange(99)}" for _ in range(8))
    n, m = sum(x[0] == "-" for x in body.split("\n")), sum(x[0] == "+" for x in body.split("\n"))
    text = f"diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,{n} +1,{m} @@\n{body}"
    return "\n".join(text.split("\n")[:-3]) if cut else text


GOOD = [("note", note()) for _ in range(120)] + [("run-log", log()) for _ in range(80)] + [("patch", diff()) for _ in range(60)] + [("title", f"Fix {R.choice(NOUNS)} in {R.choice(NOUNS)}") for _ in range(30)]
CUT = [
    ("note", note()[:-9]), ("note", note()[:-20] + " [truncated]"), ("note", note()[:-25] + "…"), ("note", note()[:-13]), ("note", note()[:-4]), ("run_log", "\n".join(log().split("\n")[:7])), ("run_log", log()[:-25]), ("patch", diff(True)),
    ("note", note() + "\n\n```\nx = 1"), ("note", note() + '\n{"a": "b", "c": "d'),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, s, t, "x") for i, (s, t) in enumerate(GOOD + CUT)]
    rows += [(len(rows), "note", None, "x"), (len(rows) + 1, "note", "", "x"), (len(rows) + 2, None, " \n ", "x"), (len(rows) + 3, "note", CUT[0][1], "x"), (len(rows) + 4, None, note(), "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, words string")
    return {r["doc_id"] for r in truncation.truncated(df).collect()}, len(GOOD)


@pytest.mark.parametrize("i", range(len(CUT)))
def test_cut_texts_are_found(found, i):
    assert found[1] + i in found[0], CUT[i]


def test_whole_texts_are_not(found):
    assert not [GOOD[i] for i in found[0] if i < found[1]]


def test_null_empty_blank_and_copies(found):
    n = found[1] + len(CUT)
    assert not {n, n + 1, n + 2, n + 4} & found[0] and n + 3 in found[0]


def test_by_source(spark):
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(GOOD + CUT)], "doc_id long, source string, text string")
    got = {r["source"]: (r["n_texts"], r["n_truncated"]) for r in truncation.truncation_by_source(df).collect()}
    assert got["run_log"] == (82, 2) and got["patch"] == (61, 1) and got["title"] == (30, 0)


def test_empty_table(spark):
    assert truncation.truncated(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def ids(spark, rows):
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string")
    return {r["doc_id"] for r in truncation.truncated(df).collect()}


def test_texts_cut_at_the_same_piece_are_all_found(spark):
    # As in a large table: a piece of a word that ends a dozen texts is still no word, and a log line that ends three no end of a log.
    whole = [("note", f"{note()} {sentence()}") for _ in range(700)] + [("run-log", log()) for _ in range(80)]
    cut = [("note", note() + f" The {n} of the {m} keeps the old or") for n in NOUNS[:3] for m in NOUNS[:4]] + [("run-log", "\n".join(log().split("\n")[:7]) + "\n[10:2") for _ in range(3)]
    assert ids(spark, whole + cut) == set(range(len(whole), len(whole + cut)))


def test_copies_change_nothing(spark):
    rows = GOOD + CUT
    once = ids(spark, rows)
    assert ids(spark, rows * 10) == {k * len(rows) + i for i in once for k in range(10)}
