"""Unified diffs and file references in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def diff_files(diff: Column) -> Column:
    """The files of a diff in order, each once: of `diff --git` lines, or of `+++ b/` lines where there are none."""
    git = F.regexp_extract_all(diff, F.lit(r"(?dm)^diff --git a/(\S+) b/\S+"), F.lit(1))
    plus = F.regexp_extract_all(diff, F.lit(r"(?dm)^\+\+\+ b/(\S+)"), F.lit(1))
    return F.coalesce(F.array_distinct(F.when(F.size(git) > 0, git).otherwise(plus)), F.array().cast("array<string>"))


def diff_hunks(diff: Column) -> Column:
    return F.coalesce(F.regexp_count(diff, F.lit("(?dm)^@@ ")), F.lit(0))


def incomplete_fix(final: Column, gold: Column) -> Column:
    """Whether a run's diff has fewer files or hunks than the known fix, where that has any."""
    final, gold = F.coalesce(final, F.lit("")), F.coalesce(gold, F.lit(""))
    gf, gh = F.size(diff_files(gold)), diff_hunks(gold)
    return gold.rlike(r"(?U)\S") & ((gf > 0) | (gh > 0)) & ((F.size(diff_files(final)) < gf) | (diff_hunks(final) < gh))


def file_refs(text: Column) -> Column:
    """The .py files that an error text names, with forward slashes, each once."""
    # The three forms a reference takes.
    forms = (r'(?dU)File\s+"([^"\n]+\.py)"', r"(?dU)(?:^|[\s(])([A-Za-z0-9_./\\-]+\.py):\d+", r"(?dU)\bin\s+([A-Za-z0-9_./\\-]+\.py)\b")
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in forms])
    return F.array_distinct(F.transform(found, lambda p: F.replace(p, F.lit("\\"), F.lit("/"))))


def without_internal(diff: Column, prefixes: tuple[str, ...]) -> Column:
    """The diff without the files whose old or new path is under the given folders. A line break stands between the files that stay, as they end."""
    chunks = F.split(diff, "\ndiff --git ")
    named = F.transform(chunks, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit("diff --git "), c)))

    def inside(c: Column) -> Column:
        words = F.filter(F.split(F.substring_index(c, "\n", 1), r"(?U)\s+"), lambda w: w != "")
        old, new = F.regexp_replace(F.get(words, F.lit(2)), "^a/", ""), F.regexp_replace(F.get(words, F.lit(3)), "^b/", "")
        under = lambda p: F.exists(F.lit(list(prefixes)), lambda x: F.startswith(p, x))
        return F.coalesce((F.size(words) >= 4) & (under(old) | under(new)), F.lit(False)) if prefixes else F.lit(False)

    kept = F.filter(named, lambda c: ~inside(c))
    return F.aggregate(F.slice(kept, 2, F.size(kept)), F.coalesce(F.get(kept, F.lit(0)), F.lit("")), lambda out, c: F.concat(out, F.when(out.endswith("\n"), "").otherwise("\n"), c))
