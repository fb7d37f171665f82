"""Task rows from a benchmark's records: texts, test lists, test commands, working folders, and tasks by seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import diffs, text


def task_text(problem: Column, hints: Column, include_hints: bool) -> Column:
    """The problem, with the hints below it where they are wanted and there are some; null if there is no problem."""
    p = text.stripped(problem)
    both = F.when(hints.rlike(r"(?U)\S"), F.concat(p, F.lit("\n\nAdditional hints:\n"), text.stripped(hints))).otherwise(p) if include_hints else p
    return F.when(problem.rlike(r"(?U)\S"), both)


def test_list(c: Column) -> Column:
    """The tests of a list that is written as JSON; entries that are no text or blank are left out, what is no list gives none."""
    items = F.from_json(F.when(c.rlike(r"^\s*\["), c), "array<variant>")
    names = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", text.stripped(F.try_variant_get(v, "$", "string"))))
    return F.coalesce(F.filter(names, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def node_id(name: Column, files: Column) -> Column:
    """The pytest node of 'method (dotted.module.Class)', its file by the first patch file that ends like the module; other names as they are."""
    m, dotted = (F.regexp_extract(F.trim(name), r"(?U)^(\w+)\s+\(([\w\.]+)\)$", i) for i in (1, 2))
    parts = F.split(dotted, r"\.")
    tail = F.concat(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"), F.lit(".py"))
    fits = F.filter(F.transform(files, lambda f: F.replace(f, F.lit("\\"), F.lit("/"))), lambda f: (f == tail) | f.endswith(F.concat(F.lit("/"), tail)))
    path = F.coalesce(F.get(fits, F.lit(0)), tail)
    return F.when((m != "") & (F.size(parts) >= 2), F.concat(path, F.lit("::"), F.element_at(parts, -1), F.lit("::"), m)).otherwise(name)


def test_command(tests: Column, test_patch: Column) -> Column:
    """The pytest command for the tests: nodes by place if one is a node, else by -k, in the patch's files where it has some; '' without tests."""
    files = diffs.diff_files(F.coalesce(test_patch, F.lit("")))
    names = F.transform(tests, lambda t: node_id(t, files))
    quoted = lambda a: F.array_join(F.transform(a, text.shell_quoted), " ")
    end = F.lit(" --tb=short -x --no-header -q")
    by_name = F.concat(F.lit("-k "), text.shell_quoted(F.array_join(names, " or ")))
    return F.when(F.size(tests) == 0, "").when(F.exists(names, lambda n: n.contains("::")), F.concat(F.lit("{python} -m pytest "), quoted(names), end)).when(F.size(files) > 0, F.concat(F.lit("{python} -m pytest "), quoted(files), F.lit(" "), by_name, end)).otherwise(F.concat(F.lit("{python} -m pytest "), by_name, end))


def with_folder(tasks: DataFrame, folders: DataFrame, root: str) -> DataFrame:
    """Tasks with cwd: the folder that `folders` (repo, cwd) maps the repository to, else one under root."""
    f = folders.select("repo", F.col("cwd").alias("_mapped"))
    return tasks.join(f, "repo", "left").withColumn("cwd", F.coalesce(F.nullif(F.col("_mapped"), F.lit("")), F.concat(F.lit(root.rstrip("/") + "/"), F.replace("repo", F.lit("/"), F.lit("__"))))).drop("_mapped")


def prepared(records: DataFrame, include_hints: bool = False) -> DataFrame:
    """Tasks from benchmark records (instance_id, repo, base_commit, problem_statement, hints_text, patch, test_patch, FAIL_TO_PASS, PASS_TO_PASS). Records without problem are left out."""
    f2p, p2p = test_list(F.col("FAIL_TO_PASS")), test_list(F.col("PASS_TO_PASS"))
    t = records.select("instance_id", task_text(F.col("problem_statement"), F.col("hints_text"), include_hints).alias("task"), "repo", "base_commit", F.col("patch").alias("gold_patch"), "test_patch", f2p.alias("fail_to_pass"), p2p.alias("pass_to_pass"))
    return t.where("task IS NOT NULL").withColumn("tier2_command", test_command(F.col("fail_to_pass"), F.col("test_patch")))


def whitelisted(tasks: DataFrame, ids: DataFrame, needed: bool = False) -> DataFrame:
    """The tasks whose instance_id is among ids; with needed, none at all is an error."""
    kept = tasks.join(ids.select("instance_id"), "instance_id", "left_semi")
    if needed and not kept.limit(1).count():
        raise ValueError("none of the tasks is among the wanted ids")
    return kept


def by_seeds(tasks: DataFrame, seeds: list[int]) -> DataFrame:
    """Each task with each seed, seeds once each in order; the seeds are exploded from a literal, so no join is made."""
    return tasks.withColumn("seed", F.explode(F.lit(list(dict.fromkeys(seeds)))))


def run_report(results: DataFrame) -> DataFrame:
    """One row: how many of (ordinal, exit_code) ended with 0, 1 and other codes, up to and with the first other one, at which the run stops."""
    first_bad = results.where("exit_code NOT IN (0, 1)").agg(F.min("ordinal").alias("stop"))
    r = results.join(F.broadcast(first_bad)).where("stop IS NULL OR ordinal <= stop")
    return r.agg(F.count("*").alias("attempted"), F.count_if(F.col("exit_code") == 0).alias("succeeded"), F.count_if(F.col("exit_code") == 1).alias("failed"), F.count_if(~F.col("exit_code").isin(0, 1)).alias("errors"))
