"""Queries over runs and their calls, with the SQL they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracefold.functions import steps
from tracefold.operators import detectors, records, sessions
from tracefold.sources.views import CALLS_SQL, RUNS_SQL, calls, runs, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, calls_view: bool = True, runs_view: bool = False):
    """Registers a query under its function's name, with its SQL over the views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            views = [v for v, on in ((CALLS_SQL, calls_view), (RUNS_SQL, runs_view)) if on]
            SQL[f.__name__] = ("WITH RECURSIVE " + ",\n".join(views) + ("" if not views else ("," if sql.lstrip().startswith("+") else "")) + "\n" if views else "") + sql.lstrip().removeprefix("+")
        return f

    return add


_RECOVERIES = r"""+
e AS (SELECT * FROM calls WHERE signal NOT IN ('NONE', 'BLOCKED')),
p AS (
  SELECT e.trajectory_id, e.pos AS error_pos, c.pos AS correction_pos, e.global_index AS error_index, c.global_index AS correction_index, e.signal AS error_signal,
    e.tool = c.tool AND e.target_file = c.target_file AS same,
    (SELECT count(*) FROM calls b WHERE b.trajectory_id = e.trajectory_id AND b.pos > e.pos AND b.pos < c.pos AND b.tool IN ('file_read', 'search') AND b.ok) AS investigation_count
  FROM e JOIN calls c ON c.trajectory_id = e.trajectory_id AND c.pos > e.pos AND c.pos <= e.pos + 8 AND c.signal = 'NONE' AND c.ok AND (c.turn_id, c.call_index_in_turn) > (e.turn_id, e.call_index_in_turn)
    AND (e.tool = c.tool OR (e.target_file = c.target_file AND e.target_file <> '') OR (e.tool, c.tool) IN (('bash', 'search'), ('search', 'bash'), ('bash', 'file_read'), ('file_read', 'bash'), ('file_edit', 'file_create'), ('file_create', 'file_edit'))
      OR c.tool IN ('file_edit', 'file_create'))
    AND (e.tool <> c.tool OR e.params_hash <> c.params_hash)
  QUALIFY row_number() OVER (PARTITION BY e.trajectory_id, e.pos ORDER BY c.pos) = 1),
rec AS (SELECT trajectory_id, error_pos, correction_pos, error_index, correction_index, error_signal, CASE WHEN investigation_count >= 2 THEN 'L3' WHEN same THEN 'L1' ELSE 'L2' END AS level, investigation_count FROM p)"""


@query(_RECOVERIES + " SELECT level, error_signal, count(*) AS n FROM rec GROUP BY ALL")
def recovery_levels(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.recovery_events(calls(spark, sf)).groupBy("level", "error_signal").agg(F.count("*").alias("n"))


@query(_RECOVERIES + " SELECT * FROM rec")
def recovery_events(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.recovery_events(calls(spark, sf))


@query(_RECOVERIES + " SELECT trajectory_id, count(*) AS n_recoveries, max(level) AS highest_level FROM rec GROUP BY ALL")
def recovery_by_run(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.recovery_by_run(calls(spark, sf))


@query("SELECT trajectory_id, signal, count(*) AS n FROM calls WHERE signal <> 'NONE' GROUP BY ALL")
def signal_counts(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.signal_histogram(calls(spark, sf))


@query("SELECT signal, tool, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM calls GROUP BY ALL")
def signal_totals(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark, sf).groupBy("signal", "tool").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


_SIGNAL_SQL = (
    "CASE WHEN signal = 'BLOCKED' THEN 'BLOCKED' WHEN ok THEN CASE WHEN regexp_matches(content, '{syntax}') THEN 'SYNTAX_ERROR' ELSE 'NONE' END WHEN regexp_matches(content, '{timeout}', 'i') THEN 'TIMEOUT' "
    "WHEN regexp_matches(content, '{syntax}') THEN 'SYNTAX_ERROR' WHEN tool = 'bash' AND regexp_matches(coalesce(try_cast(params AS JSON)->>'$.command', ''), '{loose}', 'i') AND regexp_matches(content, '{test}', 'i') THEN 'TEST_FAILURE' "
    "WHEN regexp_matches(content, '{missing}', 'i') THEN 'COMMAND_NOT_FOUND' WHEN regexp_matches(content, '(?m){runtime}') THEN 'RUNTIME_ERROR' WHEN regexp_matches(content, '{empty}', 'i') THEN 'EMPTY_DIFF' ELSE 'OTHER' END"
).format(syntax=steps.SYNTAX, timeout=steps.TIMEOUT, loose=steps.TEST_LOOSE, test=steps.TEST_FAILURE, missing=steps.NOT_FOUND, runtime=steps.RUNTIME, empty=steps.NO_CHANGES)


@query(f"SELECT trajectory_id, pos, {_SIGNAL_SQL} AS told FROM calls")
def error_signals(spark: SparkSession, sf: str) -> DataFrame:
    told = steps.error_signal(F.col("tool"), F.col("params"), F.col("ok"), F.col("content"), F.col("signal"))
    return calls(spark, sf).select("trajectory_id", "pos", told.alias("told"))


@query(
    "SELECT trajectory_id, target_file FROM (SELECT trajectory_id, target_file, signal = 'SYNTAX_ERROR' AS broken, pos FROM calls WHERE tool IN ('file_edit', 'file_create') AND target_file LIKE '%.py' AND (signal = 'SYNTAX_ERROR' OR (ok AND signal = 'NONE'))) "
    "GROUP BY ALL HAVING arg_max(broken, pos)"
)
def b22_unresolved_files(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.unresolved_syntax(calls(spark, sf))


SQL["b22_unresolved_files"] = SQL["b22_unresolved_files"].replace("GROUP BY ALL HAVING", "GROUP BY trajectory_id, target_file HAVING")


@query(
    "SELECT trajectory_id, pos, target_file FROM calls a WHERE tool = 'file_edit' AND target_file <> '' AND NOT EXISTS (SELECT 1 FROM calls r WHERE r.trajectory_id = a.trajectory_id AND r.target_file = a.target_file AND r.tool = 'file_read' AND r.ok AND r.pos < a.pos)"
)
def a1_missing_context(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.unread_edits(calls(spark, sf))


@query(
    r"""+
refs AS (SELECT trajectory_id, unnest(list_concat(regexp_extract_all(content, 'File\s+"([^"\n]+\.py)"', 1), regexp_extract_all(content, '(?:^|[\s(])([A-Za-z0-9_./\\-]+\.py):\d+', 1), regexp_extract_all(content, '\bin\s+([A-Za-z0-9_./\\-]+\.py)\b', 1))) AS f
  FROM calls WHERE signal IN ('TEST_FAILURE', 'RUNTIME_ERROR', 'SYNTAX_ERROR')),
edits AS (SELECT trajectory_id, target_file AS f FROM calls WHERE tool = 'file_edit' AND target_file <> '')
SELECT DISTINCT trajectory_id FROM refs WHERE trajectory_id IN (SELECT trajectory_id FROM edits)
  AND trajectory_id NOT IN (SELECT r.trajectory_id FROM refs r JOIN edits e ON e.trajectory_id = r.trajectory_id AND replace(e.f, '\', '/') = replace(r.f, '\', '/'))"""
)
def a2_mislocalized(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.call_facts(calls(spark, sf)).where("a2").select("trajectory_id")


@query()
def a2_of_named_files(spark: SparkSession, sf: str) -> DataFrame:
    """a2_mislocalized where failures name a file, in every other run one that the run edits and in the others one that none edits, so that it has rows."""
    edited = F.max(F.when(F.col("tool") == "file_edit", F.col("target_file"))).over(W.partitionBy("trajectory_id"))
    other = F.ascii(F.right("trajectory_id", F.lit(1))) % 2 == 0
    c = calls(spark, sf).withColumn("content", F.concat("content", F.lit('\n  File "'), F.when(other, "elsewhere.py").otherwise(F.coalesce(edited, F.lit(""))), F.lit('", line 1')))
    return detectors.call_facts(c).where("a2").select("trajectory_id")


_NAMED = """
named AS (SELECT * REPLACE (content || chr(10) || '  File "' || CASE WHEN ascii(right(trajectory_id, 1)) % 2 = 0 THEN 'elsewhere.py' ELSE coalesce(max(CASE WHEN tool = 'file_edit' THEN target_file END) OVER (PARTITION BY trajectory_id), '') END || '", line 1' AS content) FROM calls),
refs AS"""
SQL["a2_of_named_files"] = SQL["a2_mislocalized"].replace("\nrefs AS", _NAMED).replace("FROM calls WHERE", "FROM named WHERE")


_LABELS = rf"""+
rec0 AS (SELECT lower(trajectory_id) AS run, count(*) AS n_recoveries, max(level) AS highest_level FROM rec GROUP BY 1),
broken AS (SELECT DISTINCT lower(trajectory_id) AS run FROM (SELECT trajectory_id, target_file FROM calls WHERE tool IN ('file_edit', 'file_create') AND target_file LIKE '%.py' AND (signal = 'SYNTAX_ERROR' OR (ok AND signal = 'NONE'))
  GROUP BY trajectory_id, target_file HAVING arg_max(signal = 'SYNTAX_ERROR', pos))),
unread AS (SELECT DISTINCT lower(trajectory_id) AS run FROM calls a WHERE tool = 'file_edit' AND target_file <> '' AND NOT EXISTS (SELECT 1 FROM calls r WHERE r.trajectory_id = a.trajectory_id AND r.target_file = a.target_file AND r.tool = 'file_read' AND r.ok AND r.pos < a.pos)),
refs AS (SELECT trajectory_id, unnest(list_concat(regexp_extract_all(content, 'File\s+"([^"\n]+\.py)"', 1), regexp_extract_all(content, '(?:^|[\s(])([A-Za-z0-9_./\\-]+\.py):\d+', 1), regexp_extract_all(content, '\bin\s+([A-Za-z0-9_./\\-]+\.py)\b', 1))) AS f
  FROM calls WHERE signal IN ('TEST_FAILURE', 'RUNTIME_ERROR', 'SYNTAX_ERROR')),
edits AS (SELECT trajectory_id, target_file AS f FROM calls WHERE tool = 'file_edit' AND target_file <> ''),
misloc AS (SELECT DISTINCT lower(trajectory_id) AS run FROM refs WHERE trajectory_id IN (SELECT trajectory_id FROM edits) AND trajectory_id NOT IN (SELECT r.trajectory_id FROM refs r JOIN edits e ON e.trajectory_id = r.trajectory_id AND replace(e.f, '\', '/') = replace(r.f, '\', '/'))),
flags AS (SELECT lower(trajectory_id) AS run, bool_or(signal = 'TEST_FAILURE' AND regexp_matches(content, '{steps.ASSERTION}', 'i') AND NOT regexp_matches(content, '{steps.NOT_LOGIC}')) AS logic, bool_or(signal = 'TEST_FAILURE') AS tf,
  bool_or(tool = 'bash' AND regexp_matches(coalesce(try_cast(params AS JSON)->>'$.command', ''), '{steps.TEST_STRICT}')) AS ran, count(*) AS n_calls, count(*) FILTER (tool IN ('file_edit', 'file_create')) AS n_edits, count(*) FILTER (tool = 'bash') AS n_bash FROM calls GROUP BY 1),
gold AS (SELECT instance_id, gold_patch AS gold FROM tasks),
j AS (SELECT r.*, coalesce(f.logic, false) AS logic, coalesce(f.tf, false) AS tf, coalesce(f.ran, false) AS ran, coalesce(f.n_calls, 0) AS n_calls, coalesce(f.n_edits, 0) AS n_edits, coalesce(f.n_bash, 0) AS n_bash, b.run IS NOT NULL AS b22, u.run IS NOT NULL AS a1, m.run IS NOT NULL AS a2,
    coalesce(c.n_recoveries, 0) AS n_recoveries, c.highest_level, coalesce(g.gold, '') AS gold
  FROM runs r LEFT JOIN flags f USING (run) LEFT JOIN broken b USING (run) LEFT JOIN unread u USING (run) LEFT JOIN misloc m USING (run) LEFT JOIN rec0 c USING (run) LEFT JOIN gold g USING (instance_id)),
k AS (SELECT *, len(list_distinct(CASE WHEN regexp_matches(gold, '(?m)^diff --git a/\S+ b/\S+') THEN regexp_extract_all(gold, '(?m)^diff --git a/(\S+) b/\S+', 1) ELSE regexp_extract_all(gold, '(?m)^\+\+\+ b/(\S+)', 1) END)) AS gf, len(regexp_extract_all(gold, '(?m)^@@ ')) AS gh,
    len(list_distinct(CASE WHEN regexp_matches(final_diff, '(?m)^diff --git a/\S+ b/\S+') THEN regexp_extract_all(final_diff, '(?m)^diff --git a/(\S+) b/\S+', 1) ELSE regexp_extract_all(final_diff, '(?m)^\+\+\+ b/(\S+)', 1) END)) AS ff, len(regexp_extract_all(final_diff, '(?m)^@@ ')) AS fh FROM j),
l AS (SELECT *, claimed AND NOT tier1_pass AS c2, NOT claimed AND tier2_pass AND tier2_command <> '' AS c1, tier2_command <> '' AND NOT ran AS b12, trim(gold) <> '' AND (gf > 0 OR gh > 0) AND (ff < gf OR fh < gh) AS b11,
    tier1_pass AND NOT tier2_pass AND tier2_command <> '' AND (logic OR (NOT tf AND NOT b22)) AND NOT (claimed AND NOT tier1_pass) AS b21 FROM k),
lab AS (SELECT *, c2 OR b22 AS is_toxic, CASE WHEN c2 OR b22 THEN 'toxic' WHEN tier2_command <> '' AND NOT tier2_pass THEN 'failed' WHEN tier2_command = '' THEN CASE WHEN tier1_pass THEN 'weakly_verified' ELSE 'failed' END
    WHEN tier1_pass AND tier2_pass THEN CASE WHEN n_recoveries > 0 THEN 'verified_with_recovery' ELSE 'verified_one_shot' END ELSE 'failed' END AS outcome,
    list_filter([CASE WHEN a1 THEN 'A1' END, CASE WHEN a2 THEN 'A2' END, CASE WHEN b11 THEN 'B1.1' END, CASE WHEN b12 THEN 'B1.2' END, CASE WHEN b21 THEN 'B2.1' END, CASE WHEN b22 THEN 'B2.2' END, CASE WHEN c1 THEN 'C1' END, CASE WHEN c2 THEN 'C2' END], lambda x: x IS NOT NULL) AS categories FROM l)"""
ALL_LABELS = _RECOVERIES + "," + _LABELS.lstrip("+")


def labels_of(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.run_labels(calls(spark, sf), runs(spark, sf), table(spark, sf, "tasks"))


@query(ALL_LABELS + " SELECT run, outcome, is_toxic, n_recoveries, highest_level, array_to_string(categories, ',') AS categories FROM lab", runs_view=True)
def outcome_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels_of(spark, sf).select("run", "outcome", "is_toxic", "n_recoveries", "highest_level", F.array_join("categories", ",").alias("categories"))


@query("+ x AS (SELECT 1) SELECT run, NOT claimed AND tier2_pass AND tier2_command <> '' AS c1, claimed AND NOT tier1_pass AS c2 FROM runs", calls_view=False, runs_view=True)
def c1_c2_flags(spark: SparkSession, sf: str) -> DataFrame:
    return labels_of(spark, sf).select("run", "c1", "c2")


@query(ALL_LABELS + " SELECT run FROM lab WHERE b21", runs_view=True)
def b21_logic_error(spark: SparkSession, sf: str) -> DataFrame:
    return labels_of(spark, sf).where("b21").select("run")


@query(ALL_LABELS + " SELECT run FROM lab WHERE b12", runs_view=True)
def b12_untested(spark: SparkSession, sf: str) -> DataFrame:
    return labels_of(spark, sf).where("b12").select("run")


@query(ALL_LABELS + " SELECT run FROM lab WHERE b11", runs_view=True)
def b11_incomplete_fix(spark: SparkSession, sf: str) -> DataFrame:
    return labels_of(spark, sf).where("b11").select("run")


@query(ALL_LABELS + " SELECT run FROM lab WHERE NOT is_toxic", runs_view=True)
def non_toxic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return labels_of(spark, sf).where("NOT is_toxic").select("run")


@query(
    ALL_LABELS
    + """ SELECT metric, key, count(*) AS n FROM (SELECT 'outcome' AS metric, outcome AS key FROM lab UNION ALL SELECT 'level', coalesce(highest_level, 'none') FROM lab UNION ALL SELECT 'total', 'runs' FROM lab
    UNION ALL SELECT 'total', CASE WHEN is_toxic THEN 'toxic' ELSE 'not toxic' END FROM lab UNION ALL SELECT 'total', 'recovered' FROM lab WHERE n_recoveries > 0 UNION ALL SELECT 'category', unnest(categories) FROM lab) GROUP BY ALL""",
    runs_view=True,
)
def outcome_summary(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.label_summary(labels_of(spark, sf))


def _arm():
    return F.coalesce((F.col("seed") % 3).cast("string"), F.lit("none"))


@query(
    ALL_LABELS
    + """ SELECT coalesce(CAST(seed % 3 AS VARCHAR), 'none') AS arm, count(*) AS n_runs, round(avg(n_calls), 6) AS avg_calls, round(avg(n_edits), 6) AS avg_edits, round(avg(n_bash), 6) AS avg_bash, round(avg(n_edits / greatest(n_bash, 1)), 6) AS edit_bash_ratio,
    round(avg(input_tokens), 6) AS avg_input_tokens, round(avg(output_tokens), 6) AS avg_output_tokens, round(avg(CASE WHEN outcome LIKE 'verified%' THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(CASE WHEN n_recoveries > 0 THEN 1.0 ELSE 0.0 END), 6) AS recovery_rate FROM lab GROUP BY 1""",
    runs_view=True,
)
def ablation_by_arm(spark: SparkSession, sf: str) -> DataFrame:
    out = detectors.arm_aggregates(labels_of(spark, sf), _arm())
    return out.select("arm", "n_runs", *[F.round(x, 6).alias(x) for x in out.columns[2:]])


@query(ALL_LABELS + " SELECT coalesce(CAST(seed % 3 AS VARCHAR), 'none') AS arm, outcome, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY coalesce(CAST(seed % 3 AS VARCHAR), 'none')), 6) AS pct FROM lab GROUP BY 1, 2", runs_view=True)
def outcome_pct_by_arm(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.outcome_shares(labels_of(spark, sf), _arm()).withColumn("pct", F.round("pct", 6))


_LAST = "coalesce(lead(turn_id) OVER (PARTITION BY trajectory_id ORDER BY pos) <> turn_id, true)"


@query(f"SELECT trajectory_id, pos, turn_id FROM (SELECT trajectory_id, pos, turn_id, max(CAST(tool IN ('file_edit', 'file_create') AS INT)) OVER (PARTITION BY trajectory_id ORDER BY pos ROWS 5 PRECEDING) AS e, {_LAST} AS last FROM calls) WHERE e = 0 AND pos >= 5 AND last")
def no_edit_nudge(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.edit_nudges(calls(spark, sf))


@query(
    f"SELECT trajectory_id, pos, turn_id FROM (SELECT trajectory_id, pos, turn_id, bool_or(tool IN ('file_edit', 'file_create')) OVER w AS e, bool_or(tool = 'bash') OVER w AS b, {_LAST} AS last FROM calls WINDOW w AS (PARTITION BY trajectory_id ORDER BY pos ROWS 4 PRECEDING)) WHERE e AND NOT b AND last AND pos >= 4"
)
def no_test_nudge(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.test_nudges(calls(spark, sf))


@query("SELECT trajectory_id, pos, turn_id, row_number() OVER (PARTITION BY trajectory_id, turn_id ORDER BY pos) - 1 AS in_turn, row_number() OVER (PARTITION BY trajectory_id ORDER BY pos) - 1 AS in_run FROM calls")
def call_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.numbered(calls(spark, sf))


@query("SELECT trajectory_id, pos, step, CASE WHEN pos >= 100 THEN 'total' ELSE 'step' END AS why FROM (SELECT trajectory_id, pos, turn_id AS step, row_number() OVER (PARTITION BY trajectory_id, turn_id ORDER BY pos) - 1 AS s FROM calls) WHERE pos >= 100 OR s >= 15")
def budget_exceeded(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.over_budget(calls(spark, sf))


@query("SELECT * FROM (SELECT trajectory_id, pos, step, action, row_number() OVER (PARTITION BY trajectory_id, step, action ORDER BY pos) AS nth FROM (SELECT trajectory_id, pos, pos // 20 AS step, tool || ':' || coalesce(nullif(params_hash, ''), md5(params)) AS action FROM calls)) WHERE nth > 2")
def repeat_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of twenty calls, as the runs' turns are short."""
    return sessions.repeated_actions(calls(spark, sf).withColumn("step", F.floor(F.col("pos") / 20)), step="step")


@query(
    """+ e AS (SELECT trajectory_id, pos, target_file, ok FROM calls WHERE tool IN ('file_edit', 'file_create') AND target_file <> ''),
  n AS (SELECT e.trajectory_id, e.pos, e.target_file, (SELECT count(DISTINCT x.target_file) FROM e x WHERE x.trajectory_id = e.trajectory_id AND x.pos < e.pos AND x.ok) AS before, EXISTS (SELECT 1 FROM e x WHERE x.trajectory_id = e.trajectory_id AND x.pos < e.pos AND x.ok AND x.target_file = e.target_file) AS seen FROM e)
SELECT trajectory_id, pos, target_file FROM n WHERE before >= 3 AND NOT seen"""
)
def many_files(spark: SparkSession, sf: str) -> DataFrame:
    """A whole run as one step, of three files at most."""
    return records.many_files(calls(spark, sf).withColumn("step", F.lit(0)), most=3, step="step")


@query("SELECT trajectory_id, count(DISTINCT target_file) FILTER (tool = 'file_read' AND ok AND target_file <> '') AS n_read, count(DISTINCT target_file) FILTER (tool IN ('file_edit', 'file_create') AND ok AND target_file <> '') AS n_edited FROM calls GROUP BY 1")
def files_edited(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.files_touched(calls(spark, sf))


@query("SELECT trajectory_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM (SELECT trajectory_id, pos, ok, sum(CAST(ok AS INT)) OVER (PARTITION BY trajectory_id ORDER BY pos) AS g FROM calls) WHERE NOT ok GROUP BY trajectory_id, g HAVING count(*) >= 3")
def error_streaks(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.error_streaks(calls(spark, sf))


@query(
    """+
f AS (SELECT trajectory_id, pos, CASE WHEN ok THEN 0 ELSE 1 END AS fails, 0 AS blocks FROM calls WHERE pos = 0
  UNION ALL SELECT c.trajectory_id, c.pos, CASE WHEN f.fails >= 3 THEN 0 WHEN c.ok THEN 0 ELSE f.fails + 1 END, f.blocks + CASE WHEN f.fails >= 3 THEN 1 ELSE 0 END FROM f JOIN calls c ON c.trajectory_id = f.trajectory_id AND c.pos = f.pos + 1)
SELECT trajectory_id, CAST(max(blocks) AS BIGINT) AS n_blocks FROM f GROUP BY 1 HAVING max(blocks) > 0"""
)
def blocked_by_errors(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.blocked_by_errors(calls(spark, sf))


@query("SELECT trajectory_id, pos FROM (SELECT trajectory_id, pos, count(*) FILTER (tool IN ('file_edit', 'file_create')) OVER (PARTITION BY trajectory_id ORDER BY pos) AS e FROM calls) WHERE e = 0 AND pos >= 7 AND (pos - 7) % 5 = 0")
def idle_advice(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.idle_advice(calls(spark, sf))
