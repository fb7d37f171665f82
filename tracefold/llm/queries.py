"""The queries of this subpackage's operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import contamination, mixing, patterns, repeats, sampling, splits, truncation
from tracefold.sources.views import CALLS_SQL

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.collapse_repeats(_t(spark, sf, "tool_call_events")).select("trajectory_id", "first_index", "last_index")


def p1_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.collapse_repeats(_t(spark, sf, "tool_call_events"), least=1)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.frequent_patterns(_t(spark, sf, "tool_call_events")).select("pattern")


def p2_support(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.frequent_patterns(_t(spark, sf, "tool_call_events"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    short = sampling.short_categories(sampling.current_labels(_t(spark, sf, "labels")), _t(spark, sf, "sample_targets"))
    return short.select("outcome", F.col("contains_recovery").cast("long").alias("contains_recovery"), "highest_recovery_level")


def p3_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_to_targets(sampling.current_labels(_t(spark, sf, "labels")), _t(spark, sf, "sample_targets"))


def p3_sample_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What p3_sample holds of each category, and how many of its runs are labelled so."""
    current = sampling.current_labels(_t(spark, sf, "labels"))
    drawn = sampling.sample_to_targets(current, _t(spark, sf, "sample_targets")).withColumnRenamed("run", "drawn")
    same = [drawn[k] == current[k] for k in sampling.KEYS]
    known = drawn.join(current.withColumnRenamed("run", "_run"), [F.col("drawn") == F.col("_run"), *same], "left_semi")
    return known.groupBy(*sampling.KEYS).agg(F.count_distinct("drawn").alias("n_runs"))


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_report(sampling.current_labels(_t(spark, sf, "labels")), _t(spark, sf, "sample_targets"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.groups_found(_t(spark, sf, "trajectories"))


def p4_split_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The groups of p4_splits: their records and how many splits they are in."""
    return p4_splits(spark, sf).groupBy("group_id").agg(F.count_distinct("record_id").alias("n_records"), F.count_distinct("split_name").alias("n_splits"))


def p4_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_records(_t(spark, sf, "trajectories"), _t(spark, sf, "split_targets"))


def p4_forest(spark: SparkSession, sf: str) -> DataFrame:
    return splits.record_forest(_t(spark, sf, "trajectories"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.eval_leaks(_t(spark, sf, "documents"), _t(spark, sf, "eval_items"))


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.leaked_items(_t(spark, sf, "documents"), _t(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(_t(spark, sf, "documents"))


def p9_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_by_source(_t(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.short_sources(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_schedule(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))


P3_FOUND_SQL = """
WITH l AS (
  SELECT lower(trim(trajectory_id)) AS run, labelled_at,
    regexp_replace(lower(trim(outcome)), '[\\s_-]+', '_', 'g') AS outcome,
    CASE WHEN highest_recovery_level IS NULL OR lower(regexp_replace(highest_recovery_level, '[^A-Za-z0-9]', '', 'g')) IN ('', 'none', 'null', 'nil', 'na', 'no', 'nothing', 'nan')
      THEN 'NONE' ELSE upper(regexp_replace(highest_recovery_level, '[^A-Za-z0-9]', '', 'g')) END AS level, contains_recovery
  FROM labels WHERE trajectory_id IS NOT NULL),
c AS (SELECT *, coalesce(contains_recovery, level <> 'NONE') AS rec FROM l
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY labelled_at DESC NULLS LAST, outcome DESC, level DESC, coalesce(contains_recovery, level <> 'NONE') DESC) = 1),
n AS (SELECT outcome, rec, level, count(*) AS n FROM c GROUP BY ALL),
s AS (SELECT count(*) // 4 AS size FROM c)
SELECT t.outcome, CAST(t.contains_recovery AS BIGINT) AS contains_recovery, t.highest_recovery_level
FROM sample_targets t CROSS JOIN s LEFT JOIN n ON n.outcome = t.outcome AND n.rec = t.contains_recovery AND n.level = t.highest_recovery_level
WHERE coalesce(n.n, 0) < greatest(CAST(ceil(t.target_permille * s.size / 1000.0) AS BIGINT), t.min_rows)
"""

P4_FOUND_SQL = """
WITH RECURSIVE k AS (
  SELECT record_id, nullif(nullif(regexp_replace(lower(instance_id), '[^a-z0-9]', '', 'g'), ''), 'unknown') AS i,
    nullif(lower(trim(regexp_replace(trajectory_id, '#.*$', '', 's'), E' \\t\\n\\r')), '') AS r FROM trajectories),
ir AS (SELECT i, r, min(record_id) AS m FROM k WHERE i IS NOT NULL AND r IS NOT NULL GROUP BY ALL),
ii AS (SELECT DISTINCT a.i AS a, b.i AS b FROM ir a JOIN ir b ON a.r = b.r),
reach AS (SELECT a, b FROM ii UNION SELECT reach.a, ii.b FROM reach JOIN ii ON reach.b = ii.a),
comp AS (SELECT a AS i, min(b) AS root FROM reach GROUP BY a),
rr AS (SELECT ir.r, min(comp.root) AS root FROM ir JOIN comp ON comp.i = ir.i GROUP BY ir.r),
g AS (SELECT k.record_id, coalesce('i' || rr.root, 'i' || comp.root, 'i' || k.i, 'r' || k.r) AS root
  FROM k LEFT JOIN rr ON rr.r = k.r LEFT JOIN comp ON comp.i = k.i)
SELECT record_id, min(record_id) OVER (PARTITION BY root) AS group_id FROM g WHERE root IS NOT NULL QUALIFY count(*) OVER (PARTITION BY root) > 1
"""

# An edge of the pairs (task, run) is in the least spanning forest unless edges of smaller weight join its ends.
P4_FOREST_SQL = P4_FOUND_SQL.split("ii AS")[0] + """
d AS (SELECT 'i' || i AS a, 'r' || r AS b, m FROM ir UNION ALL SELECT 'r' || r, 'i' || i, m FROM ir),
reach AS (SELECT m AS e, 'i' || i AS at FROM ir UNION SELECT reach.e, d.b FROM reach JOIN d ON d.a = reach.at AND d.m < reach.e)
SELECT i AS task, r AS run, m AS record_id FROM ir WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.e = ir.m AND reach.at = 'r' || ir.r)
"""


P2_SQL = f"""
WITH {CALLS_SQL},
s AS (SELECT trajectory_id AS r, pos, tool || ':' || signal AS step, CAST(signal <> 'NONE' AS INT) AS e FROM calls),
t3 AS (SELECT a.r, c.pos, a.step || '>' || b.step || '>' || c.step AS pattern, a.e + b.e + c.e AS e
  FROM s a JOIN s b ON b.r = a.r AND b.pos BETWEEN a.pos + 1 AND a.pos + 3 JOIN s c ON c.r = a.r AND c.pos BETWEEN b.pos + 1 AND b.pos + 3),
t4 AS (SELECT t3.r, t3.pattern || '>' || d.step AS pattern, t3.e + d.e AS e FROM t3 JOIN s d ON d.r = t3.r AND d.pos BETWEEN t3.pos + 1 AND t3.pos + 3),
n AS (SELECT pattern, n_steps, count(DISTINCT r) AS n_runs FROM (SELECT r, pattern, e, 3 AS n_steps FROM t3 UNION ALL SELECT r, pattern, e, 4 FROM t4) WHERE e >= 2 GROUP BY ALL)
"""

P3_REPORT_SQL = (
    P3_FOUND_SQL.split("SELECT t.outcome, CAST")[0]
    + """,
r AS (SELECT t.outcome, t.contains_recovery, t.highest_recovery_level, t.target_permille, coalesce(n.n, 0) AS available, greatest(CAST(ceil(t.target_permille * s.size / 1000.0) AS BIGINT), t.min_rows) AS wanted
  FROM sample_targets t CROSS JOIN s LEFT JOIN n ON n.outcome = t.outcome AND n.rec = t.contains_recovery AND n.level = t.highest_recovery_level)
SELECT outcome, contains_recovery, highest_recovery_level, wanted, available, least(wanted, available) AS sampled, greatest(wanted - available, 0) AS deficit,
  round(1000.0 * least(wanted, available) / sum(least(wanted, available)) OVER (), 3) AS actual_permille, target_permille FROM r
"""
)

P3_SAMPLE_COUNTS_SQL = P3_REPORT_SQL.split("SELECT outcome, contains_recovery, highest_recovery_level, wanted")[0] + "SELECT outcome, contains_recovery, highest_recovery_level, least(wanted, available) AS n_runs FROM r WHERE least(wanted, available) > 0"
P4_SPLIT_GROUPS_SQL = P4_FOUND_SQL.split("SELECT record_id, min(record_id)")[0] + "SELECT min(record_id) AS group_id, count(*) AS n_records, 1 AS n_splits FROM g GROUP BY coalesce(root, CAST(record_id AS VARCHAR))"


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_collapsed, p2_found, p2_support, p3_found, p3_sample, p3_sample_counts, p3_report, p4_found, p4_forest, p4_splits, p4_split_groups, p7_found, p7_items, p8_found, p8_mixture, p8_report, p9_found, p9_by_source)}


def oracle_sql() -> dict[str, str]:
    frequent = " FROM n WHERE n_runs >= 0.1 * (SELECT count(DISTINCT trajectory_id) FROM calls)"
    return {"p2_found": P2_SQL + "SELECT pattern" + frequent, "p2_support": P2_SQL + "SELECT pattern, n_steps, n_runs" + frequent, "p3_found": P3_FOUND_SQL, "p3_report": P3_REPORT_SQL, "p4_found": P4_FOUND_SQL, "p4_forest": P4_FOREST_SQL, "p3_sample_counts": P3_SAMPLE_COUNTS_SQL, "p4_split_groups": P4_SPLIT_GROUPS_SQL}
