"""Queries over tasks, texts, messages, event logs and the star tables, with the SQL they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import diffs, python_udfs, text
from tracefold.functions.names import snake
from tracefold.operators import detectors, export, lookups, sessions, tasks
from tracefold.operators.ranks import ordered_running
from tracefold.plans.json_sql import attempts_sql
from tracefold.plans.run_queries import ALL_LABELS, labels_of, query
from tracefold.session import checkpointed, spread
from tracefold.sources import files
from tracefold.sources.views import calls, runs, table
from tracefold.streaming import live


@query("SELECT instance_id, seed, repo FROM tasks CROSS JOIN (SELECT unnest([0, 1, 2]) AS seed)", calls_view=False)
def tasks_by_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.by_seeds(table(spark, sf, "tasks").select("instance_id", "repo"), [0, 1, 2, 1]).select("instance_id", F.col("seed").cast("int").alias("seed"), "repo")


@query("SELECT instance_id, repo FROM tasks WHERE instance_id IN (SELECT instance_id FROM trajectories WHERE llm_claimed_success)", calls_view=False)
def whitelist_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.whitelisted(table(spark, sf, "tasks"), table(spark, sf, "trajectories").where("llm_claimed_success")).select("instance_id", "repo")


_DIFF = r"regexp_extract_all(coalesce({c}, ''), '(?m)^diff --git a/(\S+) b/\S+', 1)"


@query(f"SELECT instance_id, len(list_distinct({_DIFF.format(c='gold_patch')})) AS n_files, len(regexp_extract_all(coalesce(gold_patch, ''), '(?m)^@@ ')) AS n_hunks FROM tasks", calls_view=False)
def diff_counts(spark: SparkSession, sf: str) -> DataFrame:
    g = F.coalesce("gold_patch", F.lit(""))
    return table(spark, sf, "tasks").select("instance_id", F.size(diffs.diff_files(g)).cast("long").alias("n_files"), diffs.diff_hunks(g).cast("long").alias("n_hunks"))


@query(f"SELECT instance_id, array_to_string({_DIFF.format(c='test_patch')}, ' ') AS files FROM tasks", calls_view=False)
def test_patch_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tasks").select("instance_id", F.array_join(diffs.diff_files(F.coalesce("test_patch", F.lit(""))), " ").alias("files"))


SAFE = """CASE WHEN regexp_full_match({x}, '[A-Za-z0-9_@%+=:,./-]+') THEN {x} ELSE '''' || replace({x}, '''', '''"''"''') || '''' END"""


@query(
    "SELECT instance_id, CASE WHEN len(fail_to_pass) = 0 OR fail_to_pass IS NULL THEN '' ELSE '{python} -m pytest ' || array_to_string(list_transform(fail_to_pass, lambda x: " + SAFE.format(x="x") + "), ' ') || ' --tb=short -x --no-header -q' END AS command FROM tasks",
    calls_view=False,
)
def test_commands(spark: SparkSession, sf: str) -> DataFrame:
    f = F.coalesce("fail_to_pass", F.array().cast("array<string>"))
    return table(spark, sf, "tasks").select("instance_id", tasks.test_command(f, F.col("test_patch")).alias("command"))


@query("SELECT instance_id, coalesce(nullif(m.cwd, ''), '/data/' || replace(t.repo, '/', '__')) AS cwd FROM tasks t LEFT JOIN (SELECT repo, min(cwd) AS cwd FROM tasks GROUP BY 1 HAVING count(*) > 8) m USING (repo)", calls_view=False)
def task_folders(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "tasks")
    mapped = t.groupBy("repo").agg(F.min("cwd").alias("cwd"), F.count("*").alias("n")).where("n > 8")
    return tasks.with_folder(t.drop("cwd"), mapped, "/data").select("instance_id", "cwd")


@query(
    "SELECT record_id, t.instance_id, coalesce(k.repo, '') AS repo FROM trajectories t LEFT JOIN tasks k ON k.instance_id = t.instance_id",
    calls_view=False,
)
def record_task_join(spark: SparkSession, sf: str) -> DataFrame:
    t, k = table(spark, sf, "trajectories").select("record_id", "instance_id"), table(spark, sf, "tasks").select("instance_id", "repo")
    return t.join(k, "instance_id", "left").select("record_id", "instance_id", F.coalesce("repo", F.lit("")).alias("repo"))


@query(
    "SELECT e.event_id, e.user_id, (SELECT max(s.ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts) AS signed_up, (SELECT count(*) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts > e.ts) AS n_later FROM events e WHERE e.event_type = 'purchase'",
    calls_view=False,
)
def asof_last_signup(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    s = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("s_ts"), F.col("ts").alias("signed_up"))
    return lookups.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), s, "user_id", "ts", "s_ts", "signed_up", later="n_later").select("event_id", "user_id", "signed_up", "n_later")


_SCORE = "sqrt(n_lines) * (1.0 / (1.0 + len(string_split(path, '/')) - 1)) * CASE WHEN lower(path) LIKE '%/test%' OR lower(path) LIKE '%tests/%' OR lower(path) LIKE '%/example%' OR lower(path) LIKE '%/docs/%' THEN 0.3 ELSE 1.0 END"


@query(f"SELECT path, n_lines, round({_SCORE}, 9) AS score FROM (SELECT target_file AS path, count(*) AS n_lines FROM calls WHERE target_file <> '' GROUP BY 1) WHERE n_lines >= 2 ORDER BY {_SCORE} DESC, path LIMIT 12")
def top_k_scored(spark: SparkSession, sf: str) -> DataFrame:
    seen = calls(spark, sf).where("target_file <> ''").groupBy(F.col("target_file").alias("path")).agg(F.count("*").alias("n_lines"))
    return lookups.top_files(seen).withColumn("score", F.round("score", 9))


def _as_files(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as files: one folder a source, some in folders that searches leave out."""
    folder = F.when(F.col("doc_id") % 10 == 3, "node_modules/").when(F.col("doc_id") % 10 == 7, ".cache/").otherwise("")
    return table(spark, sf, "documents").select(F.concat(folder, snake(F.coalesce("source", F.lit("none"))), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")


_AS_FILES = r"f AS (SELECT regexp_replace(lower(trim(coalesce(source, 'none'))), '[\s_-]+', '_', 'g') || '/' || doc_id || '.txt' AS path, text FROM documents WHERE doc_id % 10 NOT IN (3, 7)), l AS (SELECT path, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM f)"


@query(f"WITH {_AS_FILES} SELECT * FROM l WHERE regexp_matches(line, 'raise \\w*Error')", calls_view=False)
def line_search(spark: SparkSession, sf: str) -> DataFrame:
    return files.search_lines(_as_files(spark, sf), r"raise \w*Error", most=None)


@query(f"WITH {_AS_FILES} SELECT * FROM l WHERE regexp_matches(line, '(?i)error') AND regexp_matches(path, '1[^/]*[.]txt$') ORDER BY path, n LIMIT 50", calls_view=False)
def first_lines_found(spark: SparkSession, sf: str) -> DataFrame:
    return files.search_lines(_as_files(spark, sf), "(?i)error", path_like="*1*.txt")


@query("SELECT doc_id, CAST(floor(length(text) / 3.5) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL", calls_view=False)
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", sessions.token_estimate(F.length("text")).alias("tokens"))


# Documents as messages: those of a task are its conversation, doc_id their turn; notes and runs' outputs play the roles.
_MESSAGES_SQL = "m AS (SELECT coalesce(instance_id, '') AS conv_id, doc_id AS turn, CASE doc_id % 4 WHEN 1 THEN 'assistant' WHEN 2 THEN 'user' ELSE 'tool_result' END AS role, text FROM documents)"


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    role = F.when(F.col("doc_id") % 4 == 1, "assistant").when(F.col("doc_id") % 4 == 2, "user").otherwise("tool_result")
    return table(spark, sf, "documents").select(F.coalesce("instance_id", F.lit("")).alias("conv_id"), F.col("doc_id").alias("turn"), role.alias("role"), "text")


def _over_messages(sql: str):
    return query(f"WITH {_MESSAGES_SQL} {sql}", calls_view=False)


_NOTE_SQL = "'[trimmed — ' || len(string_split(text, chr(10))) || ' lines] ' || left(string_split(text, chr(10))[1], 100)"
_OLD_SQL = "role = 'tool_result' AND text <> '' AND row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) > 5"
# Python's line ends; one at the end starts no line.
_SPLIT_SQL = r"string_split_regex({x}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def _cut_sql(x: str, most: int) -> str:
    parts = f"CASE WHEN {_SPLIT_SQL.format(x=x)}[-1] = '' THEN {_SPLIT_SQL.format(x=x)}[:-2] ELSE {_SPLIT_SQL.format(x=x)} END"
    return f"CASE WHEN {x} <> '' AND len({parts}) > {most} THEN array_to_string(({parts})[1:{most}], chr(10)) || chr(10) || '[truncated — ' || (len({parts}) - {most}) || ' more lines]' ELSE {x} END"


@_over_messages(f"SELECT conv_id, turn, role, CASE WHEN {_OLD_SQL} THEN {_NOTE_SQL} ELSE text END AS text FROM m")
def message_trim(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.trimmed_results(_messages(spark, sf))


@_over_messages(f"SELECT conv_id, turn, role, CASE WHEN role = 'tool_result' THEN {_cut_sql('text', 8)} ELSE text END AS text FROM m")
def message_cut(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.cut_results(_messages(spark, sf), 8)


# The first message and the last four stay; another is dropped if what is left without those before it is still too much.
_DROP_SQL = """f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM {of}),
    g AS (SELECT *, coalesce(sum(CASE WHEN a > 1 THEN length(text) END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM f),
    kept AS (SELECT * FROM g WHERE NOT (a > 1 AND b > 4 AND floor((total - before) / 3.5) > {limit}))"""


@_over_messages(f", {_DROP_SQL.format(of='m', limit=3000)} SELECT conv_id, turn, role FROM kept")
def message_drop_oldest(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.dropped_oldest(_messages(spark, sf), 3000).select("conv_id", "turn", "role")


_STAGES_SQL = f""", one AS (SELECT conv_id, turn, role, length(text) AS n0, CASE WHEN {_OLD_SQL} THEN {_NOTE_SQL} ELSE text END AS text FROM m),
    two AS (SELECT conv_id, turn, role, n0, text AS t1, CASE WHEN role = 'tool_result' THEN {_cut_sql('text', 10)} ELSE text END AS text FROM one),
    s AS (SELECT conv_id, coalesce(sum(n0), 0) AS a, coalesce(sum(length(t1)), 0) AS b, coalesce(sum(length(text)), 0) AS c FROM two GROUP BY 1),
    st AS (SELECT conv_id, CAST(floor(a / 3.5) AS BIGINT) AS tokens, CASE WHEN floor(a / 3.5) <= 2800 THEN 0 WHEN floor(b / 3.5) <= 2800 THEN 1 WHEN floor(c / 3.5) <= 2800 THEN 2 ELSE 5 END AS stage FROM s)"""


@_over_messages(_STAGES_SQL + " SELECT * FROM st")
def compaction_stages(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.compaction_stage(_messages(spark, sf), 4000, lines=10)


@_over_messages(
    _STAGES_SQL
    + f""", x AS (SELECT two.conv_id, two.turn, two.role, CASE st.stage WHEN 0 THEN m.text WHEN 1 THEN two.t1 ELSE two.text END AS text, st.stage FROM two JOIN st USING (conv_id) JOIN m ON m.conv_id = two.conv_id AND m.turn = two.turn),
    {_DROP_SQL.format(of='x', limit=2800)} SELECT conv_id, turn, role, text, stage FROM kept UNION ALL SELECT conv_id, turn, role, text, stage FROM x WHERE stage < 5 AND (conv_id, turn) NOT IN (SELECT conv_id, turn FROM kept)"""
)
def message_compacted(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.compacted(_messages(spark, sf), 4000, lines=10).select("conv_id", "turn", "role", "text", "stage")


@_over_messages(
    """, f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, count(*) OVER (PARTITION BY conv_id) AS n FROM m)
    SELECT conv_id, turn, CASE WHEN n > 5 AND a = 2 THEN 'user' ELSE role END AS role, CASE WHEN n > 5 AND a = 2 THEN '[full_summary] Previous conversation summary:' || chr(10) || chr(10) || n || ' messages' ELSE text END AS text FROM f WHERE n <= 5 OR a <= 2 OR b <= 4"""
)
def message_summary(spark: SparkSession, sf: str) -> DataFrame:
    m = _messages(spark, sf)
    given = m.groupBy("conv_id").agg(F.concat(F.count("*").cast("string"), F.lit(" messages")).alias("summary"))
    return sessions.summarised(m, given)


@_over_messages("SELECT conv_id, (a - 1) // 8 AS batch, count(*) AS n, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT conv_id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM m) GROUP BY ALL")
def message_batches(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _messages(spark, sf).select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    ranked = ordered_running(sizes, ["conv_id"], "turn")
    return lookups.batches(ranked, "rank", 8).groupBy("conv_id", "batch").agg(F.count("*").alias("n"), F.sum("n").cast("long").alias("chars"))


@query("SELECT count(text) AS n_samples, CAST(ceil(count(text) / 8.0) AS BIGINT) AS n_batches, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(length(text)), 6) AS avg_chars FROM documents", calls_view=False)
def training_text_stats(spark: SparkSession, sf: str) -> DataFrame:
    return export.sample_stats(table(spark, sf, "documents"), "text", 8)


_SAMPLES = """
u AS (SELECT t.record_id, coalesce(t.task, '') AS task, coalesce(t.llm_claimed_success, false) AS claimed, r.final_passed, r.tier1_pass, r.tier2_pass, r.input_tokens, r.output_tokens, coalesce(t.metadata['system_prompt'], '') AS sys FROM runs r JOIN trajectories t USING (record_id)),
z AS (SELECT record_id, string_agg('[ASSISTANT]' || chr(10) || 'Step ' || step || ', attempt ' || attempt || ': ' || goal || chr(10) || chr(10)
    || array_to_string(list_transform(tools, lambda n: '[TOOL]' || chr(10) || 'Tool ' || chr(39) || n || chr(39) || ' output is unavailable in the trajectory schema; this is a deterministic placeholder.' || chr(10) || chr(10)), '')
    || '[ASSISTANT]' || chr(10) || 'Attempt status: ' || status || '.' || CASE WHEN reason <> '' THEN ' Failure reason: ' || reason || '.' ELSE '' END || CASE WHEN len(files) > 0 THEN ' Target files: ' || array_to_string(files, ', ') || '.' ELSE '' END || chr(10) || chr(10), '' ORDER BY pos) AS body FROM att GROUP BY 1)
SELECT u.record_id, '[SYSTEM]' || chr(10) || sys || chr(10) || chr(10) || '[USER]' || chr(10) || task || chr(10) || chr(10) || coalesce(body, '') || '[ASSISTANT]' || chr(10) || 'Final summary: llm_claimed_success=' || CASE WHEN claimed THEN 'True' ELSE 'False' END
  || '; final_passed=' || CASE WHEN final_passed THEN 'True' ELSE 'False' END || '; tier1_pass=' || CASE WHEN tier1_pass THEN 'True' ELSE 'False' END || '; tier2_pass=' || CASE WHEN tier2_pass THEN 'True' ELSE 'False' END
  || '; input_tokens=' || input_tokens || '; output_tokens=' || output_tokens || '; total_tokens=' || (input_tokens + output_tokens) || '.' AS text FROM u LEFT JOIN z USING (record_id)"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """The runs' first deliveries as whole records, attempts in whatever shape they came."""
    t = spread(table(spark, sf, "trajectories").select("record_id", "trajectory_id", "task", "attempts", "llm_claimed_success", "metadata"), "record_id")
    r = runs(spark, sf).select("record_id", "instance_id", "model", "seed", F.struct("final_passed", "tier1_pass", "tier2_pass").alias("verification"), F.struct("input_tokens", "output_tokens", F.lit(0).alias("cache_read_tokens"), F.lit(0).alias("cache_create_tokens")).alias("token_usage"))
    return t.withColumn("attempts", export.parsed_attempts(F.col("attempts"))).join(r, "record_id")


@query("+ " + attempts_sql() + "," + _SAMPLES, calls_view=False, runs_view=True)
def rebuilt_texts(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf)
    return export.sample_rows(records.withColumn("trajectory_id", F.col("record_id"))).select(F.col("trajectory_id").alias("record_id"), "text")


@query()
def training_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The samples of all runs with their messages and metadata; rebuilt_texts is their text, which SQL can say."""
    return export.sample_rows(_records(spark, sf))


@query(
    "+ x AS (SELECT model, count(*) AS n_answers, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM runs GROUP BY 1) SELECT CAST(sum(n_answers) AS BIGINT) AS n_answers, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, 0 AS cache_read_tokens, 0 AS cache_create_tokens, round(sum(input_tokens) / 1e6 * 3 + sum(output_tokens) / 1e6 * 15, 6) AS cost FROM x",
    calls_view=False,
    runs_view=True,
)
def token_totals(spark: SparkSession, sf: str) -> DataFrame:
    """An event log of one answer a run, and others that don't count."""
    usage = F.struct(F.struct("input_tokens", "output_tokens").alias("usage"))
    r = runs(spark, sf)
    log = r.select(F.lit("llm_response").alias("type"), F.to_json(usage).alias("data")).unionByName(r.select(F.lit("tool_call").alias("type"), F.to_json(usage).alias("data")))
    return live.token_totals(log, 3.0, 15.0).withColumn("cost", F.round("cost", 6))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    tokens = (F.col("input_tokens") + F.col("output_tokens")).alias("tokens")
    return lookups.pool_items(labels_of(spark, sf).select(F.col("run").alias("trajectory_id"), lookups.pool_label(F.col("outcome")).alias("label"), tokens), "trajectory_id")


_POOL_SQL = "CASE outcome WHEN 'verified_one_shot' THEN 'one_shot_success' WHEN 'verified_with_recovery' THEN 'failure_recovery' ELSE outcome END"


@query(ALL_LABELS + f" SELECT {_POOL_SQL} AS label, count(*) AS n, CAST(sum(greatest(input_tokens + output_tokens, 1)) AS BIGINT) AS tokens FROM lab GROUP BY 1", runs_view=True)
def pool_capacity(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query(ALL_LABELS + f" SELECT run || '#' || (row_number() OVER (ORDER BY run) - 1) AS key, run AS trajectory_id, {_POOL_SQL} AS label, greatest(input_tokens + output_tokens, 1) AS tokens FROM lab", runs_view=True)
def pool_items(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf)


def _groups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    items = checkpointed(_items(spark, sf))
    target = (items.where(F.col("label") == lookups.CLEAN).agg(F.sum("tokens")).first()[0] or 0) // 2
    if not target or not items.where(F.col("label") == lookups.RECOVERY).limit(1).count():  # no groups can be made of these runs
        return items, items.limit(0).select(F.lit("").alias("group_name"), "key", "trajectory_id", "label", "tokens"), target
    return items, lookups.budget_groups(items, target=target), target


@query()
def budget_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _groups(spark, sf)[1]


_SHARE = "(SELECT count(*) FILTER (outcome = 'verified_with_recovery') / count(*) FROM lab WHERE outcome IN ('verified_one_shot', 'verified_with_recovery'))"


@query(ALL_LABELS + f" SELECT g AS group_name, true AS within_tolerance, true AS keys_are_unique, 0 AS n_strange, g = 'recovery_enriched' AND {_SHARE} > 0 AS is_enriched FROM (SELECT unnest(['clean_only', 'mixed', 'recovery_enriched', 'unfiltered']) AS g) WHERE {_SHARE} BETWEEN 1e-9 AND 1 - 1e-9", runs_view=True)
def budget_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What holds of any right choice of the groups: their tokens, no run twice but drawn copies, no run of another pool, and twice the natural share of recoveries in the enriched one."""
    items, groups, target = _groups(spark, sf)
    groups = checkpointed(groups)
    n = {lookups.CLEAN: 0, lookups.RECOVERY: 0} | {r["label"]: r["n"] for r in items.groupBy("label").agg(F.count("*").alias("n")).collect()}
    twice = min(1.0, 2.0 * n[lookups.RECOVERY] / max(1, n[lookups.RECOVERY] + n[lookups.CLEAN]))
    both = F.col("label").isin(lookups.CLEAN, lookups.RECOVERY)
    belongs = F.when(F.col("group_name") == "clean_only", F.col("label") == lookups.CLEAN).when(F.col("group_name") == "unfiltered", F.col("label") != lookups.TOXIC).otherwise(both)
    known = groups.join(items.select(F.col("trajectory_id").alias("t"), F.col("label").alias("l"), F.col("tokens").alias("k")), (F.col("trajectory_id") == F.col("t")) & (F.col("label") == F.col("l")) & (F.col("tokens") == F.col("k")), "left")
    checks = known.groupBy("group_name").agg((F.count("*") == F.count_distinct("key")).alias("keys_are_unique"), F.count_if(~belongs | F.col("t").isNull()).alias("n_strange"), F.avg((F.col("label") == lookups.RECOVERY).cast("double")).alias("share"))
    report = lookups.group_report(groups, target).select("group_name", "within_tolerance")
    return checks.join(report, "group_name").select("group_name", "within_tolerance", "keys_are_unique", "n_strange", ((F.col("group_name") == "recovery_enriched") & (F.col("share") >= twice)).alias("is_enriched"))


@query()
def exact_sample(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.exact_sample(table(spark, sf, "tasks").select("instance_id", "repo"), 20, "instance_id", seed=7)


@query()
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.seeded_sample(table(spark, sf, "tasks").select("instance_id", "repo"), 20, "instance_id", seed=7)


# Params are objects of plain values, so their canonical text is that of the sorted members; what isn't valid JSON has no hash.
@query(
    """SELECT trajectory_id, pos, CASE WHEN json_valid(params) THEN left(sha256(CASE WHEN json_type(params) = 'OBJECT' THEN '{' || array_to_string(list_transform(list_sort(json_keys(params)), lambda k: to_json(k) || ': ' || json_extract(params, '$."' || k || '"')), ', ') || '}' ELSE params END), 16) END AS told FROM calls"""
)
def params_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark, sf).select("trajectory_id", "pos", python_udfs.params_hash("params").alias("told"))


@query(
    r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(text, 'File\s+"([^"\n]+\.py)"', 1), regexp_extract_all(text, '(?:^|[\s(])([A-Za-z0-9_./\\-]+\.py):\d+', 1), regexp_extract_all(text, '\bin\s+([A-Za-z0-9_./\\-]+\.py)\b', 1)), lambda p: replace(p, '\', '/')))), ' ') AS refs
    FROM documents WHERE text IS NOT NULL""",
    calls_view=False,
)
def text_references(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.array_join(F.array_sort(diffs.file_refs(F.col("text"))), " ").alias("refs"))


# Beside the paths that calls name, some of all kinds.
_PATHS = ["", "./a//b/../c.py", "../x", "a/../..", "a\\b\\.\\c", "/x/./y/", "it's here.py", "a b", "~/x", "x/../../y", "a/b/../../c"]
_PATHS_SQL = "p AS (SELECT DISTINCT target_file FROM calls UNION SELECT unnest([" + ", ".join("'" + x.replace("'", "''") + "'" for x in _PATHS) + "]))"


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    more = spark.createDataFrame([(x,) for x in _PATHS], "target_file string")
    return calls(spark, sf).select("target_file").unionByName(more).distinct()


@query("+ " + _PATHS_SQL + " SELECT target_file, " + SAFE.format(x="target_file") + " AS word FROM p")
def shell_words(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("target_file", text.shell_quoted(F.col("target_file")).alias("word"))


@query(
    "+ " + _PATHS_SQL + r""", r AS (SELECT target_file, list_reduce(list_concat([''], string_split(replace(target_file, '\', '/'), '/')), lambda acc, x: CASE WHEN acc = '!' OR x IN ('', '.') THEN acc WHEN x = '..' THEN CASE WHEN acc = '' THEN '!' ELSE regexp_replace(acc, '/?[^/]*$', '') END WHEN acc = '' THEN x ELSE acc || '/' || x END) AS path FROM p)
    SELECT target_file, nullif(path, '!') AS path FROM r"""
)
def normal_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("target_file", text.normal_path(F.col("target_file")).alias("path"))


@query(
    "+ " + _PATHS_SQL + r""", q AS (SELECT target_file, lower(regexp_replace(replace(target_file, '\', '/'), '^(\./)+', '')) AS n FROM (SELECT target_file FROM p UNION SELECT replace(target_file, '.py', '.pyc') FROM p UNION SELECT '.Git/' || target_file FROM p))
    SELECT target_file, NOT (n LIKE '.git/%' OR n LIKE '~_~_pycache~_~_/%' ESCAPE '~' OR n LIKE '%/.git/%' OR n LIKE '%/~_~_pycache~_~_/%' ESCAPE '~' OR n LIKE '%.pyc' OR n LIKE '%.pyo' OR n LIKE '%.pyd') AS may FROM q"""
)
def workspace_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = _paths(spark, sf)
    p = p.union(p.select(F.replace("target_file", F.lit(".py"), F.lit(".pyc")))).union(p.select(F.concat(F.lit(".Git/"), "target_file"))).distinct()
    return p.select("target_file", text.workspace_path(F.col("target_file")).alias("may"))


_WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '[{_WHITE}]+', ' ', 'g'), '^ | $', '', 'g') AS text FROM documents WHERE text IS NOT NULL", calls_view=False)
def squeezed_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", text.squeezed(F.col("text")).alias("text"))


@query(
    f"""WITH l AS (SELECT doc_id, generate_subscripts({_SPLIT_SQL.format(x='text')}, 1) AS i, unnest({_SPLIT_SQL.format(x='text')}) AS line FROM documents WHERE text IS NOT NULL),
    g AS (SELECT *, count(*) FILTER (line LIKE '## %') OVER (PARTITION BY doc_id ORDER BY i) AS part FROM l),
    s AS (SELECT doc_id, part, regexp_replace(substr(min_by(line, i), 4), '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g') AS title, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (line NOT LIKE '## %'), ''), '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g') AS body FROM g WHERE part > 0 GROUP BY doc_id, part)
    SELECT doc_id, title, body FROM s WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, title ORDER BY part DESC) = 1
    UNION ALL SELECT doc_id, '__title__', regexp_replace(max_by(line, i), '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g') FROM g WHERE part = 0 AND line LIKE '# %' GROUP BY 1""",
    calls_view=False,
)
def document_sections(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.explode(text.sections(F.col("text"))).alias("title", "body"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents WHERE text IS NOT NULL", calls_view=False)
def piece_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", text.occurrences(F.col("text"), F.lit("the")).alias("n"))


@query("SELECT regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g') AS source, count(*) AS n, count(DISTINCT text) AS n_texts, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1", calls_view=False)
def sources_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(snake("source").alias("source")).agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts"), F.sum("n_chars").alias("chars"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL", calls_view=False)
def events_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    return live.windowed_counts(table(spark, sf, "events"), "ts", "event_type")


# A fold over each run's calls that keeps what a guard keeps; counts of actions are those in the list of the step's.
@query(
    """+
k AS (SELECT trajectory_id, pos, turn_id AS step, tool, tool || ':' || coalesce(nullif(params_hash, ''), md5(params)) AS action, target_file AS file, ok, tool IN ('file_edit', 'file_create') AND target_file <> '' AS edits FROM calls),
g AS (
  SELECT trajectory_id, -1 AS pos, '' AS verdict, 0 AS made, 0 AS fails, CAST(NULL AS BIGINT) AS step, CAST([] AS VARCHAR[]) AS acts, CAST([] AS VARCHAR[]) AS rd, CAST([] AS VARCHAR[]) AS ch FROM k GROUP BY 1
  UNION ALL
  SELECT trajectory_id, pos, verdict, made + CAST(verdict = 'ok' AS INT), CASE verdict WHEN 'ok' THEN CASE WHEN ok THEN 0 ELSE fails + 1 END WHEN 'too_many_errors' THEN 0 ELSE fails END, step,
    CASE WHEN verdict = 'ok' THEN list_append(acts, action) ELSE acts END, CASE WHEN verdict = 'ok' AND ok AND tool = 'file_read' AND file <> '' THEN list_append(rd, file) ELSE rd END, CASE WHEN verdict = 'ok' AND ok AND edits THEN list_distinct(list_append(ch, file)) ELSE ch END
  FROM (SELECT *, CASE WHEN made >= 100 THEN 'over_total' WHEN len(acts) >= 15 THEN 'over_step' WHEN fails >= 3 THEN 'too_many_errors' WHEN len(list_filter(acts, lambda x: x = action)) >= 2 THEN 'repeated' WHEN tool = 'file_edit' AND file <> '' AND NOT list_contains(rd, file) THEN 'unread'
        WHEN edits AND NOT list_contains(ch, file) AND len(ch) >= 10 THEN 'too_many_files' ELSE 'ok' END AS verdict
    FROM (SELECT k.*, g.made, g.fails, g.rd, CASE WHEN g.step IS DISTINCT FROM k.step THEN [] ELSE g.acts END AS acts, CASE WHEN g.step IS DISTINCT FROM k.step THEN [] ELSE g.ch END AS ch FROM g JOIN k ON k.trajectory_id = g.trajectory_id AND k.pos = g.pos + 1)))
SELECT trajectory_id, pos, verdict FROM g WHERE pos >= 0"""
)
def guard_replay(spark: SparkSession, sf: str) -> DataFrame:
    return live.guarded(calls(spark, sf))


@query("SELECT trajectory_id AS response_id, pos AS idx, 'c' || pos AS call_id, tool AS name, CASE WHEN json_valid(params) AND json_type(params) = 'OBJECT' THEN params ELSE '{}' END AS arguments FROM calls")
def assembled_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Each call's params in three pieces, of which only the first tells its id and name."""
    n = F.floor(F.length("params") / 3).cast("int")
    pieces = F.array(F.struct(F.concat(F.lit("c"), "pos").alias("call_id"), F.col("tool").alias("name"), F.left("params", n).alias("part")), *[F.struct(F.lit(None).cast("string").alias("call_id"), F.lit("").alias("name"), p.alias("part")) for p in (F.substring("params", n + 1, n), F.substring("params", 2 * n + 1, F.length("params")))])
    c = calls(spark, sf).select(F.col("trajectory_id").alias("response_id"), F.col("pos").alias("idx"), F.posexplode(pieces).alias("seq", "p")).select("response_id", "idx", "seq", "p.*")
    return live.assembled_calls(c)


@query("SELECT trajectory_id, coalesce(t.outcome, 'unknown') AS outcome, CAST(count(*) AS BIGINT) AS n FROM (SELECT trajectory_id FROM tool_call_events WHERE trajectory_id IS NOT NULL) LEFT JOIN (SELECT trajectory_id, arg_max(outcome, struct_pack(a := labelled_at, o := outcome)) AS outcome FROM labels WHERE trajectory_id IS NOT NULL GROUP BY 1) t USING (trajectory_id) GROUP BY ALL", calls_view=False)
def calls_with_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The calls of each run with the outcome it is labelled with."""
    per_run = table(spark, sf, "tool_call_events").where("trajectory_id IS NOT NULL").groupBy("trajectory_id").agg(F.count("*").alias("n"))
    d = detectors.with_labels(per_run, table(spark, sf, "labels").withColumn("at", F.struct("labelled_at", "outcome")), "at")
    return d.select("trajectory_id", F.col("outcome"), "n")


@query()
def json_objects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", python_udfs.json_object_in(F.col("text")).alias("object")).where("object IS NOT NULL")


# The star tables: what Catalyst gives over them, as a check of sums, joins and ranks at their size.
@query(
    "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL",
    calls_view=False,
)
def lineitem_totals(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double"), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS n_orders, count(DISTINCT c_custkey) AS n_customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", calls_view=False)
def orders_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations
    return j.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.count_distinct("c_custkey").alias("n_customers"))
