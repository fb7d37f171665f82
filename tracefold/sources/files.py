"""Scans of run files and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tracefold.functions import steps

RECORD_DDL = (
    "trajectory_id STRING, schema_version STRING, instance_id STRING, task STRING, model STRING, seed BIGINT, created_at DOUBLE, llm_claimed_success BOOLEAN, "
    "verification STRUCT<final_passed:BOOLEAN,tier1_pass:BOOLEAN,tier2_pass:BOOLEAN,tier2_command:STRING>, "
    "attempts ARRAY<STRUCT<step_number:BIGINT,attempt_number:BIGINT,goal:STRING,status:STRING,target_files:ARRAY<STRING>,tool_names:ARRAY<STRING>,failure_reason:STRING>>, "
    "tool_call_events ARRAY<STRUCT<turn_id:BIGINT,call_index_in_turn:BIGINT,global_index:BIGINT,tool_name:STRING,params:STRING,params_hash:STRING,target_file:STRING,result_success:BOOLEAN,"
    "result_content:STRING,error_signal:STRING,timestamp:DOUBLE>>, "
    "token_usage STRUCT<input_tokens:BIGINT,output_tokens:BIGINT,cache_read_tokens:BIGINT,cache_create_tokens:BIGINT>, metadata MAP<STRING,STRING>"
)
STATUSES = ("success", "failed", "budget_exhausted", "error")

# The members of a record and of what lies in it, with their types; those with a ? may be absent.
SHAPES = {
    "record": "schema_version any, trajectory_id text, instance_id text, task text, model text, seed int, created_at number, llm_claimed_success boolean, verification object, attempts? list, tool_call_events? list, token_usage? any, metadata? object",
    "verification": "final_passed boolean, tier1_pass boolean, tier2_pass boolean, tier2_command? string",
    "attempt": "step_number int, attempt_number int, goal string, status string, rolled_back? any, target_files? strings, tool_names? strings, failure_reason? string",
    "call": "turn_id int, call_index_in_turn int, global_index int, tool_name string, params? object, params_hash? any, target_file? any, result_success boolean, result_content? any, error_signal? string, timestamp number",
    "token_usage": "input_tokens int, output_tokens int, cache_read_tokens? int, cache_create_tokens? int, total_tokens? int",
}


def _fits(kind: str, v: Column) -> Column:
    """Whether a variant has a kind; null where it is absent."""
    t = F.schema_of_variant(v)
    if kind == "strings":
        return t.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array().cast("array<string>")), lambda x: x.isNull())
    if kind == "text":
        return (t == "STRING") & F.try_variant_get(v, "$", "string").rlike(r"(?U)\S")
    starts = {"int": "BIGINT", "string": "STRING", "boolean": "BOOLEAN", "object": "OBJECT", "list": "ARRAY", "number": "(BIGINT|DECIMAL|DOUBLE)", "any": ""}[kind]
    return t.rlike(f"^{starts}")


def shape_fault(v: Column, shape: str) -> Column:
    """Why a variant isn't of a shape: no object, unknown or missing members, or one of another type; null if it is."""
    members = {m.split()[0].rstrip("?"): (m.split()[1], "?" in m) for m in SHAPES[shape].split(", ")}
    keys = F.json_object_keys(F.to_json(v))
    unknown = F.array_except(keys, F.lit(list(members)))
    missing = F.array_except(F.lit([m for m, (_, may) in members.items() if not may]), keys)
    fault = F.when(keys.isNull(), f"{shape}: no object").when(F.size(unknown) > 0, F.concat(F.lit(f"{shape}: unknown "), F.array_join(unknown, ","))).when(F.size(missing) > 0, F.concat(F.lit(f"{shape}: missing "), F.array_join(missing, ",")))
    for m, (kind, _) in members.items():
        if kind != "any":
            fault = fault.when(~_fits(kind, F.try_variant_get(v, f"$.{m}", "variant")), f"{shape}.{m}: no {kind}")
    return fault


def record_fault(value: Column, r: Column) -> Column:
    """Why a line is no record: bad JSON, unknown, missing or mistyped members of it or of what lies in it, an unknown version, status or signal, a wrong total; null if it is one.

    r is the line read by RECORD_DDL; the rest is told from the line itself, as reading would make texts of numbers.
    """
    v = F.try_parse_json(value)
    part = lambda n: F.try_variant_get(v, f"$.{n}", "variant")
    first = lambda n, f: F.get(F.array_compact(F.transform(F.try_variant_get(v, f"$.{n}", "array<variant>"), f)), F.lit(0))
    text = lambda x, n: F.coalesce(F.try_variant_get(x, f"$.{n}", "string"), F.lit(""))
    attempt = lambda x: F.coalesce(shape_fault(x, "attempt"), F.when(~text(x, "status").isin(*STATUSES), F.concat(F.lit("attempt.status: unknown "), text(x, "status"))))
    call = lambda x: F.coalesce(shape_fault(x, "call"), F.when(~F.coalesce(F.try_variant_get(x, "$.error_signal", "string"), F.lit("NONE")).isin(*steps.SIGNALS), F.concat(F.lit("call.error_signal: unknown "), text(x, "error_signal"))))
    usage = F.when(F.schema_of_variant(part("token_usage")) != "VOID", shape_fault(part("token_usage"), "token_usage"))
    count = lambda n: F.try_variant_get(v, f"$.token_usage.{n}", "bigint")
    plain = F.exists(F.map_values(F.from_json(F.to_json(part("metadata")), "map<string,variant>")), lambda x: F.schema_of_variant(x) != "STRING")
    return F.coalesce(
        F.when(v.isNull() | F.json_object_keys(value).isNull(), "no JSON object"),
        shape_fault(v, "record"),
        F.when(~F.coalesce(r["schema_version"], F.lit("")).isin("1.0", "2.0"), "record.schema_version: unknown"),
        shape_fault(part("verification"), "verification"),
        first("attempts", attempt),
        first("tool_call_events", call),
        usage,
        F.when(count("total_tokens") != count("input_tokens") + count("output_tokens"), "token_usage.total_tokens: not the sum"),
        F.when(plain, "record.metadata: no texts"),
    )


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, place) of a text's lines that aren't blank, place being file:line.

    Lines are counted by the pieces that files are read in, whose starts (a row a piece) are broadcast; nothing is shuffled but the counts.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    pieces = lines.groupBy("_f", "_b").agg(F.min("_i").alias("_i0"), F.count("*").alias("_n"))
    earlier = W.partitionBy("_f").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = pieces.select(F.col("_f").alias("_g"), F.col("_b").alias("_c"), "_i0", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
    d = lines.join(F.broadcast(starts), (F.col("_f") == F.col("_g")) & (F.col("_b") == F.col("_c")))
    file = F.regexp_replace("_f", "^file:/*", "/")
    return d.select("value", F.concat(file, F.lit(":"), (F.col("_n0") + F.col("_i") - F.col("_i0") + 1).cast("string")).alias("place")).where(F.col("value").rlike(r"(?U)\S"))


def read_records(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, faults) of a run file, one JSON object a line, blank lines skipped.

    strict: reading a faulty line is an error that shows its place and the fault. Otherwise faulty lines are in faults (place, value, fault) only.
    Absent attempts and calls (of version 1.0) are empty lists, absent token counts 0, absent metadata an empty map, absent commands and reasons ''.
    """
    lines = placed_lines(spark, path).withColumn("r", F.from_json("value", RECORD_DDL))
    # Catalyst may move a filter below the one for blank lines, so a blank line's fault is null as well.
    lines = lines.withColumn("fault", F.when(F.col("value").rlike(r"(?U)\S"), record_fault(F.col("value"), F.col("r"))))
    if strict:
        good = lines.withColumn("r", F.when(F.col("fault").isNull(), F.col("r")).otherwise(F.raise_error(F.concat("place", F.lit(": "), "fault"))))
    else:
        good = lines.where("fault IS NULL")
    types = T.StructType.fromDDL(RECORD_DDL)
    empty = lambda c: F.from_json(F.lit("[]"), types[c].dataType)
    none = lambda c: F.coalesce(c, F.lit(""))
    records = good.select("r.*").withColumn("tool_call_events", F.coalesce("tool_call_events", empty("tool_call_events"))).withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    texts = F.array().cast("array<string>")
    records = records.withColumn("attempts", F.transform(F.coalesce("attempts", empty("attempts")), lambda a: a.withField("target_files", F.coalesce(a["target_files"], texts)).withField("tool_names", F.coalesce(a["tool_names"], texts)).withField("failure_reason", none(a["failure_reason"]))))
    records = records.withColumn("verification", F.col("verification").withField("tier2_command", none(F.col("verification.tier2_command"))))
    counts = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens")
    records = records.withColumn("token_usage", F.struct(*[F.coalesce(F.col(f"token_usage.{c}"), F.lit(0)).cast("long").alias(c) for c in counts]))
    return records, lines.where("fault IS NOT NULL").select("place", "value", "fault")


def _as_lines(records: DataFrame) -> DataFrame:
    """Records as JSON lines: params as the objects they are, the total of tokens beside its parts."""
    d = records
    if "tool_call_events" in d.columns:
        d = d.withColumn("tool_call_events", F.transform("tool_call_events", lambda e: e.withField("params", F.coalesce(F.try_parse_json(e["params"]), F.parse_json(F.lit("{}"))))))
    if "token_usage" in d.columns:
        d = d.withColumn("token_usage", F.col("token_usage").withField("total_tokens", F.col("token_usage.input_tokens") + F.col("token_usage.output_tokens")))
    return d.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line with all fields, nulls too; params are written as the JSON objects they are, absent ones as {}."""
    _as_lines(records).write.mode(mode).text(path)


def append_record_stream(records: DataFrame, path: str, checkpoint: str):
    """Writes a stream of records to a run file, exactly once."""
    return _as_lines(records).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def append_event_stream(events: DataFrame, path: str, checkpoint: str):
    """Appends a stream of events (type, data as JSON text, timestamp) to an event log, exactly once."""
    line = F.to_json(F.struct("type", F.coalesce(F.try_parse_json("data"), F.parse_json(F.lit("{}"))).alias("data"), "timestamp"))
    return events.select(line.alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, gold_patch) of a task file, leniently: lines that don't parse or lack one of both are left out, the last of an id in file order counts."""
    lines = spark.read.text(path).withColumn("at", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")))
    d = lines.where(F.array_contains(F.json_object_keys("value"), "gold_patch")).select("at", F.get_json_object("value", "$.instance_id").alias("instance_id"), F.get_json_object("value", "$.gold_patch").alias("gold_patch")).where("instance_id IS NOT NULL")
    return d.groupBy("instance_id").agg(F.max_by("gold_patch", "at").alias("gold_patch"))


def read_task_rows(spark: SparkSession, path: str, needed: tuple[str, ...] = ("instance_id", "task"), optional: tuple[str, ...] = ("cwd", "tier2_command")) -> DataFrame:
    """(*needed, *optional) of a task file, strictly: each line must be an object whose needed members are texts that aren't blank, and whose optional ones are such texts, null or absent.

    Reading another line is an error that shows its place; a file without tasks is an error at once.
    """
    lines = placed_lines(spark, path)
    if not lines.limit(1).count():
        raise ValueError(f"no tasks in {path}")
    v = F.try_parse_json("value")
    fault = F.when(v.isNull() | F.json_object_keys("value").isNull(), "no JSON object")
    for m in (*needed, *optional):
        one = F.try_variant_get(v, f"$.{m}", "variant")
        good = F.coalesce(_fits("text", one), F.lit(False))
        fault = fault.when(~(good if m in needed else good | one.isNull() | F.coalesce(F.schema_of_variant(one) == "VOID", F.lit(True))), f"{m} must be a text that isn't blank")
    text = lambda m: F.try_variant_get(v, f"$.{m}", "string")
    bad = F.raise_error(F.concat("place", F.lit(": "), fault)).cast("string")
    return lines.select(F.when(fault.isNull(), text(needed[0])).otherwise(bad).alias(needed[0]), *[text(m).alias(m) for m in (*needed[1:], *optional)])


def read_any_tasks(spark: SparkSession, path: str, needed: tuple[str, ...] = ("instance_id", "repo", "base_commit", "task")) -> DataFrame:
    """The tasks of a file with all their members, whichever they are: columns are those that the lines have. Lacking a needed one, or a blank one, is an error; so is a file without tasks."""
    d = spark.read.option("mode", "FAILFAST").json(path)
    lacking = [m for m in needed if m not in d.columns]
    if lacking or not d.limit(1).count():
        raise ValueError(f"tasks lack {', '.join(lacking)}" if lacking and d.columns else f"no tasks in {path}")
    for m in needed:
        d = d.withColumn(m, F.when(F.col(m).cast("string").rlike(r"(?U)\S"), F.col(m)).otherwise(F.raise_error(F.lit(f"a task lacks {m}")).cast(d.schema[m].dataType)))
    return d


def read_events(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(type, data, timestamp) of an event log; with `kind` only those of it. A log that isn't there has no events."""
    fields = "type STRING, data STRING, timestamp DOUBLE"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there):
        return spark.createDataFrame([], fields)
    e = spark.read.schema(fields).json(path)
    return e if kind is None else e.where(F.col("type") == kind)


def read_benchmark(spark: SparkSession, folder: str, split: str = "test") -> DataFrame:
    """The records of a benchmark's split, of an offline copy <folder>/<split>.parquet, .jsonl or .json; the needed members are checked when tasks are made of them."""
    for end, form in ((".parquet", "parquet"), (".jsonl", "json"), (".json", "json")):
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{split}{end}")
        if there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there):
            return spark.read.format(form).load(f"{folder}/{split}{end}")
    raise FileNotFoundError(f"no split {split} in {folder}")


def read_arm(spark: SparkSession, name: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, labels) of an arm: a run file and the label file beside it, which must be there."""
    labels = spark.read.json(path.removesuffix(".jsonl") + ".labels.jsonl")
    return read_records(spark, path)[0].withColumn("arm", F.lit(name)), labels.withColumn("arm", F.lit(name))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a file that holds one JSON object of texts."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return m.select(F.explode(F.coalesce("m", F.raise_error(F.lit("no JSON object")).cast("map<string,string>"))).alias("key", "value"))


def harness_result(report: Column, instance_id: Column, most: int = 4000) -> Column:
    """(resolved, output) of a report, wrapped in its instance id or not; the output is cut."""
    wrapped = F.from_json(report, "map<string,string>")[instance_id]
    return F.struct((F.coalesce(F.get_json_object(wrapped, "$.resolved"), F.get_json_object(report, "$.resolved")) == "true").alias("resolved"), F.left(report, F.lit(most)).alias("output"))


def source_files(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """(path, n_lines, text) of the files under root whose name fits."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    path = F.regexp_replace(F.regexp_replace("_metadata.file_path", "^file:/*", "/"), "^" + root.rstrip("/") + "/", "")
    return t.select(path.alias("path"), F.regexp_count("value", F.lit("\n")).alias("n_lines"), F.col("value").alias("text"))


def numbered_lines(c: Column, first: int | None = None, last: int | None = None, long_chars: int = 100_000, head: int = 50, tail: int = 20) -> Column:
    """A text's lines as (n, line) from first to last; without a range a long text gives its head and tail only."""
    all_lines = F.transform(F.split(c, "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    if first is not None or last is not None:
        return F.filter(all_lines, lambda x: (x["n"] >= (first or 1)) & (x["n"] <= (last if last is not None else 2**31 - 1)))
    n = F.size(all_lines)
    return F.when((F.length(c) > long_chars) & (n > head + tail), F.concat(F.slice(all_lines, 1, head), F.slice(all_lines, n - tail + 1, tail))).otherwise(all_lines)


# Folders that a search leaves out, beside hidden ones.
SKIPPED = ("__pycache__", "node_modules", "venv")


def search_lines(files: DataFrame, pattern: str, most: int | None = 50, path_like: str | None = None) -> DataFrame:
    """(path, n, line) of the lines of (path, text) that match, in order of path and line, the first `most` of all where it is given. Hidden, cache and dependency folders are skipped."""
    f = files.where(~F.col("path").rlike(rf"(^|/)(\.[^/]+|{'|'.join(SKIPPED)})(/|$)"))
    if path_like is not None:
        f = f.where(F.col("path").rlike("(^|/)" + path_like.replace(".", r"\.").replace("*", "[^/]*").replace("?", "[^/]") + "$"))
    rows = f.select("path", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.col("line").rlike(pattern))
    found = rows.select("path", (F.col("i") + 1).cast("long").alias("n"), "line")
    return found if most is None else found.orderBy("path", "n").limit(most)
