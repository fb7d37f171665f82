"""Calls of runs in order: first deliveries, step names and request keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.steps import SIGNALS, TOOLS, plain_signal, plain_tool  # noqa: F401
from tracefold.session import spread

#: Positions of a run are cut into chunks of so many indices, so that no run lands in one task whole.
CHUNK = 512

# Parts of a command that name something thrown away afterwards.
_THROWN = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    (r"(/(?:private/)?(?:var/)?tmp/)(?:[^/\s'\"=;|&<>]+(?=/)|[^/\s'\"=;|&<>.]+(?:\.[^/\s'\"=;|&<>.a-z]+)?(?![^\s'\"=;|&<>]))", "$1<tmp>"),
    (r"((?:^|\s|-)(?:run|job|session|trace|request|build|exec|worker)[-_]?(?:id|uuid)[= ])[^\s'\"]+", "$1<id>"),
    (r"(\bpids?[-_=: ]|\bkill (?:-\w+ )?)\d+", "$1<pid>"),
    (r"\d{4}-?\d{2}-?\d{2}[T _-]\d{2}[:-]?\d{2}(?:[:-]?\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?", "<time>"),
    (r"(?<![\w.])\d{2}:\d{2}:\d{2}(?:[.,]\d+)?", "<time>"),
    (r"(?<![\w.])1[4-9]\d{8}(?:\.\d+|\d{3}|\d{6})?(?![\w.])", "<time>"),
)


def _path(c: Column) -> Column:
    c = F.regexp_replace(F.trim(c), r"\\", "/")
    c = F.regexp_replace(c, r"/{2,}", "/")
    c = F.regexp_replace(c, r"(?<![^/])(?:\./)+", "")
    for _ in range(3):
        c = F.regexp_replace(c, r"(?<![^/])(?!\.\./)[^/]+/\.\./", "")
    c = F.regexp_replace(c, r"(?<=.)/\.?$", "")
    for p, r in _THROWN[:2]:
        c = F.regexp_replace(c, p, r)
    return c


def _command(c: Column) -> Column:
    # White space counts inside quotes only: each quoted part and each other space gets a mark, a space after a quoted part so has two.
    c = F.regexp_replace(c, r"(\"(?:[^\"\\]|\\.)*+\"|'[^']*+')|\s+", "$1\u0004")
    c = F.regexp_replace(c, "([\"'])\u0004{2,}", "$1 ")
    c = F.regexp_replace(F.regexp_replace(c, "([\"'])\u0004", "$1"), "\u0004+", " ")
    # the spelling of paths, outside of quotes' inner words and addresses
    c = F.regexp_replace(c, r"(?<![\w.:/'\"])(?:\./)+(?=[\w.])", "")
    c = F.regexp_replace(c, r"(?<=[\w.\-])/(?:\.?/)+(?=[\w.])", "/")
    c = F.regexp_replace(c, r"(?<=[\w])/(?=\s|$)", "")
    for p, r in _THROWN:
        c = F.regexp_replace(c, p, r)
    return F.trim(c)


def request_key(tool: Column, params: Column) -> Column:
    """A hash that is equal for equal requests; null where params are null.

    Objects are read as maps, so order and spacing of members don't count. Commands lose their
    spacing and throw-away values, paths their spelling. Everything else counts as written. Params
    that are no JSON object are compared as text.
    """
    m = F.from_json(params, "map<string,string>")
    paths = ("file_path", "path", "cwd", "target_file", "dir", "directory", "file")
    member = lambda e: F.concat(
        e["key"],
        F.lit("\u0001"),
        F.when(e["value"].isNull(), F.lit("null"))
        .when(e["key"].isin(*paths), _path(e["value"]))
        .when(e["value"].rlike(r"^\s*[{\[]"), F.coalesce(F.to_json(F.try_parse_json(e["value"])), e["value"]))
        .otherwise(e["value"]),
    )
    rest = F.array_sort(F.transform(F.map_entries(F.map_filter(m, lambda k, v: k != "command")), member))
    body = F.when(m.isNotNull(), F.concat(F.coalesce(_command(m["command"]), F.lit("")), F.lit("\u0002"), F.array_join(rest, "\u0002"))).otherwise(F.trim(params))
    return F.when(params.isNotNull() & (F.trim(params) != ""), F.xxhash64(tool, body))


def first_delivered(calls: DataFrame, **columns: Column) -> DataFrame:
    """One row per (trajectory_id, global_index): the first delivered; ties go to the smaller call_id.

    Gives tid, c (the chunk), g (the index) and the named columns. Rows without trajectory_id or
    global_index can't be placed and are left out; an unknown time of delivery counts as latest.
    One shuffle by (tid, c), which later windows over the same keys reuse; inputs that are spread are spread by these.
    """
    placed = calls.where("trajectory_id IS NOT NULL AND global_index IS NOT NULL").withColumn("_at_run", F.col("trajectory_id")).withColumn("_at_chunk", F.floor(F.col("global_index") / CHUNK))
    rows = spread(placed, "_at_run", "_at_chunk").select(
        F.col("_at_run").alias("tid"),
        F.col("_at_chunk").alias("c"),
        F.col("global_index").alias("g"),
        F.col("ingested_at").alias("_at"),
        F.col("call_id").alias("_id"),
        *[v.alias(k) for k, v in columns.items()],
    )
    rows = rows.withColumn("_pg", F.expr("lag(g) OVER (PARTITION BY tid, c ORDER BY g, _at NULLS LAST, _id NULLS LAST)"))
    return rows.where("_pg IS NULL OR _pg <> g").drop("_pg", "_at", "_id")
