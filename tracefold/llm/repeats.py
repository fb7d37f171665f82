"""Runs of repeated calls, collapsed by boundary interval lookup (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.calls import first_delivered, plain_tool, request_key

_NEXT = "PARTITION BY tid, c ORDER BY g"
# Bisection over the sorted start positions of a chunk: the last start that is not after rn.
_BISECT = """aggregate(sequence(1, cast(ceil(log2(size(starts) + 1)) AS int)), named_struct('lo', 1, 'hi', size(starts)),
    (s, i) -> named_struct(
        'lo', if(s.lo < s.hi AND starts[(s.lo + s.hi + 1) div 2 - 1] <= rn, cast((s.lo + s.hi + 1) div 2 AS int), s.lo),
        'hi', if(s.lo < s.hi AND starts[(s.lo + s.hi + 1) div 2 - 1] > rn, cast((s.lo + s.hi + 1) div 2 - 1 AS int), s.hi)),
    s -> starts[s.lo - 1])"""


def collapse_repeats(calls: DataFrame, least: int = 2) -> DataFrame:
    """One row per maximal stretch of at least `least` calls with the same tool and request.

    Columns: trajectory_id, first_index, last_index, n_calls, first_ts, last_ts, seconds (null where a
    clock reading is missing), tool_name. Each chunk's start positions are gathered into a sorted array, each call
    finds its start by bisection, and calls are aggregated by start. Stretches that touch a chunk's
    edge are then joined over the edges; for that only two rows a chunk move.

    A call without params is judged by its params_hash (case and length beyond 8 digits don't count); if
    that is null or empty too, it equals no other call. Null tool names equal each other. Calls
    without trajectory_id or global_index are left out; repeated rows count once. An empty table gives
    no rows. Extra columns are ignored.
    """
    t = F.coalesce(plain_tool(F.col("tool_name")), F.lit(""))
    h = F.lower(F.trim(F.col("params_hash")))
    calls = first_delivered(
        calls,
        t=t,
        k=request_key(t, F.col("params")),
        h=F.when(h.rlike("^[0-9a-f]{8,}$"), F.substring(h, 1, 8)).when(h != "", h),
        ts=F.col("ts_epoch"),
    )
    near = calls.withColumn("p", F.expr("if(k IS NULL, NULL, struct(k, h, t))")).selectExpr(
        "*", f"lag(p) IGNORE NULLS OVER ({_NEXT}) AS pv", f"lead(p) IGNORE NULLS OVER ({_NEXT}) AS nx", f"row_number() OVER ({_NEXT}) AS rn"
    )
    keyed = near.withColumn("rk", F.expr("coalesce(k, CASE WHEN pv.h = h AND pv.t = t THEN pv.k WHEN nx.h = h AND nx.t = t THEN nx.k WHEN h IS NOT NULL THEN xxhash64('#', t, h) END)"))
    bounds = keyed.selectExpr("tid", "c", "g", "rn", "t", "h", "k", "rk", "ts", f"lag(rk) OVER ({_NEXT}) AS prk").withColumn("b", F.expr("rn = 1 OR rk IS NULL OR prk IS NULL OR rk <> prk"))
    starts = bounds.withColumn("starts", F.expr("collect_list(if(b, rn, NULL)) OVER (PARTITION BY tid, c)"))
    placed = starts.withColumn("start", F.expr(_BISECT)).withColumn("edge", F.expr("if(start = 1, 1, 0) + if(start = starts[size(starts) - 1], 2, 0)"))
    pieces = placed.groupBy("tid", "c", "start").agg(
        F.min("g").alias("g0"), F.max("g").alias("g1"), F.count("*").alias("n"), F.max("rk").alias("rk"), F.max("edge").alias("edge"), F.max("t").alias("t"),
        F.max("h").alias("h"), F.max(F.col("k").isNull()).alias("no_k"), F.min_by("ts", "g").alias("ts0"), F.max_by("ts", "g").alias("ts1"),
    )
    inner = pieces.where("edge = 0").select("tid", "g0", "g1", "n", "ts0", "ts1", "t")
    order = "PARTITION BY tid ORDER BY c, start"
    same = "(rk = lag(rk) OVER (%s) OR ((no_k OR lag(no_k) OVER (%s)) AND h = lag(h) OVER (%s) AND t = lag(t) OVER (%s)))" % ((order,) * 4)
    outer = pieces.where("edge > 0").withColumn("goes_on", F.expr(f"coalesce((edge & 1) = 1 AND {same}, false)"))
    outer = outer.withColumn("island", F.expr(f"sum(if(goes_on, 0, 1)) OVER ({order})"))
    joined = outer.groupBy("tid", "island").agg(F.min("g0").alias("g0"), F.max("g1").alias("g1"), F.sum("n").alias("n"), F.min_by("ts0", "g0").alias("ts0"), F.max_by("ts1", "g1").alias("ts1"), F.max("t").alias("t")).drop("island")
    both = inner.unionByName(joined.select(*inner.columns)).where(F.col("n") >= least)
    return both.select(
        F.col("tid").alias("trajectory_id"), F.col("g0").alias("first_index"), F.col("g1").alias("last_index"), F.col("n").alias("n_calls"),
        F.col("ts0").alias("first_ts"), F.col("ts1").alias("last_ts"), (F.col("ts1") - F.col("ts0")).alias("seconds"), F.col("t").alias("tool_name"),
    )
