"""Ranks and running sums over groups of any size, without one task per group.

A window over a hot group would sort it in a single task. Here rows are spread by the leading bits of
an order hash, each piece is summed first, the (few) piece totals are added up, and the piece's offset
is put back by a join on (group, piece).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracefold.session import checkpointed


def spread_running(
    df: DataFrame,
    group: list[str],
    tie: list[str],
    value: Column | None = None,
    pieces: int = 1024,
    out: str = "running",
    rank: str = "rank",
    seed: int = 0,
) -> DataFrame:
    """Adds `rank` (from 0) and `out` (sum of value over the earlier rows) in hash order of `tie`.

    The order within a group is by (hash of tie, tie), the same on every run. `pieces` bounds what
    one task holds to about rows / pieces of a group and the totals to groups * pieces rows.
    Null values count as 0. An empty df gives an empty result.
    """
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in tie])
    rows = df.withColumn("_h", h).withColumn("_piece", F.shiftrightunsigned("_h", 64 - (pieces.bit_length() - 1)).cast("int")).withColumn("_v", F.coalesce(value if value is not None else F.lit(1), F.lit(0)).cast("long"))
    totals = rows.groupBy(*group, "_piece").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    before = W.partitionBy(*group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    if not group:
        before = W.partitionBy(F.lit(0)).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*group, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    inside = W.partitionBy(*group, "_piece").orderBy("_h", *tie)
    ranked = rows.withColumn("_r", F.row_number().over(inside) - 1).withColumn("_c", F.sum("_v").over(inside) - F.col("_v"))
    on = F.lit(True)
    o = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in group], F.col("_piece").alias("_op"), "_n0", "_s0")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    joined = ranked.join(o, on & (F.col("_piece") == F.col("_op")))
    return joined.withColumn(rank, F.col("_n0") + F.col("_r")).withColumn(out, F.col("_s0") + F.col("_c")).drop("_h", "_piece", "_v", "_r", "_c", "_n0", "_s0", "_op", *[f"_o_{c}" for c in group])


def ordered_running(df: DataFrame, group: list[str], order: str, value: Column | None = None, span: int = 4096, out: str = "running", rank: str = "rank") -> DataFrame:
    """Adds `rank` (from 0) and `out` (sum of value over the earlier rows) in order of the whole number `order`, which has no ties in a group.

    Groups are cut into pieces of `span` numbers; pieces are summed first, so no task sorts a whole hot group. Null values count as 0; rows with a null
    order are first. df should hold keys and numbers only: it goes through a window.
    """
    rows = df.withColumn("_piece", F.coalesce(F.floor(F.col(order) / span), F.lit(-(2**62)))).withColumn("_v", F.coalesce(value if value is not None else F.lit(1), F.lit(0)).cast("long"))
    by = [F.col(c) for c in group] or [F.lit(0)]
    before = W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "_piece").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    offsets = totals.select(*[F.col(c).alias(f"_o_{c}") for c in group], F.col("_piece").alias("_op"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    inside = W.partitionBy(*by, "_piece").orderBy(F.col(order).asc_nulls_first())
    ranked = rows.withColumn("_r", F.row_number().over(inside) - 1).withColumn("_c", F.sum("_v").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("_v"))
    on = F.col("_piece") == F.col("_op")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    joined = ranked.join(offsets, on)
    return joined.withColumn(rank, (F.col("_n0") + F.col("_r")).cast("long")).withColumn(out, F.col("_s0") + F.col("_c")).drop("_piece", "_v", "_r", "_c", "_n0", "_s0", "_op", *[f"_o_{c}" for c in group])


def positions(df: DataFrame, *order: str, out: str = "position") -> DataFrame:
    """df with each row's place, from 0, in the order of the given columns (nulls first; ties in any order): a range partitioning and the partitions' counts, no single task."""
    placed = checkpointed(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_n0"))  # a row a partition
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(out, F.col("_n0") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_id", "_n0")
