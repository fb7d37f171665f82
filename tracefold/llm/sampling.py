"""Samples that follow target proportions of categories (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracefold.functions.names import folded, snake
from tracefold.operators.ranks import spread_running
from tracefold.session import checkpointed

KEYS = ["outcome", "contains_recovery", "highest_recovery_level"]


def current_labels(labels: DataFrame) -> DataFrame:
    """(run, outcome, contains_recovery, highest_recovery_level): the latest label of each run, in plain spelling.

    Ties of labelled_at go to the greatest values, so the result is always the same; an unknown time is earliest. An
    absent level (null, empty, none, null, nil, n/a, no) is NONE; a null contains_recovery is true if there is a level.
    Labels without a trajectory_id belong to no run.
    """
    level = F.upper(folded("highest_recovery_level"))
    level = F.when(level.isNull() | level.isin("", "NONE", "NULL", "NIL", "NA", "NO", "NOTHING", "NAN"), "NONE").otherwise(level)
    plain = labels.where("trajectory_id IS NOT NULL").select(
        F.lower(F.trim("trajectory_id")).alias("run"),
        F.struct(F.coalesce("labelled_at", F.lit("0001-01-01").cast("timestamp_ntz")), snake("outcome").alias("outcome"), level.alias("level"), F.coalesce("contains_recovery", level != "NONE").alias("recovered")).alias("x"),
    )
    last = plain.groupBy("run").agg(F.max("x").alias("x"))
    return last.select("run", F.col("x.outcome").alias("outcome"), F.col("x.recovered").alias("contains_recovery"), F.col("x.level").alias("highest_recovery_level"))


def target_report(current: DataFrame, targets: DataFrame, one_in: int = 4) -> DataFrame:
    """Per row of targets: available, wanted = max(ceil(permille * size / 1000), min_rows), deficit; size = floor(runs / one_in).

    Categories without runs have available 0; a null target or minimum counts as 0; repeated targets of a category are one with the
    greatest numbers; categories that no target names are not sampled.
    """
    counts = current.groupBy(*KEYS).agg(F.count("*").alias("n"))
    size = counts.agg(F.floor(F.coalesce(F.sum("n"), F.lit(0)) / one_in).alias("size"))
    want = targets.groupBy(*KEYS).agg(F.coalesce(F.max("target_permille"), F.lit(0)).alias("target_permille"), F.coalesce(F.max("min_rows"), F.lit(0)).alias("min_rows"))
    c = counts.select(*[F.col(k).alias(f"_{k}") for k in KEYS], "n")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    wanted = F.greatest(F.ceil(F.col("target_permille") * F.col("size") / 1000), F.col("min_rows")).cast("long")
    rows = want.join(c, on, "left").join(F.broadcast(size)).select(*KEYS, "target_permille", "min_rows", "size", F.coalesce("n", F.lit(0)).cast("long").alias("available"), wanted.alias("wanted"))
    return rows.withColumn("deficit", F.greatest(F.col("wanted") - F.col("available"), F.lit(0)).cast("long"))


def _placed(current: DataFrame, targets: DataFrame, one_in: int, over: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, taken, extra): the targets, the accepted runs cut to their number, and what makes good a short draw."""
    current = checkpointed(current)
    report = target_report(current, targets, one_in)
    n, w = F.col("available"), F.col("wanted")
    p = F.when(w >= n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), (w * (1 + over) + 6 * F.sqrt(w) + 20) / F.greatest(n, F.lit(1))))
    p = F.when(w > 0, F.greatest(p, F.lit(0.0))).otherwise(0.0)
    # as many rows as targets, which are given by hand
    probs = report.select(*[F.col(k).alias(f"_{k}") for k in KEYS], p.alias("p"), F.least(w, n).alias("due"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("run")), 11) * F.lit(2.0**-53)
    marked = checkpointed(current.join(F.broadcast(probs), on).select("run", *KEYS, "due", (u < F.col("p")).alias("accepted")))
    drawn, left = marked.where("accepted"), marked.where("NOT accepted")
    taken = spread_running(drawn, KEYS, ["run"], seed=seed + 1).where("rank < due").select("run", *KEYS)
    # What a category's draw lacks is taken from its rejected runs, in the order of the second hash; mostly no category lacks any.
    lacks = marked.groupBy(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("due").alias("_due")).agg(F.count_if("accepted").alias("_n")).where("_n < _due").withColumn("lack", F.col("_due") - F.col("_n"))
    rest = left.join(F.broadcast(lacks), on).select("run", *KEYS, "lack")
    return report, taken, spread_running(rest, KEYS, ["run"], seed=seed + 1).where("rank < lack").select("run", *KEYS)


def sample_to_targets(current: DataFrame, targets: DataFrame, one_in: int = 4, over: float = 0.1, seed: int = 11) -> DataFrame:
    """(run, keys...): the sample: for each target row exactly min(wanted, available) runs.

    Each run is first accepted on its own with the probability wanted / available, a tenth and some rows above it, by
    a hash of its id; the accepted are then cut to the exact number in the order of a second hash, over pieces of any category (see
    operators.ranks), so no category is sorted in one task. Should the draw of a category be short, which takes a deviation of more than
    six sigma (or a negative `over`), the rest is taken from its rejected runs in the order of the second hash.

    Null keys match null targets. Empty labels or targets give no rows.
    """
    _, taken, extra = _placed(current, targets, one_in, over, seed)
    return taken.unionByName(extra)


def sample_report(current: DataFrame, targets: DataFrame, one_in: int = 4, over: float = 0.1, seed: int = 11) -> DataFrame:
    """The targets with what the sample holds of each: sampled, its share in permille, and the deficit, i.e. what was wanted and isn't in the sample."""
    report, taken, extra = _placed(current, targets, one_in, over, seed)
    # counted by category after partial sums; as many rows as targets
    got = taken.unionByName(extra).groupBy(*[F.col(k).alias(f"_{k}") for k in KEYS]).agg(F.count("*").alias("n"))
    r = report.drop("deficit").join(F.broadcast(got), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS], "left")
    sampled = F.coalesce("n", F.lit(0)).cast("long")
    r = r.select(*KEYS, "wanted", "available", sampled.alias("sampled"), F.greatest(F.col("wanted") - sampled, F.lit(0)).cast("long").alias("deficit"), "target_permille")
    total = F.sum("sampled").over(W.partitionBy(F.lit(0)))  # over the targets' rows
    return r.select(*KEYS, "wanted", "available", "sampled", "deficit", F.round(1000.0 * F.col("sampled") / total, 3).alias("actual_permille"), "target_permille")


def short_categories(current: DataFrame, targets: DataFrame, one_in: int = 4) -> DataFrame:
    """The target rows whose sample, drawn and corrected, holds fewer runs than wanted."""
    return sample_report(current, targets, one_in).where("deficit > 0").select(*KEYS)
