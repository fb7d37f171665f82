"""As-of lookups, scored top-k, seeded samples, and groups of runs with equal token budgets."""

from __future__ import annotations

import random
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracefold.operators.ranks import positions, spread_running
from tracefold.session import checkpointed


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, later: str | None = None, width: float = 86_400) -> DataFrame:
    """left with `value` of the latest row of right at or before left_time with the same key; null where there is none.

    later names a column for how many rows of right with the key come after left_time (0 for a null key or time). Ties of
    right_time go to the greatest value; the latest row's value counts if it is null, too. A null key or time matches nothing.

    Both sides are put in one order and the last right row is carried forward: one sort instead of a range join's pairs. A key's rows are cut into pieces
    of `width` (seconds for times, else units), whose last rows and counts are carried over first, so a hot key is in as many tasks as it has pieces.
    """
    kind = right.schema[value].dataType.simpleString()
    l = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(f"struct<v:{kind}>"))
    r = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True)
    number = F.col("_t").cast("timestamp").cast("double") if dict(left.dtypes)[left_time] in ("timestamp", "timestamp_ntz", "date") else F.col("_t").cast("double")
    both = both.withColumn("_piece", F.floor(number / width))
    order = [F.col("_t").asc_nulls_first(), F.col("_side"), F.col("_v").asc_nulls_first()]
    inside = W.partitionBy(key, "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = both.withColumn("_c", F.last("_v", ignorenulls=True).over(inside)).withColumn("_n", F.count("_v").over(inside))
    pieces = r.withColumn("_piece", F.floor((F.col("_t").cast("timestamp").cast("double") if dict(right.dtypes)[right_time] in ("timestamp", "timestamp_ntz", "date") else F.col("_t").cast("double")) / width))
    pieces = pieces.groupBy(key, "_piece").agg(F.max(F.struct("_t", "_v")).alias("_last"), F.count("*").alias("_m"))
    asked = both.select(key, "_piece").where(F.col(key).isNotNull() & F.col("_piece").isNotNull()).distinct()
    known = asked.join(pieces, [key, "_piece"], "left")
    before = W.partitionBy(key).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carried = known.select(F.col(key).alias("_asof_key"), F.col("_piece").alias("_p"), F.last("_last", ignorenulls=True).over(before)["_v"].alias("_c0"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_m").over(W.partitionBy(key)), F.lit(0)).alias("_all"))
    out = rows.where("_side = 1").join(carried, (F.col(key) == F.col("_asof_key")) & (F.col("_piece") == F.col("_p")), "left")
    out = out.withColumn(value, F.coalesce("_c", "_c0")["v"])
    out = out.withColumn(value, F.when(F.col("_p").isNotNull(), F.col(value)))
    if later is not None:
        out = out.withColumn(later, F.when(F.col("_p").isNotNull(), F.col("_all") - F.col("_n0") - F.col("_n")).otherwise(0).cast("long"))
    return out.drop("_t", "_side", "_v", "_c", "_piece", "_n", "_asof_key", "_p", "_c0", "_n0", "_all")


# What in a path tells a file beside the source proper.
AUXILIARY = ("/test", "tests/", "/example", "/examples/", "/docs/")


def file_score(path: Column, lines: Column) -> Column:
    """How central a source file looks: root of its lines, less by depth, less for tests, docs and examples."""
    depth = F.size(F.split(path, "/")) - 1
    aside = F.exists(F.lit(list(AUXILIARY)), lambda x: F.contains(F.lower(path), x))
    return F.sqrt(lines) * (1.0 / (1.0 + depth)) * F.when(aside, 0.3).otherwise(1.0)


def top_files(files: DataFrame, k: int = 12, order: str = "path") -> DataFrame:
    """The k files (path, n_lines) of the highest score, files of under two lines left out; ties in the order of input, which `order` tells."""
    return files.where("n_lines >= 2").withColumn("score", file_score(F.col("path"), F.col("n_lines"))).orderBy(F.desc("score"), order).limit(k)


def exact_sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows (all, if there are fewer) without replacement, the same for the same seed; n of 0 or less is an error."""
    if n <= 0:
        raise ValueError("n must be positive")
    return spread_running(rows, [], [key], seed=seed).where(F.col("rank") < n).drop("rank", "running")


def seeded_sample(rows: DataFrame, n: int, order: str, seed: int = 0) -> DataFrame:
    """n rows without replacement with their position in the order of `order`: those that Python's generator draws from as many rows; all if there are n or fewer.

    n of 0 or less is an error. The driver draws n positions, so n is meant to be small; exact_sample draws any number.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    placed = positions(rows, order)
    total = placed.count()
    if n >= total:
        return placed
    drawn = rows.sparkSession.createDataFrame([(i,) for i in random.Random(seed).sample(range(total), n)], "position long")
    return placed.join(F.broadcast(drawn), "position", "left_semi")


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds batch, the number of a row's batch of `size` rows in the order of a dense ordinal from 0."""
    return rows.withColumn("batch", F.floor(F.col(order) / size))


# --- groups of runs with equal token budgets

# The pool that a run of an outcome belongs to.
POOL_OF = {"toxic": "toxic", "failed": "failed", "weakly_verified": "weakly_verified", "verified_one_shot": "one_shot_success", "verified_with_recovery": "failure_recovery"}
CLEAN, RECOVERY, TOXIC = "one_shot_success", "failure_recovery", "toxic"


class BudgetError(ValueError):
    """The groups can't be made as wanted."""


def pool_label(outcome: Column) -> Column:
    """The pool of an outcome; reading one of an unknown outcome is an error."""
    known = F.create_map(*[x for k, v in POOL_OF.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(known[outcome], F.raise_error(F.concat(F.lit("no pool for the outcome "), F.coalesce(outcome, F.lit("null")))).cast("string"))


def pool_items(runs: DataFrame, order: str) -> DataFrame:
    """(key, trajectory_id, label, tokens) of runs (trajectory_id, label, tokens): keys are id#place in the order of `order`; tokens at least 1."""
    placed = positions(runs.select("trajectory_id", "label", "tokens", *([] if order == "trajectory_id" else [order])), order)
    return placed.select(F.concat(F.coalesce("trajectory_id", F.lit("")), F.lit("#"), F.col("position").cast("string")).alias("key"), "trajectory_id", "label", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(1)).cast("long").alias("tokens"))


def oversampled(items: DataFrame, n: int, factor: float, seed: int) -> DataFrame:
    """The n items and round(n * (factor - 1)) more of them drawn with replacement, keyed <key>@dup<i>; halves round to even. A factor of 1 or less adds none."""
    extra = int(Decimal(n * (factor - 1.0)).quantize(Decimal(1), ROUND_HALF_EVEN)) if factor > 1.0 and n else 0
    if not extra:
        return items
    drawn = items.sparkSession.range(extra).select(F.col("id").alias("_i"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n)).alias("_at"))
    ranked = spread_running(items, [], ["key"], seed=seed).drop("running")
    more = drawn.join(ranked, F.col("_at") == F.col("rank")).select(F.concat("key", F.lit("@dup"), F.col("_i").cast("string")).alias("key"), "trajectory_id", "label", "tokens")
    return items.unionByName(more)


@dataclass(frozen=True)
class Bounds:
    """A target of tokens and how far a sum may be from it."""

    target: int
    lower: int
    upper: int

    @staticmethod
    def of(target: int, tolerance: float) -> Bounds:
        return Bounds(target, int(target * (1.0 - tolerance)), int(target * (1.0 + tolerance)))

    def holds(self, total: int) -> bool:
        return self.lower <= total <= self.upper

    def score(self, total: int) -> tuple:
        return not self.holds(total), abs(self.target - total)


def filled(pool: DataFrame, capacity: int, bounds: Bounds, seed: int) -> tuple[DataFrame, int]:
    """(items, total): items of the pool in hash order up to the target, those that don't fit passed over, at last the one that comes nearest to it within the bound.

    Each round takes, of the items that still fit, the longest stretch in hash order whose sum fits, by a distributed running sum; the item that stopped it and all
    larger ones don't fit any more. Each round takes an item at least, and the room left falls below the size of one that is left out, so there are few. A pool within
    the bounds is taken whole.
    """
    if bounds.holds(capacity):
        return pool, capacity
    left, taken, total = pool.select("key", "trajectory_id", "label", "tokens"), [], 0
    while True:
        room = bounds.target - total
        fits = F.when(F.col("tokens") <= room, F.col("tokens"))
        ranked = spread_running(left, [], ["key"], fits, seed=seed).drop("rank")
        ranked = checkpointed(ranked.withColumn("_in", (F.col("tokens") <= room) & (F.col("running") + F.col("tokens") <= room)).drop("running"))
        left = ranked.where("NOT _in").drop("_in")
        got = ranked.where("_in").agg(F.sum("tokens")).first()[0]
        if not got:
            break
        taken.append(ranked.where("_in").drop("_in"))
        total += got
    off = F.abs(F.col("tokens") - (bounds.target - total))
    last = left.where((F.col("tokens") <= bounds.upper - total) & (off < abs(bounds.target - total))).orderBy(off, "key").limit(1)
    last = checkpointed(last)
    more = last.agg(F.sum("tokens")).first()[0]
    return reduce(DataFrame.unionByName, [*taken, last]), total + (more or 0)


def best_swap(inside: DataFrame, outside: DataFrame, total: int, bounds: Bounds, width: float = 65_536, anywhere: bool = False) -> tuple[str, str, int] | None:
    """(key out, key in, total after): the swap of an item inside a selection for one outside of it that comes nearest to the target, within the bounds unless anywhere; None if there is none.

    For each item outside, the best one to take out is the nearest in size to what would meet the target, found by as-of lookups from below and above, not by pairs.
    """
    asked = outside.select(F.lit(0).alias("_one"), F.col("key").alias("key_in"), F.col("tokens").alias("tokens_in"), (F.col("tokens") + total - bounds.target).alias("_ideal"))
    near = None
    for sign in (1, -1):
        right = inside.groupBy("tokens").agg(F.min("key").alias("key")).select(F.lit(0).alias("_one"), (sign * F.col("tokens")).alias("_at"), F.struct(F.col("key").alias("key_out"), F.col("tokens").alias("tokens_out")).alias("out"))
        part = as_of(asked.withColumn("_want", sign * F.col("_ideal")), right, "_one", "_want", "_at", "out", width=width).where("out IS NOT NULL").select("key_in", "tokens_in", "out.*")
        near = part if near is None else near.unionByName(part)
    after = near.withColumn("after", total - F.col("tokens_out") + F.col("tokens_in"))
    after = after if anywhere else after.where(F.col("after").between(bounds.lower, bounds.upper))
    best = after.orderBy(F.abs(F.lit(bounds.target) - F.col("after")), "key_in", "key_out").limit(1).collect()
    return (best[0]["key_out"], best[0]["key_in"], best[0]["after"]) if best else None


def _swapped(selected: DataFrame, pool: DataFrame, out: str, into: str) -> DataFrame:
    return checkpointed(selected.where(F.col("key") != out).unionByName(pool.where(F.col("key") == into)))


def _selected(pool: DataFrame, capacity: int, bounds: Bounds, seed: int, trials: int, swaps: int = 8) -> tuple[DataFrame, int]:
    """The best of some trials in other orders; the first that is within the bounds is taken. A trial that isn't is mended by swaps that come nearer to the target."""
    best = None
    for trial in range(trials):
        items, total = filled(pool, capacity, bounds, seed + 7919 * trial)
        for _ in range(swaps if total else 0):
            if bounds.holds(total):
                break
            swap = best_swap(items, pool.join(items.select("key"), "key", "left_anti"), total, bounds, anywhere=True)
            if swap is None or abs(bounds.target - swap[2]) >= abs(bounds.target - total):
                break
            items, total = _swapped(items, pool, *swap[:2]), swap[2]
        if best is None or bounds.score(total) < bounds.score(best[1]):
            best = items, total
        if bounds.holds(total):
            break
    return best


def with_recoveries(selected: DataFrame, total: int, pool: DataFrame, ratio: float, bounds: Bounds, seed: int, trials: int, swaps: int = 16) -> tuple[DataFrame, int]:
    """The selection with recoveries as `ratio` of its items where the pool and the bounds allow it; as it is where they are so many already.

    Most are exchanged at once: recoveries and the others are filled each to the tokens that so many items of their mean size have. What is missing
    then is swapped one by one (see best_swap), `swaps` times at most.
    """

    def share(items: DataFrame) -> tuple[int, int]:
        r = items.agg(F.count("*").alias("n"), F.count_if(F.col("label") == RECOVERY).alias("m")).first()
        return r["n"], r["m"]

    n, m = share(selected)
    if not n or m >= ratio * n:
        return selected, total
    by = {r["r"]: r for r in pool.groupBy((F.col("label") == RECOVERY).alias("r")).agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    mean = {k: by[k]["t"] / by[k]["n"] for k in by}
    best = (selected, total, m / n)
    for push in (0.0, 0.02, 0.05, 0.1):
        d = min(1.0, ratio + push)
        items = bounds.target / (d * mean[True] + (1 - d) * mean.get(False, 0.0))
        want = min(by[True]["t"], round(d * items * mean[True]))
        slack = (bounds.upper - bounds.lower) // 4
        rec, t1 = _selected(pool.where(F.col("label") == RECOVERY), by[True]["t"], Bounds(want, max(0, want - slack), want + slack), seed, trials) if want else (pool.limit(0), 0)
        rest = bounds.target - t1
        others = by[False]["t"] if False in by else 0
        oth, t2 = _selected(pool.where(F.col("label") != RECOVERY), others, Bounds(rest, max(0, bounds.lower - t1), bounds.upper - t1), seed, trials) if rest > 0 and others else (pool.limit(0), 0)
        both = checkpointed(rec.unionByName(oth))
        n, m = share(both)
        if n and bounds.holds(t1 + t2) and m / n > best[2]:
            best = (both, t1 + t2, m / n)
        if best[2] >= ratio:
            break
    selected, total, _ = best
    for _ in range(swaps):
        n, m = share(selected)
        if m >= ratio * n:
            break
        outside = pool.where(F.col("label") == RECOVERY).join(selected.select("key"), "key", "left_anti")
        swap = best_swap(selected.where(F.col("label") != RECOVERY), outside, total, bounds)
        if swap is None:
            break
        selected, total = _swapped(selected, pool, *swap[:2]), swap[2]
    return selected, total


def budget_groups(items: DataFrame, target: int | None = None, tolerance: float = 0.05, enrichment: float = 2.0, seed: int = 0, trials: int = 8, strict: bool = True) -> DataFrame:
    """(group_name, key, trajectory_id, label, tokens): four groups of runs with equal token budgets, of items (key, trajectory_id, label, tokens; see pool_items).

    clean_only holds runs without recovery, mixed and recovery_enriched these and recoveries, unfiltered all but toxic runs. The enriched pool has
    recoveries again, drawn with replacement (see oversampled), and its group recoveries as `enrichment` times their natural share of the items where that can be. The
    target defaults to the least capacity. Selection is by distributed running sums (see filled), so pools of any size do; no pool is collected.

    No items, an empty pool, a target that isn't positive or above a capacity, and with strict a group outside the tolerance raise BudgetError.
    """
    items = checkpointed(items.select("key", "trajectory_id", "label", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(1)).cast("long").alias("tokens")))
    sums = {r["label"]: (r["n"], r["t"]) for r in items.groupBy("label").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}  # one row a label
    if not sums:
        raise BudgetError("there are no runs")
    for label, what in ((CLEAN, "clean_only is empty"), (RECOVERY, "mixed and recovery_enriched need a recovery")):
        if label not in sums:
            raise BudgetError(what)
    n_one, n_rec = sums[CLEAN][0], sums[RECOVERY][0]
    one, rec = items.where(F.col("label") == CLEAN), items.where(F.col("label") == RECOVERY)
    more = checkpointed(oversampled(rec, n_rec, enrichment, seed))
    pools = {"clean_only": one, "mixed": one.unionByName(rec), "recovery_enriched": one.unionByName(more), "unfiltered": items.where(F.coalesce("label", F.lit("")) != TOXIC)}
    capacity = {"clean_only": sums[CLEAN][1], "mixed": sums[CLEAN][1] + sums[RECOVERY][1], "recovery_enriched": sums[CLEAN][1] + more.agg(F.sum("tokens")).first()[0], "unfiltered": sum(t for k, (_, t) in sums.items() if k != TOXIC)}
    target = min(capacity.values()) if target is None else target
    if target <= 0:
        raise BudgetError("the target must be positive")
    for g, c in capacity.items():
        if c < target:
            raise BudgetError(f"{g} has {c} tokens, fewer than the target of {target}")
    bounds, ratio, out = Bounds.of(target, tolerance), min(1.0, n_rec / (n_one + n_rec) * enrichment), None
    for i, (g, pool) in enumerate(pools.items()):
        chosen, total = _selected(pool, capacity[g], bounds, seed + i, trials)
        if g == "recovery_enriched":
            chosen, total = with_recoveries(chosen, total, pool, ratio, bounds, seed + i, trials)
        if strict and not bounds.holds(total):
            raise BudgetError(f"{g} has {total} tokens, outside of {bounds.lower} to {bounds.upper}")
        part = chosen.select(F.lit(g).alias("group_name"), "key", "trajectory_id", "label", "tokens")
        out = part if out is None else out.unionByName(part)
    return out


def group_report(groups: DataFrame, target: int, tolerance: float = 0.05) -> DataFrame:
    """(group_name, n, total_tokens, label_counts, within_tolerance) of budget_groups' rows."""
    b = Bounds.of(target, tolerance)
    by = groups.groupBy("group_name", "label").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).groupBy("group_name")
    return by.agg(F.sum("n").alias("n"), F.sum("t").alias("total_tokens"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts")).withColumn("within_tolerance", F.col("total_tokens").between(b.lower, b.upper))
