"""Splits that keep related records together (problem 4): a spanning forest by Boruvka contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions.names import folded, run_key
from tracefold.operators.ranks import spread_running
from tracefold.session import checkpointed


def task_key(c: str):
    """The task's id, letters and digits only, lower case; null where it links nothing."""
    k = folded(c)
    return F.when(~k.isin("", "unknown"), k)


def keyed_records(records: DataFrame, id_col: str = "record_id", task_col: str = "instance_id", run_col: str = "trajectory_id") -> DataFrame:
    """(record_id, i, r): the record with its task node 'i:...' and run node 'r:...', null where it has none."""
    return records.select(F.col(id_col).cast("long").alias("record_id"), F.concat(F.lit("i:"), task_key(task_col)).alias("i"), F.concat(F.lit("r:"), run_key(run_col)).alias("r"))


#: Pointer doublings between two checkpoints: trees of a depth up to 2 ** DOUBLINGS take one.
DOUBLINGS = 3


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of edges (u, v, w), w unique: (forest, roots). forest has the edges (u, v, w) of the least spanning forest, roots (node, root) of every node.

    In each round every component takes its least edge to another component; these edges are the forest's. The trees they
    make are contracted by pointer doubling, edges are renamed and parallel ones reduced to the least. Components at
    least halve, so rounds grow with the logarithm of the longest chain. Each round is written to the shared folder, the forest as well, so it
    stays when executors are lost. A component's edges are reduced by partial aggregation and renamed by joins on the component, which adaptive
    execution splits where one component is hot.
    """
    plain = edges.where("u <> v").groupBy("u", "v").agg(F.min("w").alias("w"))
    live = checkpointed(plain.select("u", "v", "w", F.col("u").alias("u0"), F.col("v").alias("v0")))
    names = None  # (node, root), null before the first round
    forest = None
    while live.limit(1).count():
        e = F.struct("w", "u0", "v0").alias("e")
        both = live.select(F.col("u").alias("a"), F.col("v").alias("b"), e).unionByName(live.select(F.col("v").alias("a"), F.col("u").alias("b"), e))
        least = checkpointed(both.groupBy("a").agg(F.min_by(F.col("b"), F.col("e.w")).alias("p"), F.min("e").alias("e")))
        chosen = least.select(F.col("e.u0").alias("u"), F.col("e.v0").alias("v"), F.col("e.w").alias("w"))
        forest = chosen if forest is None else forest.unionByName(chosen)
        # Each tree has one pair that chose the same edge; its smaller end becomes the root.
        back = least.select(F.col("a").alias("_a"), F.col("p").alias("_p"))
        up = least.join(back, F.col("p") == F.col("_a"), "left").select("a", F.when((F.col("_p") == F.col("a")) & (F.col("a") < F.col("p")), F.col("a")).otherwise(F.col("p")).alias("p"))
        while True:
            for _ in range(DOUBLINGS):
                above = up.select(F.col("a").alias("_a"), F.col("p").alias("_p"))
                up = up.join(above, F.col("p") == F.col("_a")).select("a", F.col("_p").alias("p"), (F.col("_p") != F.col("p")).alias("moved"))
            up = checkpointed(up)
            if not up.where("moved").limit(1).count():
                break
        if names is None:
            names = up.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            names = names.join(up, F.col("root") == F.col("a"), "left").select("node", F.coalesce("p", "root").alias("root"))
        names = checkpointed(names)
        ua, va = up.select(F.col("a").alias("u"), F.col("p").alias("pu")), up.select(F.col("a").alias("v"), F.col("p").alias("pv"))
        renamed = live.join(ua, "u").join(va, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"), F.struct("w", "u0", "v0").alias("e"))
        live = checkpointed(renamed.groupBy("u", "v").agg(F.min("e").alias("e")).select("u", "v", "e.*"))
    if names is None:
        names = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).limit(0)
        forest = edges.select("u", "v", "w").limit(0)
    return checkpointed(forest.distinct()), names


def record_edges(keys: DataFrame) -> DataFrame:
    """(u, v, w): each pair of a task and a run that a record has, weighted by the pair's smallest record_id."""
    return keys.where("i IS NOT NULL AND r IS NOT NULL").groupBy(F.col("i").alias("u"), F.col("r").alias("v")).agg(F.min("record_id").alias("w"))


def record_forest(records: DataFrame, **cols: str) -> DataFrame:
    """(task, run, record_id): the edges of the least spanning forest of tasks and runs, i.e. the records that hold the groups together."""
    forest, _ = spanning_forest(record_edges(checkpointed(keyed_records(records, **cols).where("record_id IS NOT NULL"))))
    return forest.select(F.substring("u", 3, 2**31 - 1).alias("task"), F.substring("v", 3, 2**31 - 1).alias("run"), F.col("w").alias("record_id"))


def related_groups(records: DataFrame, **cols: str) -> DataFrame:
    """(record_id, group_id): every record with the smallest record_id of all records it is linked to.

    Records are linked by an equal task (instance_id: letters and digits, case ignored; null, empty and unknown link
    nothing) or an equal run (trajectory_id without case, blanks and what follows '#'; null and empty link nothing), over any chain. Records that nothing
    links are groups of one. Repeated record_ids are one record; rows without record_id are left out.

    Tasks and runs are the nodes, each (task, run) pair an edge weighted by its smallest record_id, so the
    graph is as large as the distinct pairs, not as the deliveries or their pairs. The groups are the trees of its spanning forest.
    """
    keys = checkpointed(keyed_records(records, **cols).where("record_id IS NOT NULL"))
    _, roots = spanning_forest(record_edges(keys))
    # A run node carries each record; the task node does where there is no run.
    at = keys.withColumn("node", F.coalesce("r", "i"))
    lone = at.where("node IS NULL").select("record_id", F.col("record_id").alias("group_id"))
    rooted = at.where("node IS NOT NULL").join(roots, "node", "left").select("record_id", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("record_id").alias("group_id"))
    linked = rooted.join(first, "root").select("record_id", "group_id")
    return linked.unionByName(lone).groupBy("record_id").agg(F.min("group_id").alias("group_id"))


def groups_found(records: DataFrame) -> DataFrame:
    """The groups of two or more records."""
    groups = checkpointed(related_groups(records))
    large = groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return groups.join(large, "group_id").select("record_id", "group_id")


def split_records(records: DataFrame, targets: DataFrame, seed: int = 5) -> DataFrame:
    """(record_id, group_id, split_name): whole groups dealt to the splits by target_permille.

    Groups are stratified by size band (powers of two) and within a band dealt systematically: groups stand in hash order, each goes to the split whose interval
    of the band's records holds its middle. Bands are dealt from the largest groups down, and a band's intervals are what each split
    still lacks of its target after the bands before, so what a band of few groups has too much is made good by the next. A split ends within about the
    smallest groups' size of its target, unless larger groups fill it beyond. Shares of 0 get nothing. Empty records give no rows.

    There is one pass of sums a band, about log2 of the largest group at most; the driver gets one row a band and split.
    """
    groups = checkpointed(related_groups(records))
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.log2("n")).cast("int"))
    shares = [(r[0], r[1]) for r in targets.where("target_permille > 0 AND split_name IS NOT NULL").groupBy("split_name").agg(F.sum("target_permille").alias("s")).orderBy(F.desc("s"), "split_name").collect()]
    if not shares:
        raise ValueError("targets need a positive share")
    ranked = checkpointed(spread_running(sizes, ["band"], ["group_id"], F.col("n"), seed=seed))
    bands = [(r[0], r[1]) for r in ranked.groupBy("band").agg(F.sum("n").alias("n")).orderBy(F.desc("band")).collect()]  # one row a power of two
    lacks = {name: sum(n for _, n in bands) * s / sum(s for _, s in shares) for name, s in shares}
    split = F.lit(None).cast("string")
    for band, band_n in bands:
        left = sum(max(0.0, v) for v in lacks.values())
        middle = (F.col("running") + F.col("n") / 2) / band_n
        of, low = F.lit(max(lacks, key=lambda x: lacks[x])), 0.0
        for name, _ in shares:
            high = low + max(0.0, lacks[name]) / left
            of = F.when((middle >= low) & (middle < high), name).otherwise(of)
            low = high
        for r in ranked.where(F.col("band") == band).groupBy(of.alias("name")).agg(F.sum("n").alias("n")).collect():  # one row a split
            lacks[r["name"]] -= r["n"]
        split = F.when(F.col("band") == band, of).otherwise(split)
    return groups.join(ranked.select("group_id", split.alias("split_name")), "group_id").select("record_id", "group_id", "split_name")
