import random

import pytest

from tracefold.llm import splits

SCHEMA = "record_id long, instance_id string, trajectory_id string, root string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def brute(rows):
    import re

    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, i, t in rows:
        i = re.sub(r"[\W_]", "", (i or "").lower())
        t = (t or "").split("#")[0].strip().lower()
        root(a)
        if i not in ("", "unknown"):
            up[root(a)] = root("i" + i)
        if t:
            up[root(a)] = root("r" + t)
    groups = {}
    for a, _, _ in rows:
        groups.setdefault(root(a), []).append(a)
    return {a: min(g) for g in groups.values() for a in g}


def test_spellings_and_what_links_nothing(spark):
    rows = [(5, "Org__Repo-1", "t1"), (3, "org/repo#1\t", "t2"), (7, None, "T2#resume1"), (8, "unknown", " t9 "), (9, "UNKNOWN", "t8"), (10, "", None), (11, None, None), (12, "org__repox-1", "t5")]
    got = {r["record_id"]: r["group_id"] for r in splits.related_groups(table(spark, rows)).collect()}
    assert got == {5: 3, 3: 3, 7: 3, 8: 8, 9: 9, 10: 10, 11: 11, 12: 12}
    assert sorted(r["record_id"] for r in splits.groups_found(table(spark, rows)).collect()) == [3, 5, 7]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_union_find(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, "unknown", *[f"x{k}" for k in range(60)]]), r.choice([None, *[f"t{k}" for k in range(90)]])) for i in range(120)]
    assert {x["record_id"]: x["group_id"] for x in splits.related_groups(table(spark, rows)).collect()} == brute(rows)


def test_long_chain(spark):
    rows = [(i, f"i{i}", f"t{i // 2 if i % 2 else i // 2}") for i in range(40)] + [(100 + i, f"i{i + 1}", f"t{i // 2}") for i in range(39)]
    assert {x["record_id"]: x["group_id"] for x in splits.related_groups(table(spark, rows)).collect()} == brute(rows)


def test_splits_keep_groups_and_shares(spark):
    rows = [(i, "hot" if i % 5 == 0 else f"i{i // 3}", f"t{i}") for i in range(3000)]
    t = spark.createDataFrame([("train", 800), ("validation", 100), ("test", 100), ("none", 0)], "split_name string, target_permille long")
    got = splits.split_records(table(spark, rows), t).toPandas()
    assert len(got) == 3000 and got.groupby("group_id").split_name.nunique().max() == 1
    n = got.groupby("split_name").size()
    assert abs(n["train"] - 2400) < 60 and abs(n["validation"] - 300) < 60 and abs(n["test"] - 300) < 60 and "none" not in n


def test_empty(spark):
    t = spark.createDataFrame([("train", 800)], "split_name string, target_permille long")
    assert splits.split_records(table(spark, [(1, "a", "b")]).limit(0), t).count() == 0
    with pytest.raises(ValueError):
        splits.split_records(table(spark, [(1, "a", "b")]), t.limit(0))


def test_all_groups_are_dealt_by_bands(spark):
    """Few large groups: the bands below make good what those have too much."""
    rows, k = [], 0
    for size, n in ((40, 1), (17, 3), (9, 5), (4, 20), (2, 30), (1, 60)):
        for _ in range(n):
            rows += [(k * 100 + j, f"g{k}", None) for j in range(size)]
            k += 1
    t = spark.createDataFrame([("train", 800), ("validation", 100), ("test", 100)], "split_name string, target_permille long")
    got = splits.split_records(table(spark, rows), t).toPandas()
    assert len(got) == len(rows) and got.groupby("group_id").split_name.nunique().max() == 1
    n = got.groupby("split_name").size()
    assert abs(n["train"] - 0.8 * len(rows)) <= 2 and abs(n["validation"] - 0.1 * len(rows)) <= 2


@pytest.mark.parametrize("seed", [3, 4])
def test_forest_is_least(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, *[f"x{k}" for k in range(15)]]), r.choice([None, *[f"t{k}" for k in range(25)]])) for i in range(90)]
    up, least, seen = {}, set(), set()

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, i, t in rows:  # Kruskal: record_ids rise
        if i and t and (i, t) not in seen:
            seen.add((i, t))
            if root("i" + i) != root("r" + t):
                up[root("i" + i)] = root("r" + t)
                least.add((i, t, a))
    assert {tuple(x) for x in splits.record_forest(table(spark, rows)).collect()} == least
