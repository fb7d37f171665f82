import json

import pandas as pd

from tracefold.operators import drift

BASE = {"trajectory_id": "t", "seed": 1, "model": "m-small", "created_at": 1.5, "attempts": [{"goal": "g", "rolled_back": False}], "metadata": {"a": "b"}}


def lines(spark, *files):
    rows = []
    for s, records in enumerate(files):
        rows += [("c1", f"c1/{s}", s, i, r if isinstance(r, str) or r is None else json.dumps(r), "z") for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "collector string, file_name string, file_seq long, line_no long, payload string, path string")


def changes(df):
    return sorted((r["file_name"], r["change_kind"], r["field_path"], r["new_path"]) for r in drift.drift_report(df).collect())


def many(**change):
    out = []
    for i in range(8):
        r = json.loads(json.dumps(BASE)) | {"trajectory_id": f"t{i}", "seed": i * 37, "model": ["m-small", "k-large"][i % 2]}
        r["attempts"][0]["rolled_back"] = i % 3 == 0
        for k, v in change.items():
            if v is None:
                r.pop(k)
            elif callable(v):
                v(r)
            else:
                r[k] = v
        out.append(r)
    return out


def rename(old, new):
    def f(r):
        r[new] = r.pop(old)

    return f


def test_no_change(spark):
    assert changes(lines(spark, many(), many())) == []


def test_added_removed_and_values_that_change(spark):
    assert changes(lines(spark, many(), many(model=None, extra=5))) == [("c1/1", "added", "extra", ""), ("c1/1", "removed", "model", "")]
    assert changes(lines(spark, many(), many(model="other"))) == []


def test_renamed_at_the_top_and_inside(spark):
    assert changes(lines(spark, many(), many(x=rename("seed", "run_seed")))) == [("c1/1", "renamed", "seed", "run_seed")]

    def inner(r):
        r["attempts"][0]["reverted"] = r["attempts"][0].pop("rolled_back")

    assert changes(lines(spark, many(), many(x=inner))) == [("c1/1", "renamed", "attempts[].rolled_back", "attempts[].reverted")]


def test_retyped_hides_what_lies_inside(spark):
    assert changes(lines(spark, many(), many(attempts="none"))) == [("c1/1", "retyped", "attempts", "")]
    assert changes(lines(spark, many(), many(created_at="2025"))) == [("c1/1", "retyped", "created_at", "")]


def test_nulls_bad_lines_and_open_objects_say_nothing(spark):
    a, b = many(), many(metadata={"other": 1})
    b[0]["seed"] = None
    del b[1]["model"]
    assert changes(lines(spark, [*a, "{broken", None, ""], [*b, b[2]])) == []


def test_empty_table(spark):
    df = lines(spark, many()).limit(0)
    assert changes(df) == []
    assert drift.unified_records(df, drift.drift_report(df), {"seed": "bigint"}).count() == 0


def test_unified_records_follow_renames(spark):
    df = lines(spark, many(), many(x=rename("seed", "run_seed")), many(x=rename("seed", "rng_seed")))
    rep = drift.drift_report(df)
    got = drift.unified_records(df, rep, {"trajectory_id": "string", "seed": "bigint", "attempts": "array<string>"}).collect()
    assert len(got) == 24 and all(r["seed"] == int(r["trajectory_id"][1:]) * 37 for r in got)


def test_unified_records_have_every_field_and_value(spark):
    def later(r):
        r["created_at"] = "2025-01-05T00:00:01.5+00:00"
        r["createdBy"] = "x"
        r["line_no"] = 7
        r["seed"] = str(r["seed"])

    first = many(model=None)
    first[0]["created_by"] = "y"
    both = many(run_seed="kept")
    df = lines(spark, first, many(x=later, sandbox_image="i:1", elapsed_seconds=5), both)
    got = drift.unified_records(df, drift.drift_report(df))
    types = dict(got.dtypes)
    assert types["sandbox_image"] == "string" and types["elapsed_seconds"] == "bigint" and types["seed"] == "bigint" and types["created_at"] == "double" and types["metadata"] == "map<string,string>"
    rows = got.collect()
    second = [r for r in rows if r["file_seq"] == 1]
    assert len(second) == 8 and all(r["sandbox_image"] == "i:1" and r["elapsed_seconds"] == 5 and r["line_no_"] == 7 for r in second)
    assert all(r["created_at"] == 1736035201.5 and r["created_at_text"] == "2025-01-05T00:00:01.5+00:00" for r in second)
    assert sorted(r["seed"] for r in second) == [i * 37 for i in range(8)]
    by = "created_by" if "created_by" in types else "createdBy"
    assert sum(r[by] is not None for r in rows) == 9 and {r["run_seed"] for r in rows if r["file_seq"] == 2} == {"kept"}
    assert drift.unified_records(df.limit(0), drift.drift_report(df)).count() == 0


def profile(records):
    files = next(drift._profile_batches(iter([pd.DataFrame({"collector": "c", "file_seq": 0, "file_name": "f", "payload": [json.dumps(r) for r in records]})])))
    return files.to_dict("records")


def test_flooding_decides_where_no_records_are_shared(monkeypatch):
    def later(change):
        records = many(x=change)
        for r in records:
            r["trajectory_id"] = "later " + r["trajectory_id"]
        return profile(records)

    def other(r):
        del r["model"]
        r["sandbox_image"] = "registry.local/images/base:2025"

    assert drift.schema_changes(profile(many()), later(rename("seed", "run_seed"))) == [("renamed", "seed", "run_seed")]
    assert {x[0] for x in drift.schema_changes(profile(many()), later(other))} == {"removed", "added"}
    real = drift.flood

    def low(old, new, base):
        score = real(old, new, base)
        score[old.at["seed"], new.at["run_seed"]] = 0.01 * score.max()
        return score

    monkeypatch.setattr(drift, "flood", low)
    assert sorted(drift.schema_changes(profile(many()), later(rename("seed", "run_seed")))) == [("added", "run_seed", ""), ("removed", "seed", "")]


def test_flooding_makes_the_renames(spark, monkeypatch):
    """With shared records too: content only sets the first scores, what flows decides."""
    agree = {("seed", "run_seed"): (8, 8, 8)}
    files = profile(many()), profile(many(x=rename("seed", "run_seed")))
    assert drift.schema_changes(*files, agree) == [("renamed", "seed", "run_seed")]
    assert {x[0] for x in drift.schema_changes(*files, {("seed", "run_seed"): (8, 1, 1)})} == {"removed", "added"}
    monkeypatch.setattr(drift, "flood", lambda old, new, base: base * 0)
    assert {x[0] for x in drift.schema_changes(*files, agree)} == {"removed", "added"}


def test_lists_in_lists_are_walked_whole(spark):
    old = {"trajectory_id": "a", "x": [[{"p": 1}], [[{"q": 2}], {"r": 3}]]}
    assert changes(lines(spark, [old], [old | {"x": [[{"p": 1}], [[{"s": "two"}]]]}])) == [("c1/1", "added", "x[].s", ""), ("c1/1", "removed", "x[].q", ""), ("c1/1", "removed", "x[].r", "")]
    files = [[{"trajectory_id": f"t{i}", "x": [[{"p": 1}], [{n: i * 7}]]} for i in range(6)] for n in ("zz_a", "kind")]
    assert changes(lines(spark, *files)) == [("c1/1", "renamed", "x[].zz_a", "x[].kind")]


def test_content_counts_over_all_records(spark):
    """Files of many records that share few: no sketch could hold the shared ones of both."""
    a = [{"trajectory_id": f"a{i}", "left": f"value {i}", "k": i} for i in range(1500)]
    b = [{"trajectory_id": f"b{i}", "zq": f"other {i}", "k": i} for i in range(1500)] + [{"trajectory_id": f"a{i}", "zq": f"value {i}", "k": i} for i in range(0, 1500, 300)]
    assert changes(lines(spark, a, b)) == [("c1/1", "renamed", "left", "zq")]
    c = [r | ({"zq": "not that"} if r["trajectory_id"][0] == "a" else {}) for r in b]
    assert changes(lines(spark, a, c)) == [("c1/1", "added", "zq", ""), ("c1/1", "removed", "left", "")]


def test_name_likeness():
    assert drift.name_likeness("input_tokens", "inputTokens") == 1.0
    assert drift.name_likeness("llm_claimed_success", "claimed_success") > 0.5
    assert drift.name_likeness("task", "sandbox_image") < 0.4
