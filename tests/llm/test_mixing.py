import os

import pytest

from tracefold.llm import mixing

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no vocabulary here")
TARGETS = "source string, target_permille long, max_repeats long"


def docs(spark, **n):
    rows = [(k * 10_000 + i, name.replace("_", "-").upper() if i % 2 else name, "some words of a text, again and again. " * (i % 5)) for k, (name, m) in enumerate(n.items()) for i in range(m)]
    return spark.createDataFrame([*rows, (-1, None, "x"), (-2, "big_one", None)], "doc_id long, source string, text string")


def test_short_sources(spark):
    d = docs(spark, big_one=600, small=60, tiny=3)
    t = spark.createDataFrame([("big_one", 500, 1), ("small", 300, 4), ("tiny", 150, 9), ("absent", 50, 2)], TARGETS)
    assert sorted(r["source"] for r in mixing.short_sources(d, t).collect()) == ["absent", "tiny"]


def test_only_sources_near_their_last_slot_are_asked(spark):
    d = docs(spark, big_one=900, small=60, tiny=3)
    t = spark.createDataFrame([("big_one", 500, 1), ("small", 300, 40), ("tiny", 200, 1)], TARGETS)
    for block in (64, 512, 16_384):
        s = mixing.slot_schedule(mixing.source_supply(mixing.token_counts(d), t), block)
        rows = {r["source"]: r for r in mixing.used_up(s).collect()}
        assert [k for k, r in rows.items() if r["falls_short"]] == ["tiny"] == [r["source"] for r in mixing.short_sources(d, t, block_tokens=block).collect()]
        if block == 64:
            assert rows["tiny"]["slots"] > rows["tiny"]["n_blocks"] and rows["small"]["slots"] < rows["small"]["n_blocks"] * 40


def test_mixture_has_the_shares_and_caps_repeats(spark):
    d = docs(spark, big_one=3000, small=700)
    t = spark.createDataFrame([("big_one", 600, 1), ("small", 400, 3)], TARGETS)
    rep = {r["source"]: r for r in mixing.mix_report(d, t, block_tokens=512).collect()}
    assert abs(rep["small"]["actual_permille"] - 400) < 15 and abs(rep["big_one"]["actual_permille"] - 600) < 15
    mix = mixing.mix_schedule(d, t, block_tokens=512).toPandas()
    assert mix.groupby(["source", "doc_id"]).size().max() <= 3 and mix[mix.source == "big_one"].groupby("doc_id").size().max() == 1
    # every stretch of slots has nearly the shares
    first = mix[mix.slot < 40].groupby("source").slot.nunique()
    assert abs(first["small"] - 16) <= 3


def test_used_up_sources_leave_their_slots_empty(spark):
    d = docs(spark, big_one=900, small=40)
    t = spark.createDataFrame([("big_one", 500, 1), ("small", 500, 2), (None, 5, 5)], TARGETS)
    rep = {r["source"]: r for r in mixing.mix_report(d, t, block_tokens=256).collect()}
    assert rep["small"]["falls_short"] and rep["small"]["mixed"] <= rep["small"]["most"]


def test_empty(spark):
    t = spark.createDataFrame([("a", 500, 1)], TARGETS)
    d = docs(spark, a=3).limit(0)
    assert mixing.mix_schedule(d, t).count() == 0 and mixing.short_sources(d, t).count() == 0
    assert mixing.mix_schedule(docs(spark, a=3), t.limit(0)).count() == 0
