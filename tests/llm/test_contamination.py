import random

import pytest

from tracefold.llm import contamination as c

R = random.Random(4)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ri", "so", "tu") for b in ("ban", "der", "fim", "gol", "hus", "jit", "kem", "lap", "mov", "nax")]


def prose(n, tag):
    return [f"{R.choice(WORDS)}{tag}{i % 7}" for i in range(n)]


ITEMS = [prose(80, f"x{k}") for k in range(6)]
FORM = prose(30, "form")
for _k in (0, 1, 2):
    ITEMS[_k] = FORM + ITEMS[_k]


def leaks(spark, *texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(100 + k, "k", " ".join(w)) for k, w in enumerate(ITEMS)], "item_id long, item_kind string, text string")
    return sorted((r["doc_id"], r["item_id"]) for r in c.eval_leaks(docs, items).collect())


def test_passages_in_other_clothes(spark):
    w = ITEMS[4][10:40]
    texts = [
        "Intro. " + " ".join(w) + " end.", " ".join(x.upper() for x in w), "\n".join("> " + " ".join(w[i : i + 6]) for i in range(0, 30, 6)), "\n".join(f"{i}| " + " ".join(w[i : i + 5]) for i in range(0, 30, 5)),
        " ".join(f"**{x}**," for x in w), "<p>" + "</p> <p>".join(w) + "</p>", " ".join(w[:20]),
    ]
    assert leaks(spark, *texts) == [(i, 104) for i in range(len(texts))]


def test_one_word_in_six_may_differ(spark):
    w = ITEMS[5][20:44]
    changed = [x if i % 6 != 5 else "other" for i, x in enumerate(w)]
    dropped = [x for i, x in enumerate(w) if i not in (6, 13)]
    added = w[:8] + ["new"] + w[8:16] + ["words"] + w[16:]
    assert leaks(spark, *(" ".join(x) for x in (changed, dropped, added))) == [(i, 105) for i in range(3)]
    assert leaks(spark, " ".join(x if i % 4 != 3 else "other" for i, x in enumerate(w))) == []


def test_no_leaks(spark):
    w = ITEMS[3]
    shuffled = [x for k in range(0, 60, 5) for x in reversed(w[k : k + 5])]
    assert leaks(spark, " ".join(w[:19]), " ".join(shuffled), " ".join(FORM), " ".join(FORM + ["my", "own"] * 20), None, "", " \n", "see item 103") == []


def test_long_texts_and_copies(spark):
    long = " ".join(prose(40_000, "z") + ITEMS[3][:25] + prose(40_000, "z"))
    assert leaks(spark, long, long) == [(0, 103), (1, 103)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "k", None)], "item_id long, item_kind string, text string")
    assert c.eval_leaks(docs, items).count() == 0 and c.eval_leaks(docs.limit(0), items).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(c, "WORDS_A_PASS", 100)
    assert leaks(spark, " ".join(ITEMS[0][40:70]), " ".join(ITEMS[5][:30])) == [(0, 100), (1, 105)]


def test_search_equals_direct_comparison():
    index = c.build_index(list(range(6)), ITEMS, c.form_places(ITEMS))
    import numpy as np

    words = [x for _ in range(40) for x in (R.choice(ITEMS)[R.randrange(60) :][: R.randrange(3, 12)])]
    text = np.concatenate([np.full(64, -2), [index.vocabulary.get(x, 0) for x in words], np.full(64, -2)])
    at, where = c.search(index, text)
    want = {(i, j) for i in range(len(text) - c.M) for j in index.at if (text[i : i + c.M] == index.flat[j : j + c.M]).all()}
    assert set(zip(at.tolist(), where.tolist())) == {(int(a), int(b)) for a, b in want}


def test_search_jumps():
    """Of a text without item words only each M-th place is looked at."""
    import numpy as np

    index = c.build_index(list(range(6)), ITEMS, c.form_places(ITEMS))
    looked = []

    class Text(np.ndarray):
        def __getitem__(self, k):
            if isinstance(k, np.ndarray):
                looked.append(k.size)
            return np.asarray(super().__getitem__(k))

    text = np.concatenate([np.zeros(40_000, np.int32), [index.vocabulary[x] for x in ITEMS[4]], np.zeros(40_000, np.int32)]).view(Text)
    assert len(c.stops(index, text)) >= len(ITEMS[4]) - c.M + 1
    assert sum(looked) / 2 < len(text) / c.M * 1.1 + 200


def test_four_of_24_words_changed(spark):
    w = ITEMS[5][20:44]
    assert leaks(spark, " ".join(x if i % 5 != 4 else "other" for i, x in enumerate(w)), " ".join(x if i % 4 != 3 else "other" for i, x in enumerate(w))) == [(0, 105)]


def test_any_passage_within_the_limit(spark):
    """Passages of all lengths with as many replaced words as may be, at random places, are found."""
    r = random.Random(8)
    texts = []
    for n in [*range(20, 50), 60, 75]:
        for _ in range(3):
            w = list(ITEMS[4][2 : 2 + n])
            at = r.sample(range(1, len(w) - 1), len(w) // 6)
            texts.append(" ".join(["before"] * 30 + [f"no{k}" if k in at else x for k, x in enumerate(w)] + ["after"] * 30))
    assert leaks(spark, *texts) == [(i, 104) for i in range(len(texts))]


def test_heads_of_log_lines(spark):
    w = ITEMS[4][10:40]
    heads = ("[07:08:38] bash:", "07:08:42 file_read ->", "[07:08:58] file edit finished,", "07:08:58 a =>")
    texts = ["\n".join(f"{h} " + " ".join(w[i : i + 6]) for i in range(0, 30, 6)) for h in heads]
    assert leaks(spark, *texts) == [(i, 104) for i in range(len(texts))]


@pytest.mark.parametrize("ops, want", [([1] * 20, True), ([1] * 19, False), ([1] * 10 + [0] + [1] * 12, False), ([1] * 9 + [-5] + [1] * 9 + [-5] + [1] * 3, True), ([1, 1, -5] * 10, False)])
def test_passage_in(ops, want):
    assert c.passage_in([(o, True) for o in ops]) is want
