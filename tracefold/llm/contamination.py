"""Documents that repeat passages of evaluation items (problem 7): Wu-Manber search, then direct comparison."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tracefold.session import spread

#: Words of a search pattern, of its blocks, and of the shortest passage that counts. Of L >= 20 words of which L // 6 differ, four in a row
#: are equal (24 words with every fifth changed have no five).
M, B, PASSAGE = 4, 2, 20
#: Bits of a block's hash: the shift table has so many entries (of one byte), whatever the items are.
BITS = 20
#: Places of a text at which the search goes on at once.
LANES = 4096
#: One word in so many may differ.
ONE_IN = 6
#: A word is an item's own if so many items have it at most.
SPECIFIC = 2
#: Words looked at around a hit, on either side.
AROUND = 32
HITS = 5
#: Item words that one pass searches for; more items take more passes. It bounds what executors are sent.
WORDS_A_PASS = 400_000

#: Costs in an alignment of a word put in or left out, and of one replaced; a passage scores LEAST_SCORE at least.
GAP, OTHER = 0.55, 0.6
#: So many of PASSAGE words in a row of a longer passage may differ, in its best stretch of them: four of 24 can't be split better.
NEAR_OFF = 4
LEAST_SCORE = PASSAGE - PASSAGE // ONE_IN * (1 + OTHER) - 0.01

# What may stand before a line: quote and list marks, numbers, comment signs, a speaker, a clock time with up to three words and a separator.
_PREFIX = re.compile(r"^[ \t]*(?:(?:\[?\d{2}:\d{2}:\d{2}\]?(?:(?:[ \t]+[\w\-]+){1,3}[ \t]*(?:[-=]>|[,:|]))?|[>|#*+\-]+|\d+[ \t]*[|:)]|\d+\.(?=[ \t])|//+|[A-Za-z_]{1,12}[:>](?=[ \t]))[ \t]*)+", re.M)
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|&(?:[a-z]{2,6}|#\d{1,5});|\\[nrt](?![a-z]{2,}\\)")
_WORD = re.compile(r"[^\W_]+(?:_+[^\W_]+)*")


def words(text: str) -> list[str]:
    """The words of a text without case, punctuation, markup and what stands before a line."""
    if "<" in text or "&" in text or "\\" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(_PREFIX.sub("", text).lower())


@dataclass
class Index:
    """Shift table, suffix buckets and the items' words. Word 0 is any word the items don't have; pads compare equal to nothing."""

    vocabulary: dict[str, int]
    shift: np.ndarray  # by a block's hash: how far no pattern can end, 0 where one may
    suffix: np.ndarray  # sorted hashes of the blocks that end patterns
    first: np.ndarray  # where each suffix's bucket starts
    at: np.ndarray  # by bucket entry: where the pattern begins in `flat`
    flat: np.ndarray  # all items' words, padded
    item: np.ndarray  # the item row of each place
    form: np.ndarray  # whether a place is form text
    ids: np.ndarray
    specific: np.ndarray  # by word, whether at most SPECIFIC items (or a hundredth of them) have it


def form_places(items: list[list[str]]) -> list[np.ndarray]:
    """By item, which words lie in a run of PASSAGE or more words that another item has too."""
    held: dict[tuple, set] = {}
    for i, w in enumerate(items):
        for p in range(len(w) - PASSAGE + 1):
            held.setdefault(tuple(w[p : p + PASSAGE]), set()).add(i)
    out = []
    for w in items:
        mask = np.zeros(len(w), bool)
        for p in range(len(w) - PASSAGE + 1):
            if len(held[tuple(w[p : p + PASSAGE])]) > 1:
                mask[p : p + PASSAGE] = True
        out.append(mask)
    return out


def build_index(ids: list[int], items: list[list[str]], forms: list[np.ndarray]) -> Index:
    vocabulary: dict[str, int] = {}
    for w in items:
        for x in w:
            vocabulary.setdefault(x, len(vocabulary) + 1)
    holders = np.bincount([vocabulary[y] for w in items for y in set(w)], minlength=len(vocabulary) + 1)
    specific = (holders > 0) & (holders <= max(SPECIFIC, len(items) // 100))
    pad = np.full(2 * AROUND, -1, np.int32)
    flat, item, form = [pad], [np.full(len(pad), -1)], [np.ones(len(pad), bool)]
    for i, w in enumerate(items):
        flat += [np.array([vocabulary[x] for x in w], np.int32), pad]
        item += [np.full(len(w), i), np.full(len(pad), -1)]
        form += [forms[i], np.ones(len(pad), bool)]
    flat, item, form = np.concatenate(flat), np.concatenate(item), np.concatenate(form)
    starts = np.arange(len(flat) - M + 1)
    whole = np.ones(len(starts), bool)
    for k in range(M):
        whole &= (flat[starts + k] > 0) & ~form[starts + k]
    starts = starts[whole]
    shift = np.full(1 << BITS, M - B + 1, np.uint8)
    for end in range(B - 1, M):  # the block nearest to a pattern's end decides, also among blocks of the same hash
        np.minimum.at(shift, _block(flat[starts + end - 1], flat[starts + end]), M - 1 - end)
    last = _block(flat[starts + M - 2], flat[starts + M - 1])
    order = np.argsort(last, kind="stable")
    suffix, first = np.unique(last[order], return_index=True)
    return Index(vocabulary, shift, suffix, np.append(first, len(order)), starts[order], flat, item, form, np.array(ids), specific)


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring words, BITS wide."""
    h = (a.astype(np.int64) * 0x9E3779B1 + b) * 0x85EBCA77 & 0xFFFFFFFF
    return (h ^ h >> 15) & ((1 << BITS) - 1)


def stops(x: Index, text: np.ndarray) -> np.ndarray:
    """The places at which a pattern may end. The search jumps by the shift table from place to place, in LANES stretches of the text at once."""
    n = len(text)
    lanes = max(1, min(LANES, (n - M + 1) // (4 * M)))
    bounds = np.linspace(M - 1, max(n, M - 1), lanes + 1).astype(np.int64)
    at, end = bounds[:-1], bounds[1:]
    at, end = at[at < end], end[at < end]
    found = []
    while len(at):
        b, a = text[at], text[at - 1]
        jump = x.shift[_block(a, b)].astype(np.int64)
        # A word that no item has is in no pattern: none ends before the place M (or M - 1) words on.
        jump[a <= 0] = M - 1
        jump[b <= 0] = M
        stop = jump == 0
        found.append(at[stop])
        at = at + np.maximum(jump, 1)
        on = at < end
        if not on.all():
            at, end = at[on], end[on]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def search(x: Index, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text place, item place) of every occurrence of every pattern in a padded text of word numbers."""
    if not len(x.suffix):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = stops(x, text)
    block = _block(text[ends - 1], text[ends])
    bucket = np.minimum(np.searchsorted(x.suffix, block), len(x.suffix) - 1)
    ends, bucket = ends[x.suffix[bucket] == block], bucket[x.suffix[bucket] == block]
    n = x.first[bucket + 1] - x.first[bucket]
    at = np.repeat(ends - M + 1, n)
    entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(x.first[bucket], n)
    where = x.at[entry]
    for k in range(M - 1, -1, -1):
        same = text[at + k] == x.flat[where + k]
        at, where = at[same], where[same]
    return at, where


def alignment_scores(texts: np.ndarray, items: np.ndarray) -> np.ndarray:
    """The best local alignment score of each row of items in the same row of texts, all rows at once."""
    n, m = items.shape[1], texts.shape[1]
    steps = np.arange(m + 1, dtype=np.float32) * GAP
    before, best = np.zeros((len(items), m + 1), np.float32), np.zeros(len(items), np.float32)
    for i in range(n):
        w = items[:, i : i + 1]
        row = np.zeros_like(before)
        row[:, 1:] = np.maximum(before[:, 1:] - GAP, before[:, :-1] + np.where((w == texts) & (w > 0), np.float32(1), np.float32(-OTHER)))
        np.maximum(row, 0, out=row)
        before = np.maximum.accumulate(row + steps, axis=1) - steps
        best = np.maximum(best, before.max(1))
    return best


def aligned(text: np.ndarray, item: np.ndarray, form: np.ndarray, specific: np.ndarray) -> bool:
    """Whether some PASSAGE or more words of the item stand in the text with one in ONE_IN differing at most.

    A word differs if it is replaced, left out or put in. Form text is no part of a passage.
    """
    n, m = len(item), len(text)
    eq = (item[:, None] == text[None, :]) & (item[:, None] > 0)
    score = np.zeros((n + 1, m + 1), np.float32)
    steps = np.arange(m + 1, dtype=np.float32) * GAP
    for i in range(1, n + 1):
        best = np.maximum(score[i - 1, 1:] - GAP, score[i - 1, :-1] + np.where(eq[i - 1], 1.0, -OTHER))
        row = np.concatenate([[0], best])
        row = np.maximum(row, 0)
        score[i] = np.maximum.accumulate(row + steps) - steps
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    ops: list[tuple[int, bool]] = []  # +1 same, -5 replaced or left out, -6 put in, 0 form; and whether the word is the item's own
    while i > 0 and j > 0 and score[i, j] > 0:
        s = score[i, j]
        if abs(s - (score[i - 1, j - 1] + (1.0 if eq[i - 1, j - 1] else -OTHER))) < 1e-4:
            ops.append((0 if form[i - 1] else 1 if eq[i - 1, j - 1] else 1 - ONE_IN, bool(specific[i - 1])))
            i, j = i - 1, j - 1
        elif abs(s - (score[i - 1, j] - GAP)) < 1e-4:
            ops.append((0 if form[i - 1] else 1 - ONE_IN, bool(specific[i - 1])))
            i -= 1
        else:
            ops.append((-ONE_IN, False))
            j -= 1
    return passage_in(ops)


def passage_in(ops: list[tuple[int, bool]]) -> bool:
    """Whether a stretch of (op, specific) has PASSAGE item words, few enough that differ, and keeps what is the item's own.

    Of the specific words, those that hardly any other item has, at least one and at least half must be the same: stock phrases
    around other names are no copy.
    """
    part: list[tuple[int, bool]] = []
    for o in [*ops, (0, False)]:
        if o[0]:
            part.append(o)
            continue
        if len(part) >= PASSAGE:
            op, own = np.array([x for x, _ in part]), np.array([y for _, y in part])
            sums = [np.concatenate([[0], np.cumsum(c)]) for c in (op, op != -ONE_IN, own & (op == 1), own & (op == 1 - ONE_IN))]
            total, of_item, kept, lost = (c[None, :] - c[:, None] for c in sums)
            if ((total >= 0) & (of_item >= PASSAGE) & (kept >= np.maximum(1, lost))).any():
                return True
        part = []
    return False


def leaks(x: Index, texts: list[str]) -> list[tuple[int, int]]:
    """(text, item row) of the texts that repeat a passage of an item."""
    get = x.vocabulary.get
    pad = np.full(2 * AROUND, -2, np.int32)
    parts, owner = [pad], [np.full(len(pad), -1)]
    for i, t in enumerate(texts):
        w = np.fromiter((get(y, 0) for y in words(t)), np.int32)
        parts += [w, pad]
        owner += [np.full(len(w), i), np.full(len(pad), -1)]
    text, owner = np.concatenate(parts), np.concatenate(owner)
    at, where = search(x, text)
    # A passage of L words of which d differ has L - 4 d - 3 patterns at least, which is HITS or more within AROUND words.
    pair = owner[at] * len(x.ids) + x.item[where]
    order = np.lexsort((at, pair))
    at, where = at[order], where[order]
    line = pair[order] * (len(text) + 2 * AROUND) + at
    many = np.searchsorted(line, line + AROUND, "right") - np.searchsorted(line, line - AROUND) >= HITS
    at, where = at[many], where[many]
    # One hit a text, item, diagonal and stretch stands for its neighbours.
    # (texts and items stand apart, so a stretch and a diagonal have one of each)
    _, pick = np.unique((at // 8) * (len(text) + len(x.flat)) + (at - where + len(x.flat)), return_index=True)
    at, where = at[pick], where[pick]
    found: set[tuple[int, int]] = set()
    spread = np.arange(-PASSAGE + M, PASSAGE)
    wide = np.arange(-PASSAGE + M - 4, PASSAGE + 4)
    around = np.arange(-AROUND, M + AROUND)
    for lo in range(0, len(at), 4096):
        a, w = at[lo : lo + 4096], where[lo : lo + 4096]
        # Of some PASSAGE words of a passage all but NEAR_OFF are near the hit; few chance hits have so many.
        mine = x.flat[w[:, None] + spread]
        there = np.zeros(mine.shape, bool)
        near = text[a[:, None] + wide]
        for k in range(near.shape[1]):
            there |= mine == near[:, k : k + 1]
        there &= ~x.form[w[:, None] + spread]
        run = np.cumsum(np.pad(there, ((0, 0), (1, 0))), 1)
        close = (run[:, PASSAGE:] - run[:, :-PASSAGE]).max(1) >= PASSAGE - NEAR_OFF
        a, w = a[close], w[close]
        if not len(a):
            continue
        rows_text, rows_item = a[:, None] + around, w[:, None] + around
        t = np.where(owner[rows_text] == owner[a][:, None], text[rows_text], -2)
        own = x.item[rows_item] == x.item[w][:, None]
        i, form = np.where(own, x.flat[rows_item], -1), x.form[rows_item] | ~own
        scores = alignment_scores(t, np.where(form, -1, i))
        mine = own & ~form & x.specific[np.maximum(i, 0)]
        for h in sorted(np.flatnonzero(scores >= LEAST_SCORE), key=lambda h: -scores[h]):
            both = (int(owner[a[h]]), int(x.item[w[h]]))
            if both not in found and np.isin(i[h][mine[h]], t[h]).any() and aligned(t[h], i[h], form[h], mine[h]):
                found.add(both)
    return sorted(found)


def eval_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that repeat, wholly or in part, a passage of an item.

    A passage is PASSAGE or more words of the item in a row of which one in ONE_IN may differ; case, punctuation, spacing, markup and what
    stands before lines don't count. Any such passage holds M words in a row that are equal (see M), so the search for all M-word patterns misses none. What is left of the item's own words counts, see passage_in. Form text, i.e. PASSAGE or more words in a row that several items have, is
    neither searched for nor counted.

    Null, empty and blank texts give no rows; repeated documents give a row each. Items must fit the driver, as a held-out set does; they are
    searched for in blocks of WORDS_A_PASS words, which bounds what executors get. Other columns are ignored.
    """
    spark = documents.sparkSession
    rows = items.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text").collect()
    texts = [words(r["text"]) for r in rows]
    forms = form_places(texts)
    docs = spread(documents.select("doc_id", "text"), "doc_id").where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text")
    out = None
    start = 0
    while start < len(rows) or out is None:
        stop, n = start, 0
        while stop < len(rows) and (stop == start or n + len(texts[stop]) <= WORDS_A_PASS):
            n += len(texts[stop])
            stop += 1
        index = spark.sparkContext.broadcast(build_index([r["item_id"] for r in rows[start:stop]], texts[start:stop], forms[start:stop]))

        def find(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            x = index.value
            for b in batches:
                # Texts that are read together are bounded by their length, too.
                ids, held, size = [], [], 0
                for d, t in zip(b["doc_id"], b["text"]):
                    ids.append(d)
                    held.append(t)
                    size += len(t)
                    if size > 8_000_000:
                        yield _rows(x, ids, held)
                        ids, held, size = [], [], 0
                if ids:
                    yield _rows(x, ids, held)

        part = docs.mapInPandas(find, "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
        start = max(stop, start + 1)
    return out.distinct()


def _rows(x: Index, ids: list[int], texts: list[str]) -> pd.DataFrame:
    hits = leaks(x, texts)
    return pd.DataFrame({"doc_id": [ids[i] for i, _ in hits], "item_id": [int(x.ids[j]) for _, j in hits]}, dtype="int64")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, item_kind, n_documents): the items that leaked, and into how many documents."""
    hits = eval_leaks(documents, items).groupBy("item_id").count().withColumnRenamed("count", "n_documents")
    return hits.join(items.select("item_id", "item_kind").distinct(), "item_id").select("item_id", "item_kind", "n_documents")
