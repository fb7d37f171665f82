"""Schemas that drift between the files of a collector (problem 6), matched by similarity flooding."""

from __future__ import annotations

import difflib
import json
import math
import re
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.session import apart, checkpointed, spread

#: Objects whose members are data, not fields.
OPEN = ("metadata", "params")
#: Share of the flooded score of fields that keep their name from which a removed and an added field correspond.
FLOODED = 0.6
_KINDS = {str: "string", bool: "boolean", int: "number", float: "number", dict: "object", list: "array"}
_PROFILE = "collector string, file_seq long, file_name string, path string, kinds array<string>, n long, stats array<double>"
_CONTENT = "collector string, pair long, k long, is_new boolean, path string, v long"
_AGREE = "array<struct<old:string,new:string,shared:bigint,same:bigint,distinct:bigint>>"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _text(v: object) -> str:
    """A value's content, whatever type carries it: 5 and "5", true and "True" are the same."""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return str(int(v))
    if isinstance(v, (dict, list)):
        return json.dumps(list(v.values()) if isinstance(v, dict) else v, sort_keys=True)
    return str(v).strip().lower() if not isinstance(v, str) else re.sub(r"^(-?\d+)\.0+$", r"\1", v.strip().lower())


_DIGIT, _UPPER = re.compile(r"\d"), re.compile(r"[A-Z]")


def _stats(v: object) -> tuple:
    """What a value looks like: counts and sums that add up over values."""
    if isinstance(v, str):
        return (1, 0, 0.0, 0, 0, 1, min(len(v), 2000), " " in v, "/" in v or "\\" in v, _DIGIT.search(v) is not None, _UPPER.search(v) is not None, 0, 0)
    if isinstance(v, bool):
        return (1, 0, 0.0, 1, v, 0, 0, 0, 0, 0, 0, 0, 0)
    if isinstance(v, (int, float)):
        return (1, 1, math.log10(abs(v) + 1) if math.isfinite(v) else 0.0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0)
    return (1, 0, 0.0, 0, 0, 0, 0, 0, 0, 0, 0, 1, len(v))


def _members(v: object) -> Iterator[tuple[str, dict]]:
    """The objects in a list, those in lists inside it too, each with its place."""
    todo = [("", v)]
    while todo:
        at, x = todo.pop()
        if isinstance(x, list):
            todo += [(f"{at}.{i}", y) for i, y in enumerate(x)]
        elif isinstance(x, dict):
            yield at, x


def _walk(value: dict, path: str, out: dict, seen: set) -> None:
    """Adds to out[path] what each member is: kinds, number of lines, and stats."""
    for name, v in value.items():
        p = f"{path}.{name}" if path else name
        e = out.get(p)
        if e is None:
            e = out[p] = [set(), 0, [0.0] * 13]
        if p not in seen:
            seen.add(p)
            e[1] += 1
        if v is None:
            continue
        e[0].add(_KINDS[type(v)])
        total = e[2]
        for i, x in enumerate(_stats(v)):
            if x:
                total[i] += x
        if name in OPEN:
            continue
        if isinstance(v, dict):
            _walk(v, p, out, seen)
        elif isinstance(v, list):
            inner = f"{p}[]"
            for _, x in _members(v):
                out.setdefault(inner, [{"object"}, 0, [0.0] * 13])[1] += 1
                _walk(x, inner, out, seen)


def _containers(value: dict, path: str, at: str, wanted: set[str]) -> Iterator[tuple[str, str, dict]]:
    """(path, place, object) of the objects at or above the wanted paths."""
    yield path, at, value
    for name, v in value.items():
        p = f"{path}.{name}" if path else name
        if name not in OPEN and isinstance(v, (dict, list)) and (p in wanted or f"{p}[]" in wanted):
            if isinstance(v, dict):
                yield from _containers(v, p, at, wanted)
            else:
                for i, x in _members(v):
                    yield from _containers(x, f"{p}[]", at + i, wanted)


def _record_place(o: dict) -> str:
    """What tells a record from others, whatever its fields are called: its run id, else its longest plain value."""
    ids = [v for k, v in o.items() if isinstance(v, str) and re.sub(r"[^a-z]", "", k.lower()) in ("trajectoryid", "runid", "recordid")]
    if ids:
        return ids[0]
    texts = [v for v in o.values() if isinstance(v, str)]
    return max(texts, key=lambda v: (len(v), v), default="")


def _parsed(text: object) -> dict | None:
    try:
        o = json.loads(text) if isinstance(text, str) else None
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


def _profile_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        files: dict = {}
        for c, s, f, p in zip(b["collector"], b["file_seq"], b["file_name"], b["payload"]):
            o = _parsed(p)
            if o is not None:
                _walk(o, "", files.setdefault((c, s, f), {}), set())
        rows = [(c, s, f, p, sorted(k), n, [float(x) for x in st]) for (c, s, f), paths in files.items() for p, (k, n, st) in paths.items()]
        yield pd.DataFrame(rows, columns=["collector", "file_seq", "file_name", "path", "kinds", "n", "stats"])


def _placed_lines(lines: DataFrame) -> DataFrame:
    rows = lines.where("file_seq IS NOT NULL")
    return rows.select(F.col("collector").cast("string").alias("collector"), F.col("file_seq").cast("long").alias("file_seq"), F.col("file_name").cast("string").alias("file_name"), F.col("payload").cast("string").alias("payload"))


def file_profiles(lines: DataFrame) -> DataFrame:
    """One row per file and field path: its types, lines, and what its values look like.

    Lines are profiled where they are read; only sums and type sets of each field move. Lines
    that don't parse to an object, and lines without file_seq, say nothing about a file's fields.
    """
    parts = spread(_placed_lines(lines), "file_name", "payload").mapInPandas(_profile_batches, _PROFILE)
    stats = F.array(*[F.sum(F.col("stats")[i]) for i in range(13)])
    return parts.groupBy("collector", "file_seq", "file_name", "path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"), F.sum("n").alias("n"), stats.alias("stats"))


def _content_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The values of the asked fields of each line, by record place."""
    for b in batches:
        rows = []
        for c, p, asked in zip(b["collector"], b["payload"], b["asked"]):
            o = _parsed(p)
            if o is None:
                continue
            fields: dict[str, list] = {}
            wanted: set[str] = set()
            for x in asked:
                up, _, name = x["path"].rpartition(".")
                fields.setdefault(up, []).append((x["pair"], x["is_new"], x["path"], name))
                while up and up not in wanted:
                    wanted.add(up)
                    up = up[:-2] if up.endswith("[]") else up.rpartition(".")[0]
            for path, at, inside in _containers(o, "", _record_place(o), wanted):
                for pair, is_new, full, name in fields.get(path, ()):
                    if inside.get(name) is not None:
                        rows.append((c, pair, _hash(f"{at}|{path}"), is_new, full, _hash(_text(inside[name]))))
        yield pd.DataFrame(rows, columns=["collector", "pair", "k", "is_new", "path", "v"])


def content_agreements(lines: DataFrame, sided: DataFrame) -> DataFrame:
    """(collector, pair, agree): of the fields that one file of a pair has and the other hasn't, how far their values are the same in the records that both hold.

    sided: (collector, pair, is_new, path, file_seq). Fields are compared within the same parent. Only lines of such files are read again and only these fields' values move; all
    records count, by a join on the record's place.
    """
    same = F.bit_or(F.when(F.col("is_new"), 2).otherwise(1))
    one = sided.where("NOT endswith(path, '[]')").groupBy("collector", "pair", "path").agg(same.alias("sides"), F.first("is_new").alias("is_new"), F.first("file_seq").alias("file_seq")).where("sides < 3")
    one = one.withColumn("parent", F.regexp_replace("path", r"(^|\.)[^.]*$", ""))
    whole = one.groupBy("collector", "pair", "parent").agg(F.bit_or("sides").alias("all_sides")).where("all_sides = 3").select(F.col("collector").alias("_c"), F.col("pair").alias("_p"), F.col("parent").alias("_q"))
    both = one.join(whole, F.col("collector").eqNullSafe(F.col("_c")) & (F.col("pair") == F.col("_p")) & (F.col("parent") == F.col("_q")), "left_semi")
    asked = both.groupBy(F.col("collector").alias("_c"), F.col("file_seq").alias("_s")).agg(F.collect_list(F.struct("pair", "is_new", "path")).alias("asked"))
    rows = _placed_lines(lines).join(asked, F.col("collector").eqNullSafe(F.col("_c")) & (F.col("file_seq") == F.col("_s"))).select("collector", "payload", "asked")
    values = rows.mapInPandas(_content_batches, _CONTENT).groupBy("collector", "pair", "k", "is_new", "path").agg(F.max("v").alias("v"))
    at = values.groupBy("collector", "pair", "k").agg(F.collect_list(F.when(~F.col("is_new"), F.struct("path", "v"))).alias("a"), F.collect_list(F.when(F.col("is_new"), F.struct("path", "v"))).alias("b"))
    pairs = at.select("collector", "pair", F.explode("a").alias("a"), "b").select("collector", "pair", "a", F.explode("b").alias("b")).withColumn("same", F.col("a.v") == F.col("b.v"))
    agree = pairs.groupBy("collector", "pair", F.col("a.path").alias("old"), F.col("b.path").alias("new")).agg(F.count("*").alias("shared"), F.count_if("same").alias("same"), F.count_distinct(F.when(F.col("same"), F.col("a.v"))).alias("distinct"))
    return agree.groupBy("collector", "pair").agg(F.collect_list(F.struct("old", "new", "shared", "same", "distinct")).alias("agree"))


def _words(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)}


@lru_cache(maxsize=100_000)
def name_likeness(a: str, b: str) -> float:
    """1 for the same words; shared words and letters count."""
    x, y = _words(a), _words(b)
    if x == y and x:
        return 1.0
    shared = len(x & y) / max(1, min(len(x), len(y)))
    jaccard = len(x & y) / max(1, len(x | y))
    letters = difflib.SequenceMatcher(None, "".join(sorted(x)) if x else a, "".join(sorted(y)) if y else b).ratio()
    plain = difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()
    return max(0.5 * shared + 0.4 * jaccard, 0.9 * plain, 0.6 * letters * (shared > 0))


def _looks(s: list[float]) -> np.ndarray:
    n = max(1.0, s[0])
    return np.array([s[1] / n, s[2] / max(1.0, s[1]), s[3] / n, s[4] / max(1.0, s[3]), s[5] / n, math.log1p(s[6] / max(1.0, s[5])), s[7] / n, s[8] / n, s[9] / n, s[10] / n, s[11] / n, math.log1p(s[12] / max(1.0, s[11]))])


class Side:
    """A file's schema graph: fields, their parents and types, and what they hold."""

    def __init__(self, rows: list[dict]):
        rows = sorted(rows, key=lambda r: r["path"])
        self.paths = [r["path"] for r in rows]
        self.at = {p: i for i, p in enumerate(self.paths)}
        self.kinds = [set(r["kinds"]) for r in rows]
        self.looks = [_looks(list(r["stats"])) for r in rows]
        self.full = [r["stats"][0] > 0 for r in rows]
        self.name = [re.split(r"\.", p)[-1] for p in self.paths]
        self.parent = [self.at.get(p.rpartition(".")[0], -1) if not p.endswith("[]") else self.at.get(p[:-2], -1) for p in self.paths]
        self.links = np.zeros((len(rows), len(rows)))
        for i, p in enumerate(self.parent):
            if p >= 0:
                self.links[p, i] = 1.0

    def inside(self, i: int) -> set[str]:
        """The paths of the fields inside a field, from it on."""
        p = self.paths[i]
        return {q[len(p) :] for q in self.paths if q.startswith((p + ".", p + "[]."))}


def first_scores(old: Side, new: Side, agree: dict[tuple[str, str], tuple[int, int, int]]) -> np.ndarray:
    """How alike all old and all new fields are before anything flows: by names, types, looks of the values, and what is known of a removed and an added field's content.

    agree: by (old path, new path) of these, the records that both files hold, those with the same value, and the different values among them. Where that says something, nearly
    the same values or hardly any, it outweighs the rest; where it says little, as for flags that are always false, it is one sign among them. Fields with the same
    fields inside are alike, fields with other types aren't.
    """
    names = np.array([[1.0 if a == b else name_likeness(x, y) for b, y in zip(new.paths, new.name)] for a, x in zip(old.paths, old.name)])
    bits = {k: 1 << i for i, k in enumerate(("string", "boolean", "number", "object", "array"))}
    have_old, have_new = (np.array([[bool(m & b) for b in bits.values()] for m in (sum(bits[k] for k in ks) for ks in x.kinds)], float) for x in (old, new))
    both = have_old @ have_new.T
    either = have_old.sum(1)[:, None] + have_new.sum(1)[None, :] - both
    types = np.where(either > 0, both / np.maximum(either, 1), 0.5)
    looks = np.exp(-np.abs(np.array(old.looks)[:, None, :] - np.array(new.looks)[None, :, :]).sum(2))
    looks = np.where(np.outer(old.full, new.full), looks, 0.3)
    lists = np.array([p.endswith("[]") for p in old.paths])[:, None] == np.array([p.endswith("[]") for p in new.paths])[None, :]
    base = (0.5 * names + 0.2 * types + 0.3 * looks) * lists
    for i, a in enumerate(old.paths):
        for j, b in enumerate(new.paths):
            if a in new.at or b in old.at or a.endswith("[]") or b.endswith("[]") or a.rpartition(".")[0] != b.rpartition(".")[0]:
                continue
            if old.kinds[i] and new.kinds[j] and not (old.kinds[i] & new.kinds[j]):
                base[i, j] = 0.0
                continue
            inner_old, inner_new = old.inside(i), new.inside(j)
            if inner_old and inner_new:
                alike = len(inner_old & inner_new) / len(inner_old | inner_new)
                if alike >= 0.6 or alike < 0.2:
                    base[i, j] = 0.7 + 0.2 * alike + 0.1 * names[i, j] if alike >= 0.6 else 0.0
                    continue
            shared, same, distinct = agree.get((a, b), (0, 0, 0))
            share = same / shared if shared else 0.0
            if shared >= 2 and share < 0.8:
                base[i, j] = 0.0
            elif shared >= 2 and (distinct >= 3 or (distinct == 2 and shared >= 6)):
                base[i, j] = 0.7 + 0.2 * share + 0.1 * names[i, j]
            else:
                base[i, j] += (share - base[i, j]) * shared / (shared + 2)
    return base


def flood(old: Side, new: Side, base: np.ndarray, rounds: int = 50, close: float = 1e-3) -> np.ndarray:
    """The match scores of all old with all new fields after similarity flooding from the first scores.

    Scores flow between pairs along equal edges of both graphs: from a pair of
    objects to the pairs of their members and back, a pair's share divided by the number of its edges, until nothing moves.
    """
    down_old, down_new = (x / np.maximum(1, x.sum(1, keepdims=True)) for x in (old.links, new.links))
    score = base.copy()
    for _ in range(rounds):
        spread = score + base
        moved = base + score + down_old.T @ spread @ down_new + old.links @ spread @ new.links.T / np.maximum(1, np.outer(old.links.sum(1), new.links.sum(1)))
        moved /= moved.max() or 1
        done = np.abs(moved - score).max() < close
        score = moved
        if done:
            break
    return score


def schema_changes(old_rows: list[dict], new_rows: list[dict], agree: dict[tuple[str, str], tuple[int, int, int]] | None = None) -> list[tuple[str, str, str]]:
    """(change_kind, field_path, new_path) between two files' profiles; only the outermost changed fields.

    A removed and an added field of the same parent correspond if their flooded score is FLOODED of that of fields that keep their name, or more; of several
    the best pairs are taken in order of the score, which is a stable matching.
    """
    old, new = Side(old_rows), Side(new_rows)
    changes: list[tuple[str, str, str]] = []
    inside: set[str] = set()
    # Each level is decided before its members: what lies inside a changed field isn't looked at.
    gone, come = {}, {}
    kept = [p for p in old.paths if p in new.at and not p.endswith("[]")]
    for p in sorted(kept, key=len):
        a, b = old.kinds[old.at[p]], new.kinds[new.at[p]]
        if a and b and not (a & b) and not any(p.startswith((q + ".", q + "[")) for q in inside):
            changes.append(("retyped", p, ""))
            inside.add(p)

    def parent(p: str) -> str:
        return p.rpartition(".")[0]

    def comparable(p: str) -> bool:
        """Whether both files have objects that could hold the field, unchanged themselves."""
        q = parent(p)
        return not any(p.startswith((x + ".", x + "[")) for x in inside) and (q == "" or (q in old.at and q in new.at and _holds(old, q) and _holds(new, q)))

    def _holds(side: Side, q: str) -> bool:
        return q.endswith("[]") or "object" in side.kinds[side.at[q]]

    for side, other, out in ((old, new, gone), (new, old, come)):
        for p in side.paths:
            if not p.endswith("[]") and p not in other.at and comparable(p):
                out.setdefault(parent(p), []).append(p)
    score = None
    for q in sorted(gone.keys() | come.keys()):
        pairs = []
        if gone.get(q) and come.get(q):
            score = flood(old, new, first_scores(old, new, agree or {})) if score is None else score
            known = _known_score(old, new, score, q)
            pairs = [(score[old.at[a], new.at[b]] / known, a, b) for a in gone[q] for b in come[q]]
            pairs = [x for x in pairs if x[0] >= FLOODED and not (old.kinds[old.at[x[1]]] and new.kinds[new.at[x[2]]] and not (old.kinds[old.at[x[1]]] & new.kinds[new.at[x[2]]]))]
        taken: set[str] = set()
        for _, a, b in sorted(pairs, key=lambda x: (-x[0], x[1], x[2])):
            if a not in taken and b not in taken:
                taken |= {a, b}
                changes.append(("renamed", a, b))
        changes += [("removed", p, "") for p in gone.get(q, []) if p not in taken]
        changes += [("added", p, "") for p in come.get(q, []) if p not in taken]
    return changes


def _known_score(old: Side, new: Side, score: np.ndarray, parent: str) -> float:
    """The median score of the fields that keep their name, in a parent or else anywhere; 1, the highest score, where there are none."""
    kept = [p for p in old.paths if p in new.at and not p.endswith("[]")]
    kept = [p for p in kept if p.rpartition(".")[0] == parent] or kept
    return float(np.median([score[old.at[p], new.at[p]] for p in kept])) or 1.0 if kept else 1.0


def _compare_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for c, s, fields, agree in zip(b["collector"], b["file_seq"], b["fields"], b["agree"]):
            sides: list[list[dict]] = [[], []]
            name = None
            for f in fields:
                sides[int(f["is_new"])].append(f)
                name = f["file_name"] if f["is_new"] else name
            if sides[0] and sides[1]:
                known = {(x["old"], x["new"]): (x["shared"], x["same"], x["distinct"]) for x in (agree if agree is not None else ())}
                rows += [(c, s, name, *x) for x in schema_changes(*sides, known)]
        yield pd.DataFrame(rows, columns=["collector", "file_seq", "file_name", "change_kind", "field_path", "new_path"])


def drift_report(lines: DataFrame) -> DataFrame:
    """(collector, file_seq, file_name, change_kind, field_path, new_path): each change from a collector's file to its next.

    Columns needed: collector, file_seq, file_name, payload; others are ignored. Lines that don't parse, null payloads and lines without
    file_seq are skipped; repeated lines change nothing; an empty table gives no rows. A null in all lines of a file is a field without a type.
    Lines are profiled in one pass; one task compares two files' profiles, whose size is given by their fields, not by their lines. What the changed fields
    hold is compared over all records, see content_agreements.
    """
    profiles = checkpointed(file_profiles(lines))
    n = profiles.select("collector", "file_seq").distinct().select(F.col("collector").alias("_c"), F.col("file_seq").alias("_s"), F.expr("lead(file_seq) OVER (PARTITION BY collector ORDER BY file_seq)").alias("next_seq"))
    both = profiles.join(n, F.col("collector").eqNullSafe(F.col("_c")) & (F.col("file_seq") == F.col("_s")))
    roles = F.array(F.struct(F.col("file_seq").alias("pair"), F.lit(True).alias("is_new")), F.struct(F.col("next_seq").alias("pair"), F.lit(False).alias("is_new")))
    sided = both.select("collector", "file_seq", "file_name", "path", "kinds", "n", "stats", F.explode(roles).alias("r")).where("r.pair IS NOT NULL").select("*", "r.pair", "r.is_new")
    # A collector's first file is in no pair as the new one.
    pairs = sided.groupBy("collector", "pair").agg(F.collect_list(F.struct("is_new", "file_name", "path", "kinds", "n", "stats")).alias("fields")).where("exists(fields, x -> NOT x.is_new)")
    agree = content_agreements(lines, sided.select("collector", "pair", "is_new", "path", "file_seq")).select(F.col("collector").alias("_c"), F.col("pair").alias("_p"), F.col("agree").cast(_AGREE).alias("agree"))
    known = pairs.join(agree, F.col("collector").eqNullSafe(F.col("_c")) & (F.col("pair") == F.col("_p")), "left").select("collector", F.col("pair").alias("file_seq"), "fields", "agree")
    return apart(known, "collector", "file_seq").mapInPandas(_compare_batches, "collector string, file_seq long, file_name string, change_kind string, field_path string, new_path string")


def _renamer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def apply(o: dict, path: str, names: dict) -> dict:
        out = {}
        for k, v in o.items():
            p = f"{path}.{k}" if path else k
            if k not in OPEN:
                if isinstance(v, dict):
                    v = apply(v, p, names)
                elif isinstance(v, list):
                    v = [apply(x, p + "[]", names) if isinstance(x, dict) else x for x in v]
            name = names.get(p, k)
            out[k if name != k and (name in o or name in out) else name] = v  # a record that has both names keeps both fields
        return out

    for b in batches:
        payloads = []
        for text, pairs in zip(b["payload"], b["names"]):
            try:
                o = json.loads(text)
            except (ValueError, TypeError, RecursionError):
                o = None
            payloads.append(json.dumps(apply(o, "", {x["path"]: x["name"] for x in (pairs if pairs is not None else [])})) if isinstance(o, dict) else None)
        yield b.drop(columns=["names"]).assign(payload=payloads)


def first_names(report: DataFrame) -> DataFrame:
    """(collector, from_seq, path, name): from the file from_seq on, the field at path goes by its first name `name`."""
    renames = report.where("change_kind = 'renamed'").select("collector", "file_seq", "field_path", "new_path")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for c, steps in zip(b["collector"], b["steps"]):
                first: dict[str, str] = {}
                for s in steps:
                    first[s["new_path"]] = first.get(s["field_path"], s["field_path"].rpartition(".")[2])
                    rows.append((c, s["file_seq"], s["new_path"], first[s["new_path"]]))
            yield pd.DataFrame(rows, columns=["collector", "from_seq", "path", "name"])

    steps = renames.groupBy("collector").agg(F.array_sort(F.collect_list(F.struct("file_seq", "field_path", "new_path"))).alias("steps"))
    return steps.mapInPandas(chain, "collector string, from_seq long, path string, name string")


#: ISO times as files write them; a time without a zone is UTC.
_TIME = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:\d\d)?")
_EXACT = 1 << 53


def _value_kind(v: object) -> str:
    """What a value is for the merged schema; texts that say a number, a flag or a time are told from others."""
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "flag" if v in (0, 1) else "int" if abs(v) <= _EXACT else "long" if -(1 << 63) <= v < 1 << 63 else "huge"
    if isinstance(v, float):
        return "double"
    if isinstance(v, dict):
        return "object"
    if isinstance(v, list):
        return "array"
    if v in ("true", "false", "True", "False"):
        return "boolean text"
    if re.fullmatch(r"-?(0|[1-9]\d{0,14})", v) and v != "-0":
        return "int text"
    if re.fullmatch(r"-?(0|[1-9]\d{0,14})\.\d+", v) and repr(float(v)) == v:
        return "double text"
    if _TIME.fullmatch(v):
        try:
            datetime.fromisoformat(v)
            return "time text"
        except ValueError:
            pass
    return "text"


def _widest(name: str, kinds: set[str]) -> str:
    """The narrowest type that holds all values of a field as they are; text where there is none."""
    if "boolean" in kinds and kinds <= {"boolean", "flag", "boolean text"}:
        return "boolean"
    if kinds & {"int", "flag", "long"} and kinds <= {"int", "flag", "long", "int text"}:
        return "bigint"
    if kinds & {"int", "flag", "double"} and kinds <= {"int", "flag", "double", "int text", "double text", "time text"}:
        return "double"
    return "map<string,string>" if name in OPEN and kinds == {"object"} else "string"


def _spelling(name: str) -> str:
    """createdAt and created_at are the same field."""
    return "_".join(w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^\W\d_]+", name)) or name


def _seen_fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen: dict = {}
        for text in b["payload"]:
            o = json.loads(text) if isinstance(text, str) else {}
            spelled: dict[str, int] = {}
            for k, v in o.items():
                spelled[_spelling(k)] = spelled.get(_spelling(k), 0) + 1
                at = (k, "null" if v is None else _value_kind(v))
                seen[at] = seen.get(at, 0) + 1
            for k in o:
                if spelled[_spelling(k)] > 1:
                    seen[k, "both"] = 1
        yield pd.DataFrame([(k, t, n) for (k, t), n in seen.items()], columns=["name", "kind", "n"])


def merged_fields(clean: DataFrame) -> dict[str, tuple[str, list[str], set[str]]]:
    """Column name to (type, spellings, kinds) of all fields that any line's payload has, by name.

    Spellings of one name (createdAt, created_at) are one column under the most frequent, unless a record has two of them. Only the fields' names
    and kinds come to the driver.
    """
    fields: dict[str, dict[str, int]] = {}
    for r in clean.select("payload").mapInPandas(_seen_fields, "name string, kind string, n long").groupBy("name", "kind").agg(F.sum("n").alias("n")).collect():
        fields.setdefault(r["name"], {})[r["kind"]] = r["n"]
    in_one = {_spelling(k) for k, kinds in fields.items() if "both" in kinds}
    groups: dict[tuple, list[str]] = {}
    for k in fields:
        groups.setdefault((_spelling(k), k if _spelling(k) in in_one else ""), []).append(k)
    out: dict[str, tuple[str, list[str], set[str]]] = {}
    taken = {"collector", "file_name", "file_seq", "line_no", "is_parsed"}
    for names in sorted(sorted(g, key=lambda k: (-sum(fields[k].values()), k)) for g in groups.values()):
        kinds = {t for k in names for t in fields[k]} - {"null", "both"}
        column = names[0] or "_"
        while column.lower() in taken or ("time text" in kinds and f"{column}_text".lower() in taken):
            column += "_"
        taken |= {column.lower()} | ({f"{column}_text".lower()} if "time text" in kinds else set())
        out[column] = (_widest(names[0], kinds), names, kinds)
    return out


def unified_records(lines: DataFrame, report: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """All lines as one table, renamed fields under their first name; the columns are those of the merged schema, or the given ones (name to type).

    Merged schema: each field that any line has is a column, of the widest type of its values (see _widest); values of unlike types are text,
    lists and objects JSON text. Times in a column of numbers become epoch seconds, and `<column>_text` keeps what was written. Columns named like the
    place columns, or like another in other case, get a trailing underscore. Given columns: a value of another type is cast where it can be and null
    where not; a lone value where a list is wanted becomes a list of one. Lines that don't parse keep their place with null columns and is_parsed false.
    """
    names = first_names(report).groupBy("collector").agg(F.array_sort(F.collect_list(F.struct("from_seq", "path", "name"))).alias("all_names"))
    n = names.withColumnRenamed("collector", "_c")
    rows = lines.select("collector", "file_name", "file_seq", "line_no", "payload").join(n, F.col("collector").eqNullSafe(F.col("_c")), "left").drop("_c")
    rows = rows.withColumn("names", F.transform(F.filter("all_names", lambda x: x["from_seq"] <= F.col("file_seq")), lambda x: F.struct(x["path"].alias("path"), x["name"].alias("name")))).drop("all_names")
    clean = rows.mapInPandas(_renamer, "collector string, file_name string, file_seq long, line_no long, payload string")
    if fields is None:
        clean = checkpointed(clean)
    m = clean.withColumn("_m", F.from_json("payload", "map<string,string>"))
    at = ["collector", "file_name", "file_seq", "line_no", F.col("payload").isNotNull().alias("is_parsed")]

    def cast(v: Column, kind: str) -> Column:
        if kind.lower().startswith(("array", "struct", "map")):
            one = F.concat(F.lit("["), v, F.lit("]")) if kind.lower().startswith("array") else v
            return F.from_json(F.when(v.startswith("[") | ~F.lit(kind.lower().startswith("array")), v).otherwise(one), kind)
        return v.try_cast(kind)

    if fields is not None:
        return m.select(*at, *[cast(F.col("_m")[k], t).alias(k) for k, t in fields.items()])
    columns = []
    for column, (kind, spellings, kinds) in merged_fields(clean).items():
        v = F.coalesce(*[F.col("_m")[k] for k in spellings])
        if kind == "double" and "time text" in kinds:
            is_time = v.rlike(f"^{_TIME.pattern}$")
            zoned = F.when(v.rlike(r"(Z|[+-]\d\d:\d\d)$"), v).otherwise(F.concat(v, F.lit("Z")))
            columns += [F.when(is_time, F.unix_micros(zoned.try_cast("timestamp")) / 1_000_000).otherwise(v.try_cast("double")).alias(column), F.when(is_time, v).alias(f"{column}_text")]
        else:
            columns.append(cast(v, kind).alias(column))
    return m.select(*at, *columns)
