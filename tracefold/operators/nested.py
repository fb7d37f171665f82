"""Deeply nested JSON text turned into related flat tables (problem 5)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.session import spread

#: Objects whose members are data and not columns of a table.
OPEN = ("params", "metadata")
_KIND = {str: "string", bool: "boolean", int: "bigint", float: "double", dict: "object", list: "array", type(None): "null"}
_TYPES = {frozenset({"boolean"}): "BOOLEAN", frozenset({"bigint"}): "BIGINT", frozenset({"double"}): "DOUBLE", frozenset({"bigint", "double"}): "DOUBLE"}


def _folded(name: str) -> str:
    return re.sub(r"[\W_]+", "", name.lower())


def loaded(text: str | None) -> object:
    """What a text holds: JSON, JSON written as a string once more, or else the text; None for none or an empty one."""
    for _ in range(3):
        if not isinstance(text, str):
            return text
        t = text.strip()
        if not t:
            return None
        try:
            new = json.loads(t)
        except (ValueError, RecursionError):
            return text
        if isinstance(new, str) and not new.strip().startswith(("[", "{", '"')):
            return new
        text = new
    return text


def _group_list(x: object) -> str | None:
    """The member that holds the list of a group or envelope, {"turn_id": 3, "calls": [{...}]}; None if x is neither.

    Such an object has one list of objects and at most two plain members beside it.
    """
    if not isinstance(x, dict) or not 1 <= len(x) <= 3:
        return None
    lists = [k for k, v in x.items() if isinstance(v, list) and any(isinstance(y, (dict, list)) for y in v)]
    plain = [k for k, v in x.items() if not isinstance(v, (dict, list))]
    return lists[0] if len(lists) == 1 and len(plain) == len(x) - 1 else None


def elements(value: object, name: str) -> list:
    """The elements of a table's value in written order.

    Taken as a list: a list, lists in a list, an object keyed by positions, an envelope with the value under the table's own name or
    in a list beside plain members, and lists of groups, whose plain members go to each of their elements. Anything else
    is one element. Nulls, empty objects and empty lists are no elements.
    """
    if isinstance(value, dict):
        inner = _group_list(value)
        if len(value) == 1 and _folded(next(iter(value))) == _folded(name) and isinstance(next(iter(value.values())), (dict, list)):
            return elements(next(iter(value.values())), name)
        if value and all(k.isdigit() for k in value):
            value = list(value.values())
        elif inner is not None:
            value = value[inner]
        else:
            value = [value]
    elif not isinstance(value, list):
        value = [value]
    out = []
    groups = {m for m in map(_group_list, value) if m is not None} if any(isinstance(x, dict) and len(x) <= 3 for x in value) else ()
    for x in value:
        if isinstance(x, list):
            out += elements(x, name)
        elif groups and isinstance(x, dict) and len(x) <= 3 and (m := next((g for g in groups if g in x), None)) is not None and isinstance(x[m], (list, type(None))):
            given = {k: v for k, v in x.items() if k != m}
            out += [given | y if isinstance(y, dict) and y else y for y in elements(x[m] or [], name)]
        else:
            out.append(x)
    return [x for x in out if x is not None and x != {} and x != []]


def child_name(table: str, member: str) -> str:
    return f"{re.sub('s$', '', table)}_{member}"


def _see(table: str, rows: list, seen: dict) -> None:
    """Adds to seen[table, member] the kinds of the members of a table's rows, and of the lists in them."""
    for x in rows:
        if not isinstance(x, dict):
            seen.setdefault((table, ""), set()).add(_KIND[type(x)])
            continue
        for k, v in x.items():
            seen.setdefault((table, k), set()).add(_KIND[type(v)])
            if isinstance(v, list) and k not in OPEN:
                _see(child_name(table, k), elements(v, k), seen)


#: A schema has so many members and kinds at most; where names are data it would have no end.
MEMBERS = 20_000


class FlatTables:
    """The flat tables of some JSON columns, by the merged schema of all their rows.

    schemas has, by table, each member's kinds; children has the members that hold lists in some row, which are tables of their own, named after
    the parent in the singular. rows has (table, key, parent_pos, child_pos, element). Top tables have parent_pos -1; a child's parent_pos is the
    child_pos of its parent's row, so (key, parent_pos) points to it. child_pos counts from 0 in written order within the record for top tables, else within
    the parent. A lone value where other rows have a list is a list of one. See elements() for what counts as a list.

    Null, empty and blank texts give no rows, a text that doesn't parse gives one row with the text; an empty table gives empty tables. Lists at any depth are
    followed. Columns other than the key and the given ones are ignored. Two passes read the records, each where they lie; nothing is shuffled but the schema.
    """

    def __init__(self, records: DataFrame, key: str, columns: list[str]):
        self.key, self.columns = key, columns
        self.records = spread(records, key).select(F.col(key).cast("long").alias("_key"), *[F.col(c).cast("string").alias(c) for c in columns])
        self.schemas: dict[str, dict[str, set[str]]] = {c: {} for c in columns}

        def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: dict = {}
            for b in batches:
                for c in columns:
                    for text in b[c]:
                        _see(c, elements(loaded(text), c), seen)
            yield pd.DataFrame([(t, m, k) for (t, m), kinds in seen.items() for k in kinds], columns=["t", "m", "k"])

        found = self.records.select(*columns).mapInPandas(infer, "t string, m string, k string").distinct().limit(MEMBERS + 1).collect()
        if len(found) > MEMBERS:
            raise ValueError("too many member names for a schema: an object whose names are data belongs to OPEN")
        for r in sorted(found):
            self.schemas.setdefault(r["t"], {}).setdefault(r["m"], set()).add(r["k"])
        self.children = {t: sorted(m for m, k in ms.items() if "array" in k and m not in OPEN) for t, ms in self.schemas.items()}

    def rows(self, with_elements: bool = True) -> DataFrame:
        columns, children, key = self.columns, self.children, self.key

        def put(table: str, value: object, name: str, record: int, parent: int, out: list) -> None:
            for i, x in enumerate(elements(value, name)):
                out.append((record, table, parent, i, (x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) if with_elements else None))
                if isinstance(x, dict):
                    for m in children.get(table, ()):
                        put(child_name(table, m), loaded(x.get(m)) if isinstance(x.get(m), str) and x[m][:1] in "[{" else x.get(m), m, record, i, out)

        def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out: list = []
                for record, *texts in zip(b["_key"], *[b[c] for c in columns]):
                    for c, text in zip(columns, texts):
                        put(c, loaded(text), c, record, -1, out)
                    if len(out) > 20_000:
                        yield pd.DataFrame(out, columns=["_key", "child_table", "parent_pos", "child_pos", "element"])
                        out = []
                yield pd.DataFrame(out, columns=["_key", "child_table", "parent_pos", "child_pos", "element"])

        flat = self.records.where("_key IS NOT NULL").mapInPandas(flatten, "_key long, child_table string, parent_pos long, child_pos long, element string")
        return flat.withColumnRenamed("_key", key)

    def typed(self, name: str) -> DataFrame:
        """The table with one column per member; members of unlike kinds, lists and objects are JSON text.

        A table of plain values has the column value. Members named like the key columns get a trailing underscore.
        """
        members = {m: k - {"null"} for m, k in self.schemas.get(name, {}).items() if m}
        rows = self.rows().where(F.col("child_table") == name).drop("child_table")
        if not members:
            return rows.withColumnRenamed("element", "value")
        ddl = ", ".join(f"`{m.replace('`', '``')}` {_TYPES.get(frozenset(k), 'STRING')}" for m, k in members.items())
        fixed = {self.key.lower(), "parent_pos", "child_pos"}
        s = rows.withColumn("_s", F.from_json("element", ddl))
        return s.select(self.key, "parent_pos", "child_pos", *[F.col("_s")[m].alias(m + "_" if m.lower() in fixed else m) for m in members])

    def positions(self) -> DataFrame:
        """(key, child_table, parent_pos, child_pos) of all rows of all tables."""
        return self.rows(with_elements=False).drop("element")
