"""Texts of runs: shell words, tool calls in text, cut results, sections, paths, and what a training text looks like."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters at which a line ends, beyond the plain line feed.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def stripped(c: Column) -> Column:
    """Without white space around it, all of Unicode's."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column) -> Column:
    """The lines of a text; a line end at the end starts no line, an empty text has none."""
    parts = F.split(c, LINE_END)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def shell_quoted(c: Column) -> Column:
    """The text as one word of a POSIX shell."""
    return F.when(c == "", "''").when(c.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def without_trailing_commas(c: Column) -> Column:
    return F.regexp_replace(c, r",\s*([}\]])", "$1")


# The two forms of a call in a text, and a thought.
TAGGED_CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
FENCED_CALL = r"(?s)```(?:tool_call|json)?\s*\n(\{.*?\})\n\s*```"
THOUGHT = r"(?sU)<think>.*?</think>\s*"


def without_thoughts(c: Column) -> Column:
    return stripped(F.regexp_replace(c, THOUGHT, ""))


def text_tool_calls(c: Column) -> Column:
    """The tool calls written in a text: an array of (id, name, arguments), tagged ones before those in fences; ids count the calls that have a name.

    arguments is the JSON text of the member arguments, or of parameters where that is absent; what is no object reads {}. What doesn't parse, and calls without a
    name, are none; null text has none.
    """
    found = F.concat(*[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(1)) for p in (TAGGED_CALL, FENCED_CALL)])
    named = F.filter(found, lambda x: F.try_parse_json(x).isNotNull() & (F.coalesce(F.get_json_object(x, "$.name"), F.lit("")) != ""))

    def arguments(x: Column) -> Column:
        has = F.array_contains(F.json_object_keys(x), "arguments")
        a = F.when(has, F.get_json_object(x, "$.arguments")).otherwise(F.get_json_object(x, "$.parameters"))
        return F.when(a.startswith("{"), a).otherwise("{}")

    return F.transform(named, lambda x, i: F.struct(F.concat(F.lit("text_tc_"), i.cast("string")).alias("id"), F.get_json_object(x, "$.name").alias("name"), arguments(x).alias("arguments")))


# The notes below a cut result, when a tool returns it and when a history is compacted.
RESULT_NOTE = "\n\n[truncated — %d more lines]"
HISTORY_NOTE = "\n[truncated — %d more lines]"


def truncated_lines(c: Column, most: int = 200, note: str = RESULT_NOTE) -> Column:
    """The first `most` lines with a note on the rest; a shorter text as it is."""
    parts = lines(c)
    head, tail = note.split("%d")
    return F.when(F.size(parts) > most, F.concat(F.array_join(F.slice(parts, 1, most), "\n"), F.lit(head), (F.size(parts) - most).cast("string"), F.lit(tail))).otherwise(c)


def result_text(ok: Column, output: Column, error: Column, most: int = 2000) -> Column:
    """What a call's result reads like: an error line before the output of one that failed; cut to `most` characters."""
    e, o = F.coalesce(error, F.lit("")), F.coalesce(output, F.lit(""))
    return F.left(F.when(ok | (e == ""), o).otherwise(F.when(o == "", F.concat(F.lit("ERROR: "), e)).otherwise(F.concat(F.lit("ERROR: "), e, F.lit("\n"), o))), F.lit(most))


def training_text(messages: Column) -> Column:
    """Messages (role, content) as blocks '[ROLE]\\ncontent' with a blank line between."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), F.coalesce(m["content"], F.lit("")))), "\n\n")


def conversation_text(messages: Column, most: int = 1000) -> Column:
    """Messages without those of the system and empty ones as '[role] content', each cut, a blank line between, for a summary."""
    kept = F.filter(messages, lambda m: (m["role"] != "system") & (F.coalesce(m["content"], F.lit("")) != ""))
    return F.array_join(F.transform(kept, lambda m: F.concat(F.lit("["), m["role"], F.lit("] "), F.left(m["content"], F.lit(most)))), "\n\n")


def sections(c: Column) -> Column:
    """Title to text of a Markdown text's second-level sections, '__title__' to its first-level heading before them (the last, if there are several).

    A later section of the same title wins; a section without title is none. What stands before the first section is left out.
    """
    at = lines(c)
    start = F.transform(at, lambda x, i: F.when(x.startswith("## "), i + 1))
    starts = F.concat(F.array_compact(start), F.array(F.size(at) + 1))
    first = F.element_at(starts, 1)
    heads = F.filter(F.slice(at, 1, first - 1), lambda x: x.startswith("# "))
    pairs = F.transform(
        F.slice(starts, 1, F.size(starts) - 1),
        lambda s, i: F.struct(stripped(F.substring(F.element_at(at, s), 4, 2**31 - 1)).alias("k"), stripped(F.array_join(F.slice(at, s + 1, F.element_at(starts, i + 2) - s - 1), "\n")).alias("v")),
    )
    named = F.filter(pairs, lambda p: p["k"] != "")
    last = F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.size(named) + 1), lambda q: q["k"] == p["k"]))
    title = F.when(F.size(heads) > 0, F.array(F.struct(F.lit("__title__").alias("k"), stripped(F.element_at(heads, -1)).alias("v"))))
    return F.map_from_entries(F.concat(F.coalesce(title, F.array().cast("array<struct<k:string,v:string>>")), F.filter(last, lambda p: p["k"] != "__title__")))


def rendered_sections(m: Column) -> Column:
    """A section map as Markdown: the title first, then each section below its heading, blank lines between, one line break at the end."""
    rest = F.map_entries(F.map_filter(m, lambda k, v: k != "__title__"))
    parts = F.transform(rest, lambda e: F.concat(F.lit("## "), e["key"], F.when(F.coalesce(e["value"], F.lit("")) != "", F.concat(F.lit("\n"), e["value"])).otherwise(""), F.lit("\n")))
    title = F.when(F.coalesce(m["__title__"], F.lit("")) != "", F.array(F.concat(m["__title__"], F.lit("\n")))).otherwise(F.array().cast("array<string>"))
    return F.concat(stripped(F.array_join(F.concat(title, parts), "\n")), F.lit("\n"))


def capped(c: Column, most: int = 10_000) -> Column:
    """A memory text as it is saved: cut to `most` characters with a note below."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("\n... [truncated]\n"))).otherwise(c)


def topic_name(c: Column) -> Column:
    """A name for a file: letters, digits, - and _ stay, all else becomes _."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_\-]", "_")


def head_or_more(entries: Column, most: int = 40) -> Column:
    """The first `most` entries, and how many more there are as a last one."""
    more = F.size(entries) - most
    return F.when(more > 0, F.concat(F.slice(entries, 1, most), F.array(F.concat(F.lit("[... "), more.cast("string"), F.lit(" more entries]"))))).otherwise(entries)


def squeezed(c: Column) -> Column:
    return stripped(F.regexp_replace(c, r"(?U)\s+", " "))


def occurrences(text: Column, piece: Column) -> Column:
    """How often a piece stands in a text without overlap; an empty piece gives null."""
    return F.when(piece != "", ((F.length(text) - F.length(F.replace(text, piece, F.lit("")))) / F.length(piece)).cast("long"))


def normal_path(c: Column) -> Column:
    """The path with / as separator and without empty, . and .. parts; null if it leads out of its root."""
    parts = F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/")
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))
    step = lambda s, x: F.when(x.isin("", "."), s).when(x == "..", F.struct(F.slice(s["p"], 1, F.greatest(F.size(s["p"]) - 1, F.lit(0))).alias("p"), (s["ok"] & (F.size(s["p"]) > 0)).alias("ok"))).otherwise(F.struct(F.concat(s["p"], F.array(x)).alias("p"), s["ok"].alias("ok")))
    return F.aggregate(parts, start, step, lambda s: F.when(s["ok"], F.array_join(s["p"], "/")))


# Folders at a path's start or inside it, and endings, that no tool may write.
NO_FOLDERS = ("__pycache__", ".git")
NO_SUFFIXES = (".pyc", ".pyo", ".pyd")


def workspace_path(c: Column, own_folder: str | None = None) -> Column:
    """Whether a tool may touch the path: not in a version control or cache folder or the agent's own one, and no compiled file; an empty or null path may.

    Case and the kind of separator don't count, nor does ./ at the start.
    """
    n = F.lower(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(\./)+", ""))
    folders = [*NO_FOLDERS, *([own_folder.lower()] if own_folder else [])]
    bad = [n.startswith(f"{f}/") for f in folders] + [n.contains(f"/{f}/") for f in folders] + [n.endswith(x) for x in NO_SUFFIXES]
    return ~F.coalesce(F.expr("false") if not bad else reduce(lambda a, b: a | b, bad), F.lit(False))


def parsed_time(c: Column) -> Column:
    """A time from digits (epoch seconds) or ISO text; without a zone it is UTC (the session's zone must be UTC)."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d+$"), F.timestamp_seconds(t.try_cast("bigint"))).otherwise(F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00")))


def backoff_seconds(attempt: Column, base: float = 1.0, most: float = 60.0, retry_after: Column | None = None, jitter: Column | None = None) -> Column:
    """The wait before an attempt (from 0), doubled each time up to `most`, no less than what the server asked for; times a half to one where jitter (0 to 1, e.g. rand()) is given."""
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))
    wait = wait if retry_after is None else F.greatest(wait, F.coalesce(retry_after, F.lit(0.0)))
    return wait if jitter is None else wait * (0.5 + jitter * 0.5)


def seed_list(c: Column) -> Column:
    """The seeds of '0,1, 2', each once in order; null if one is no number."""
    s = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    n = F.transform(s, lambda x: x.try_cast("bigint"))
    return F.when(~F.exists(n, lambda x: x.isNull()), F.array_distinct(n))


def folder_name(c: Column) -> Column:
    """A repository's name as a folder: '/' as '__', case kept."""
    return F.replace(c, F.lit("/"), F.lit("__"))


def arm_spec(c: Column) -> Column:
    """(name, path) of 'name:path'; without a colon or with a blank name an error is raised."""
    name, path = F.trim(F.substring_index(c, ":", 1)), F.trim(F.regexp_replace(c, "^[^:]*:", ""))
    bad = F.raise_error(F.concat(F.lit("expected name:path, got "), c)).cast("string")
    return F.struct(F.when(c.contains(":") & (name != ""), name).otherwise(bad).alias("name"), path.alias("path"))


def first_candidate(texts: Column, names: list[str], most: int) -> Column:
    """The head of the first candidate of a map (name to text) that isn't blank within `most` characters, below its name; '' if there is none."""
    out = F.lit("")
    for name in reversed(names):
        t = texts[name]
        head = stripped(F.left(t, F.lit(most)))
        note = F.when(F.length(t) > most, f"\n\n[...truncated at {most} chars]").otherwise("")
        out = F.when(F.coalesce(head, F.lit("")) != "", F.concat(F.lit(f"### {name}\n\n"), head, note)).otherwise(out)
    return out


def normalised_lines(c: Column) -> Column:
    """A text's lines without blanks at their ends and with one blank for runs of blanks and tabs."""
    return F.transform(lines(c), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)\s+$", ""), r"[ \t]+", " "))


def window_match(content: Column, wanted: Column) -> Column:
    """(matched, n): the stretch of content's lines that equals the wanted lines but for blanks, and how often it stands there; null if there is none.

    If all such stretches are the same text, n is how often that text stands in the content, else the number of stretches; matched is the first.
    """
    old, new = normalised_lines(wanted), normalised_lines(content)
    size = F.size(old)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(new) - size + 1, F.lit(1))), lambda i: F.slice(new, i, size) == old)
    found = F.transform(starts, lambda i: F.array_join(F.slice(lines(content), i, size), "\n"))
    n = F.when(F.size(F.array_distinct(found)) == 1, occurrences(content, F.get(found, F.lit(0)))).otherwise(F.size(found).cast("long"))
    return F.when((size > 0) & (size <= F.size(new)) & F.array_join(old, "").rlike(r"(?U)\S") & (F.size(found) > 0), F.struct(F.get(found, F.lit(0)).alias("matched"), n.alias("n")))


def cased_name(c: Column) -> Column:
    """A repository's name as a folder or image name: lower case, '/' as '__'."""
    return F.replace(F.lower(c), F.lit("/"), F.lit("__"))


def image_tag(c: Column, prefix: str) -> Column:
    """The tag of an instance's image: the prefix, and the id as image names may be."""
    return F.concat(F.lit(f"{prefix}."), cased_name(c), F.lit(":latest"))


def container_name(c: Column, prefix: str) -> Column:
    """The name of an instance's container: the prefix, and the id with '_' for '/'."""
    return F.concat(F.lit(f"{prefix}-"), F.replace(c, F.lit("/"), F.lit("_")))
