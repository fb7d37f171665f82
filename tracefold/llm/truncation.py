"""Texts that stop before their own end (problem 9), by trigrams that are frequent inside texts but hardly ever end one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.names import snake
from tracefold.session import checkpointed

#: A context with fewer sightings says nothing; the shorter one is asked then. With fewer than SURE sightings it can show that a text
#: may end there, but not that it may not: no end among a few sightings is chance.
SEEN, SURE = 8, 60
#: Below this share of ends a trigram hardly ever ends a line, or a sequence of lines a text.
RARE_END = 0.02
#: What ends this share of a source's texts closes them: short lines, and contexts that stand nowhere else.
CLOSING = 0.02
#: A source whose texts are closed so by this share ends all its texts so.
ALL_CLOSED = 0.7
#: A context that ends texts more than so many times as often as it stands anywhere else isn't known from whole texts: in a large table many are cut at the same piece.
ONLY_LAST = 4

# Signs that something is missing, at the very end. Dots and three-dots may be meant and are only taken off.
_SIGN = r"(?is)[\s\n]*(?:[\[(<{][^\[\](){}<>\n]{0,24}?\b(?:truncated|cut|snip|snipped|omitted|elided|clipped|abridged|continued|output too long|too long|more lines?|more bytes)\b[^\[\](){}<>\n]{0,24}[\])>}])\s*$"
_DOTS = r"(?s)(?:\s*(?:…|\.{3,}|。{3,}))\s*$"
# Open classes of tokens, each a private character: time, path, identifier, class name, number.
_CLASSES = (
    (r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?", ""),
    (r"(?<![\p{L}\p{N}_.\-])[\p{L}\p{N}_.\-]*+(?:/[\p{L}\p{N}_.\-]*+)++(?:::[\p{L}\p{N}_]*+)?", ""),
    (r"(?<![\p{L}\p{N}_])[\p{L}\p{N}]*+_[\p{L}\p{N}_]*+", ""),
    (r"\b\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}*)+\b", ""),
    (r"(?<=[\p{Ll},] )\p{Lu}\p{L}*", ""),
    (r"\d+(?:\.\d+)?", ""),
)
_TOKEN = r"[-]|\p{IsHan}|[\p{L}\p{N}']+|\n|[^\s\p{L}\p{N}]"


_LEVELS = ("h3", "h2", "h1", "g2", "h0")
_SEEN = ("inside", "lines", "ends", "once")
_GRAM = "struct<" + ",".join(f"{h}:bigint" for h in _LEVELS) + ",inside:int,lines:int,ends:int>"


def without_signs(text: Column) -> Column:
    """The text without what says that something is missing, and without blanks behind it."""
    # A sign, like dots, is short; only the end is searched for it.
    split = F.greatest(F.length(F.rtrim(text)) - 120, F.lit(0))
    end = F.regexp_replace(F.regexp_replace(F.substring(text, split + 1, F.length(text)), _SIGN, ""), _DOTS, "")
    return F.regexp_replace(F.concat(F.left(text, split), end), r"(?<!\s)\s+$", "")


def has_sign(text: Column) -> Column:
    return F.right(F.rtrim(text), F.lit(120)).rlike(_SIGN)


def _classed(text: Column) -> Column:
    for p, r in _CLASSES:
        text = F.regexp_replace(text, p, r)
    return text


def _kind(line: Column) -> Column:
    """What a (classed) line is: its form where it has one, else the first words of a short line, else plain text."""
    words = F.regexp_extract_all(line, F.lit(r"[-]|[\p{L}']+|[^\s\p{L}]"), F.lit(0))
    return (
        F.when(line.startswith("```"), "fence")
        .when(line.rlike(r"^@@ "), "hunk")
        .when(line.rlike(r"^(diff|---|\+\+\+|index) ?.*[]"), "file")
        .when(line.rlike(r"^\s*[{\[]\s*\""), "json")
        .when(line.rlike(r"^\[?"), F.concat(F.lit("log "), F.regexp_extract(line, r"^\[?\]? ?([-]|\p{L}+)?", 1)))
        .when(line.rlike(r"^\s*(?:::)?\S* (?:\p{Lu}{4,}|ok)\s*$"), "check")
        .when(line.rlike(r"^E  "), "error")
        .when(line.rlike(r"^____ "), "part")
        .when(line.rlike(r"^\s*\|"), "row")
        .when(line.rlike(r"^\s*([*+\-•]|[.)])\s"), "item")
        .when(line.rlike(r"^#+ "), "head")
        .when(line.rlike(r"^\p{L}+: \S"), "turn")
        .when(line.rlike(r"^( |\t)"), "code")
        .when((F.size(words) <= 9) & line.rlike(r"[-=]|^\P{L}*\p{Ll}[\p{Ll} ,?]*$"), F.concat(F.lit("short "), F.array_join(F.slice(words, 1, 3), " ")))
        .otherwise("text")
    )


def _with_state(d: DataFrame) -> DataFrame:
    """Adds state, what is unfinished in the form of `bare`: an open code block, hunk or JSON line; null if nothing is."""
    lined = F.concat(F.lit("\n"), F.col("bare"))
    d = d.withColumn("_hunk", F.when(lined.contains("\n@@ -"), F.substring_index(lined, "\n@@ -", -1))).withColumn("_line", F.substring_index("bare", "\n", -1))
    d = d.withColumn("_head", F.regexp_extract_all(F.substring_index("_hunk", "\n", 1), F.lit(r"^\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@"), F.lit(0)))
    d = d.withColumn("_body", F.filter(F.split(F.regexp_replace("_hunk", r"^[^\n]*\n?", ""), "\n"), lambda x: x.rlike(r"^[ +\-]")))
    sized = lambda i: F.coalesce(F.regexp_extract(F.get("_head", F.lit(0)), r"^\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", i).try_cast("int"), F.lit(1))
    has = lambda sign: F.size(F.filter("_body", lambda x: ~x.startswith(sign)))
    state = (
        F.when((F.size("_head") > 0) & ((has("+") < sized(1)) | (has("-") < sized(2))), "hunk-open")
        .when(F.regexp_count("bare", F.lit(r"(?m)^```")) % 2 == 1, "code-open")
        .when(F.col("_line").rlike(r"^\s*[{\[]\s*\"") & F.try_parse_json("_line").isNull(), "json-open")
    )
    return d.withColumn("state", state).drop("_hunk", "_line", "_head", "_body")


def _grams(tokens: str, of: str, every: bool) -> Column:
    """An array of (h3, h2, h1, g2, h0, inside, lines, ends): a token with two, one and no token before it in its source, with one and none in any.

    tokens names an array column; line breaks in it are no tokens but end what stands before them. One of inside (a line), lines (a line's end with more behind it)
    and ends (the text's end) is 1. Without `every`, only the last token.
    """
    t, n = F.col(tokens), F.size(tokens)
    at = lambda i: F.coalesce(F.get(t, i), F.lit("\n"))
    places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(t, i) != "\n") if every else F.array(n - 1)
    return F.transform(
        F.when(n > 0, places).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.xxhash64(F.lit(of + "3"), F.col("source"), at(i - 2), at(i - 1), at(i)).alias("h3"), F.xxhash64(F.lit(of + "2"), F.col("source"), at(i - 1), at(i)).alias("h2"),
            F.xxhash64(F.lit(of + "1"), F.col("source"), at(i)).alias("h1"), F.xxhash64(F.lit(of + "-2"), at(i - 1), at(i)).alias("g2"), F.xxhash64(F.lit(of + "0"), at(i)).alias("h0"), F.when(at(i + 1) == "\n", 0).otherwise(1).alias("inside"),
            F.when(F.get(t, i + 1) == "\n", 1).otherwise(0).alias("lines"), F.when(F.get(t, i + 1).isNull(), 1).otherwise(0).alias("ends"),
        ),
    )


def _hashed(documents: DataFrame) -> DataFrame:
    """(doc_id, source, text, copy): the texts that aren't null or blank; copy is the same for equal texts of a source."""
    d = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.coalesce(snake("source"), F.lit("")).alias("source"), "text").where(F.col("text").rlike(r"\S"))
    return d.withColumn("copy", F.xxhash64("source", "text"))


def _prepared(documents: DataFrame) -> DataFrame:
    """Each distinct text as word tokens with line breaks between, and as line kinds. forms has the open form at each of its places inside, and what is open at the end."""
    d = _hashed(documents).groupBy("copy").agg(F.first("source").alias("source"), F.first("text").alias("text"), F.count("*").alias("copies"))
    d = d.withColumn("bare", without_signs(F.col("text")))
    d = _with_state(d).withColumn("classed", _classed(F.col("bare")))
    d = d.withColumn("words", F.regexp_extract_all(F.lower("classed"), F.lit(_TOKEN), F.lit(0)))
    d = d.withColumn("kinds", F.transform(F.filter(F.split("classed", "\n"), lambda x: x.rlike(r"\S")), _kind))
    count = lambda p: F.regexp_count(F.col("bare"), F.lit(p))
    fences = F.when(count(r"(?m)^```") > 0, F.size("kinds")).otherwise(0)
    open_at = F.concat(
        F.array_repeat(F.lit("hunk-open"), F.when(count(r"(?m)^@@ ") > 0, F.greatest(count(r"(?m)^[+\- ]") - 1, F.lit(0))).otherwise(0)),
        F.array_repeat(F.lit("code-open"), fences), F.array_repeat(F.lit("json-open"), count(r"(?m)^\s*[{\[]\s*\"") * 4),
    )
    return d.withColumn("forms", F.concat(open_at, F.array(F.coalesce("state", F.lit("closed")))))


def gram_pass(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, finals), from one pass over the texts.

    counts (h3, h2, h1, g2, h0, inside, lines, ends, once): how often each trigram of words stands inside a line, at its end and at a text's end, and each of line kinds
    and open forms inside a text and at its end; once is the sum over distinct texts. They are summed where the texts are tokenised; what moves is one row per distinct
    trigram and partition.
    finals: per distinct text its last trigrams of words, line kinds and forms (w, k, f), the state of its form, and its hash (copy).
    """
    d = _prepared(documents)
    w, k, f = (F.get(_grams(c, of, False), F.lit(0)) for c, of in (("words", "word"), ("kinds", "line"), ("forms", "form")))
    final = F.struct(
        "copy", "copies", "source", has_sign(F.col("text")).alias("signed"), "state", F.try_element_at("kinds", F.lit(-1)).alias("kind"), F.try_element_at("words", F.lit(-1)).alias("word"), F.size("kinds").alias("n_lines"), F.array_contains("kinds", "hunk").alias("hunks"),
        F.size("words").alias("n_words"), w.alias("w"), k.alias("k"), f.alias("f"),
    )
    d = d.withColumn("final", final).withColumn("w", _grams("words", "word", True)).withColumn("k", _grams("kinds", "line", True)).withColumn("f", _grams("forms", "form", True))
    d = d.select("final", "copies", F.explode(F.concat("w", "k", "f", F.array(F.lit(None).cast(_GRAM)))).alias("g"))
    # The last row of each text carries it; all others are trigrams.
    rows = d.select("g.*", "copies", F.when(F.col("g").isNull(), F.col("final")).alias("final")).groupBy(*_LEVELS, "final").agg(*[F.sum(F.col(c) * F.col("copies")).alias(c) for c in _SEEN[:3]], F.count("*").alias("once"))
    rows = checkpointed(rows)
    return rows.where("final IS NULL").drop("final"), rows.where("final IS NOT NULL").select("final.*")




def _sightings(finals: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds {name}_{i, l, e, o}_{level}: what was seen inside, at lines' ends, at texts' ends and in distinct texts of each context of a text's last trigrams."""
    names = [(n, h) for n in ("w", "k", "f") for h in _LEVELS]
    seen = counts.select(F.explode(F.array(*_LEVELS)).alias("h"), *_SEEN).groupBy("h").agg(*[F.sum(c).alias(c) for c in _SEEN])
    asked = finals.select("copy", F.posexplode(F.array(*[F.col(f"{n}.{h}") for n, h in names])).alias("at", "h"))
    found = asked.join(seen, "h").groupBy("copy").agg(*[F.max(F.when(F.col("at") == i, F.col(c))).alias(f"{n}_{c[0]}_{h}") for i, (n, h) in enumerate(names) for c in _SEEN])
    return finals.drop("w", "k", "f").join(found, "copy", "left")


def _judged(out: DataFrame, name: str) -> DataFrame:
    """Adds {name}_cut: whether the longest context that says something hardly ever ends, null if none does, {name}_own_cut by the source alone; and {name}_in, the last
    token's sightings inside.

    What the text and its copies add to the ends is left out, and copies don't make a context seen more often, but count in its shares. A context that hardly stands anywhere but at texts' ends says something only where it ends so many that it closes
    them: cut texts end in pieces of words and lines that, in a table of any size, others are cut at too. After a sentence's last mark the source alone says nothing.
    """
    inside, lines = (lambda h, c=c: F.coalesce(f"{name}_{c}_{h}", F.lit(0)) for c in "il")
    last = lambda h: F.greatest(F.coalesce(f"{name}_e_{h}", F.lit(0)) - F.col("copies"), F.lit(0))
    once = lambda h: F.coalesce(f"{name}_o_{h}", F.lit(0)) - 1
    closes = lambda h: last(h) >= F.greatest(CLOSING * F.col("texts" if h[0] == "h" and h != "h0" else "all_texts"), F.lit(2))
    elsewhere = lambda h: (inside(h) + lines(h)) * ONLY_LAST >= last(h)
    mark = F.col("word").rlike(r"^[^\p{L}\p{N}-]$")
    verdicts = {}
    for h in _LEVELS:  # 0: texts end there, 1: they surely don't, 2: none is seen to, null: too few are seen
        n = inside(h) + lines(h) + last(h)
        v = F.when((once(h) < SEEN) | ~(elsewhere(h) | closes(h)), None).when(lines(h) + last(h) >= RARE_END * n, 0).when(once(h) >= SURE, 1).otherwise(2)
        verdicts[h] = F.when(~mark, v) if h == "h1" and name == "w" else v
    out = out.withColumn("_all", F.array_compact(F.array(*verdicts.values()))).withColumn("_own", F.array_compact(F.array(*[verdicts[h] for h in ("h3", "h2", "h1")])))
    first = lambda c: F.get(F.filter(c, lambda v: v != 2), F.lit(0))
    cut, own_cut = F.coalesce(first("_all") == 1, F.when(F.size("_all") > 0, True)), first("_own") == 1
    out = out.withColumn(f"{name}_cut", cut).withColumn(f"{name}_own_cut", own_cut).withColumn(f"{name}_own_in", inside("h1")).withColumn(f"{name}_ends", last("h1"))
    out = out.withColumn(f"{name}_in", F.when(elsewhere("h0"), F.least(inside("h0"), once("h0"))).otherwise(0))
    known = ((once("g2") >= SEEN) & elsewhere("g2")) | ((once("h1") >= SEEN) & closes("h1"))
    return out.withColumn(f"{name}_known", known).drop("_all", "_own", *[f"{name}_{x}_{h}" for x in "ileo" for h in _LEVELS])


def truncation_evidence(documents: DataFrame) -> DataFrame:
    """One row per text with what speaks for its being cut: its last trigrams of words, lines and forms, and signs.

    word_cut: the last words are frequent inside lines and hardly ever end one, or the last is a piece of a word, one that stands nowhere inside a line and
    isn't known after the word before it. line_cut: the last lines are frequent inside texts and hardly ever end one,
    or nothing is known of them and nearly all texts of the source are closed by lines that stand nowhere inside, as logs are. form_cut: a code
    block, hunk or JSON value is open, which it hardly ever is at an end; a text with hunks ends where the last is complete. Short closing lines that mostly
    end texts and texts of one short line, as titles are, are judged by their own source alone; a sentence's last mark in prose isn't judged.

    Null, empty and blank texts have no row; copies count as one text and are judged alike. An empty table gives no rows.
    """
    counts, finals = gram_pass(documents)
    texts = finals.groupBy(F.col("source").alias("_source")).agg(F.sum("copies").alias("texts"))
    texts = texts.crossJoin(texts.agg(F.sum("texts").alias("all_texts")))
    d = _sightings(finals.join(texts, F.col("source") == F.col("_source")).drop("_source"), counts)
    for name in ("w", "k", "f"):
        d = _judged(d, name)
    short = (F.length("word") <= 2) & ~F.col("w_known")
    piece = F.col("word").rlike(r"^\p{L}[\p{L}']*$") & ~F.col("word").rlike(r"\p{IsHan}") & (short | (F.col("w_in") < SEEN)) & ~F.col("w_known")
    common = (F.col("k_ends") >= 2) & (F.col("k_ends") >= CLOSING * F.col("texts")) & (F.col("k_own_in") * 50 < F.col("k_ends"))
    d = d.withColumn("closed", F.coalesce(common, F.lit(False)))
    closed = d.groupBy(F.col("source").alias("_source")).agg((F.sum(F.when(F.col("closed"), F.col("copies")).otherwise(0)) >= ALL_CLOSED * F.sum("copies")).alias("all_closed"))
    d = d.join(closed, F.col("source") == F.col("_source")).drop("_source")
    closing = F.coalesce(F.col("kind").startswith("short") & F.col("closed"), F.lit(False))
    line = F.coalesce("k_cut", F.col("all_closed") & ~F.col("closed"))
    title = (F.col("n_lines") == 1) & (F.col("n_words") <= 8)
    whole = F.col("word").rlike(r"^[.!?。！？]$") & F.col("kind").isin("text", "item", "turn", "head")
    judged = F.when(title | closing, F.col("w_own_cut")).otherwise(F.col("w_cut"))
    word = ~whole & ((piece & ~closing) | F.coalesce(judged, F.lit(False)))
    d = d.select("copy", "source", "signed", "state", "kind", "word", "w_in", "w_known", F.coalesce(word, F.lit(False)).alias("word_cut"), (~F.col("hunks") & line).alias("line_cut"), (F.col("state").isNotNull() & F.coalesce("f_cut", F.lit(True))).alias("form_cut"))
    return _hashed(documents).select("doc_id", "copy").join(d, "copy").drop("copy")


_CUT = "signed OR word_cut OR line_cut OR form_cut"


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id): the texts that stop before their own end."""
    return truncation_evidence(documents).where(_CUT).select("doc_id")


def truncation_by_source(documents: DataFrame) -> DataFrame:
    """(source, n_texts, n_truncated, share) of all texts that aren't null or blank."""
    e = truncation_evidence(documents)
    cut = F.count_if(F.expr(_CUT))
    return e.groupBy("source").agg(F.count("*").alias("n_texts"), cut.alias("n_truncated"), F.round(cut / F.count("*"), 6).alias("share"))
