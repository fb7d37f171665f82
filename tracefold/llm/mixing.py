"""Sources mixed to target shares of tokens (problem 8), by a low-discrepancy schedule of equal blocks."""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracefold.functions.names import snake
from tracefold.operators.ranks import spread_running
from tracefold.session import checkpointed, spread

#: The public tokenizer whose tokens are counted; a parameter of every function here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before this tokenizer's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PHI = 0.6180339887498949


#: A vocabulary is sent to the executors if it has so many bytes at most; public ones have a few million.
VOCABULARY_BYTES = 64_000_000


@lru_cache(maxsize=2)
def _encoding(name: str, vocabulary: bytes):
    """The tokenizer of a vocabulary file's bytes, built once a worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of each text, source in plain spelling; null texts have 0 tokens. Special tokens' names are plain text.

    The vocabulary file is read by the driver and sent to the executors, which needn't have it; one of over VOCABULARY_BYTES is an error.
    """
    with open(tokenizer, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to be sent to executors")
    name, vocabulary = os.path.basename(tokenizer), documents.sparkSession.sparkContext.broadcast(data)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(name, vocabulary.value).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": pd.Series([len(encode(t)) if t else 0 for t in b["text"]], dtype="int64")})

    return spread(documents.select("doc_id", "source", "text"), "doc_id").select("doc_id", snake("source").alias("source"), "text").mapInPandas(count, "doc_id long, source string, n_tokens long")


def _targets(targets: DataFrame) -> DataFrame:
    plain = targets.where("source IS NOT NULL").select("source", snake("source").alias("_key"), F.coalesce("target_permille", F.lit(0)).alias("target_permille"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    return plain.groupBy("_key").agg(F.min("source").alias("source"), F.max("target_permille").alias("target_permille"), F.max("max_repeats").alias("max_repeats"))


def source_supply(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of targets: its tokens, all tokens of these sources, what is wanted (permille of all) and the most it can give (max_repeats times)."""
    sums = counts.groupBy(F.col("source").alias("_source")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("n_docs"))
    t = _targets(targets).join(sums, F.col("_key") == F.col("_source"), "left").select("source", "_key", "target_permille", "max_repeats", F.coalesce("n", F.lit(0)).cast("long").alias("tokens"), F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"))
    total = F.sum("tokens").over(W.partitionBy(F.lit(0)))  # over the targets' rows
    return t.withColumn("total", total).withColumn("wanted", F.col("target_permille") * F.col("total") / 1000).withColumn("most", F.col("tokens") * F.col("max_repeats"))


@dataclass
class Slots:
    """A schedule: rows has (slot, source, k), a source's k-th slot; plan has one row a source, given to the driver."""

    rows: DataFrame
    plan: DataFrame
    n_slots: int
    n_docs: int


def slot_schedule(supply: DataFrame, block_tokens: int) -> Slots:
    """The slots of a mixture, as many as all tokens of the sources need in blocks of about block_tokens.

    Slot i lies at the fractional part of i * golden ratio; the sources' cumulative weights map it to a source, so every stretch of slots has nearly the
    target shares. Slots are ranked per source in closed form over ranges, so no source is sorted in one task.
    """
    spark = supply.sparkSession
    rows = supply.orderBy("source").collect()  # as many as targets
    total = rows[0]["total"] if rows else 0
    # A source's blocks are equal but differ a little from another's, so slots are dealt by tokens wanted over tokens a block.
    needs, blocks = [], []
    for r in rows:
        blocks.append(max(1, round(r["tokens"] / block_tokens)) if r["tokens"] else 0)
        needs.append(r["target_permille"] * total / 1000 / (r["tokens"] / blocks[-1] if blocks[-1] else block_tokens))
    whole, low, plan = sum(needs), 0.0, []
    of = F.lit(None).cast("string")
    for r, n_blocks, need in zip(rows, blocks, needs):
        high = low + need / whole if whole else low
        of = F.when((F.col("u") >= low) & (F.col("u") < high), r["source"]).otherwise(of)
        low = high
        plan.append((*(r[c] for c in ("source", "_key", "target_permille", "max_repeats", "tokens")), float(r["wanted"]), r["most"], n_blocks))
    n_slots = math.ceil(whole)
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("u", F.col("slot") * F.lit(PHI) % F.lit(1.0)).withColumn("source", of).where("source IS NOT NULL")
    ranges = slots.withColumn("part", F.floor(F.col("slot") / 65_536))
    sums = ranges.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = sums.select(F.col("source").alias("_s"), F.col("part").alias("_p"), F.expr("coalesce(sum(n) OVER (PARTITION BY source ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("n0"))
    ranked = ranges.withColumn("k", F.expr("row_number() OVER (PARTITION BY source, part ORDER BY slot) - 1")).join(before, (F.col("source") == F.col("_s")) & (F.col("part") == F.col("_p")))
    known = spark.createDataFrame(plan, "source string, _key string, target_permille long, max_repeats long, tokens long, wanted double, most long, n_blocks long")
    return Slots(ranked.select("slot", "source", (F.col("k") + F.col("n0")).alias("k")), known, n_slots, sum(r["n_docs"] for r in rows))


def used_up(s: Slots) -> DataFrame:
    """The plan with slots, what the schedule gives a source, and falls_short: whether its blocks, repeated as often as they may be, can't fill them.

    A golden-ratio sequence gives an interval its share of n slots up to 2 + ln n, so only sources whose slots use up their blocks up
    to that many can be short; for these the tokens are compared exactly.
    """
    given = s.rows.groupBy(F.col("source").alias("_s")).agg((F.max("k") + 1).alias("slots"))
    p = s.plan.join(given, F.col("source") == F.col("_s"), "left").drop("_s").withColumn("slots", F.coalesce("slots", F.lit(0)))
    near = F.col("slots") + (2 + math.log(s.n_slots + 1)) >= F.col("n_blocks") * F.col("max_repeats")
    return p.withColumn("falls_short", near & (F.col("most") < F.col("wanted")))


def short_sources(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int = 16_384) -> DataFrame:
    """(source): the targets whose slots in the schedule stay empty, because max_repeats times their documents' tokens can't fill them."""
    return used_up(slot_schedule(source_supply(token_counts(documents, tokenizer), targets), block_tokens)).where("falls_short").select("source")


def _filled(counts: DataFrame, s: Slots, seed: int) -> DataFrame:
    placed = s.rows.join(F.broadcast(s.plan.select("source", "max_repeats", "n_blocks")), "source")
    used = placed.where("n_blocks > 0 AND k < n_blocks * max_repeats").select("slot", "source", (F.col("k") % F.col("n_blocks")).alias("block"), F.floor(F.col("k") / F.col("n_blocks")).alias("repeat"))
    docs = counts.join(F.broadcast(s.plan.select(F.col("_key").alias("_k"), F.col("source").alias("_name"), "n_blocks", "tokens")), F.col("source") == F.col("_k")).where("n_tokens > 0").select("doc_id", F.col("_name").alias("source"), "n_tokens", "n_blocks", "tokens")
    # pieces of about 100,000 documents, whatever their number
    shuffled = spread_running(docs, ["source"], ["doc_id"], F.col("n_tokens"), pieces=1 << max(6, math.ceil(math.log2(s.n_docs / 100_000 + 1))), seed=seed)
    blocks = shuffled.select("doc_id", "source", "n_tokens", F.floor(F.col("running") * F.col("n_blocks") / F.col("tokens")).alias("block"))
    return used.join(blocks, ["source", "block"]).select("slot", "source", "block", "repeat", "doc_id", "n_tokens")


def mix_schedule(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int = 16_384, seed: int = 3) -> DataFrame:
    """(slot, source, block, repeat, doc_id, n_tokens): the mixture, in order of slot.

    Each source's documents are shuffled by a hash and cut into blocks of about block_tokens, whole documents each. A
    source's k-th slot (see slot_schedule) takes its block k, again from the first once all are used, max_repeats times at most. Slots
    of a source that is used up stay empty, which the report shows.

    Documents of sources without target are left out; null and empty texts have no tokens and are left out; copies count each. Texts are tokenised once,
    their counts kept in the shared folder; blocks are ranked by operators.ranks. The driver holds one row a target.
    """
    counts = checkpointed(token_counts(documents, tokenizer))
    return _filled(counts, slot_schedule(source_supply(counts, targets), block_tokens), seed)


def mix_report(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int = 16_384, seed: int = 3) -> DataFrame:
    """Per source of targets: tokens there, wanted, most it can give, mixed, its actual share in permille of the mixture, and whether it falls short."""
    counts = checkpointed(token_counts(documents, tokenizer))
    s = slot_schedule(source_supply(counts, targets), block_tokens)
    mixed = _filled(counts, s, seed).groupBy(F.col("source").alias("_m")).agg(F.sum("n_tokens").alias("mixed"))
    m = F.coalesce("mixed", F.lit(0)).cast("long")
    all_mixed = F.sum(m).over(W.partitionBy(F.lit(0)))  # over the targets' rows
    d = used_up(s).join(mixed, F.col("source") == F.col("_m"), "left")
    return d.select("source", "target_permille", "max_repeats", "tokens", F.ceil("wanted").alias("wanted"), "most", m.alias("mixed"), F.round(1000 * m / all_mixed, 3).alias("actual_permille"), "falls_short")
