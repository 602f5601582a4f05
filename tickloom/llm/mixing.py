"""Source mixtures at target token shares."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut, fits_broadcast, ship

TOKENIZER = os.environ.get("TICKLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the word pattern that goes with the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def _encoding(key: int, vocabulary: Broadcast, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.value.splitlines() if line)}
    return tiktoken.Encoding("tokens", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, tokens) of every text by a public tokenizer; null texts have none. The vocabulary, a file of a megabyte, is read on the driver and broadcast."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(id(vocabulary.value), vocabulary, pattern).encode_ordinary
        for texts in batches:
            yield pd.Series([0 if t is None else len(encode(t)) for t in texts.tolist()], dtype="int64")

    return docs.select("doc_id", "source", F.when(F.col("text").isNull(), 0).otherwise(tokens("text")).cast("long").alias("tokens"))


def rates(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, rate, tokens_sd): how often a source's documents are taken on average, and the
    standard deviation of the tokens so taken, as the last copy of each is a coin.

    Shares are taken relative to the targets that have tokens. Without a budget the total is the largest at which no source
    needs more than its max_repeats, so that every share is met; with one (in tokens) a source that would need more stays at
    its cap and the shares of the others are what the budget leaves them. Targets without documents keep rate 0; of repeated targets the
    smallest share counts, null and non-positive shares are left out.
    """
    goals = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.min("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens").cast("double") * F.col("tokens")).alias("_squares"))
    both = cut(goals.join(have, "source", "left").na.fill(0, ["documents", "tokens", "_squares"]))
    present = F.col("tokens") > 0
    # two scalars over the targets
    shares_, fit = both.agg(F.sum(F.when(present, F.col("target_share"))).alias("s")), both.agg(F.min(F.when(present, F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).alias("f"))
    total = F.lit(budget).cast("double") if budget is not None else fit.scalar() * shares_.scalar()
    rate = F.when(present, F.least(total * F.col("target_share") / shares_.scalar() / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    part = F.col("rate") - F.floor("rate")
    return both.withColumn("rate", rate).select("source", "target_share", "max_repeats", "documents", "tokens", "rate", F.sqrt(part * (1 - part) * F.col("_squares")).alias("tokens_sd"))


def mix(sized: DataFrame, rated: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, copy, tokens): each document floor(rate) times and once more with the remaining probability.

    The coin is a hash of seed and doc_id, so that the result doesn't depend on partitions or runs; a document never appears more
    than max_repeats times. Sources without a target are left out.
    """
    small = rated.where("rate > 0").select("source", "rate")
    if fits_broadcast(small):
        small = F.broadcast(small)
    coin = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) / float(1 << 52)
    copies = (F.floor("rate") + (coin < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    taken = sized.join(small, "source").withColumn("n", copies).where("n > 0")
    return taken.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "tokens")


def shares(mixed: DataFrame, rated: DataFrame) -> DataFrame:
    """The target and the actual share of each source, with what was available and taken, and share_sd: by how much the share may stray, one standard deviation of the source's own coins."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents_out"), F.sum("tokens").alias("tokens_out"))
    full = rated.join(got, "source", "left").na.fill(0, ["documents_out", "tokens_out"])
    everything = got.agg(F.sum("tokens_out")).scalar()
    part = lambda c: F.coalesce(F.col(c) / everything, F.lit(0.0))
    return full.select("source", "target_share", "max_repeats", "rate", "documents", "tokens", "documents_out", "tokens_out", part("tokens_out").alias("actual_share"), part("tokens_sd").alias("share_sd"))


def prepared(docs: DataFrame, targets: DataFrame, budget: int | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(sized, rated): token counts of the targeted sources' documents, written once to the shared folder, and their rates."""
    goals = targets.where("source is not null").select("source").distinct()
    wanted = docs.where("text is not null").select("doc_id", "source", "text").join(F.broadcast(goals) if fits_broadcast(goals) else goals, "source", "left_semi")
    sized = cut(count_tokens(wanted, tokenizer))
    return sized, cut(rates(sized, targets, budget))
