"""Mixing sources to target weights by Poisson replication (problem 7)."""

from __future__ import annotations

import base64
import math
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.plans.lineage import broadcast_if_small, materialize

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the published splitting pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A registry of up to so many sources is broadcast; a larger one is joined by shuffles.
MAX_SOURCES = 10_000


@lru_cache(maxsize=2)
def _encoder(folder: str):
    import tiktoken

    with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("loomtext", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """doc_id, source_id (lower case, trimmed), n_tokens of a public byte-level tokenizer; 0 for null text."""

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        enc = _encoder(tokenizer_dir)
        return pd.Series([0 if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="int64")

    return docs.select("doc_id", F.lower(F.trim("source")).alias("source_id"), n_tokens(F.col("text")).alias("n_tokens"))


def source_supply(sizes: DataFrame, spec: DataFrame) -> DataFrame:
    """Per source of the registry: its tokens, the tokens of all documents, and what it may reach."""
    names = spec.filter("source_id is not null").select("source_id", F.lower(F.trim("source_id")).alias("_k"), F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).dropDuplicates(["_k"])
    # one aggregate over all documents gives the sources and, summed again, the whole: kept, so that no text is tokenized twice
    by_source = materialize(sizes.groupBy(F.col("source_id").alias("_s")).agg(F.sum("n_tokens").alias("tokens")), "supply")
    whole = by_source.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    got = names.join(by_source, F.col("_k") == F.col("_s"), "left").withColumn("all_tokens", whole)
    return got.select(
        "source_id", "target_weight", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), "all_tokens",
        (F.coalesce("tokens", F.lit(0)) * F.col("max_repeats")).alias("most_tokens"), (F.col("target_weight") * F.col("all_tokens")).alias("wanted_tokens"),
    )


def capped_mean(rate: float, cap: int) -> float:
    """Mean of min(Poisson(rate), cap)."""
    p, mean, below = math.exp(-rate), 0.0, 0.0
    for k in range(cap):
        mean += k * p
        below += p
        p *= rate / (k + 1)
    return mean + cap * (1 - below)


def poisson_rate(wanted: float, cap: int) -> float:
    """The rate at which a Poisson count cut off at ``cap`` has the mean ``wanted`` (< cap)."""
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < wanted and high < 700:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < wanted else (low, mid)
    return (low + high) / 2


def poisson_steps(wanted: float, cap: int) -> list[float]:
    """The distribution function of the count at 0 .. cap - 1: a draw u gets as many copies as steps are <= u."""
    if wanted >= cap:
        return [0.0] * cap
    if wanted <= 0:
        return []
    rate = poisson_rate(wanted, cap)
    steps, p, below = [], math.exp(-rate), 0.0
    for k in range(cap):
        below += p
        steps.append(min(below, 1.0))
        p *= rate / (k + 1)
    return steps


def replication_table(supply: DataFrame) -> DataFrame:
    """Per source of the registry: the mean repetition wanted, the steps of its Poisson count, the mean that these give,
    and whether it falls short, that is, whether every count must stay at ``max_repeats`` and that is still too little.

    A source without tokens that has a weight falls short. The steps come from a function of every row, so
    the registry may be of any size.
    """

    @F.pandas_udf("array<double>")
    def steps(want: pd.Series, cap: pd.Series) -> pd.Series:
        return pd.Series([poisson_steps(w, max(0, int(c))) for w, c in zip(want, cap)], dtype=object)

    wanted = F.coalesce(F.try_divide(F.col("wanted_tokens"), F.col("tokens")), F.lit(0.0))
    table = supply.withColumn("mean_wanted", wanted).withColumn("steps", steps("mean_wanted", "max_repeats"))
    mean = F.aggregate("steps", F.lit(0.0), lambda s, x: s + 1 - x)
    return table.withColumn("mean", mean).withColumn("falls_short", F.col("wanted_tokens") > F.col("tokens") * F.greatest(F.col("max_repeats"), F.lit(0)))


def mix_sources(docs: DataFrame, spec: DataFrame, seed: int = 17, tokenizer_dir: str = TOKENIZER_DIR, sizes: DataFrame | None = None) -> DataFrame:
    """The mix: one row (doc_id, source_id, copy_no, n_tokens, shuffle_key) per copy, in global random order.

    A document of source s gets min(Poisson(rate_s), max_repeats) copies, by inverting the
    distribution at a number hashed from (seed, doc_id); rate_s makes the expected tokens of s
    its target weight of the tokens of all documents; where max_repeats cannot reach that, every
    document has max_repeats copies. Sources outside the registry get none.
    """
    sizes = materialize(token_sizes(docs, tokenizer_dir), "mix-sizes") if sizes is None else sizes
    steps = replication_table(source_supply(sizes, spec)).select(F.lower(F.trim("source_id")).alias("_k"), F.col("steps").alias("_steps"))
    # 52 bits of the hash as a fraction
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 12) / F.lit(float(2**52))
    counted = sizes.join(broadcast_if_small(materialize(steps, "steps"), MAX_SOURCES), F.col("source_id") == F.col("_k")).withColumn("_u", u)
    copies = counted.withColumn("_n", F.expr("size(filter(_steps, s -> _u >= s))")).filter("_n > 0")
    exploded = copies.select("doc_id", "source_id", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy_no"))
    return exploded.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("copy_no"))).orderBy("shuffle_key", "doc_id", "copy_no")


def mix_shares(docs: DataFrame, spec: DataFrame, seed: int = 17, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Per source: weight wanted, tokens and copies in the mix, the share of the mix, and that of the total.

    ``share_of_total`` is measured against the tokens of all documents, the total that weights refer to:
    where a source cannot reach its weight the mix is smaller than that, and the shares of the
    others in the mix are larger.
    """
    sizes = materialize(token_sizes(docs, tokenizer_dir), "mix-sizes")
    got = mix_sources(docs, spec, seed, tokenizer_dir, sizes).groupBy(F.col("source_id").alias("_s")).agg(F.count(F.lit(1)).alias("copies"), F.sum("n_tokens").alias("mix_tokens"))
    whole = got.agg(F.sum("mix_tokens")).scalar()
    every = sizes.agg(F.sum("n_tokens")).scalar()
    names = spec.filter("source_id is not null").select("source_id", F.lower(F.trim("source_id")).alias("_k"), "target_weight", "max_repeats").dropDuplicates(["_k"])
    j = names.join(got, F.col("_k") == F.col("_s"), "left").withColumn("_all", whole).withColumn("_every", every)
    return j.select(
        "source_id", "target_weight", "max_repeats", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"),
        F.round(F.coalesce(F.try_divide(F.coalesce("mix_tokens", F.lit(0)), F.col("_all")), F.lit(0.0)), 6).alias("share"),
        F.round(F.coalesce(F.try_divide(F.coalesce("mix_tokens", F.lit(0)), F.col("_every")), F.lit(0.0)), 6).alias("share_of_total"),
    )
