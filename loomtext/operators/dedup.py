"""Exact, folded and banded duplicates.

"First" always means the smallest position. The first row of a key is found by a grouped
minimum, which combines on the map side, and marked by joining on the *position*, which is
unique: a key that holds a third of all rows never meets in one task.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.plans.lineage import materialize


def mark_first(df: DataFrame, keys: list[str], pos: str, flag: str) -> DataFrame:
    """Adds ``flag``: whether the row is the first of its key. Null keys are keys like any other; rows with a null
    position are never first."""
    firsts = df.filter(F.col(pos).isNotNull()).groupBy(*keys).agg(F.min(pos).alias("__first")).select("__first", F.lit(True).alias("__is"))
    return df.join(firsts, F.col(pos) == F.col("__first"), "left").withColumn(flag, F.coalesce("__is", F.lit(False))).drop("__first", "__is")


def two_stage(df: DataFrame, pos: str = "doc_id", text: str = "text") -> DataFrame:
    """(pos, verdict): keep, exact (text seen before) or near (folded text seen before among the rest)."""
    keyed = df.filter(F.col(text).isNotNull()).select(F.col(pos).alias("pos"), T.exact_key(F.col(text)).alias("_e"), T.folded_key(F.col(text)).alias("_n"))
    staged = mark_first(keyed, ["_e"], "pos", "_first_exact")
    rest = staged.filter("_first_exact").groupBy("_n").agg(F.min("pos").alias("_first")).select(F.col("_first").alias("pos"), F.lit(True).alias("_first_near"))
    verdict = F.when(~F.col("_first_exact"), "exact").when(F.col("_first_near"), "keep").otherwise("near")
    return staged.join(rest, "pos", "left").select("pos", verdict.alias("verdict"))


def corpus_duplicates(df: DataFrame, pos: str = "doc_id", text: str = "text") -> DataFrame:
    """(pos, is_duplicate): not the first in the exact or not the first in the folded key space; null texts are no duplicates."""
    keyed = df.select(F.col(pos).alias("pos"), F.col(text).alias("_t")).select("pos", F.col("_t").isNull().alias("_null"), T.exact_key(F.col("_t")).alias("_e"), T.folded_key(F.col("_t")).alias("_n"))
    # 140 bytes a row instead of two more scans of the texts
    keyed = materialize(keyed, "duplicate-keys")
    firsts = lambda k: keyed.filter("not _null").groupBy(k).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias(f"_first{k}"))
    marked = keyed.join(firsts("_e"), "pos", "left").join(firsts("_n"), "pos", "left")
    return marked.select("pos", (~F.col("_null") & (F.col("_first_e").isNull() | F.col("_first_n").isNull())).alias("is_duplicate"))


# ------------------------------------------------------------------ Bloom filter figures
PROBES = 5


def bloom_positions(key: Column, bits: int) -> Column:
    """The positions that a key sets: double hashing of a digest."""
    h1, h2 = T.draw(F.lit("a"), key), T.draw(F.lit("b"), key)
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.pmod(F.pmod(h1, F.lit(bits)) + i * (F.pmod(h2, F.lit(bits - 1)) + 1), F.lit(bits)))


def bloom_figures(df: DataFrame, text: str, bits_per_item: int = 8) -> DataFrame:
    """Items, bits, bits set, fill and the false-positive rate that a Bloom filter over the texts would have."""
    keys = df.filter(F.col(text).isNotNull()).select(T.exact_key(F.col(text)).alias("k")).distinct()
    items = keys.count()
    bits = max(64, bits_per_item * items)
    set_bits = keys.select(F.explode(bloom_positions(F.col("k"), bits)).alias("p")).distinct()
    fill = F.col("bits_set") / F.lit(float(bits))
    return set_bits.agg(F.count(F.lit(1)).alias("bits_set")).select(
        F.lit(items).cast("long").alias("items"), F.lit(bits).cast("long").alias("bits"), "bits_set", F.round(fill, 6).alias("fill"), F.round(F.pow(fill, F.lit(PROBES)), 6).alias("fpr")
    )


def filter_size(total_bytes: Column) -> Column:
    """Chunks to expect from so many bytes: one per 1200, at least 1000."""
    return F.greatest(F.ceil(total_bytes / 1200), F.lit(1000)).cast("long")


# ------------------------------------------------------------------ MinHash bands
PRIME = (1 << 31) - 1
BANDS, ROWS = 8, 8
#: Affine maps modulo PRIME; multiplier and offset of permutation k.
WORD = re.compile(r"[a-z0-9']+")
PERMS = [(48271 * (k + 1) % PRIME, 69621 * (k + 7) % PRIME) for k in range(BANDS * ROWS)]
_MULTIPLIERS, _OFFSETS = (np.array(x, np.int64)[:, None] for x in zip(*PERMS))


def _bands(text: str | None, shingle: int, least: int) -> list[str] | None:
    words = WORD.findall(text.lower()) if text else []
    grams = {" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)}
    if len(grams) < least:
        return None
    # the first 28 bits of each digest, read in one go
    hashes = np.frombuffer(b"".join([hashlib.sha256(g.encode()).digest()[:4] for g in grams]), ">u4").astype(np.int64) >> 4
    low = ((hashes[None, :] * _MULTIPLIERS + _OFFSETS) % PRIME).min(axis=1).reshape(BANDS, ROWS)
    return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()[:16] for row in low.tolist()]


def band_hashes(c: Column, shingle: int = 5, least: int = 20) -> Column:
    """One digest per band of the text's shingles of five words; null with fewer than ``least`` different ones.

    In Arrow batches: the permutations are one array operation per text, about ten times as
    fast as the same in higher-order functions, and nothing is exploded.
    """

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_bands(t, shingle, least) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<string>")(c)


def minhash_bands(df: DataFrame, pos: str = "doc_id", text: str = "text") -> DataFrame:
    """(pos, band_no, band_hash) of every text long enough to sketch."""
    hashed = df.filter(F.col(text).isNotNull()).select(F.col(pos).alias("pos"), band_hashes(F.col(text)).alias("b"))
    # an outer explode: the filter that Spark infers for the inner one would run the function a second time
    return hashed.select("pos", F.posexplode_outer("b").alias("band_no", "band_hash")).filter("band_hash is not null")


def near_duplicates(bands: DataFrame) -> DataFrame:
    """(pos, is_near_duplicate): not the first of its bucket in at least one band; no closure, no verification."""
    bands = materialize(bands, "bands")
    firsts = bands.groupBy("band_no", "band_hash").agg(F.min("pos").alias("pos"))
    # a text is first in so many of its bands; one band less than all marks it
    leads = firsts.groupBy("pos").agg(F.count(F.lit(1)).alias("_leads"))
    return bands.select("pos").distinct().join(leads, "pos", "left").select("pos", (F.coalesce("_leads", F.lit(0)) < BANDS).alias("is_near_duplicate"))
