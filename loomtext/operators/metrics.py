"""Metrics of generated text against sources and references."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import dedup
from loomtext.operators.tokens import TOKENIZER, _processor
from loomtext.plans.lineage import broadcast_if_small

# What an output must keep: links, addresses, handles, code and numbers; and marks that do not belong to the end of a link.
SPAN_PATTERNS = [
    r"https?://\S+",
    r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    r"(?<![\w@])@\w+",
    r"`[^`\n]+`",
    r"(?<![\w.])\d+(?:[.,:/]\d+)*%?",
]
LINK_END = ".,;:!?)]}'\""


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def run_counts(sequences: list[np.ndarray], n: int, keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """How often every run of ``n`` symbols occurs in each of several sequences: a matrix with a row per sequence and a column per different run.

    ``keys`` are the 64-bit keys of the runs of n - 1 symbols (the last call's second result; empty at first), so that each order costs one
    multiplication and one sort.
    """
    if n == 1:
        keys = [x * _FACTOR for x in sequences]
    else:
        keys = [(k[: max(0, len(x) - n + 1)] ^ x[n - 1 :]) * _FACTOR + np.uint64(n) for k, x in zip(keys, sequences)]
    whole = np.concatenate(keys)
    different, at = np.unique(whole, return_inverse=True)
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    return np.bincount(row * len(different) + at, minlength=len(keys) * len(different)).reshape(len(keys), -1), keys


def _harmonic(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def _share(part: float, whole: float) -> float:
    return float(part / whole) if whole else 1.0


def _mean_ratio(part: np.ndarray, whole: np.ndarray) -> float:
    """Mean of part / whole over the runs that the whole has; 1 without any."""
    there = whole > 0
    return float((part[there] / whole[there]).mean()) if there.any() else 1.0


def sari(source: str, output: str, references: list[str]) -> float:
    """SARI of tokenised, lower-cased texts (0 to 100): keep and add as F1, delete as precision, over runs of 1 to 4 tokens.

    Source and output counts are multiplied by the number of references, whose counts are added up.
    """
    number: dict[str, int] = {}
    sequences = [np.array([number.setdefault(t, len(number) + 1) for t in x.split()], np.uint64) for x in (source, output, *references)]
    total, keys = 0.0, []
    for n in range(1, 5):
        counts, keys = run_counts(sequences, n, keys)
        src, out, ref = counts[0] * len(references), counts[1] * len(references), counts[2:].sum(axis=0)
        kept, gone = np.minimum(src, out), np.maximum(src - out, 0)
        good, rightly = np.minimum(kept, ref), np.maximum(gone - ref, 0)
        keep = _harmonic(_mean_ratio(good, kept), _share(good.sum(), np.minimum(src, ref).sum()))
        fresh = src == 0
        added, due = fresh & (out > 0), fresh & (ref > 0)
        hits = (added & due).sum()
        total += keep + _mean_ratio(rightly, gone) + _harmonic(_share(hits, added.sum()), _share(hits, due.sum()))
    return 100 * total / 12


def chrf(output: str, reference: str, order: int = 6, beta: float = 2.0) -> float:
    """Mean F-beta of character runs of 1 to ``order`` without blanks (0 to 100); two empty texts are equal."""
    codes = [np.frombuffer(x.replace(" ", "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for x in (output, reference)]
    if not len(codes[0]) and not len(codes[1]):
        return 100.0
    scores, keys = [], []
    for n in range(1, min(order, *map(len, codes)) + 1):
        counts, keys = run_counts(codes, n, keys)
        common = float(np.minimum(counts[0], counts[1]).sum())
        p, r = (common / len(k) for k in keys)
        scores.append((1 + beta**2) * p * r / (beta**2 * p + r) if common else 0.0)
    return 100 * sum(scores) / len(scores) if scores else 0.0


def protected_list(text: str) -> list[str]:
    """Links, addresses, handles, code and numbers, each once; what starts inside the match of an earlier pattern belongs to that."""
    owner = bytearray(len(text) + 1)
    out: dict[str, None] = {}
    for n, p in enumerate(map(re.compile, SPAN_PATTERNS)):
        for m in p.finditer(text):
            a, b = m.span()
            if not owner[a]:
                owner[a:b] = b"\1" * (b - a)
                out.setdefault(m.group() if n else m.group().rstrip(LINK_END))
    return [x for x in out if x]


def preserved(source: str, output: str) -> float | None:
    spans = protected_list(source)
    return sum(s in output for s in spans) / len(spans) if spans else None


def _sari_series(source: pd.Series, output: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([None if None in (s, o, r) else sari(s, o, [r]) for s, o, r in zip(source, output, reference)], dtype="float64")


def _chrf_series(output: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([None if None in (o, r) else chrf(o, r) for o, r in zip(output, reference)], dtype="float64")


def _preserved_series(source: pd.Series, output: pd.Series) -> pd.Series:
    return pd.Series([None if None in (s, o) else preserved(s, o) for s, o in zip(source, output)], dtype="float64")


def reject_reason(source, output, style, cleanup, wanted_style: str, low: float = 0.5, high: float = 2.0, longest: int = 2000):
    """The first reason that keeps a pair out of the training set, or null."""
    ratio = T.length_ratio(source, output)
    return (
        F.when(~style.eqNullSafe(F.lit(wanted_style)), "wrong_style")
        .when(~F.coalesce(cleanup, F.lit("KEEP")).eqNullSafe(F.lit("KEEP")), "cleanup_excluded")
        .when((T.strip(F.coalesce(source, F.lit(""))) == "") | (T.strip(F.coalesce(output, F.lit(""))) == ""), "empty")
        .when(source == output, "identity")
        .when(F.length(source) > longest, "source_too_long")
        .when(F.length(output) > longest, "target_too_long")
        .when(ratio < low, "length_ratio_low")
        .when(ratio > high, "length_ratio_high")
    )


#: Tokens that a frame adds to a source and to a target.
SOURCE_OVERHEAD, TARGET_OVERHEAD = 4, 1
#: Evaluation keys that are broadcast; more of them are joined by a shuffle.
MAX_KEYS = 100_000


def sft_reasons(pairs: DataFrame, evals: DataFrame, wanted_style: str, low: float = 0.5, high: float = 2.0, most_source: int = 512, most_target: int = 384, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, reason): the first reason that keeps a pair (doc_id, src, out, style, cleanup) out of the training set, or kept.

    Rules on the record come first, then the evaluation set (``evals``: text) and equal inputs, of which the lowest
    doc_id stays; then protected spans and the lengths in tokens of the model, with the frame's own tokens.
    """
    src, out = (T.strip(F.coalesce(c, F.lit(""))) for c in ("src", "out"))
    record = (
        F.when(~F.col("style").eqNullSafe(F.lit(wanted_style)), "wrong_style")
        .when(~F.coalesce("cleanup", F.lit("KEEP")).eqNullSafe(F.lit("KEEP")), "cleanup_excluded")
        .when((src == "") | (out == ""), "empty")
        .when(src == out, "identity")
    )
    keys = broadcast_if_small(evals.filter("text is not null").select(F.sha2(T.strip(F.col("text")), 256).alias("_key"), F.lit(True).alias("_eval")).distinct(), MAX_KEYS)
    marked = pairs.select("doc_id", src.alias("src"), out.alias("out"), record.alias("_record"), F.sha2(src, 256).alias("_key")).join(keys, "_key", "left")
    marked = marked.withColumn("_record", F.coalesce("_record", F.when(F.col("_eval"), "in_eval_set"))).drop("_eval")
    first = dedup.mark_first(marked.filter("_record is null").select("doc_id", "_key"), ["_key"], "doc_id", "_first").select("doc_id", "_first")
    marked = marked.join(first, "doc_id", "left").withColumn("_record", F.coalesce("_record", F.when(~F.col("_first"), "duplicate_input")))

    def frame(source: pd.Series, output: pd.Series) -> pd.Series:
        sp = _processor(path)
        reasons = []
        for s, o in zip(source, output):
            if s is None or o is None:
                reasons.append(None)
                continue
            kept = preserved(s, o)
            a, b = sp.encode([s, o], num_threads=1)
            rules = (
                (kept is not None and kept < 1, "target_drops_protected_span"),
                (not a or not b, "empty_after_tokenization"),
                (any(map(sp.is_control, a)) or any(map(sp.is_control, b)), "control_token_in_text"),
                (len(a) + SOURCE_OVERHEAD > most_source, "source_too_long"),
                (len(b) + TARGET_OVERHEAD > most_target, "target_too_long"),
                (len(b) < low * len(a), "length_ratio_low"),
                (len(b) > high * len(a), "length_ratio_high"),
            )
            reasons.append(next((name for hit, name in rules if hit), "kept"))
        return pd.Series(reasons, dtype=object)

    # pairs that are out already reach the model as nulls
    left = [F.when(F.col("_record").isNull(), F.col(c)) for c in ("src", "out")]
    return marked.select("doc_id", F.coalesce("_record", F.pandas_udf(frame, "string")(*left)).alias("reason"))


def sari_udf(*columns: Column) -> Column:
    return F.pandas_udf(_sari_series, "double")(*columns)


def chrf_udf(*columns: Column) -> Column:
    return F.pandas_udf(_chrf_series, "double")(*columns)


def preserved_udf(*columns: Column) -> Column:
    return F.pandas_udf(_preserved_series, "double")(*columns)


def acceptable(rules: list[Column]) -> Column:
    """Whether every rule holds; a rule that is null (its metric is undefined) does not count against a text."""
    out = F.lit(True)
    for r in rules:
        out = out & F.coalesce(r, F.lit(True))
    return out


def generation_means(pairs: DataFrame, by: str, source: str, output: str, low: float = 0.5, high: float = 2.0, most_novel: float = 0.8) -> DataFrame:
    """(by, mean_ratio, mean_novel, acceptable, pairs): means of the length ratio and of the share of new words, nulls left out, and the share
    of pairs that meet all limits at once: ratio within its range, few enough new words, no loop."""
    src, out = F.col(source), F.col(output)
    scored = pairs.select(by, T.length_ratio(src, out).alias("_r"), T.novel_word_rate(src, out).alias("_n"), T.has_loop(out).alias("_l"))
    good = acceptable([F.col("_r").between(low, high), F.col("_n") <= most_novel, ~F.col("_l")])
    return scored.groupBy(by).agg(F.round(F.avg("_r"), 6).alias("mean_ratio"), F.round(F.avg("_n"), 6).alias("mean_novel"), F.round(F.avg(good.cast("double")), 6).alias("acceptable"), F.count(F.lit(1)).alias("pairs"))
