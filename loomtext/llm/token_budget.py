"""Token budget per source and language (problem 4).

Two parts: exact totals from tokenizer scans, and estimates for documents. The estimate is
one ridge regression per language from bytes, words, digits, punctuation and script counts
to tokens, fitted on all counted documents; predictions of documents that were held out (a fifth at a time)
give the ratio of true to predicted totals that corrects its bias, and its error. Fits need sums of products only, so
these are summed by language and fifth, and nothing else comes to the driver.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.plans.lineage import broadcast_if_small, materialize

FEATURES = ["n_bytes", "n_words", "n_digits", "n_punct", "n_latin_ext", "n_other", "n_space"]
#: Up to this many counts are broadcast to pick out their documents; beyond, a shuffle join does.
BROADCAST_COUNTS = 40_000
#: Languages with fewer counted documents than this use the fit over all languages.
LEAST_ROWS = 20
#: Parts that are held out in turn, by hash.
FOLDS = 5
#: Sources that a registry may have to be broadcast.
MAX_SOURCES = 100_000


def language(name: str) -> Column:
    """Two lower-case letters of a language tag; null when there are none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(F.col(name))), "^([a-z]{2})", 1), F.lit(""))


def source_key(c: Column) -> Column:
    """The source_id that a written form spells: case, dashes, blanks and a size suffix do not matter."""
    folded = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s_-]+", "_")
    return F.regexp_replace(folded, r"_?\d+(\.\d+)?_?[kmgt]i?b$", "")


def known_source(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


def scan_totals(scans: DataFrame, spec: DataFrame) -> DataFrame:
    """Tokens per (source_id, lang) from ``per_source``, each shard once by its latest scan.

    Ties of ``scanned_at`` go to the later ``loaded_at``, then the greater ``scan_id``; scans
    without a shard path are separate shards. Keys that spell no known source, null figures and reports
    without a language are left out; negative figures never occur in a valid report and are ignored.
    """
    shard = F.coalesce(F.col("shard_path"), F.concat(F.lit("?"), F.col("scan_id").cast("string")))
    latest = scans.groupBy(shard.alias("_shard")).agg(
        F.max_by(F.struct(language("lang").alias("lang"), F.map_entries("per_source").alias("entries")), F.struct("scanned_at", "loaded_at", "scan_id")).alias("r")
    )
    rows = latest.select("r.lang", F.explode("r.entries").alias("e")).select("lang", source_key(F.col("e.key")).alias("_key"), F.col("e.value.tokens").alias("tokens"))
    names = spec.filter("source_id is not null").select("source_id", known_source(F.col("source_id")).alias("_known")).dropDuplicates(["_known"])
    rows = rows.filter("tokens >= 0 and lang is not null").groupBy("_key", "lang").agg(F.sum("tokens").alias("tokens"))
    return rows.join(broadcast_if_small(names, MAX_SOURCES), F.col("_key") == F.col("_known")).groupBy("source_id", "lang").agg(F.sum("tokens").alias("tokens"))


def budget_report(totals: DataFrame, slices: DataFrame) -> DataFrame:
    """Wanted and reached tokens of every row of ``slice_budget`` (a fixed small table)."""
    wanted = slices.select("source_id", "lang", "target_share")
    got = wanted.join(totals, ["source_id", "lang"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    whole = got.agg(F.sum("tokens")).scalar()
    return got.withColumn("slice_total", whole).withColumn("wanted_tokens", F.col("target_share") * F.col("slice_total"))


def document_features(docs: DataFrame) -> DataFrame:
    """Counts of every document; null and blank texts have zeros."""
    t = F.coalesce(F.col("text"), F.lit(""))
    count = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    n = F.length(t)
    return docs.select(
        "doc_id", F.coalesce(language("lang"), F.lit("?")).alias("lang"), F.lower(F.trim("source")).alias("source_id"), F.col("domain"),
        F.octet_length(t).cast("double").alias("n_bytes"),
        F.regexp_count(t, F.lit(r"[\p{L}\p{N}]+")).cast("double").alias("n_words"),
        (n - count(r"[0-9]+")).cast("double").alias("n_digits"),
        (n - count(r"[^\p{L}\p{N}\s]+")).cast("double").alias("n_punct"),
        (n - count(r"[À-ɏ]+")).cast("double").alias("n_latin_ext"),
        count(r"[\u0000-ɏ]+").cast("double").alias("n_other"),
        (n - count(r"\s+")).cast("double").alias("n_space"),
    )


class Sums(NamedTuple):
    """What a fit needs to know of documents: their number, tokens, features, and weighted products of features and of features and tokens."""

    n: int
    y: float
    x: np.ndarray
    xx: np.ndarray
    xy: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(*(a + b for a, b in zip(self, other)))

    def __sub__(self, other: Sums) -> Sums:
        return Sums(*(a - b for a, b in zip(self, other)))


def _ridge(s: Sums) -> np.ndarray:
    """Least squares weighted for relative error, with a slight ridge, no intercept: no text, no tokens."""
    scale = np.maximum(s.x / max(s.n, 1), 1e-9)
    return np.linalg.solve(s.xx / np.outer(scale, scale) + 1e-3 * np.eye(len(scale)), s.xy / scale) / scale


def _held_out(folds: list[Sums]) -> list[np.ndarray]:
    """For every fifth the fit on the other four."""
    whole = sum(folds[1:], folds[0])
    return [_ridge(whole - f if whole.n > f.n else whole) for f in folds]


def _ratio(y: float, guess: float) -> float:
    return float(y / guess) if guess > 0 else 1.0


def _guesses(folds: list[Sums]) -> list[float]:
    """Predicted tokens of every fifth, by the fit on the others."""
    return [float(f.x @ b) for f, b in zip(folds, _held_out(folds))]


def counted_rows(features: DataFrame, counts: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, lang, n_tokens, features) of all counted documents.

    ``tokenizer`` None takes the one with the most counted documents. Repeated and null counts are dropped, the
    latest stays; of documents with one id, the greatest.
    """
    valid = counts.filter("n_tokens is not null and doc_id is not null")
    if tokenizer is None:
        top = valid.groupBy("tokenizer").agg(F.countDistinct("doc_id").alias("count")).orderBy(F.desc("count"), "tokenizer").limit(1).collect()
        tokenizer = top[0][0] if top else None
    one = valid.filter(F.col("tokenizer").eqNullSafe(F.lit(tokenizer))).groupBy("doc_id").agg(F.max_by("n_tokens", F.struct("counted_at", "n_tokens")).alias("n_tokens"))
    rows = features.select("doc_id", "lang", *FEATURES).join(broadcast_if_small(one, BROADCAST_COUNTS), "doc_id")
    return rows.groupBy("doc_id").agg(F.max(F.struct("lang", "n_tokens", *FEATURES)).alias("r")).select("doc_id", "r.*")


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(FOLDS)).cast("int")


def _sums(rows: DataFrame) -> dict[str, list[Sums]]:
    """The sums of each fit by fifth ('*' all, languages with enough documents); a language is two letters, so there are few.

    Summed as decimals: the same at any partitioning.
    """
    exact = lambda c, kind: F.sum(c.cast(kind))
    w, k = F.greatest(F.col("n_tokens").cast("double"), F.lit(1.0)), len(FEATURES)
    wanted = [F.count(F.lit(1)), exact(F.col("n_tokens"), "decimal(28,0)")]
    wanted += [exact(F.col(f), "decimal(28,0)") for f in FEATURES]
    wanted += [exact(F.col(f) * F.col(g) / w, "decimal(28,6)") for i, f in enumerate(FEATURES) for g in FEATURES[i:]]
    wanted += [exact(F.col(f) * F.col("n_tokens") / w, "decimal(28,6)") for f in FEATURES]
    upper = np.triu_indices(k)
    none = Sums(0, 0.0, np.zeros(k), np.zeros((k, k)), np.zeros(k))
    by: dict[str, list[Sums]] = {}
    for r in rows.groupBy("lang", _fold().alias("fold")).agg(*wanted).orderBy("lang", "fold").collect():
        v = np.array([float(x) for x in r[4:]])
        xx = np.zeros((k, k))
        xx[upper] = v[k : k + len(upper[0])]
        one = Sums(r[2], float(r[3]), v[:k], xx + np.triu(xx, 1).T, v[k + len(upper[0]) :])
        for name in ("*", r.lang):
            parts = by.setdefault(name, [none] * FOLDS)
            parts[r.fold] = parts[r.fold] + one
    return {n: parts for n, parts in by.items() if n == "*" or sum(p.n for p in parts) >= LEAST_ROWS}


def fit_token_model(features: DataFrame, counts: DataFrame, tokenizer: str | None = None) -> dict[str, tuple[list[float], float]]:
    """Coefficients and bias correction by language; '*' is the fit over all languages."""
    fits = _sums(counted_rows(features, counts, tokenizer))
    if not fits:
        return {"*": ([0.25] + [0.0] * (len(FEATURES) - 1), 1.0)}  # a token per four bytes, without any count
    return {n: (_ridge(sum(parts[1:], parts[0])).tolist(), _ratio(sum(p.y for p in parts), sum(_guesses(parts)))) for n, parts in fits.items()}


def held_out_error(docs: DataFrame, counts: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per fit (a language, or '*'): counted documents, their true tokens, those predicted without the document's own fifth, in
    the fit and in the bias correction, the error of the total and the mean error of a document."""
    spark = docs.sparkSession
    rows = materialize(counted_rows(document_features(docs), counts, tokenizer), "counted")
    fits = _sums(rows)
    models, fixed = [], {}
    for name, parts in fits.items():
        guess, true = _guesses(parts), [p.y for p in parts]
        fix = [_ratio(sum(true) - t, sum(guess) - g) for t, g in zip(true, guess)]
        fixed[name] = sum(g * f for g, f in zip(guess, fix))
        models += [(name, k, (b * f).tolist()) for k, (b, f) in enumerate(zip(_held_out(parts), fix))]
    table = F.broadcast(spark.createDataFrame(models, "name string, fold int, model array<double>"))  # five rows a language
    each = rows.withColumn("fold", _fold()).withColumn("name", F.explode(F.array(F.lit("*"), "lang"))).join(table, ["name", "fold"])
    guess = sum((F.col(f) * F.col("model")[i] for i, f in enumerate(FEATURES)), F.lit(0.0))
    error = F.when(F.col("n_tokens") > 0, F.abs(guess / F.col("n_tokens") - 1))
    mean = {r.name: r.mean or 0.0 for r in each.groupBy("name").agg(F.avg(error).alias("mean")).collect()}
    out = []
    for name, parts in fits.items():
        n, true = sum(p.n for p in parts), sum(p.y for p in parts)
        out.append((name, n, int(true), fixed[name], abs(fixed[name] / max(true, 1) - 1), mean.get(name, 0.0)))
    return spark.createDataFrame(out, "lang string, documents long, true_tokens long, held_out_tokens double, total_error double, mean_error double")


def predict_tokens(features: DataFrame, models: dict[str, tuple[list[float], float]]) -> DataFrame:
    """doc_id, source_id, lang, domain, est_tokens (a whole number, 0 for blank texts)."""

    def of(name: str) -> Column:
        b, fix = models[name]
        total = sum((F.col(f) * float(c) for f, c in zip(FEATURES, b)), F.lit(0.0))
        return total * fix

    value = of("*")
    for name in models:
        if name != "*":
            value = F.when(F.col("lang") == name, of(name)).otherwise(value)
    est = F.when(F.col("n_bytes") == F.col("n_space"), 0.0).otherwise(F.greatest(F.lit(1.0), value))
    return features.select("doc_id", "source_id", F.when(F.col("lang") != "?", F.col("lang")).alias("lang"), "domain", F.round(est).cast("long").alias("est_tokens"))


def estimate_documents(docs: DataFrame, counts: DataFrame) -> DataFrame:
    features = document_features(docs)
    return predict_tokens(features, fit_token_model(features, counts))


def slice_estimates(estimates: DataFrame) -> DataFrame:
    """Totals by every combination of source, language and domain kept or rolled up."""
    return (
        estimates.cube("source_id", "lang", "domain")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum("est_tokens").alias("est_tokens"), F.grouping_id().alias("level"))
    )
