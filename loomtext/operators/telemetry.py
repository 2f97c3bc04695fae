"""Counters, histograms, calibration, rankings and gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpadded(name: str, pad: int) -> Column:
    """Length without the padding at the right end."""
    return F.expr(f"coalesce(array_max(transform(`{name}`, (x, i) -> if(x <> {pad}, i + 1, 0))), 0)")


def lengths(batch: DataFrame) -> DataFrame:
    """(example_id, mode, e, l), every example once."""
    return batch.select("example_id", "mode", unpadded("encoder_input_ids", 0).alias("e"), unpadded("labels", -100).alias("l")).distinct()


def mode_counters(batch: DataFrame) -> DataFrame:
    by = lengths(batch).groupBy("mode").agg(F.count(F.lit(1)).alias("examples"), F.sum("e").alias("encoder_tokens"), F.sum("l").alias("label_tokens"), F.round(F.avg("e"), 6).alias("mean_encoder"))
    return by.withColumn("token_share", F.round(F.try_divide(F.col("encoder_tokens"), F.sum("encoder_tokens").over(Window.partitionBy())), 6))


def example_counters(examples: DataFrame, mode: str, spans: Column, truncated: Column, skipped: Column) -> DataFrame:
    """(mode, examples, spans, truncated, skipped, mean_spans): kept examples with their spans and how many of them were cut, and how many were skipped.

    ``skipped`` is the reason why there is no example, null where there is one.
    """
    rows = examples.select(F.col(mode).alias("mode"), spans.alias("_s"), truncated.alias("_t"), skipped.isNotNull().alias("_k"))
    kept = ~F.col("_k")
    by = rows.groupBy("mode").agg(
        F.count(F.when(kept, 1)).alias("examples"), F.coalesce(F.sum(F.when(kept, F.col("_s"))), F.lit(0)).cast("long").alias("spans"), F.count(F.when(kept & F.col("_t"), 1)).alias("truncated"), F.count(F.when(F.col("_k"), 1)).alias("skipped")
    )
    return by.withColumn("mean_spans", F.round(F.coalesce(F.try_divide(F.col("spans"), F.col("examples")), F.lit(0.0)), 6))


def skip_counts(examples: DataFrame, mode: str, skipped: Column) -> DataFrame:
    """(mode, reason, n) of the examples that were skipped."""
    return examples.select(F.col(mode).alias("mode"), skipped.alias("reason")).filter("reason is not null").groupBy("mode", "reason").agg(F.count(F.lit(1)).alias("n"))


def bucket(value: Column, edges: list[int]) -> Column:
    """The first edge that is not exceeded; the number of edges beyond all."""
    out = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        out = F.when(value <= edges[k], k).otherwise(out)
    return out


def length_histogram(batch: DataFrame, edges: list[int]) -> DataFrame:
    return lengths(batch).groupBy("mode", bucket(F.col("l"), edges).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def calibration(df: DataFrame, bins: int) -> DataFrame:
    """Per bin of confidence: rows, gap to the accuracy; and the expected calibration error over all (repeated)."""
    binned = df.withColumn("bin", F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int"))
    g = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.sum("hit") - F.sum("conf")).alias("_gap"))
    every = Window.partitionBy()
    return g.select("bin", "n", F.round(F.col("_gap") / F.col("n"), 6).alias("gap"), F.round(F.sum("_gap").over(every) / F.sum("n").over(every), 6).alias("ece"))


def weight_histogram(df: DataFrame, name: str, least: float = 1e-12, factor: float = 1.1) -> DataFrame:
    v = F.col("v")
    k = F.greatest(F.lit(0), F.floor(F.ln(F.abs(v) / least) / math.log(factor))).cast("int")
    values = df.select(F.explode(name).alias("v")).select(F.col("v").cast("double").alias("v"))
    return values.groupBy(F.when(v == 0, 0).otherwise(F.signum(v).cast("int") * (k + 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def binomial_tail(n: Column, m: Column) -> Column:
    """P(at least m heads of n), by summing n choose i along a recurrence; clamped to [0, 1]."""
    start = F.struct(F.lit(1.0).alias("c"), F.when(m <= 0, 1.0).otherwise(0.0).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        c = acc["c"] * (n - i + 1) / i
        return F.struct(c.alias("c"), (acc["s"] + F.when(i >= m, c).otherwise(0.0)).alias("s"))

    total = F.aggregate(F.sequence(F.lit(1).cast("long"), n), start, step, lambda a: a["s"])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / F.pow(F.lit(2.0), n)))


def rank_variants(df: DataFrame, key: str, criteria: list[tuple[Column, int]], eligible: Column) -> DataFrame:
    """(key, mean_rank) over weighted ordinal ranks, ties by key; null for what is not eligible. For small tables."""
    ranks = [(F.row_number().over(Window.partitionBy("_ok").orderBy(c, key)), w) for c, w in criteria]
    total = sum((r * w for r, w in ranks), F.lit(0)) / float(sum(w for _, w in criteria))
    return df.withColumn("_ok", eligible).withColumn("mean_rank", F.when(F.col("_ok"), total)).select(key, "mean_rank")


def gates(scans: DataFrame) -> DataFrame:
    """(gate, passed, metric) from one pass over the reports."""
    s = scans.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("total_unk", "total_words", "total_tokens", "total_byte_tokens")])
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    rows = [
        ("records", F.col("n") > 0, F.col("n").cast("double")),
        ("unknown", F.col("total_unk") <= 0.01 * F.col("total_words"), share("total_unk", "total_words")),
        ("fertility", F.try_divide(F.col("total_tokens"), F.col("total_words")) < 4, share("total_tokens", "total_words")),
        ("bytes", F.col("total_byte_tokens") <= 0.02 * F.col("total_tokens"), share("total_byte_tokens", "total_tokens")),
    ]
    return s.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), p.alias("passed"), m.alias("metric")) for g, p, m in rows])).alias("r")).select("r.*")


def best_checkpoint(df: DataFrame, by: str, step: str, value: str) -> DataFrame:
    """(by, best_low, best_high): the step of the lowest and of the highest value, the earliest of equal ones."""
    return df.groupBy(by).agg(F.min_by(step, F.struct(value, step)).alias("best_low"), F.max_by(step, F.struct(F.col(value), (-F.col(step)).alias("_n"))).alias("best_high"))


def mean_loss(df: DataFrame, by: str, loss: str, weight: str) -> DataFrame:
    """(by, mean_loss, perplexity) from sums of losses and of weights, per group and over all (null)."""
    mean = F.try_divide(F.sum(loss), F.sum(weight))
    return df.groupingSets([[by], []], by).agg(F.round(mean, 6).alias("mean_loss"), F.round(F.exp(F.least(mean, F.lit(50.0))), 6).alias("perplexity"))


def loss_by_length(df: DataFrame, length: str, loss: str, edges: list[int]) -> DataFrame:
    """(bucket, n, mean_loss): means by upper edges of lengths, the last bucket open; null losses are left out."""
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(length)))
    return df.filter(F.col(length).isNotNull() & F.col(loss).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(loss), 6).alias("mean_loss"))


def weight_moments(df: DataFrame, values: str) -> DataFrame:
    """(n, total, squares) of all elements of an array column, as doubles."""
    x = df.select(F.explode(values).alias("v")).select(F.col("v").cast("double").alias("v"))
    return x.agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"))


#: Files that one digest may stand for.
MAX_FILES = 100_000


def root_hashes(files: DataFrame, by: str, name: str, digest: Column) -> DataFrame:
    """(by, root): one digest over the lines "digest  name" of every group, ordered by name.

    A digest of a sequence is made in one task: a group of more than ``MAX_FILES`` names is refused, not gathered.
    """
    rows = files.select(by, name, F.concat(digest, F.lit("  "), F.col(name).cast("string"), F.lit("\n")).alias("_line"))
    if large := rows.groupBy(by).count().filter(F.col("count") > MAX_FILES).limit(1).collect():
        raise ValueError(f"{large[0][0]}: more than {MAX_FILES} files under one digest")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, "_line"))), lambda s: s["_line"]), "")
    return rows.groupBy(by).agg(F.sha2(joined, 256).alias("root"))


def file_digests(df: DataFrame, name: str, content: str) -> DataFrame:
    """(name, digest, bytes) of contents; null has no digest and no bytes."""
    return df.select(name, F.sha2(content, 256).alias("digest"), F.coalesce(F.octet_length(content), F.lit(0)).alias("bytes"))


def window_accumulators(df: DataFrame, by: str, step: str, width: int, value: str, label: str) -> DataFrame:
    """(by, window_id, total, highest, last_type): what gathers between two log lines, ``width`` steps apart."""
    return df.groupBy(by, F.floor(F.col(step) / width).alias("window_id")).agg(F.sum(value).alias("total"), F.max(value).alias("highest"), F.max_by(label, step).alias("last_type"))


def count_by_mode(df: DataFrame, key: str, mode: str = "mode") -> DataFrame:
    """(mode, n) of different examples."""
    return df.select(key, mode).distinct().groupBy(mode).agg(F.count(F.lit(1)).alias("n"))


def check_names(df: DataFrame, name: str, shape: str) -> DataFrame:
    """One row: names, different ones, whether none repeats and whether all have the shape."""
    n, different = F.count(F.lit(1)), F.countDistinct(name)
    return df.agg(n.alias("names"), different.alias("distinct_names"), (n == different).alias("unique_names"), F.bool_and(F.col(name).rlike(f"^(?:{shape})$")).alias("well_formed"))


def name_ids(df: DataFrame, name: str, first_id: int) -> DataFrame:
    """(name, id): ids that follow one another from ``first_id`` in order of names. For the small table of reserved names."""
    return df.select(name).distinct().select(name, (F.row_number().over(Window.partitionBy().orderBy(name)) - 1 + first_id).alias("id"))


def saturated(sources: DataFrame, lines: DataFrame, key: str, limit: str) -> DataFrame:
    """(key, lines, saturated): whether a source (source, lines) has as many lines as its limit, where it has one."""
    j = sources.select(key, limit).join(lines.select(F.col("source").alias(key), "lines"), key)
    return j.select(key, "lines", ((F.col("lines") >= F.col(limit)) & (F.col(limit) > 0)).alias("saturated"))


def schedule(steps: DataFrame, step: str, first: int, every: int, cooldown: int) -> DataFrame:
    """Adds due (every so many steps, counted from one, not before ``first``) and phase (main, then cooldown)."""
    s = F.col(step)
    return steps.withColumn("due", (s + 1 >= first) & ((s + 1) % every == 0)).withColumn("phase", F.when(s >= cooldown, "cooldown").otherwise("main"))
