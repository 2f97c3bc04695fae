"""Apportionment, blends, budgets and splits over small tables of sources."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.plans.lineage import small_rows


def largest_remainder(df: DataFrame, total: int, weight: str, order: str, out: str = "share") -> DataFrame:
    """``total`` split by the weights of a small table: floors first, then one each to the largest fractions,
    ties by ``order``; never more than min(total, sum of weights). Zero weights get 0. Fractions are compared as whole
    numbers, so no rounding decides a tie."""
    whole = Window.partitionBy()
    sized = df.withColumn("__w", F.coalesce(F.col(weight), F.lit(0)).cast("decimal(38,0)")).withColumn("__sum", F.sum("__w").over(whole))
    sized = sized.withColumn("__total", F.least(F.lit(total).cast("decimal(38,0)"), F.col("__sum")))
    product = (F.col("__total") * F.col("__w")).cast("decimal(38,0)")
    cut = F.when(F.col("__sum") > 0, F.expr("cast(cast(__total * __w as decimal(38,0)) div __sum as bigint)")).otherwise(F.lit(0))
    sized = sized.withColumn("__floor", cut).withColumn("__rest", F.when(F.col("__sum") > 0, product % F.col("__sum")).otherwise(F.lit(0)))
    ranked = sized.withColumn("__rank", F.row_number().over(whole.orderBy(F.desc("__rest"), order))).withColumn("__left", F.col("__total").cast("bigint") - F.sum("__floor").over(whole))
    return ranked.withColumn(out, (F.col("__floor") + F.when(F.col("__rank") <= F.col("__left"), 1).otherwise(0)).cast("long")).drop("__w", "__sum", "__total", "__floor", "__rest", "__rank", "__left")


def allocate(budget: int, weights: dict[str, float], capacities: dict[str, int]) -> dict[str, int]:
    """Water-filling: shares in proportion to weights, cut at capacities, what is left over shared out again.

    The sum is min(budget, capacity of the weighted sources). Ties go to the smaller name.
    """
    got = dict.fromkeys(capacities, 0)
    left = min(budget, sum(capacities.values()))
    while left > 0:
        open_ = sorted(k for k in capacities if weights.get(k, 0) > 0 and got[k] < capacities[k])
        total = sum(weights[k] for k in open_)
        if not open_ or total <= 0:
            break
        exact = {k: left * weights[k] / total for k in open_}
        share = {k: int(v) for k, v in exact.items()}
        for k in sorted(open_, key=lambda k: (share[k] - exact[k], k))[: left - sum(share.values())]:
            share[k] += 1
        given = {k: min(share[k], capacities[k] - got[k]) for k in open_}
        if not any(given.values()):
            break
        for k, n in given.items():
            got[k] += n
        left -= sum(given.values())
    return got


def allocate_table(df: DataFrame, budget: int, key: str, weight: str, capacity: str) -> DataFrame:
    """``allocate`` over a table of sources (refused beyond 10,000 rows); null weights count as 0."""
    rows = small_rows(df.select(key, weight, capacity), 10_000, "sources")
    got = allocate(budget, {r[0]: float(r[1] or 0) for r in rows}, {r[0]: int(r[2] or 0) for r in rows})
    return df.sparkSession.createDataFrame([(k, n) for k, n in got.items()], f"{key} string, allocated long")


def train_budget(total: Column, requested: Column) -> Column:
    """The budget asked for, or, when there is not more than that, all but a tenth (at least one)."""
    return F.when(total <= requested, total - F.greatest(F.lit(1), F.floor(total / 10))).otherwise(requested).cast("long")


def blend_weights(blend: DataFrame, stats: DataFrame) -> DataFrame:
    """(source, weight): byte shares over bytes per line, scaled to 1 over the sources that have lines.

    blend(source, share), stats(source, lines, bytes). Sources without statistics are left out.
    """
    per = blend.join(stats, "source").filter("lines > 0 and bytes > 0 and share > 0").withColumn("__w", F.col("share") / (F.col("bytes") / F.col("lines")))
    return per.select("source", (F.col("__w") / F.sum("__w").over(Window.partitionBy())).alias("weight"))


#: Rows of a range that is finished by one task, and the most ranges.
RANGE_ROWS, MOST_RANGES = 1_000_000, 10_000
#: Up to so many bounds are compared in the JVM; more of them are searched in Arrow batches.
FEW_BOUNDS = 64


def range_part(df: DataFrame, pos: str, range_rows: int | None = None, least: int = 16) -> Column:
    """The number of the range of positions that a row falls into: ranges hold about ``range_rows`` rows each, wherever the positions lie.

    Bounds are approximate quantiles of the positions that occur, so an outlying position or a dense stretch makes
    no range larger; null positions fall into the first. One pass over the positions alone.
    """
    rows = RANGE_ROWS if range_rows is None else range_rows
    n = df.filter(F.col(pos).isNotNull()).count()
    parts = min(MOST_RANGES, max(least, -(-n // rows)))
    cuts = [k / parts for k in range(1, parts)]
    found = df.agg(F.percentile_approx(pos, cuts, F.lit(max(10_000, 20 * parts)))).first()[0] if n else None
    bounds = sorted(set(found or []))
    if len(bounds) <= FEW_BOUNDS:
        return reduce(lambda a, b: a + b, [F.coalesce((F.col(pos) > F.lit(b)).cast("int"), F.lit(0)) for b in bounds], F.lit(0))

    def search(values: pd.Series) -> pd.Series:
        # null positions come as NaN, which would sort behind all bounds
        return pd.Series(np.where(values.isna(), 0, np.searchsorted(np.array(bounds), values.fillna(bounds[0]).to_numpy(), side="left"))).astype("int32")

    return F.pandas_udf(search, "int")(pos)


def prefix_sums(df: DataFrame, pos: str, value: str, out: str, range_rows: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one by ``pos`` (unique, whole numbers).

    Two levels: sums of ranges of positions (``range_part``), then inside each range. No task sees all rows.
    """
    ranged = df.withColumn("__part", range_part(df, pos, range_rows))
    sums = ranged.groupBy("__part").agg(F.sum(value).alias("__s"))
    # at most MOST_RANGES rows
    before = sums.select("__part", F.coalesce(F.sum("__s").over(Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(before), "__part").withColumn(out, (F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")).drop("__part", "__before")


def numbered(df: DataFrame, key: str, out: str, parts: int = 1024) -> DataFrame:
    """Adds ``out``: the numbers 0, 1, 2 ... of the distinct values of ``key``, null for null; the same at any partitioning.

    Values are ranked inside hash buckets, whose sizes are summed first; no task sees all values. The result has one row per value.
    """
    values = df.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    sizes = values.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__bucket", F.coalesce(F.sum("__n").over(Window.partitionBy().orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy(key))
    return values.join(F.broadcast(before), "__bucket").withColumn(out, (F.col("__before") + rank - 1).cast("long")).drop("__bucket", "__before")


def budget_cut(df: DataFrame, pos: str, size: Column, budget: int, shard: int) -> DataFrame:
    """Rows until the budget is met, in order of position, with the shard each goes to.

    A row is written while the bytes before it are below the budget, so the last may exceed it.
    """
    sized = prefix_sums(df.withColumn("line_bytes", size.cast("long")), pos, "line_bytes", "bytes_before")
    return sized.filter(F.col("bytes_before") < budget).withColumn("shard", F.floor(F.col("bytes_before") / shard).cast("long"))


def select_quota(df: DataFrame, groups: list[str], quota: Column, *seed: Column) -> DataFrame:
    """An exact number of rows of every group, uniform and reproducible: the lowest draws win.

    The cut runs over a histogram of draws: groups are never sorted as a whole. Only the bucket in
    which the quota ends is ranked.
    """
    from loomtext.functions.text import draw

    drawn = df.withColumn("__draw", draw(*seed)).withColumn("__quota", quota)
    bucketed = drawn.withColumn("__bucket", F.shiftright("__draw", 44).cast("int"))
    counts = bucketed.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*groups, "__bucket", F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__before"))
    keys = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups] + [F.col("l.__bucket") == F.col("r.__bucket")]
    joined = bucketed.alias("l").join(before.alias("r"), keys).select("l.*", "r.__before")
    ranked = joined.withColumn("__rn", F.row_number().over(Window.partitionBy(*groups, "__bucket").orderBy("__draw")))
    return ranked.withColumn("selected", F.col("__before") + F.col("__rn") <= F.col("__quota")).drop("__draw", "__bucket", "__before", "__rn", "__quota")


def cumulative_draw(df: DataFrame, weights: DataFrame, u: Column, key: str = "source", weight: str = "weight") -> DataFrame:
    """Adds ``drawn``: the source whose stretch of the running weight sum holds u; the last source owns the tail.

    ``weights`` is a small table: its bounds become one array, so no join is needed.
    """
    rows = sorted((r[0], float(r[1])) for r in small_rows(weights.select(key, weight), 10_000, "weights") if r[1] and r[1] > 0)
    if not rows:
        raise ValueError("no source has a positive weight")
    total, bounds = sum(w for _, w in rows), []
    for _, w in rows:
        bounds.append((bounds[-1] if bounds else 0.0) + w / total)
    names = F.array(*[F.lit(k) for k, _ in rows])
    at = F.size(F.filter(F.array(*map(F.lit, bounds[:-1])), lambda b: b <= F.col("__u"))) + 1
    return df.withColumn("__u", u).withColumn("drawn", F.element_at(names, at)).drop("__u")


def realized_shares(drawn: DataFrame, lines: DataFrame, source: str = "drawn") -> DataFrame:
    """(source, draws, share, epochs): draws per source, their share of all, and how often its lines (source, lines) were gone through."""
    d = drawn.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("draws"))
    whole = F.sum("draws").over(Window.partitionBy())  # one row per source
    return d.join(lines.select("source", "lines"), "source").select("source", "draws", F.round(F.col("draws") / whole, 6).alias("share"), F.floor(F.col("draws") / F.col("lines")).alias("epochs"))


def byte_budgets(weights: DataFrame, have: DataFrame, total: int, key: str = "source_id", weight: str = "target_weight", least: float = 0.9) -> DataFrame:
    """(key, wanted_bytes, underfilled): the bytes every source should give to ``total``, and whether it has (source, bytes) less than ``least`` of that."""
    share = F.col(weight) / F.sum(weight).over(Window.partitionBy())  # one row per source
    j = weights.select(key, share.alias("_share")).join(have.select(F.col("source").alias(key), "bytes"), key, "left")
    return j.select(key, F.floor(F.col("_share") * total).alias("wanted_bytes"), (F.coalesce("bytes", F.lit(0)) < F.lit(least) * F.col("_share") * total).alias("underfilled"))


def token_estimates(counts: DataFrame, bytes_per_token: int = 4) -> DataFrame:
    """(source, rounded, tokens, gib) from bytes: tokens rounded half to even and rounded down, and gibibytes."""
    c = F.col("bytes")
    return counts.select("source", F.bround(c / bytes_per_token).cast("long").alias("rounded"), F.floor(c / bytes_per_token).alias("tokens"), F.round(c / float(1 << 30), 6).alias("gib"))


def bottom_draws(df: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """A uniform sample of n rows with their ``draw``: the lowest draws. Samples of parts merge (``merge_samples``)."""
    from loomtext.functions.text import draw

    return df.withColumn("draw", draw(F.lit(seed), F.col(key))).orderBy("draw", key).limit(n)


def merge_samples(parts: list[DataFrame], n: int, key: str) -> DataFrame:
    """The sample of n rows of all parts together, from a sample of n (or more) rows of each, whatever their sizes: the lowest draws of the union."""
    return reduce(DataFrame.unionByName, parts).orderBy("draw", key).limit(n)


def key_order_split(df: DataFrame, pos: str, text: str, salt: str, evals: int, trains: int) -> DataFrame:
    """(pos, split) of distinct texts, each by its first position: in order of salted digests the first ``evals`` evaluate, the next
    ``trains`` train, the rest rests. Two ordered limits, no global window; digests are moved, not texts."""
    key = F.sha2(F.concat(F.lit(salt), F.lit("\x01"), F.col(text)), 256)
    keyed = df.filter(F.col(text).isNotNull()).groupBy(key.alias("_key")).agg(F.min(pos).alias(pos))
    head = keyed.orderBy("_key").limit(evals + trains)
    first = head.orderBy("_key").limit(evals).select(pos, F.lit("eval").alias("_e"))
    marked = head.select(pos).join(first, pos, "left").select(pos, F.coalesce("_e", F.lit("train")).alias("_split"))
    return keyed.select(pos).join(marked, pos, "left").select(pos, F.coalesce("_split", F.lit("rest")).alias("split"))


def seed_offset(name: Column, factor: int = 31) -> Column:
    """The sum of the code points of a name times a factor: an offset that a name always has."""
    return F.aggregate(F.transform(F.split(name, ""), F.ascii), F.lit(0).cast("long"), lambda s, x: s + x) * factor


def sign_stream(keys: DataFrame, key: str, n: int) -> DataFrame:
    """(key, counter, sign): n signs per key from digests in counter mode."""
    k = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")).alias("counter"))
    first = F.conv(F.substring(F.sha2(F.concat_ws(":", key, "counter"), 256), 1, 1), 16, 10).cast("int")
    return k.select(key, "counter", F.when(first >= 8, 1).otherwise(-1).alias("sign"))


def grid(base: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Every row of ``base`` with every combination of the axes' values."""
    for name, values in axes.items():
        base = base.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return base


def in_turn(items: DataFrame, pos: str, workers: int) -> DataFrame:
    """Adds worker: items go round the workers in turn."""
    return items.withColumn("worker", F.pmod(pos, F.lit(workers)))
