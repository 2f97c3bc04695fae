"""Operators over ordered logs: spikes, rates, chains, schedules, long form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loomtext.operators.blend import range_part

#: Rows of one key that are processed together; longer logs are cut into blocks of this many.
BLOCK = 100_000


def ranked(df: DataFrame, by: list[str], order: str, range_rows: int) -> DataFrame:
    """Adds __rank: the number of a row inside its key by ``order`` (unique there), from 0; counts of ranges are summed, then each range is ranked by itself."""
    cut = df.withColumn("__part", range_part(df, order, range_rows))
    counts = cut.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*by, "__part", F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__before"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*by, "__part"]]
    joined = cut.alias("l").join(before.alias("r"), same).select("l.*", "r.__before")
    return joined.withColumn("__rank", F.col("__before") + F.row_number().over(Window.partitionBy(*by, "__part").orderBy(order)) - 1).drop("__part", "__before")


def blocks(df: DataFrame, by: list[str], order: str, halo: int, size: int | None = None, range_rows: int | None = None) -> DataFrame:
    """Adds _rank (from 0 inside the key), _block and _halo: logs cut into blocks that each repeat the ``halo`` rows before them.

    A key may hold a third of all rows: ranks come from counts of ranges of ``order`` (whole
    numbers, unique inside a key; ``blend.range_part``) and their prefix sums, so no task sees a whole key. Windows over
    (by, _block) that look back at most ``halo`` rows are exact for the rows with _halo false.
    """
    size = BLOCK if size is None else size
    numbered = ranked(df, by, order, size if range_rows is None else range_rows)
    own = F.floor(F.col("__rank") / size)
    # a row is also the halo of the next block when it stands among the last of its own
    both = F.when(F.pmod(F.col("__rank"), F.lit(size)) >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return numbered.withColumn("__own", own).withColumn("__block", F.explode(both)).withColumn("__halo", F.col("__block") != F.col("__own")).drop("__own")


def _done(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("__halo")).drop("__rank", "__block", "__halo")


def loss_spikes(df: DataFrame, by: list[str], step: str, value: str, window: int = 50, history: int = 20, threshold: float = 3.0) -> DataFrame:
    """Adds ratio (value over the median of up to ``window`` earlier values, null before ``history`` of them), spike and
    rising (a spike that does not continue one)."""
    cut = blocks(df, by, step, window + 1)
    past = Window.partitionBy(*by, "__block").orderBy("__rank").rowsBetween(-window, -1)
    order = Window.partitionBy(*by, "__block").orderBy("__rank")
    finite = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    ratio = F.when(F.count(finite).over(past) >= history, finite / F.nullif(F.percentile(finite, F.lit(0.5)).over(past), F.lit(0.0)))
    out = cut.withColumn("ratio", ratio).withColumn("spike", F.coalesce(F.col("ratio") >= threshold, F.lit(False)))
    return _done(out.withColumn("rising", F.col("spike") & ~F.coalesce(F.lag("spike").over(order), F.lit(False))))


def throughput(df: DataFrame, by: list[str], step: str, seconds: Column) -> DataFrame:
    """Adds seconds since the previous record and since the first of the session, and records per second so far."""
    timed = df.withColumn("__s", seconds)
    starts = timed.groupBy(*by).agg(F.min_by("__s", step).alias("__first"))
    order = Window.partitionBy(*by, "__block").orderBy("__rank")
    cut = blocks(timed, by, step, 1).withColumn("delta_s", F.col("__s") - F.lag("__s").over(order)).withColumn("done", F.col("__rank"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    out = _done(cut).alias("l").join(starts.alias("r"), same).select("l.*", "r.__first").withColumn("session_s", F.col("__s") - F.col("__first"))
    return out.withColumn("rate", F.when(F.col("session_s") > 0, F.col("done") / F.col("session_s"))).drop("__s", "__first")


def hash_chain(df: DataFrame, by: list[str], seq: str, payload: Column) -> DataFrame:
    """Adds hash (of the record) and prev_hash (of the record before; 64 zeros for the first)."""
    cut = blocks(df.withColumn("hash", F.sha2(payload, 256)), by, seq, 1)
    return _done(cut.withColumn("prev_hash", F.lag("hash", 1, "0" * 64).over(Window.partitionBy(*by, "__block").orderBy("__rank"))))


def verify_chain(df: DataFrame, by: list[str], seq: str, payload: Column | None = None) -> DataFrame:
    """Adds state: broken (prev_hash differs from the hash of the row before), absent (the payload is gone), mismatch (the payload has
    another hash) or ok, the first that holds. Without ``payload`` only the links are looked at."""
    expected = F.lag("hash", 1, "0" * 64).over(Window.partitionBy(*by, "__block").orderBy("__rank"))
    state = F.when(~F.col("prev_hash").eqNullSafe(expected), "broken")
    if payload is not None:
        state = state.when(payload.isNull(), "absent").when(~F.sha2(payload, 256).eqNullSafe(F.col("hash")), "mismatch")
    return _done(blocks(df, by, seq, 1).withColumn("state", state.otherwise("ok")))


def append_chain(log: DataFrame, present: DataFrame, step: str, payload: str) -> DataFrame:
    """The rows (entry, step, hash, prev_hash) that a log of one chain (the same columns) gets for what is ``present`` (step, payload) and not yet in it.

    The log is append-only: steps it has stay as they are, whatever is present now; new ones follow its last entry in order of
    steps, also those that lie before steps already written. Null steps and payloads are left out; of a step given twice the greatest payload counts.
    """
    fresh = present.filter(F.col(step).isNotNull() & F.col(payload).isNotNull()).groupBy(step).agg(F.max(payload).alias("_payload")).join(log.select(step).distinct(), step, "left_anti")
    last = log.agg(F.coalesce(F.max("entry"), F.lit(-1)).alias("e"), F.max_by("hash", "entry").alias("h")).first()
    linked = hash_chain(fresh.withColumn("_all", F.lit(0)), ["_all"], step, F.col("_payload"))
    numbered = ranked(linked, ["_all"], step, BLOCK)
    prev = F.when(F.col("__rank") == 0, F.lit(last.h or "0" * 64)).otherwise(F.col("prev_hash"))
    return numbered.select((F.col("__rank") + last.e + 1).alias("entry"), step, "hash", prev.alias("prev_hash"))


def missing_links(log: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """What is present and not yet in the log (nulls never are)."""
    return present.filter(F.col(key).isNotNull()).join(log.select(key), key, "left_anti")


def reset_windows(df: DataFrame, by: list[str], order: list[str], value: str, budget: int) -> DataFrame:
    """Adds window_no: rows gather until their values reach the budget, then a new window starts.

    Sequential inside a group, so groups must be bounded; the caller names what bounds them.
    """
    schema = StructType([*df.schema.fields, StructField("window_no", IntegerType())])

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        numbers, total, k = [], 0, 0
        for v in pdf[value]:
            numbers.append(k)
            total += 0 if v is None or v != v else v
            if total >= budget:
                total, k = 0, k + 1
        pdf["window_no"] = numbers
        return pdf

    return df.groupBy(*by).applyInPandas(run, schema)


SCHEDULES = ["constant", "constant_with_warmup", "linear", "cosine", "inverse_sqrt", "wsd_linear", "wsd_cosine", "wsd_sqrt"]


def learning_rates(step: Column, warmup: int, total: int, decay: int, floor: float = 0.0) -> dict[str, Column]:
    """The factor of every schedule at a step."""
    ramp = step / F.lit(float(max(1, warmup)))
    late = F.greatest(F.lit(0.0), (F.lit(float(total)) - step) / float(max(1, total - warmup)))
    turn = (step - warmup) / F.lit(float(max(1, total - warmup)))
    fall = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - (total - decay)) / F.lit(float(max(1, decay)))))
    shapes = {"wsd_linear": 1 - fall, "wsd_cosine": 0.5 * (1 + F.cos(fall * math.pi)), "wsd_sqrt": 1 - F.sqrt(fall)}
    out = {
        "constant": F.lit(1.0), "constant_with_warmup": F.lit(1.0), "linear": late, "cosine": F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(turn * math.pi)) * (1 - floor) + floor),
        "inverse_sqrt": 1 / F.sqrt((step + F.lit(float(warmup or 10_000)) - warmup) / float(warmup or 10_000)),
    } | {k: v * (1 - floor) + floor for k, v in shapes.items()}
    return {k: v if k == "constant" else F.when(step < warmup, ramp).otherwise(v) for k, v in out.items()}


def newest(df: DataFrame, keep: int, order: str, protect: Column) -> DataFrame:
    """Rows to delete: beyond the newest ``keep`` of those that are not protected. ``order`` is unique."""
    open_ = df.filter(~protect)
    return open_.join(open_.orderBy(F.desc(order)).limit(keep).select(order), order, "left_anti")


def scalars(df: DataFrame, step: str, columns: list[str]) -> DataFrame:
    """A wide record as (step, tag, value) rows; only the named numeric columns, nulls and NaN left out."""
    long = df.select(F.col(step), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([step], columns, "tag", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def describe_tags(tags: DataFrame, catalogue: list[tuple[str, str]]) -> DataFrame:
    """Adds text: of the first pattern of the catalogue that fully matches the tag."""
    text = F.coalesce(*[F.when(F.col("tag").rlike(f"^(?:{p})$"), F.lit(t)) for p, t in catalogue])
    return tags.withColumn("text", text)


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: list[float]) -> DataFrame:
    """(by, percent, value): sorted[min(n - 1, round_half_even(p / 100 * (n - 1)))].

    Values are counted first, so what is ordered is the distinct values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy(*by).orderBy(value)
    ranked = counts.withColumn("_upto", F.sum("__n").over(run)).withColumn("_all", F.sum("__n").over(Window.partitionBy(*by)))
    at = ranked.withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    want = F.least(F.col("_all") - 1, F.bround(F.col("percent") / 100 * (F.col("_all") - 1)).cast("long"))
    return at.filter((want < F.col("_upto")) & (want >= F.col("_upto") - F.col("__n"))).select(*by, "percent", value)


def top_shares(counts: DataFrame, n: str, percents: list[int]) -> DataFrame:
    """(percent, share): of the total that the top percent of ids hold. Equal counts are exchangeable, so the
    histogram of counts is enough: ids are never ordered one by one."""
    hist = counts.groupBy(F.col(n).alias("c")).agg(F.count(F.lit(1)).alias("ids"))
    desc = Window.partitionBy().orderBy(F.desc("c"))
    runs = hist.withColumn("_upto", F.sum("ids").over(desc)).withColumn("_ids", F.sum("ids").over(Window.partitionBy())).withColumn("_total", F.sum(F.col("c") * F.col("ids")).over(Window.partitionBy()))
    each = runs.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_ids") * F.col("percent") / 100)))
    taken = F.least(F.col("ids"), F.greatest(F.lit(0), F.col("_k") - (F.col("_upto") - F.col("ids"))))
    return each.groupBy("percent").agg(F.round(F.sum(F.col("c") * taken) / F.first("_total"), 6).alias("share"))
