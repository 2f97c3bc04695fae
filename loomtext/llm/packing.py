"""Filling two-dimensional containers with examples (problem 3).

Every example of a mode has an encoder length and a label length; a container has a
capacity for each. The plan is made on the *histogram* of length pairs, whose size is
bounded by (encoder_capacity + 1) * (label_capacity + 1) per mode whatever the number of
examples, so the one task per mode that plans stays bounded. Examples then find their
container by their rank inside their length pair.

Planning: first the dominance reduction of Martello and Toth, in its form for vectors.
For a pair class j, let C be the classes that still fit beside it.

* C is empty: {j} is fixed.
* C holds a class that fills both remaining capacities exactly: {j, it} is fixed.
* at most one more example fits and one class of C is at least as large in both
  dimensions as all of C: {j, it} is fixed.
* at most two more fit, and the largest and the next largest of C (in both dimensions)
  fit together: {j, both} is fixed.

In each case any feasible container of j can be exchanged for the fixed one without
needing another container. The reduction is repeated until nothing changes; the rest is
packed by best fit, container by container.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.plans.lineage import broadcast_if_small

#: Ranks of one length pair are counted in independent parts: one for so many examples of the table, but this many at least.
PART_ROWS, LEAST_PARTS = 200_000, 64
#: Modes that a specification may have to be broadcast.
MAX_MODES = 100_000
#: Ranks are joined to the runs of the plan in blocks of this many.
BLOCK = 4096

PLAN_SCHEMA = "mode string, e int, l int, rank_from long, n long, container_from long"


def unpadded_length(name: str, pad: int) -> Column:
    """Length without the padding at the right end; 0 for null, empty or all-padding arrays.

    Null elements count as padding at the end and as content inside.
    """
    return F.expr(f"coalesce(array_max(transform(`{name}`, (x, i) -> if(x <> {pad}, i + 1, 0))), 0)")


def example_lengths(batch: DataFrame) -> DataFrame:
    """One row per ``example_id`` (deliveries of the same one collapse): mode and both lengths.

    Rows with a null ``example_id`` are left out. Other columns are ignored.
    """
    sized = batch.filter(F.col("example_id").isNotNull()).select(
        "example_id", "mode", unpadded_length("encoder_input_ids", 0).cast("int").alias("enc_len"), unpadded_length("labels", -100).cast("int").alias("label_len")
    )
    return sized.groupBy("example_id").agg(F.max(F.struct("enc_len", "label_len", "mode")).alias("m")).select("example_id", "m.mode", "m.enc_len", "m.label_len")


def capacities(spec: DataFrame) -> DataFrame:
    """One row per mode: the smaller where a mode is given twice; rows without positive capacities are left out."""
    valid = spec.filter("mode is not null and encoder_capacity > 0 and label_capacity > 0")
    return valid.groupBy("mode").agg(F.min("encoder_capacity").alias("encoder_capacity"), F.min("label_capacity").alias("label_capacity"))


def split_pieces(lengths: DataFrame, spec: DataFrame) -> DataFrame:
    """Pieces to pack: (example_id, mode, piece_no, n_pieces, e, l).

    An example is cut only when it exceeds a capacity by itself, into as few pieces as both
    capacities allow. Examples whose mode has no specification come out with n_pieces 0
    and are not packed.
    """
    caps = capacities(spec).select(F.col("mode").alias("_m"), F.col("encoder_capacity").alias("_ce"), F.col("label_capacity").alias("_cl"))
    known = lengths.join(broadcast_if_small(caps, MAX_MODES), F.col("mode") == F.col("_m"), "left")
    need = F.greatest(F.ceil(F.col("enc_len") / F.col("_ce")), F.ceil(F.col("label_len") / F.col("_cl")), F.lit(1)).cast("int")
    known = known.withColumn("n_pieces", F.when(F.col("_ce").isNull() | F.col("_cl").isNull(), 0).otherwise(need))
    cut = known.withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.greatest("n_pieces", F.lit(1)))))
    part = lambda n, c: F.greatest(F.lit(0), F.least(F.col(c), F.col(n) - (F.col("piece_no") - 1) * F.col(c))).cast("int")
    return cut.select("example_id", "mode", "piece_no", "n_pieces", "enc_len", "label_len", part("enc_len", "_ce").alias("e"), part("label_len", "_cl").alias("l"))


def _plan(ce: int, cl: int, hist: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (e, l, rank_from, n, container_from): n examples of a pair, one per container."""
    left = np.zeros((ce + 1, cl + 1), np.int64)
    for (e, l), n in hist.items():
        left[e, l] += n
    used = np.zeros_like(left)
    runs: list[tuple[int, int, int, int, int]] = []
    containers = 0

    def put(e: int, l: int, n: int, at: int) -> None:
        runs.append((e, l, int(used[e, l]), n, at))
        used[e, l] += n
        left[e, l] -= n

    empties, left[0, 0] = int(left[0, 0]), 0
    order = lambda: [(int(e), int(l)) for e, l in sorted(zip(*np.nonzero(left)), key=lambda c: (-(max(c[0] / ce, c[1] / cl)), -(c[0] / ce + c[1] / cl), c))]

    def dominating(e: int, l: int) -> list[tuple[int, int]] | None:
        """The partners that provably serve (e, l) best; None when no rule applies."""
        fits = left[: ce - e + 1, : cl - l + 1]
        own = e <= ce - e and l <= cl - l
        if own:
            left[e, l] -= 1
        try:
            rows, cols = np.nonzero(fits.any(axis=1))[0], np.nonzero(fits.any(axis=0))[0]
            if not len(rows):
                return []
            if fits[ce - e, cl - l]:
                return [(ce - e, cl - l)]
            big = (int(rows[-1]), int(cols[-1]))
            if not fits[big]:
                return None
            low_e, low_l = int(rows[0]), int(cols[0])
            if 2 * low_e > ce - e or 2 * low_l > cl - l:
                return [big]
            if 3 * low_e > ce - e or 3 * low_l > cl - l:
                fits[big] -= 1
                rows, cols = np.nonzero(fits.any(axis=1))[0], np.nonzero(fits.any(axis=0))[0]
                second = (int(rows[-1]), int(cols[-1])) if len(rows) else None
                there = second is not None and fits[second] > 0
                fits[big] += 1
                if there and big[0] + second[0] <= ce - e and big[1] + second[1] <= cl - l:
                    return [big, second]
            return None
        finally:
            if own:
                left[e, l] += 1

    changed = True
    while changed:
        changed = False
        for e, l in order():
            while left[e, l] > 0:
                partners = dominating(e, l)
                if partners is None:
                    break
                members = [(e, l), *partners]
                # as many containers of this make-up as there are examples for
                n = min(int(left[m]) // members.count(m) for m in set(members))
                if partners:
                    # the rules look at what is left, so stop one short of using a class up, then look again
                    n = max(1, n - 1)
                for m in members:
                    put(*m, n, containers)
                containers += n
                changed = True

    # best fit of what is left: a container opens with the largest pair and takes, again and again, the
    # pair that fits its room best: the largest product with the room, weighted by how scarce each side is
    pairs = np.argwhere(left > 0)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0], -(pairs / [ce, cl]).sum(axis=1), -(pairs / [ce, cl]).max(axis=1)))]
    count = left[pairs[:, 0], pairs[:, 1]]
    while len(pairs):
        size = pairs / [ce, cl]
        demand = (size * count[:, None]).sum(axis=0) + 1e-12
        weight = demand / demand.sum()
        at = 0
        # the arrays are cut down when half of the pairs are used up
        while (live := int((count > 0).sum())) and 2 * live > len(pairs):
            while not count[at]:
                at += 1
            free = count.copy()
            free[at] -= 1
            members = [at]
            room = np.array([ce, cl]) - pairs[at]
            fits = (pairs[:, 0] <= room[0]) & (pairs[:, 1] <= room[1]) & (free > 0)
            while fits.any():
                near = np.where(fits, size @ (weight * (room / [ce, cl]) ** 2), -1.0)
                k = int(np.argmax(near))
                members.append(k)
                free[k] -= 1
                room = room - pairs[k]
                fits &= (pairs[:, 0] <= room[0]) & (pairs[:, 1] <= room[1])
                fits[k] &= free[k] > 0
            n = min(int(count[k]) // members.count(k) for k in set(members))
            for k in members:
                put(int(pairs[k, 0]), int(pairs[k, 1]), n, containers)
                count[k] -= n
            containers += n
        pairs, count = pairs[count > 0], count[count > 0]
    left[0, 0] = empties
    while left[0, 0] > 0:
        # an empty example needs no room: spread them over the containers there are
        put(0, 0, min(int(left[0, 0]), max(containers, 1)), 0)
    return runs


def plan_containers(pieces: DataFrame, spec: DataFrame) -> DataFrame:
    """Runs of the packing plan, by mode; one bounded task per mode (see the module's text)."""
    hist = pieces.filter("n_pieces > 0").groupBy("mode", "e", "l").agg(F.count(F.lit(1)).alias("n"))
    caps = capacities(spec)

    def plan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ce, cl = int(pdf.encoder_capacity.iloc[0]), int(pdf.label_capacity.iloc[0])
        runs = _plan(ce, cl, {(int(e), int(l)): int(n) for e, l, n in zip(pdf.e, pdf.l, pdf.n)})
        out = pd.DataFrame(runs, columns=["e", "l", "rank_from", "n", "container_from"])
        out.insert(0, "mode", key[0])
        return out

    return hist.join(broadcast_if_small(caps, MAX_MODES), "mode").groupBy("mode").applyInPandas(plan, PLAN_SCHEMA)


def pack(batch: DataFrame, spec: DataFrame) -> DataFrame:
    """Assign every piece of every example to a container.

    Result: example_id, mode, piece_no, n_pieces, e, l, container_id (from 0 per mode; null
    where the mode is null or has no specification). Deterministic for any partitioning.
    """
    keys = ["mode", "e", "l"]
    pieces = split_pieces(example_lengths(batch), spec)
    runs = plan_containers(pieces, spec)
    part = F.pmod(F.xxhash64("example_id", "piece_no"), F.lit(max(LEAST_PARTS, batch.count() // PART_ROWS))).cast("int")
    parts = pieces.withColumn("_part", part)
    before = (
        parts.filter("n_pieces > 0").groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("example_id", "piece_no")
    ranked = parts.withColumn("_rn", F.row_number().over(inside)).join(before, [*keys, "_part"], "left").withColumn("_rank", F.col("_before") + F.col("_rn") - 1)
    ranked = ranked.withColumn("_block", F.floor(F.col("_rank") / BLOCK))
    blocks = runs.select(
        *(F.col(k).alias(f"_r_{k}") for k in keys), "rank_from", "n", "container_from",
        F.explode(F.sequence(F.floor(F.col("rank_from") / BLOCK), F.floor((F.col("rank_from") + F.col("n") - 1) / BLOCK))).alias("_r_block"),
    )
    same = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col("_block") == F.col("_r_block"), F.col("_rank") >= F.col("rank_from"), F.col("_rank") < F.col("rank_from") + F.col("n")]
    return ranked.join(blocks, same, "left").select(
        "example_id", "mode", "piece_no", "n_pieces", "e", "l", (F.col("container_from") + F.col("_rank") - F.col("rank_from")).alias("container_id")
    )


def container_fill(packed: DataFrame, spec: DataFrame) -> DataFrame:
    """Per mode: pieces, containers, the least number any packing needs, and the shares filled."""
    caps = capacities(spec).select("mode", F.col("encoder_capacity").cast("long").alias("ce"), F.col("label_capacity").cast("long").alias("cl"))
    by_mode = packed.filter("container_id is not null").groupBy("mode").agg(
        F.count(F.lit(1)).alias("pieces"), (F.max("container_id") + 1).alias("containers"), F.sum("e").alias("_e"), F.sum("l").alias("_l")
    )
    j = by_mode.join(broadcast_if_small(caps, MAX_MODES), "mode")
    return j.select(
        "mode", "pieces", "containers", F.greatest(F.ceil(F.col("_e") / F.col("ce")), F.ceil(F.col("_l") / F.col("cl"))).cast("long").alias("least_containers"),
        F.round(F.col("_e") / (F.col("containers") * F.col("ce")), 6).alias("encoder_fill"), F.round(F.col("_l") / (F.col("containers") * F.col("cl")), 6).alias("label_fill"),
    )


def capacity_report(packed: DataFrame, spec: DataFrame) -> DataFrame:
    """Per mode: examples and tokens in containers, containers over a capacity (never any), the least number of containers
    that any packing needs, and whether those used are at most a tenth, and two, more."""
    caps = capacities(spec).select("mode", F.col("encoder_capacity").cast("long").alias("ce"), F.col("label_capacity").cast("long").alias("cl"))
    boxes = packed.filter("container_id is not null").groupBy("mode", "container_id").agg(F.sum("e").alias("_e"), F.sum("l").alias("_l"))
    boxes = boxes.join(broadcast_if_small(caps, MAX_MODES), "mode").groupBy("mode", "ce", "cl").agg(
        F.count(F.lit(1)).alias("_used"), F.sum("_e").alias("encoder_tokens"), F.sum("_l").alias("label_tokens"), F.count(F.when((F.col("_e") > F.col("ce")) | (F.col("_l") > F.col("cl")), 1)).alias("over_capacity")
    )
    examples = packed.filter("container_id is not null").groupBy("mode").agg(F.countDistinct("example_id").alias("examples"))
    least = F.greatest(F.ceil(F.col("encoder_tokens") / F.col("ce")), F.ceil(F.col("label_tokens") / F.col("cl"))).cast("long")
    return boxes.join(examples, "mode").withColumn("least_containers", least).select(
        "mode", "examples", "encoder_tokens", "label_tokens", "over_capacity", "least_containers", (F.col("_used") <= 1.1 * F.col("least_containers") + 2).alias("within_a_tenth")
    )
