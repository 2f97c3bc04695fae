import random
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from loomtext.llm import packing

BATCH = "example_id long, mode string, encoder_input_ids array<int>, labels array<int>"


def batch(spark, sizes, mode="R"):
    return spark.createDataFrame([(k, mode, [5] * e, [7] * l) for k, (e, l) in enumerate(sizes)], BATCH)


def spec(spark, e=100, l=50):
    return spark.createDataFrame([("R", e, l), ("S", e, l)], "mode string, encoder_capacity int, label_capacity int")


def check(rows, e=100, l=50):
    room = defaultdict(lambda: [0, 0])
    for r in rows:
        room[r.mode, r.container_id][0] += r.e
        room[r.mode, r.container_id][1] += r.l
    assert all(a <= e and b <= l for a, b in room.values())
    return len(room)


def test_unpadded_lengths(spark):
    rows = [(1, "R", [3, 0, 4, 0, 0], [5, -100, 6, -100]), (2, "R", [0, 0], [-100]), (3, "R", None, None), (4, "R", [], [])]
    got = {r.example_id: (r.enc_len, r.label_len) for r in packing.example_lengths(spark.createDataFrame(rows, BATCH)).collect()}
    assert got == {1: (3, 3), 2: (0, 0), 3: (0, 0), 4: (0, 0)}


def test_every_example_once_within_capacity(spark, clashing):
    rng = random.Random(4)
    sizes = [(rng.randint(0, 130), rng.randint(0, 70)) for _ in range(900)] + [(30, 10)] * 400
    df = batch(spark, sizes)
    df = clashing(df.unionByName(df.filter("example_id % 9 = 0")))
    rows = packing.pack(df, spec(spark)).collect()
    check(rows)
    by = defaultdict(list)
    for r in rows:
        by[r.example_id].append(r)
    assert len(by) == len(sizes)
    for k, (e, l) in enumerate(sizes):
        assert sum(r.e for r in by[k]) == e and sum(r.l for r in by[k]) == l
        assert len(by[k]) == max(1, -(-e // 100), -(-l // 50))
    again = packing.pack(df.repartition(7), spec(spark)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_little_room_is_lost(spark):
    rng = random.Random(5)
    sizes = [(rng.randint(3, 60), rng.randint(2, 20)) for _ in range(2000)]
    fill = packing.container_fill(packing.pack(batch(spark, sizes), spec(spark)), spec(spark)).first()
    assert fill.containers <= 1.03 * fill.least_containers


def brute(sizes, ce, cl):
    """The fewest containers, over all orders of first fit (which reaches an optimum for some order)."""
    best = len(sizes)
    for order in set(permutations(sizes)):
        bins = []
        for e, l in order:
            for b in bins:
                if b[0] + e <= ce and b[1] + l <= cl:
                    b[0] += e
                    b[1] += l
                    break
            else:
                bins.append([e, l])
        best = min(best, len(bins))
    return best


def test_reduction_keeps_the_optimum():
    """Where the reduction fixes everything, the number of containers is the least there is."""
    rng = random.Random(6)
    for _ in range(150):
        sizes = [(rng.randint(3, 10), rng.randint(3, 10)) for _ in range(6)]
        hist = defaultdict(int)
        for s in sizes:
            hist[s] += 1
        runs = packing._plan(10, 10, dict(hist))
        used = {c for _, _, _, n, at in runs for c in range(at, at + n)}
        best = brute(sizes, 10, 10)
        assert best <= len(used) <= best + (0 if all(2 * min(a, b) > 7 for a, b in sizes) else 1)


def test_edges(spark):
    rows = [(1, None, [1], [1]), (2, "Z", [1], [1]), (None, "R", [1], [1]), (3, "R", None, None)]
    got = {r.example_id: r for r in packing.pack(spark.createDataFrame(rows, BATCH), spec(spark)).collect()}
    assert set(got) == {1, 2, 3} and got[1].container_id is None and got[2].n_pieces == 0 and got[3].container_id == 0
    assert packing.pack(batch(spark, []), spec(spark)).count() == 0
    none = spark.createDataFrame([("R", 0, None)], "mode string, encoder_capacity int, label_capacity int")
    assert packing.pack(batch(spark, [(3, 3)]), none).first().container_id is None
    huge = packing.pack(batch(spark, [(100_000, 1)]), spec(spark)).agg(F.count("*"), F.countDistinct("container_id")).first()
    assert tuple(huge) == (1000, 1000)


@pytest.mark.parametrize("block", [1, 7])
def test_blocks_do_not_matter(spark, monkeypatch, block):
    df = batch(spark, [(30, 10)] * 50 + [(70, 40)] * 20)
    want = sorted(map(tuple, packing.pack(df, spec(spark)).collect()))
    monkeypatch.setattr(packing, "BLOCK", block)
    assert sorted(map(tuple, packing.pack(df, spec(spark)).collect())) == want
