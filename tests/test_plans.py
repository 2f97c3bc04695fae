import json
import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import tokens
from loomtext.plans import corpus_build as build

DOC = "doc_id long, source string, text string"


def test_viterbi_against_all_segmentations():
    rng = random.Random(1)
    pieces = {p: -rng.random() * 5 for p in ["a", "b", "ab", "ba", "aab", "bb", "abab"]}

    def best(t):
        if not t:
            return 0.0, []
        out = (-1e9, [])
        for k in range(1, len(t) + 1):
            s = pieces.get(t[:k], -20.0 if k == 1 else None)
            if s is not None:
                rest = best(t[k:])
                out = max(out, (s + rest[0], [t[:k], *rest[1]]))
        return out

    for _ in range(100):
        t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
        cut = tokens.viterbi(t, pieces)
        assert "".join(cut) == t and sum(pieces[p] for p in cut) == pytest.approx(best(t)[0])
    assert tokens.viterbi("axyb", pieces) == ["a", "xy", "b"]
    some = {"a": -1.0} | {f"<0x{b:02X}>": -9.0 for b in "é".encode()}
    assert tokens.with_bytes(tokens.viterbi("aéa€", some), some) == ["a", "<0xC3>", "<0xA9>", "a", "€"]


def test_repeat_ban(spark):
    df = spark.createDataFrame([([1, 2, 3, 1, 2],), ([1, 2, 3, 1, 2, 4, 1, 2],), ([1, 2],), ([],)], "t array<int>")
    assert [sorted(r.b) for r in df.select(tokens.banned_next("t", 3).alias("b")).collect()] == [[3], [3, 4], [], []]


def test_comparisons(spark):
    df = spark.createDataFrame([([1, 2], [1, 2]), ([1, 2], [2, 1]), ([1], [2]), (None, None)], "a array<int>, b array<int>")
    assert {r.state: r.n for r in tokens.compare_encodings(df, "a", "b").collect()} == {"equal": 2, "same_tokens": 1, "different": 1}
    a = spark.createDataFrame([("x", 1), ("y", 2)], "piece string, id int")
    assert tokens.compare_vocabularies(a, a).count() == 0
    assert {r.piece for r in tokens.compare_vocabularies(a, a.filter("id = 1")).collect()} == {"y"}


def test_user_supplied_encoder(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "k int, t string")
    got = {r.k: r.ids for r in tokens.encode(df, ["k"], "t", lambda ts: [[ord(c) % 250 + 5 for c in t] for t in ts]).collect()}
    assert got == {1: [102, 103], 2: None, 3: []}


@pytest.mark.parametrize("parts", [1, 5])
def test_corpus_build_is_exact(spark, parts):
    rows = [(k, "abc"[k % 3] if k % 7 else None, "\n".join(f"line {n} of {k}" for n in range(k % 5))) for k in range(300)]
    df = spark.createDataFrame(rows, DOC).repartition(parts)
    lines, report = build.build_corpus(df, build.BuildSettings(200), {"a": 2.0, "b": 1.0, "c": 1.0})
    assert {r.source: r.trained for r in report.collect()} == {"a": 100, "b": 50, "c": 50}
    ids = sorted((r.doc_id, r.line_no) for r in lines.filter("train").collect())
    again = build.build_corpus(df.repartition(9), build.BuildSettings(200), {"a": 2.0, "b": 1.0, "c": 1.0})[0]
    assert ids == sorted((r.doc_id, r.line_no) for r in again.filter("train").collect())


def test_corpus_build_refuses(spark):
    df = spark.createDataFrame([(1, "a", "x" * 50), (2, "a", "short")], DOC)
    with pytest.raises(build.CorpusError, match="too long"):
        build.build_corpus(df, build.BuildSettings(1, max_line_bytes=10))
    for bad in ({}, {"train_budget": 0}, {"train_budget": 1, "x": 2}):
        with pytest.raises(build.CorpusError):
            build.BuildSettings.from_dict(bad)
    assert build.build_corpus(df.limit(0), build.BuildSettings(5))[1].count() == 0


def test_frozen_examples(spark):
    df = spark.range(50).select("id", F.transform(F.sequence(F.lit(1), (F.col("id") + 5).cast("int")), lambda x: (x + 1000).cast("int")).alias("t"))
    got = build.frozen_examples(df, "id", "t", {"R": 2, "S": 1, "X": 1}, 20)
    assert {r["mode"]: r["count"] for r in got.groupBy("mode").count().collect()} == {"R": 10, "S": 5, "X": 5}
    assert sorted(map(str, got.collect())) == sorted(map(str, build.frozen_examples(df.repartition(6), "id", "t", {"R": 2, "S": 1, "X": 1}, 20).collect()))


def test_freeze_and_loaders(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    gates = spark.createDataFrame([("ok", True), ("soft", False)], "gate string, passed boolean")
    with pytest.raises(build.CorpusError, match="soft"):
        build.freeze(str(tmp_path), gates, ["a.bin"])
    with pytest.raises(build.CorpusError, match="missing"):
        build.freeze(str(tmp_path), gates, ["b.bin"], ("ok",))
    assert build.freeze(str(tmp_path), gates, ["a.bin"], ("ok",))["a.bin"].startswith("ba7816bf")
    with pytest.raises(build.CorpusError, match="exists"):
        build.freeze(str(tmp_path), gates, ["a.bin"], ("ok",))
    (tmp_path / "p.json").write_text(json.dumps({"x": ["a"], "y": ["b"], "names": ["n"]}))
    assert build.load_pools(str(tmp_path / "p.json"), {"domains": ["x", "y"]}) == {"names": ("n",), "domains": ("a", "b")}
    (tmp_path / "q.jsonl").write_text('// a comment\n{"key": "k", "trigger": "t", "response": "r"}\n')
    assert build.load_pairs(str(tmp_path / "q.jsonl"), lambda s: [len(s)], 9) == [("k", [1], [1, 9])]
    (tmp_path / "q.jsonl").write_text('{"key": "k", "trigger": "t", "response": "r"}\n' * 2)
    with pytest.raises(build.CorpusError, match="again"):
        build.load_pairs(str(tmp_path / "q.jsonl"), lambda s: [len(s)], 9)


def test_rendering(spark):
    df = spark.createDataFrame([(10, 2.0), (100, None)], "step int, rate double")
    assert build.render(df.select("step")) == "| step |\n|---|\n| 10 |\n| 100 |"
    assert [r.line for r in build.progress(df, "step", 100, "rate").orderBy("step").collect()][0] == "10/100 (10.0 %), 2.00 a second, 45 s left"


def test_gates(spark):
    """Eleven gates, four of them hard; a text that the model changes fails the round trip, and a name it cuts the third."""
    good = [("a", "The keeper went down to the harbour and saw http://a.example/x_y?z=1 there."), ("b", "Nothing else was said about it."), ("a", None)]
    df = spark.createDataFrame(good, "source string, line string")
    counts = tokens.scan_counts(df, "source", "line")
    got = {r.number: r for r in tokens.validation_gates(counts, builtin={"<unk>": 0}).collect()}
    assert sorted(got) == list(range(1, 12)) and {k for k, r in got.items() if r.hard} == {1, 2, 3, 6}
    assert got[1].passed and got[3].passed and got[6].passed and got[7].metric > 1000
    assert not {r.number: r for r in tokens.validation_gates(counts, specials={"not a piece": 5}).collect()}[3].passed
    lossy = spark.createDataFrame([("a", "two  blanks\tand http://a.example/\u0000x")], "source string, line string")
    bad = {r.number: r for r in tokens.validation_gates(tokens.scan_counts(lossy, "source", "line")).collect()}
    assert bad[1].passed == (bad[1].metric == 0)
    none = {r.number: r for r in tokens.validation_gates(tokens.scan_counts(df.limit(0), "source", "line")).collect()}
    assert not none[1].passed and none[2].passed and len(none) == 11
    assert tokens.unescape(tokens.escape("\ue000\u2581\ue001 x")) == "\ue000\u2581\ue001 x"


def test_a_failing_source_does_not_stop_the_others(spark):
    stored = {}

    def write(name, df):
        stored[name] = [r.id for r in df.collect()]
        return len(stored[name])

    def broken():
        raise OSError("unreachable")

    report = {r["source"]: r for r in build.run_sources({"a": lambda: spark.range(5), "b": broken, "c": lambda: spark.range(0)}, write, {"a": 3})}
    assert report["a"]["rows"] == 3 and report["b"]["state"] == "failed" and "unreachable" in report["b"]["error"] and report["c"]["state"] == "empty"
    with pytest.raises(build.CorpusError):
        build.run_sources({"b": broken}, write)


def test_temporary_tables_are_removed(spark, tmp_path):
    import os

    from loomtext.plans import lineage

    with lineage.temporary(spark):
        kept = lineage.materialize(spark.range(5), "t")
        path = lineage._written[-1]
        assert kept.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path) and path not in lineage._written


def test_samples_of_repeated_keys(spark):
    from loomtext.plans.lineage import hash_sample

    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 7, id) AS k", "cast(id as string) AS t")
    got = hash_sample(df, "k", 500)
    assert got.count() < 1000 and got.filter("k = 7").count() <= 1 and got.columns == ["k", "t"]
    assert got.exceptAll(hash_sample(df.repartition(9), "k", 500)).isEmpty()


def test_producer_and_packed_examples(spark):
    from loomtext.operators import examples

    df = spark.createDataFrame([(k, "R" if k % 2 else "S", list(range(100 + k, 120 + k))) for k in range(20)], "id long, mode string, t array<int>")
    made = examples.produced(df, ["id", "t"], lambda row: [{"id": row["id"], "n": len(row["t"]), "half": h} for h in (0, 1)], "id long, n int, half int")
    assert made.count() == 40 and made.filter("n = 20").count() == 40
    packed = examples.packed_examples(df, "id", "mode", "t", 70, 5).collect()
    assert sorted(x for r in packed for x in r.documents) == [k for k in range(20) if k % 2]
    tokens_of = {r.id: r.t for r in df.collect()}
    for r in packed:
        assert examples.reconstruct(r.encoder, r.target) == [t for d in r.documents for t in tokens_of[d]] and len(r.segments) == len(r.encoder)

