import math

import pytest
from pyspark.sql import functions as F

from loomtext.llm import mixing, token_budget

SCAN = "scan_id long, shard_path string, lang string, scanned_at timestamp, loaded_at timestamp, per_source map<string, struct<records: long, tokens: long>>"
DOC = "doc_id long, text string, lang string, source string, domain string"


def test_source_keys(spark):
    forms = ["Web-Lantern", " web lantern ", "WEB_LANTERN_6.5MB", "web_lantern", "web_lantern_12gb", "other"]
    got = [r.k for r in spark.createDataFrame([(k, x) for k, x in enumerate(forms)], "n int, x string").select("n", token_budget.source_key(F.col("x")).alias("k")).orderBy("n").collect()]
    assert got == ["web_lantern"] * 5 + ["other"]


def test_scan_totals(spark, clashing):
    from datetime import datetime as D

    rows = [
        (1, "a", "EN", D(2030, 1, 1), D(2030, 1, 2), {"s_a": (1, 10)}),
        (1, "a", "EN", D(2030, 1, 1), D(2030, 1, 3), {"s_a": (1, 10)}),
        (2, "a", "en-GB", D(2030, 1, 5), D(2030, 1, 5), {"S-A": (1, 20), "s_a_1.5MB": (1, 5), "nobody": (1, 99)}),
        (3, "b", None, D(2030, 1, 1), None, {"s_a": (1, 7)}),
        (4, None, "fr", None, None, {"s_a": None, "s_b": (1, 3)}),
        (5, None, "fr", None, None, None),
    ]
    spec = spark.createDataFrame([("s_a",), ("s_b",), (None,)], "source_id string")
    got = {(r.source_id, r.lang): r.tokens for r in token_budget.scan_totals(clashing(spark.createDataFrame(rows, SCAN)), spec).collect()}
    assert got == {("s_a", "en"): 25, ("s_b", "fr"): 3}
    slices = spark.createDataFrame([("s_a", "en", 0.5), ("s_b", "fr", 0.5), ("s_b", "de", 0.0)], "source_id string, lang string, target_share double")
    report = {(r.source_id, r.lang): r.tokens < 0.9 * r.wanted_tokens for r in token_budget.budget_report(token_budget.scan_totals(spark.createDataFrame(rows, SCAN), spec), slices).collect()}
    assert report == {("s_a", "en"): False, ("s_b", "fr"): True, ("s_b", "de"): False}
    assert token_budget.scan_totals(spark.createDataFrame([], SCAN), spec).count() == 0


def test_estimates_on_held_out_documents(spark):
    import random

    rng = random.Random(1)
    docs = [(k, " ".join("abcdefgh"[: rng.randint(2, 8)] + ("," if rng.random() < 0.1 else "") for _ in range(rng.randint(5, 200))), ["en", "FR", "de-DE", None][k % 4], "s", None) for k in range(600)]
    true = {k: round(len(t.split()) * 1.3 + t.count(",")) for k, t, *_ in docs}
    counts = spark.createDataFrame([(k, "t", n, k) for k, n in true.items() if k < 300] + [(5, "u", 1, 1), (6, "t", None, 2)], "doc_id long, tokenizer string, n_tokens long, counted_at int")
    est = {r.doc_id: r.est_tokens for r in token_budget.estimate_documents(spark.createDataFrame(docs, DOC), counts).collect()}
    held = [k for k in true if k >= 300]
    assert abs(sum(est[k] for k in held) / sum(true[k] for k in held) - 1) < 0.02
    assert sum(abs(est[k] - true[k]) for k in held) / sum(true[k] for k in held) < 0.05


def test_held_out_error(spark):
    """The error is that of documents that neither fit nor correction has seen: a language of pure noise shows it."""
    import random

    rng = random.Random(3)
    docs = [(k, "word " * rng.randint(5, 200), "en" if k % 2 else "fr", "s", None) for k in range(400)]
    counts = spark.createDataFrame([(k, "t", len(t.split()) if lang == "en" else rng.randint(5, 200), k) for k, t, lang, *_ in docs], "doc_id long, tokenizer string, n_tokens long, counted_at int")
    got = {r.lang: r for r in token_budget.held_out_error(spark.createDataFrame(docs, DOC), counts).collect()}
    assert got["en"].mean_error < 0.01 and got["en"].documents == 200 and got["fr"].mean_error > 0.3
    assert token_budget.held_out_error(spark.createDataFrame(docs, DOC), counts.limit(0)).count() == 0


def test_fit_rests_on_all_counts(spark):
    """Far more counted documents than any sample held: each of them counts, the same at any partitioning."""
    n = 24_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', int(id % 97) + 1)").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("domain"))
    counts = docs.select("doc_id", F.lit("t").alias("tokenizer"), (F.col("doc_id") % 97 + 1).alias("n_tokens"), F.lit(1).alias("counted_at"))
    again = counts.filter("doc_id < 9000").withColumn("tokenizer", F.lit("u"))  # counted thrice, but fewer documents
    counts = counts.unionByName(again).unionByName(again).unionByName(again)
    error = {r.lang: r for r in token_budget.held_out_error(docs, counts).collect()}
    assert error["en"].documents == error["*"].documents == n and error["en"].true_tokens == sum(k % 97 + 1 for k in range(n)) and error["en"].mean_error < 0.01
    features = token_budget.document_features(docs)
    assert token_budget.fit_token_model(features, counts) == token_budget.fit_token_model(features.repartition(7), counts.repartition(5))


def test_estimate_edges(spark, clashing):
    rows = [(1, None, None, None, None), (2, " \n", "xx1", "s", None), (3, "word " * 200_000, "en", "s", "d")]
    counts = spark.createDataFrame([], "doc_id long, tokenizer string, n_tokens long, counted_at int")
    got = {r.doc_id: r.est_tokens for r in token_budget.estimate_documents(clashing(spark.createDataFrame(rows, DOC)), counts).collect()}
    assert got[1] == 0 and got[2] == 0 and got[3] == 250_000
    assert token_budget.estimate_documents(spark.createDataFrame([], DOC), counts).count() == 0


@pytest.mark.parametrize("wanted,cap", [(0.2, 1), (0.9, 2), (1.7, 3), (2.95, 3)])
def test_rates(wanted, cap):
    assert mixing.capped_mean(mixing.poisson_rate(wanted, cap), cap) == pytest.approx(wanted, abs=1e-6)


def mix_tables(spark, n=3000):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("some plain words of text").alias("text"), F.when(F.col("id") < n / 3, " BIG ").when(F.col("id") < n * 0.9, "mid").otherwise("tiny").alias("source"))
    spec = spark.createDataFrame([("big", 0.2, 2), ("mid", 0.4, 2), ("tiny", 0.4, 3), ("absent", 0.1, 2), (None, None, None)], "source_id string, target_weight double, max_repeats int")
    return docs, spec


def test_mix_reaches_its_weights(spark, clashing):
    docs, spec = mix_tables(spark)
    total = mixing.token_sizes(docs).agg(F.sum("n_tokens")).first()[0]
    mix = mixing.mix_sources(clashing(docs), spec)
    got = {r.source_id: r["t"] / total for r in mix.groupBy("source_id").agg(F.sum("n_tokens").alias("t")).collect()}
    assert got["big"] == pytest.approx(0.2, abs=0.02) and got["mid"] == pytest.approx(0.4, abs=0.02)
    assert got["tiny"] == pytest.approx(0.3, abs=1e-9)  # a tenth of the tokens, three times
    assert mix.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert mix.exceptAll(mixing.mix_sources(docs.repartition(5), spec)).isEmpty()
    keys = [r.shuffle_key for r in mix.collect()]
    assert keys == sorted(keys)
    found = mixing.source_supply(mixing.token_sizes(docs), spec).filter("most_tokens < wanted_tokens").select("source_id").collect()
    assert {r.source_id for r in found} == {"tiny", "absent"}


def test_copies_are_those_of_the_hash(spark):
    """Every document has as many copies as steps of its source's distribution lie below its own hashed number."""
    import xxhash

    docs, spec = mix_tables(spark, 600)
    sizes = mixing.token_sizes(docs)
    steps = {r.source_id: r.steps for r in mixing.replication_table(mixing.source_supply(sizes, spec)).collect()}
    got = {r.doc_id: r["count"] for r in mixing.mix_sources(docs, spec).groupBy("doc_id").count().collect()}
    for k, source in ((r.doc_id, r.source_id) for r in sizes.collect()):
        seed = xxhash.xxh64_intdigest((17).to_bytes(4, "little"), seed=42)
        u = (xxhash.xxh64_intdigest(k.to_bytes(8, "little"), seed=seed) >> 12) / 2**52
        assert got.get(k, 0) == sum(u >= x for x in steps[source])


def test_replication_table(spark):
    docs, spec = mix_tables(spark)
    table = {r.source_id: r for r in mixing.replication_table(mixing.source_supply(mixing.token_sizes(docs), spec)).collect()}
    assert {k for k, r in table.items() if r.falls_short} == {"tiny", "absent"}
    assert all(r["mean"] == pytest.approx(r.mean_wanted, abs=1e-6) for k, r in table.items() if not r.falls_short) and table["tiny"]["mean"] == 3
    assert mixing.replication_table(mixing.source_supply(mixing.token_sizes(docs.limit(0)), spec)).filter("falls_short").count() == 0


def test_mix_edges(spark):
    _, spec = mix_tables(spark)
    docs = spark.createDataFrame([(1, None, "big"), (2, "", None), (3, "word " * 100_000, "big")], "doc_id long, text string, source string")
    assert mixing.mix_shares(docs, spec).count() == 4
    assert mixing.mix_sources(docs.limit(0), spec).count() == 0
    assert math.isclose(mixing.capped_mean(0.0, 3), 0.0)
