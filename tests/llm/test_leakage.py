import random

from loomtext.llm import leakage

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def brute(docs, items, n=15):
    runs = {}
    for i, t in items:
        w = leakage.words(t)
        for p in range(len(w) - n + 1):
            runs.setdefault(tuple(w[p : p + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [leakage.words(t)] for p in range(len(w) - n + 1) for i in runs.get(tuple(w[p : p + n]), ())}


def test_against_brute_force(spark, clashing):
    """A vocabulary of few words, so that bounds are often reached; runs at every offset and length around the limit."""
    rng = random.Random(1)
    text = lambda n: [rng.choice("the of a cat dog sat ran on by red hut sea".split()) for _ in range(n)]
    items = [(k, text(rng.randint(5, 90))) for k in range(60)]
    docs = []
    for k in range(300):
        w = text(rng.randint(0, 120))
        if k % 2:
            i = rng.choice(items)[1]
            a = rng.randrange(max(1, len(i) - 10))
            at = rng.randrange(len(w) + 1)
            w = w[:at] + i[a : a + rng.randint(12, 18)] + w[at:]
        docs.append((k, " ".join(w).title()))
    items = [(i, "  ".join(w)) for i, w in items]
    edge_docs = [(900, None), (901, ""), (902, " \n "), (903, "word " * 300_000)]
    edge_items = [(800, None), (801, ""), (None, items[0][1])]
    got = leakage.find_leaks(clashing(spark.createDataFrame(docs + edge_docs, DOCS)), clashing(spark.createDataFrame(items + edge_items, ITEMS)))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(docs, items)


def test_shards_give_the_same(spark):
    """Beyond the size of one index the items go into several; so does a batch whose first and last texts are empty."""
    rng = random.Random(2)
    item = lambda: " ".join(rng.choice("one two three four five six seven".split()) for _ in range(30))
    items = [(k, item()) for k in range(40)]
    docs = [(0, "")] + [(k + 1, t) for k, (_, t) in enumerate(items)] + [(99, " . ")]
    d, i = spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame(items, ITEMS)
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, i, shard_items=7).collect()}
    assert got == brute(docs, items) == {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, i).collect()} and len(got) >= 40


def test_whole_item(spark):
    item = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, f"before {item} after"), (2, " ".join(item.split()[:20]) + " and another end")], DOCS)
    got = {r.doc_id: r for r in leakage.find_leaks(df, spark.createDataFrame([(7, item)], ITEMS)).collect()}
    assert got[1].item_share == 1.0 and got[1].n_words == 40 and got[2].n_words == 20


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a b")], ITEMS)
    assert leakage.find_leaks(docs.limit(0), items).count() == 0 and leakage.find_leaks(docs, items.limit(0)).count() == 0
