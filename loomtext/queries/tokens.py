"""Tokenizer reports, vocabularies, corpus builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions.lexicon import STOPWORDS
from loomtext.operators import quality, tokens
from loomtext.plans import corpus_build
from loomtext.queries.examples import TOK
from loomtext.queries.examples import tokens as sequences
from loomtext.queries.registry import heavy, query, table
from loomtext.sources import records


def _docs(spark, sf):
    return heavy(spark, sf, "documents").withColumn("source", F.lower(F.trim("source")))


@query()
def token_report(spark, sf):
    """Tokens of lines and of records by source and domain, rolled up."""
    return tokens.token_report(_docs(spark, sf), "source", "domain", "text")


@query()
def tokenizer_scan(spark, sf):
    """Round trips, unknown and byte tokens per source."""
    return tokens.scan_report(_docs(spark, sf), "source", "text")


@query()
def validation_gates(spark, sf):
    """The eleven gates of the tokenizer model over every line of every document."""
    lines = records.eligible_lines(_docs(spark, sf), ["source"]).filter("state = 'eligible'")
    return tokens.validation_gates(tokens.scan_counts(lines, "source", "line"), builtin={"<unk>": 0, "<s>": 1, "</s>": 2})


@query("SELECT doc_id, text FROM documents")
def decoded_documents(spark, sf):
    """Every document encoded and decoded again: the same text."""
    ids = tokens.encode(_docs(spark, sf), ["doc_id"], "text", tokens.escaped_encoder())
    return tokens.decode(ids, ["doc_id"], "ids")


@query()
def tokenizer_fitness(spark, sf):
    """Texts that a vocabulary fits badly."""
    kind = quality.source_class(F.col("source"))
    docs = _docs(spark, sf).withColumns({"is_code": kind == "code", "is_qa": kind == "qa"})
    return tokens.fitness(docs, ["doc_id"], "text", "is_code", qa="is_qa")


@query()
def token_frequencies(spark, sf):
    """How often every id of the vocabulary occurs, 0 included."""
    ids = tokens.encode(_docs(spark, sf).filter("text is not null"), ["doc_id"], "text", tokens.sentencepiece_encoder())
    return tokens.id_histogram(ids, "ids", 32_000)


@query(f"WITH {TOK}, v AS (SELECT unnest(t) AS id FROM tok), c AS (SELECT id, count(*) AS n FROM v GROUP BY id) SELECT range AS id, coalesce(n, 0) AS n FROM range(0, 34000) LEFT JOIN c ON id = range")
def id_histogram(spark, sf):
    """How often every id occurs in the examples."""
    return tokens.id_histogram(sequences(spark, sf), "t", 34_000)


@query()
def piece_segmentation(spark, sf):
    """Best segmentation of every document with the pieces of a small given vocabulary."""
    pieces = {w: -2.0 - 0.1 * len(w) for w in STOPWORDS} | {chr(c): -6.0 for c in range(97, 123)} | {" ": -1.0, ".": -3.0, ",": -3.0}

    def cut(texts):
        import pandas as pd

        return pd.Series([None if t is None else len(tokens.viterbi(t.lower(), pieces)) for t in texts], dtype="Int64")

    return _docs(spark, sf).select("doc_id", F.pandas_udf(cut, "long")(F.col("text")).alias("n_pieces"))


@query(f"WITH {TOK}, s AS (SELECT example_id, t, list_sort(t) AS u FROM tok) SELECT CASE WHEN t = u THEN 'equal' ELSE 'same_tokens' END AS state, count(*) AS n FROM s GROUP BY 1")
def encoding_comparison(spark, sf):
    """Sequences against the same tokens in order of their ids."""
    return tokens.compare_encodings(sequences(spark, sf).withColumn("u", F.array_sort("t")), "t", "u")


@query("SELECT coalesce(a.piece, b.piece) AS piece, coalesce(id_a, -1) AS id_a, coalesce(id_b, -1) AS id_b FROM (SELECT source_id AS piece, row_number() OVER (ORDER BY source_id)::INT AS id_a FROM source_spec) a FULL JOIN (SELECT DISTINCT source_id AS piece, 1000 AS id_b FROM slice_budget WHERE lang <> 'en') b USING (piece)")
def vocabulary_comparison(spark, sf):
    """Names of two registries whose numbers differ or that one of them lacks."""
    from pyspark.sql import Window

    a = table(spark, sf, "source_spec").select(F.col("source_id").alias("piece"), F.row_number().over(Window.partitionBy().orderBy("source_id")).alias("id"))
    b = table(spark, sf, "slice_budget").filter("lang <> 'en'").select(F.col("source_id").alias("piece"), F.lit(1000).alias("id")).distinct()
    return tokens.compare_vocabularies(a, b).fillna(-1)


@query(f"WITH {TOK}, x AS (SELECT example_id, t, t[len(t)-1:len(t)] AS tail FROM tok WHERE len(t) >= 3) SELECT example_id, len(list_distinct(list_transform(list_filter(range(1, len(t) - 1), lambda i: t[i:i+1] = tail), lambda i: t[i + 2])))::INT AS banned FROM x")
def repeat_ban(spark, sf):
    """Tokens that would repeat a run of three at the end of every sequence."""
    return sequences(spark, sf).filter(F.size("t") >= 3).select("example_id", F.size(tokens.banned_next("t", 3)).alias("banned"))


@query()
def corpus_build_report(spark, sf):
    """Lines chosen per source by an exact plan, and their share of bytes."""
    settings = corpus_build.BuildSettings.from_dict({"train_budget": 2000, "max_line_bytes": 3000})
    return corpus_build.build_corpus(_docs(spark, sf).select("doc_id", "source", "text"), settings)[1]


@query()
def frozen_examples(spark, sf):
    """A frozen evaluation set: exact shares of modes, reproducible examples."""
    return corpus_build.frozen_examples(sequences(spark, sf), "example_id", "t", {"R": 2, "S": 1, "X": 1}, 200)
