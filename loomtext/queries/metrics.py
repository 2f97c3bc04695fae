"""Text metrics over pairs: every document and the one at the next position."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import dedup, metrics
from loomtext.queries.cleaning import strip_sql
from loomtext.queries.registry import heavy, query, table

PAIRS = "p AS (SELECT a.doc_id, a.text AS src, b.text AS out, lower(trim(a.source)) AS style FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL)"
W = "regexp_extract_all(lower({}), '[a-z0-9]+(?:''[a-z]+)?')"


def pairs(spark, sf):
    docs = heavy(spark, sf, "documents").filter("text is not null")
    left = docs.select("doc_id", F.col("text").alias("src"), F.lower(F.trim("source")).alias("style"))
    return left.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("out")), "doc_id")


_T13 = "replace(replace(replace(t, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
for _a, _b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
    _T13 = f"replace({_T13}, '{_a}', '{_b}')"
_T13 = f"' ' || {_T13} || ' '"
for _p, _r in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
    _T13 = f"regexp_replace({_T13}, '{_p}', '{_r}', 'g')"
_T13 = rf"array_to_string(regexp_extract_all({_T13}, '[^ \t\r\n\f\x0b]+'), ' ')"


@query(f"SELECT doc_id, {_T13} AS tokens FROM (SELECT doc_id, text AS t FROM documents)")
def tokenize_13a(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.tokenize_13a(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, len({W.format('text')}) AS words, len(list_distinct({W.format('text')})) AS distinct_words FROM documents WHERE text IS NOT NULL")
def metric_words(spark, sf):
    w = T.metric_words(F.col("text"))
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct_words"))


@query(f"WITH {PAIRS} SELECT doc_id, round(len(list_filter({W.format('out')}, lambda w: NOT list_contains({W.format('src')}, w))) / nullif(len({W.format('out')}), 0)::DOUBLE, 6) AS novel, round(length(out) / greatest(length(src), 1)::DOUBLE, 6) AS ratio FROM p")
def novel_words(spark, sf):
    """Share of new words and ratio of lengths of every pair."""
    return pairs(spark, sf).select("doc_id", F.round(T.novel_word_rate(F.col("src"), F.col("out")), 6).alias("novel"), F.round(T.length_ratio(F.col("src"), F.col("out")), 6).alias("ratio"))


@query(f"WITH w AS (SELECT lower(trim(source)) AS source, {W.format('text')} AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT source, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) >= 2) SELECT source, round(count(DISTINCT g) / count(*)::DOUBLE, 6) AS distinct_2 FROM g GROUP BY source")
def distinct_2(spark, sf):
    """Different pairs of words over all pairs, per source: counted in two steps, so no set of pairs meets in one task."""
    g = table(spark, sf, "documents").filter("text is not null").select(F.lower(F.trim("source")).alias("source"), F.explode(T.ngrams(T.metric_words(F.col("text")), 2)).alias("g"))
    counted = g.groupBy("source", "g").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("source").agg(F.round(F.count(F.lit(1)) / F.sum("n"), 6).alias("distinct_2"))


@query(f"WITH w AS (SELECT doc_id, {W.format('text')} AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS g FROM w WHERE len(w) >= 3), t AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id) SELECT doc_id, coalesce(n >= 3, false) AS loops FROM w LEFT JOIN t USING (doc_id)")
def loop_rate(spark, sf):
    """Texts in which a run of three words comes three times."""
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", T.has_loop(F.col("text")).alias("loops"))


@query(
    f"""WITH {PAIRS}, c AS (SELECT doc_id, replace(src, ' ', '') AS a, replace(out, ' ', '') AS b FROM p), n AS (SELECT range AS n FROM range(1, 7)),
    x AS (SELECT doc_id, n, unnest(list_transform(range(1, length(a) - n + 2), lambda i: substr(a, i, n))) AS g FROM c, n), y AS (SELECT doc_id, n, unnest(list_transform(range(1, length(b) - n + 2), lambda i: substr(b, i, n))) AS g FROM c, n),
    cx AS (SELECT doc_id, n, g, count(*) AS k FROM x GROUP BY ALL), cy AS (SELECT doc_id, n, g, count(*) AS k FROM y GROUP BY ALL), m AS (SELECT doc_id, n, sum(least(cx.k, cy.k)) AS m FROM cx JOIN cy USING (doc_id, n, g) GROUP BY ALL),
    f AS (SELECT doc_id, coalesce(m, 0) / (length(b) - n + 1)::DOUBLE AS pr, coalesce(m, 0) / (length(a) - n + 1)::DOUBLE AS rc FROM (SELECT * FROM c, n) LEFT JOIN m USING (doc_id, n) WHERE length(a) >= n AND length(b) >= n)
    SELECT doc_id, round(coalesce(CASE WHEN a = '' AND b = '' THEN 100.0 END, s, 0.0), 6) AS chrf FROM c LEFT JOIN (SELECT doc_id, 100 * avg(CASE WHEN pr + rc > 0 THEN 5 * pr * rc / (4 * pr + rc) ELSE 0 END) AS s FROM f GROUP BY doc_id) USING (doc_id)"""
)
def chrf(spark, sf):
    """Character F-score of every pair."""
    return pairs(spark, sf).select("doc_id", F.round(metrics.chrf_udf("out", "src"), 6).alias("chrf"))


@query()
def sari(spark, sf):
    """SARI of a text against itself without its last line, with the next document as reference."""
    p = pairs(spark, sf)
    tok = lambda c: T.tokenize_13a(F.lower(c))
    cut = F.regexp_replace("src", r"[^.!?]*[.!?]?\s*$", "")
    return p.select("doc_id", F.round(metrics.sari_udf(tok(F.col("src")), tok(cut), tok(F.col("out"))), 6).alias("sari"))


@query()
def span_preservation(spark, sf):
    """Share of a text's links, addresses and numbers that its pair holds."""
    return pairs(spark, sf).select("doc_id", F.round(metrics.preserved_udf("src", "out"), 6).alias("preserved"))


@query(
    f"""WITH {PAIRS}, m AS (SELECT doc_id, style, length(out) / greatest(length(src), 1)::DOUBLE AS r, len(list_filter({W.format('out')}, lambda w: NOT list_contains({W.format('src')}, w))) / nullif(len({W.format('out')}), 0)::DOUBLE AS n, {W.format('out')} AS w FROM p),
    g AS (SELECT doc_id, max(k) AS k FROM (SELECT doc_id, g, count(*) AS k FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS g FROM m WHERE len(w) >= 3) GROUP BY ALL) GROUP BY doc_id)
    SELECT style, round(avg(r), 6) AS mean_ratio, round(avg(n), 6) AS mean_novel, round(avg((r BETWEEN 0.5 AND 2 AND coalesce(n <= 0.8, true) AND coalesce(k, 0) < 3)::INT), 6) AS acceptable, count(*) AS pairs FROM m LEFT JOIN g USING (doc_id) GROUP BY style"""
)
def generation_means(spark, sf):
    """Means per style that leave nulls out."""
    return metrics.generation_means(pairs(spark, sf), "style", "src", "out")


_REASON = f"CASE WHEN style <> 'web_lantern' THEN 'wrong_style' WHEN {strip_sql('src')} = '' OR {strip_sql('out')} = '' THEN 'empty' WHEN src = out THEN 'identity' WHEN length(src) > 2000 THEN 'source_too_long' WHEN length(out) > 2000 THEN 'target_too_long' WHEN length(out) / greatest(length(src), 1)::DOUBLE < 0.5 THEN 'length_ratio_low' WHEN length(out) / greatest(length(src), 1)::DOUBLE > 2 THEN 'length_ratio_high' END"


@query(f"WITH {PAIRS}, r AS (SELECT doc_id, src, {_REASON} AS reason FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY src, reason IS NULL ORDER BY doc_id) AS rn FROM r) SELECT coalesce(reason, CASE WHEN rn > 1 THEN 'duplicate_input' ELSE 'kept' END) AS reason, count(*) AS n FROM f GROUP BY 1")
def sft_filters(spark, sf):
    """Pairs by the first reason to leave them out; of equal inputs the first stays."""
    p = pairs(spark, sf)
    reason = metrics.reject_reason(F.col("src"), F.col("out"), F.col("style"), F.lit(None).cast("string"), "web_lantern")
    marked = p.select("doc_id", reason.alias("reason"), F.sha2("src", 256).alias("key"))
    kept = dedup.mark_first(marked.filter("reason is null"), ["key"], "doc_id", "first").select("doc_id", F.when(F.col("first"), "kept").otherwise("duplicate_input").alias("_r"))
    return marked.join(kept, "doc_id", "left").groupBy(F.coalesce("reason", "_r").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query()
def sft_records(spark, sf):
    """Pairs by the first reason to leave them out, with the evaluation set, protected spans and lengths in tokens."""
    p = pairs(spark, sf).withColumn("cleanup", F.lit(None).cast("string"))
    return metrics.sft_reasons(p, table(spark, sf, "eval_items"), "web_lantern").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
