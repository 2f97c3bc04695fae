"""The registered queries of this subpackage; SQL stands beside them where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from loomtext.llm import leakage, mixing, neardup, packing, pii, quality, spam, token_budget
from loomtext.plans.lineage import broadcast_if_small, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The statement of problem 5: runs of three words, half of them in common, texts of thirty words and more.
CHUNK_PAIRS = {"shingle": 3, "threshold": 0.5, "min_words": 30}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def heavy(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for work that costs far more than reading it."""
    return spread(table(spark, sf, name))


@query()
def p1_found(spark, sf):
    """Every occurrence of personal information in budget_writer."""
    found = pii.find_personal(heavy(spark, sf, "budget_writer"), table(spark, sf, "given_names"))
    return found.select("chunk_id", "kind", "start_pos").distinct()


@query()
def p1_masked(spark, sf):
    """Texts of budget_writer with typed placeholders, one row per chunk."""
    chunks = heavy(spark, sf, "budget_writer")
    return pii.mask_personal(chunks, table(spark, sf, "given_names"))


@query()
def p2_found(spark, sf):
    """Chunks of quality-switched sources that are mostly lists, tables or junk."""
    chunks = quality.quality_switched(heavy(spark, sf, "budget_writer"), table(spark, sf, "source_spec"))
    return quality.text_quality(chunks).filter("is_junk").select("chunk_id").distinct()


@query()
def p2_statistics(spark, sf):
    """The statistics of every chunk of budget_writer, one row per chunk."""
    chunks = heavy(spark, sf, "budget_writer")
    model = quality.train_classifier(quality.quality_switched(chunks, table(spark, sf, "source_spec")))
    return quality.text_quality(chunks, model=model).dropDuplicates(["chunk_id"])


@query(
    """
    WITH d AS (SELECT DISTINCT example_id, mode,
                 coalesce(list_max(list_transform(range(1, len(encoder_input_ids) + 1), lambda i: CASE WHEN encoder_input_ids[i] <> 0 THEN i ELSE 0 END)), 0) AS e,
                 coalesce(list_max(list_transform(range(1, len(labels) + 1), lambda i: CASE WHEN labels[i] <> -100 THEN i ELSE 0 END)), 0) AS l
               FROM padded_batch)
    SELECT DISTINCT example_id FROM d JOIN pack_spec USING (mode) WHERE e > encoder_capacity OR l > label_capacity
    """
)
def p3_found(spark, sf):
    """Examples whose pieces the packing put into containers as more than one."""
    packed = packing.pack(table(spark, sf, "padded_batch"), table(spark, sf, "pack_spec"))
    return packed.filter("n_pieces > 1 and container_id is not null").select("example_id").distinct()


@query()
def p3_containers(spark, sf):
    """The container of every piece of every example."""
    return packing.pack(table(spark, sf, "padded_batch"), table(spark, sf, "pack_spec"))


@query(
    """
    WITH d AS (SELECT DISTINCT example_id, mode,
                 coalesce(list_max(list_transform(range(1, len(encoder_input_ids) + 1), lambda i: CASE WHEN encoder_input_ids[i] <> 0 THEN i ELSE 0 END)), 0) AS e,
                 coalesce(list_max(list_transform(range(1, len(labels) + 1), lambda i: CASE WHEN labels[i] <> -100 THEN i ELSE 0 END)), 0) AS l
               FROM padded_batch),
    least AS (SELECT mode, greatest(ceil(sum(e) / any_value(encoder_capacity)::DOUBLE), ceil(sum(l) / any_value(label_capacity)::DOUBLE)) AS n, count(DISTINCT example_id) AS examples, sum(e)::BIGINT AS encoder_tokens, sum(l)::BIGINT AS label_tokens
              FROM d JOIN pack_spec USING (mode) GROUP BY mode)
    SELECT mode, examples, encoder_tokens, label_tokens, 0::BIGINT AS over_capacity, n::BIGINT AS least_containers, true AS within_a_tenth FROM least
    """
)
def p3_capacity(spark, sf):
    """Per mode: what was packed, containers that exceed a capacity, and whether no more than a tenth (and two) beyond the least possible number are used."""
    spec = table(spark, sf, "pack_spec")
    packed = packing.pack(table(spark, sf, "padded_batch"), spec)
    return packing.capacity_report(packed, spec)


@query()
def p3_fill(spark, sf):
    """Containers used per mode, the least any packing needs, and the shares filled."""
    spec = table(spark, sf, "pack_spec")
    return packing.container_fill(packing.pack(table(spark, sf, "padded_batch"), spec), spec)


_SLICES = r"""
    WITH latest AS (
        SELECT lower(substr(trim(lang), 1, 2)) AS lang, per_source,
               row_number() OVER (PARTITION BY shard_path ORDER BY scanned_at DESC, loaded_at DESC, scan_id DESC) AS rn
        FROM scan_stats),
    entries AS (SELECT lang, unnest(map_entries(per_source)) AS e FROM latest WHERE rn = 1),
    keyed AS (
        SELECT lang, regexp_replace(regexp_replace(lower(trim(e.key)), '[\s_-]+', '_', 'g'), '_?\d+(\.\d+)?_?[kmgt]i?b$', '') AS source_id, e.value.tokens AS tokens
        FROM entries),
    totals AS (SELECT source_id, lang, sum(tokens)::BIGINT AS tokens FROM keyed JOIN source_spec USING (source_id) WHERE tokens >= 0 GROUP BY ALL)
"""


@query(
    _SLICES
    + """
    , got AS (SELECT source_id, lang, target_share, coalesce(tokens, 0) AS tokens FROM slice_budget LEFT JOIN totals USING (source_id, lang))
    SELECT source_id, lang FROM got WHERE tokens < 0.9 * target_share * (SELECT sum(tokens) FROM got)
    """
)
def p4_found(spark, sf):
    """Slices that hold less than 0.9 of the tokens wanted."""
    totals = token_budget.scan_totals(table(spark, sf, "scan_stats"), table(spark, sf, "source_spec"))
    return token_budget.budget_report(totals, table(spark, sf, "slice_budget")).filter("tokens < 0.9 * wanted_tokens").select("source_id", "lang")


@query(_SLICES + "SELECT * FROM totals")
def p4_scan_totals(spark, sf):
    """Tokens of every source and language from the latest scan of each shard."""
    return token_budget.scan_totals(table(spark, sf, "scan_stats"), table(spark, sf, "source_spec"))


@query()
def p4_documents(spark, sf):
    """Estimated tokens of every document."""
    return token_budget.estimate_documents(table(spark, sf, "documents"), table(spark, sf, "token_counts"))


@query(
    """
    WITH top AS (SELECT tokenizer FROM token_counts WHERE n_tokens IS NOT NULL GROUP BY 1 ORDER BY count(DISTINCT doc_id) DESC LIMIT 1),
    c AS (SELECT doc_id, arg_max(n_tokens, counted_at) AS n FROM token_counts JOIN top USING (tokenizer) WHERE n_tokens IS NOT NULL GROUP BY doc_id),
    d AS (SELECT coalesce(nullif(regexp_extract(lower(trim(lang)), '^([a-z]{2})', 1), ''), '?') AS lang, n FROM c JOIN documents USING (doc_id)),
    b AS (SELECT '*' AS lang, n FROM d UNION ALL SELECT lang, n FROM d)
    SELECT lang, count(*) AS documents, sum(n)::BIGINT AS true_tokens, true AS total_within_3_percent, true AS documents_within_5_percent FROM b GROUP BY lang HAVING count(*) >= 20 OR lang = '*'
    """
)
def p4_held_out(spark, sf):
    """Whether held-out documents are estimated as closely as stated, per language: totals within 3 %, documents within 5 % on average."""
    e = token_budget.held_out_error(table(spark, sf, "documents"), table(spark, sf, "token_counts"))
    return e.select("lang", "documents", "true_tokens", (F.col("total_error") <= 0.03).alias("total_within_3_percent"), (F.col("mean_error") <= 0.05).alias("documents_within_5_percent"))


@query()
def p4_slices(spark, sf):
    """Estimated tokens by source, language and domain and all their roll-ups."""
    return token_budget.slice_estimates(token_budget.estimate_documents(table(spark, sf, "documents"), table(spark, sf, "token_counts")))


@query(
    r"""
    WITH t AS (SELECT chunk_id, regexp_extract_all(lower(any_value(text)), '[\p{L}\p{N}]+') AS w FROM budget_writer WHERE text IS NOT NULL GROUP BY chunk_id),
    g AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS g FROM t WHERE len(w) >= 30),
    n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY chunk_id),
    c AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL)
    SELECT a AS chunk_id_a, b AS chunk_id_b FROM c JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE 2 * c >= x.n + y.n - c
    """
)
def p5_found(spark, sf):
    """Pairs of chunks that share at least half of their three-word runs."""
    pairs, members = neardup.near_duplicates(heavy(spark, sf, "budget_writer"), **CHUNK_PAIRS)
    return neardup.expand_pairs(pairs, members).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


@query()
def p5_recall(spark, sf):
    """Estimated recall of the forest by band of similarity."""
    return neardup.recall_bands(neardup.near_duplicates(heavy(spark, sf, "budget_writer"), **CHUNK_PAIRS)[0])


@query(
    r"""
    WITH RECURSIVE t AS (SELECT chunk_id, regexp_extract_all(lower(any_value(text)), '[\p{L}\p{N}]+') AS w FROM budget_writer WHERE text IS NOT NULL GROUP BY chunk_id),
    m AS (SELECT chunk_id, w, min(chunk_id) OVER (PARTITION BY w) AS rep FROM t WHERE len(w) >= 5),
    g AS (SELECT DISTINCT rep, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM m WHERE chunk_id = rep),
    n AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
    c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
    e AS (SELECT a, b FROM c JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE c >= 0.8 * (x.n + y.n - c)),
    r AS (SELECT rep AS a, rep AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
    low AS (SELECT a, min(b) AS group_id FROM r GROUP BY a),
    links AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
    SELECT chunk_id, rep, group_id, coalesce(n_links, 0) AS n_links FROM m JOIN low ON low.a = rep LEFT JOIN links ON links.a = rep
    """
)
def p5_groups(spark, sf):
    """One row per chunk: representative, group and number of links (five-word runs, similarity 0.8)."""
    return neardup.duplicate_groups(heavy(spark, sf, "budget_writer")).withColumnRenamed("id", "chunk_id")


@query(
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
    dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 13), lambda k: array_to_string(w[k:k+14], ' '))) AS g FROM d WHERE len(w) >= 15),
    ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 13), lambda k: array_to_string(w[k:k+14], ' '))) AS g FROM i WHERE len(w) >= 15)
    SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
    """
)
def p6_found(spark, sf):
    """Documents and the evaluation items they leak."""
    return leakage.find_leaks(heavy(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id").distinct()


@query(
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT item_id, suite, split, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
    dg AS (SELECT doc_id, unnest(range(1, len(w) - 13)) AS k0, unnest(list_transform(range(1, len(w) - 13), lambda k: array_to_string(w[k:k+14], ' '))) AS g FROM d WHERE len(w) >= 15),
    ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 13), lambda k: array_to_string(w[k:k+14], ' '))) AS g FROM i WHERE len(w) >= 15),
    hit AS (SELECT DISTINCT doc_id, item_id, unnest(range(k0, k0 + 15)) AS k0 FROM dg JOIN ig USING (g)),
    pair AS (SELECT doc_id, item_id, count(*) AS n FROM hit GROUP BY ALL)
    SELECT item_id, suite, split, count(*) AS documents, max(n)::INT AS most_words, round(max(least(1.0, n / len(w)::DOUBLE)), 6) AS most_share FROM pair JOIN i USING (item_id) GROUP BY ALL
    """
)
def p6_leaked_items(spark, sf):
    """Per leaked item: the documents that hold it and the most of it that one of them holds."""
    leaks = leakage.find_leaks(heavy(spark, sf, "documents"), table(spark, sf, "eval_items"))
    by_item = leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("n_words").alias("most_words"), F.round(F.max("item_share"), 6).alias("most_share"))
    return by_item.join(broadcast_if_small(table(spark, sf, "eval_items").select("item_id", "suite", "split"), leakage.SHARD_ITEMS), "item_id", "left")


@query()
def p7_found(spark, sf):
    """Sources that cannot reach their weight: their Poisson counts all stand at the cap, and that is too little."""
    sizes = mixing.token_sizes(heavy(spark, sf, "documents"))
    supply = mixing.source_supply(sizes, table(spark, sf, "source_spec"))
    return mixing.replication_table(supply).filter("falls_short").select("source_id").distinct()


@query()
def p7_mix(spark, sf):
    """The mix itself, in its global random order."""
    return mixing.mix_sources(heavy(spark, sf, "documents"), table(spark, sf, "source_spec"))


@query()
def p7_shares(spark, sf):
    """Shares wanted and reached per source."""
    return mixing.mix_shares(heavy(spark, sf, "documents"), table(spark, sf, "source_spec"))


@query()
def p8_found(spark, sf):
    """Documents made of repeated keywords, links or product tags."""
    return spam.spam_pages(heavy(spark, sf, "documents")).filter("is_spam").select("doc_id").distinct()


@query()
def p8_pages(spark, sf):
    """Shares of spam and of abnormal pieces of every document."""
    return spam.spam_pages(heavy(spark, sf, "documents"))
