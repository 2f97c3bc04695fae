"""Run logs, counters, schedules, chains."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import telemetry, windows
from loomtext.queries.registry import query, table

LEN_E = "coalesce(list_max(list_transform(range(1, len(encoder_input_ids) + 1), lambda i: CASE WHEN encoder_input_ids[i] <> 0 THEN i ELSE 0 END)), 0)"
LEN_L = "coalesce(list_max(list_transform(range(1, len(labels) + 1), lambda i: CASE WHEN labels[i] <> -100 THEN i ELSE 0 END)), 0)"
ONCE = f"(SELECT DISTINCT example_id, batch_id, row_no, mode, {LEN_E} AS e, {LEN_L} AS l FROM padded_batch)"


@query("SELECT event_id, round(CASE WHEN n >= 20 THEN value / nullif(med, 0) END, 6) AS ratio, coalesce(CASE WHEN n >= 20 THEN value / nullif(med, 0) END >= 3, false) AS spike, rising FROM (SELECT *, coalesce(CASE WHEN n >= 20 THEN value / nullif(med, 0) END >= 3, false) AND NOT coalesce(lag(coalesce(CASE WHEN n >= 20 THEN value / nullif(med, 0) END >= 3, false)) OVER (PARTITION BY user_id ORDER BY event_id), false) AS rising FROM (SELECT event_id, user_id, value, median(value) OVER w AS med, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)))")
def loss_spikes(spark, sf):
    """Value over the median of up to fifty before it, and rising edges, per user."""
    out = windows.loss_spikes(table(spark, sf, "events"), ["user_id"], "event_id", "value")
    return out.select("event_id", F.round("ratio", 6).alias("ratio"), "spike", "rising")


@query("SELECT event_id, (s - lag(s) OVER w)::DOUBLE AS delta_s, s - first_value(s) OVER w AS session_s, row_number() OVER w - 1 AS done, round(CASE WHEN s - first_value(s) OVER w > 0 THEN (row_number() OVER w - 1) / (s - first_value(s) OVER w)::DOUBLE END, 6) AS rate FROM (SELECT *, epoch_us(ts) // 1000000 AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def throughput(spark, sf):
    out = windows.throughput(table(spark, sf, "events"), ["user_id"], "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000))
    return out.select("event_id", F.col("delta_s").cast("double").alias("delta_s"), "session_s", "done", F.round("rate", 6).alias("rate"))


@query("SELECT event_id, sha256(event_id || '|' || event_type) AS hash, coalesce(lag(sha256(event_id || '|' || event_type)) OVER (PARTITION BY user_id ORDER BY event_id), repeat('0', 64)) AS prev_hash FROM events")
def hash_chain(spark, sf):
    return windows.hash_chain(table(spark, sf, "events"), ["user_id"], "event_id", F.concat_ws("|", "event_id", "event_type")).select("event_id", "hash", "prev_hash")


@query(
    """
    WITH h AS (SELECT user_id, event_id, sha256(event_id || '|' || event_type) AS made, event_id || '|' || event_type AS payload FROM events),
    c AS (SELECT *, coalesce(lag(made) OVER (PARTITION BY user_id ORDER BY event_id), repeat('0', 64)) AS prev FROM h WHERE event_id % 89 <> 0),
    p AS (SELECT user_id, event_id, made AS hash, CASE WHEN event_id % 101 = 0 THEN 'x' ELSE prev END AS prev_hash, CASE WHEN event_id % 107 = 0 THEN NULL WHEN event_id % 103 = 0 THEN payload || '!' ELSE payload END AS payload FROM c WHERE event_id % 97 <> 0),
    s AS (SELECT user_id, CASE WHEN prev_hash IS DISTINCT FROM coalesce(lag(hash) OVER (PARTITION BY user_id ORDER BY event_id), repeat('0', 64)) THEN 'broken' WHEN payload IS NULL THEN 'absent' WHEN sha256(payload) <> hash THEN 'mismatch' ELSE 'ok' END AS state FROM p)
    SELECT user_id, count(*) AS records, count(*) FILTER (state = 'broken') AS broken, count(*) FILTER (state = 'absent') AS absent, count(*) FILTER (state = 'mismatch') AS mismatch FROM s GROUP BY user_id
    """
)
def chain_verification(spark, sf):
    """Chains of events from which records were removed, links overwritten, and payloads changed or lost afterwards: what each chain shows."""
    e = F.col("event_id")
    log = table(spark, sf, "events").select("user_id", "event_id", F.concat_ws("|", "event_id", "event_type").alias("payload")).filter(e % 89 != 0)
    chained = windows.hash_chain(log, ["user_id"], "event_id", F.col("payload")).filter(e % 97 != 0)
    tampered = chained.withColumn("prev_hash", F.when(e % 101 == 0, "x").otherwise(F.col("prev_hash"))).withColumn("payload", F.when(e % 107 == 0, None).when(e % 103 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    n = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    return windows.verify_chain(tampered, ["user_id"], "event_id", F.col("payload")).groupBy("user_id").agg(F.count(F.lit(1)).alias("records"), n("broken"), n("absent"), n("mismatch"))


@query(
    """
    WITH p AS (SELECT event_id, max(event_type) AS payload FROM events GROUP BY event_id), old AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS entry, payload FROM p WHERE event_id % 3 = 0),
    new AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 + (SELECT count(*) FROM old) AS entry, payload FROM p WHERE event_id % 3 <> 0), every AS (SELECT * FROM old UNION ALL SELECT * FROM new)
    SELECT entry, event_id, sha256(payload) AS hash, coalesce(lag(sha256(payload)) OVER (ORDER BY entry), repeat('0', 64)) AS prev_hash FROM every
    """
)
def chain_append(spark, sf):
    """A chain of every third event, to which all events are then offered: what it had stays, the others follow."""
    ev = table(spark, sf, "events").select("event_id", F.col("event_type").alias("payload"))
    empty = spark.createDataFrame([], "entry long, event_id long, hash string, prev_hash string")
    log = windows.append_chain(empty, ev.filter("event_id % 3 = 0"), "event_id", "payload")
    changed = ev.withColumn("payload", F.when(F.col("event_id") % 3 == 0, "changed").otherwise(F.col("payload")))
    return log.unionByName(windows.append_chain(log, changed, "event_id", "payload"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM token_counts WHERE doc_id IS NOT NULL)")
def chain_backfill(spark, sf):
    """Documents that the log of counts does not have yet."""
    return windows.missing_links(table(spark, sf, "token_counts"), table(spark, sf, "documents").select("doc_id"), "doc_id")


_PI = repr(math.pi)
_STEP = "CASE WHEN step < 100 THEN step / 100.0::DOUBLE ELSE {} END"
_FALL = "least(1.0, greatest(0.0, (step - 800) / 200.0::DOUBLE))"


@query(
    f"""SELECT step, 1.0::DOUBLE AS constant, {_STEP.format('1.0')} AS constant_with_warmup, round({_STEP.format('greatest(0.0, (1000 - step) / 900.0::DOUBLE)')}, 6) AS linear,
    round({_STEP.format(f'greatest(0.0, 0.5 * (1 + cos({_PI} * (step - 100) / 900.0::DOUBLE)) * 0.9 + 0.1)')}, 6) AS cosine, round({_STEP.format('1 / sqrt(step / 100.0::DOUBLE)')}, 6) AS inverse_sqrt,
    round({_STEP.format(f'(1 - {_FALL}) * 0.9 + 0.1')}, 6) AS wsd_linear, round({_STEP.format(f'0.5 * (1 + cos({_PI} * {_FALL})) * 0.9 + 0.1')}, 6) AS wsd_cosine, round({_STEP.format(f'(1 - sqrt({_FALL})) * 0.9 + 0.1')}, 6) AS wsd_sqrt
    FROM (SELECT range AS step FROM range(0, 1001))"""
)
def lr_schedules(spark, sf):
    """The factor of every learning-rate schedule over a thousand steps."""
    steps = spark.range(1001).withColumnRenamed("id", "step")
    rates = windows.learning_rates(F.col("step"), 100, 1000, 200, 0.1)
    return steps.select("step", *[(F.round(c, 6) if k not in ("constant",) else c).alias(k) for k, c in rates.items()])


@query("WITH d AS (SELECT DISTINCT batch_id FROM padded_batch) SELECT batch_id FROM (SELECT batch_id, row_number() OVER (ORDER BY batch_id DESC) AS rn FROM d WHERE batch_id <> 3) WHERE rn > 5")
def checkpoint_retention(spark, sf):
    """Batches to delete when the newest five and one protected one stay."""
    return windows.newest(table(spark, sf, "padded_batch").select("batch_id").distinct(), 5, "batch_id", F.col("batch_id") == 3)


@query("SELECT user_id, arg_min(event_id, (value, event_id)) AS best_low, arg_max(event_id, (value, -event_id)) AS best_high FROM events GROUP BY user_id")
def best_checkpoint(spark, sf):
    """The step of the lowest and of the highest value, the earliest of equal ones."""
    return telemetry.best_checkpoint(table(spark, sf, "events"), "user_id", "event_id", "value")


@query("SELECT scan_id, tag, value FROM (UNPIVOT (SELECT DISTINCT scan_id, n_records::DOUBLE AS n_records, total_tokens::DOUBLE AS total_tokens, total_words::DOUBLE AS total_words, total_unk::DOUBLE AS total_unk FROM scan_stats) ON n_records, total_tokens, total_words, total_unk INTO NAME tag VALUE value)")
def metric_scalars(spark, sf):
    """Scan reports as (scan_id, tag, value)."""
    names = ["n_records", "total_tokens", "total_words", "total_unk"]
    return windows.scalars(table(spark, sf, "scan_stats").select("scan_id", *names).distinct(), "scan_id", names)


CATALOGUE = [("total_tokens", "tokens of the scan"), ("total_.*", "a total of the scan"), ("n_.*", "a count")]


@query("SELECT DISTINCT tag, CASE WHEN tag = 'total_tokens' THEN 'tokens of the scan' WHEN tag LIKE 'total%' THEN 'a total of the scan' WHEN tag LIKE 'n%' THEN 'a count' END AS text FROM (VALUES ('n_records'), ('total_tokens'), ('total_words'), ('total_unk')) t(tag)")
def tag_catalogue(spark, sf):
    """What the catalogue says about each tag: its first pattern that matches fully."""
    return windows.describe_tags(metric_scalars(spark, sf).select("tag").distinct(), CATALOGUE)


@query(f"SELECT mode, count(*) AS examples, sum(e)::BIGINT AS encoder_tokens, sum(l)::BIGINT AS label_tokens, round(avg(e), 6) AS mean_encoder, round(sum(e) / sum(sum(e)) OVER (), 6) AS token_share FROM {ONCE} GROUP BY mode")
def mode_counters(spark, sf):
    return telemetry.mode_counters(table(spark, sf, "padded_batch"))


_COUNTED = f"(SELECT mode, e // 20 AS spans, e > 200 AS cut, CASE WHEN e < 8 THEN 'too_short' WHEN l < 2 THEN 'no_target' END AS skipped FROM {ONCE})"


def _counted(spark, sf):
    x = telemetry.lengths(table(spark, sf, "padded_batch"))
    reason = F.when(F.col("e") < 8, "too_short").when(F.col("l") < 2, "no_target")
    return x.select("mode", F.floor(F.col("e") / 20).alias("spans"), (F.col("e") > 200).alias("cut"), reason.alias("skipped"))


@query(f"SELECT mode, count(*) FILTER (skipped IS NULL) AS examples, coalesce(sum(spans) FILTER (skipped IS NULL), 0)::BIGINT AS spans, count(*) FILTER (skipped IS NULL AND cut) AS truncated, count(*) FILTER (skipped IS NOT NULL) AS skipped, round(coalesce(sum(spans) FILTER (skipped IS NULL) / nullif(count(*) FILTER (skipped IS NULL), 0)::DOUBLE, 0), 6) AS mean_spans FROM {_COUNTED} GROUP BY mode")
def example_counters(spark, sf):
    """Examples, spans (one for twenty tokens), cut and skipped ones by mode."""
    return telemetry.example_counters(_counted(spark, sf), "mode", F.col("spans"), F.col("cut"), F.col("skipped"))


@query(f"SELECT mode, skipped AS reason, count(*) AS n FROM {_COUNTED} WHERE skipped IS NOT NULL GROUP BY ALL")
def skip_counts(spark, sf):
    """Why examples were skipped."""
    return telemetry.skip_counts(_counted(spark, sf), "mode", F.col("skipped"))


@query(f"SELECT mode, CASE WHEN l <= 16 THEN 0 WHEN l <= 32 THEN 1 WHEN l <= 64 THEN 2 WHEN l <= 96 THEN 3 WHEN l <= 128 THEN 4 WHEN l <= 192 THEN 5 WHEN l <= 256 THEN 6 ELSE 7 END AS bucket, count(*) AS n FROM {ONCE} GROUP BY ALL")
def target_length_histogram(spark, sf):
    """Label lengths by seven edges and an overflow."""
    return telemetry.length_histogram(table(spark, sf, "padded_batch"), [16, 32, 64, 96, 128, 192, 256])


@query("SELECT event_type, round(sum(value) / sum(user_id), 6) AS mean_loss, round(exp(least(sum(value) / sum(user_id), 50)), 6) AS perplexity FROM events GROUP BY GROUPING SETS ((event_type), ())")
def mean_loss(spark, sf):
    """Weighted mean and perplexity by mode and over all."""
    return telemetry.mean_loss(table(spark, sf, "events"), "event_type", "value", "user_id")


@query("SELECT CASE WHEN user_id <= 30 THEN 0 WHEN user_id <= 60 THEN 1 WHEN user_id <= 100 THEN 2 ELSE 3 END AS bucket, count(*) AS n, round(avg(value), 6) AS mean_loss FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY 1")
def loss_by_length(spark, sf):
    """Means of a value by edges of another column."""
    return telemetry.loss_by_length(table(spark, sf, "events"), "user_id", "value", [30, 60, 100])


@query("SELECT n, round(total, 3) AS total, round(squares, 3) AS squares FROM (SELECT count(v) AS n, sum(v) AS total, sum(v * v) AS squares FROM (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings))")
def weight_moments(spark, sf):
    """Number, sum and sum of squares of all weights."""
    return telemetry.weight_moments(table(spark, sf, "embeddings"), "embedding").select("n", F.round("total", 3).alias("total"), F.round("squares", 3).alias("squares"))


@query("WITH b AS (SELECT least(floor(value / 500 * 15), 14)::INT AS bin, value / 500 AS conf, CASE WHEN event_id % 3 <> 0 THEN 1.0 ELSE 0.0 END AS hit FROM events), g AS (SELECT bin, count(*) AS n, sum(conf) AS conf, sum(hit) AS hit FROM b GROUP BY bin) SELECT bin, n, round(abs(hit - conf) / n, 6) AS gap, round(sum(abs(hit - conf)) OVER () / sum(n) OVER (), 6) AS ece FROM g")
def calibration_error(spark, sf):
    """Gap of confidence and accuracy in fifteen bins, and their weighted mean."""
    ev = table(spark, sf, "events")
    hit = F.when(F.pmod("event_id", F.lit(3)) != 0, 1.0).otherwise(0.0)
    return telemetry.calibration(ev.select((F.col("value") / 500).alias("conf"), hit.alias("hit")), 15)


@query("WITH x AS (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT CASE WHEN v = 0 THEN 0 ELSE sign(v)::INT * (1 + greatest(0, floor(ln(abs(v) / 1e-12) / ln(1.1)))::INT) END AS bucket, count(*) AS n, min(v) AS low, max(v) AS high FROM x GROUP BY 1")
def weight_histogram(spark, sf):
    """Exponential buckets (factor 1.1 from 1e-12), signed."""
    return telemetry.weight_histogram(table(spark, sf, "embeddings"), "embedding")


@query("SELECT suite, sha256(string_agg(sha256(text) || '  ' || item_id || chr(10), '' ORDER BY item_id)) AS root FROM eval_items GROUP BY suite")
def root_hashes(spark, sf):
    """One digest over the ordered digests of every suite."""
    return telemetry.root_hashes(table(spark, sf, "eval_items"), "suite", "item_id", F.sha2("text", 256))


@query("SELECT doc_id, sha256(text) AS digest, coalesce(octet_length(encode(text)), 0) AS bytes FROM documents")
def file_digests(spark, sf):
    return telemetry.file_digests(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT n, m, round(list_sum(list_transform(range(m, n + 1), lambda i: factorial(n::INT) / (factorial(i::INT) * factorial((n - i)::INT)))) / pow(2, n), 6) AS p FROM (SELECT range AS n FROM range(1, 21)), (SELECT range AS m FROM range(0, 21)) WHERE m <= n")
def binomial_tail(spark, sf):
    """Probability of at least m of n even coins."""
    grid = spark.range(1, 21).withColumnRenamed("id", "n").withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    return grid.select("n", "m", F.round(telemetry.binomial_tail(F.col("n"), F.col("m")), 6).alias("p"))


@query("SELECT user_id, event_id // 500 AS window_id, sum(value) AS total, max(value) AS highest, arg_max(event_type, event_id) AS last_type FROM events GROUP BY ALL")
def window_accumulators(spark, sf):
    """Sums, the maximum and the last label between two log lines."""
    return telemetry.window_accumulators(table(spark, sf, "events"), "user_id", "event_id", 500, "value", "event_type")


@query("SELECT mode, count(*) AS n FROM (SELECT DISTINCT example_id, mode FROM padded_batch) GROUP BY mode")
def frozen_by_mode(spark, sf):
    return telemetry.count_by_mode(table(spark, sf, "padded_batch"), "example_id")


@query("SELECT count(*) AS names, count(DISTINCT source_id) AS distinct_names, count(*) = count(DISTINCT source_id) AS unique_names, bool_and(regexp_full_match(source_id, '[a-z]+_[a-z]+')) AS well_formed FROM source_spec")
def reserved_names(spark, sf):
    """Every name once and well formed."""
    return telemetry.check_names(table(spark, sf, "source_spec"), "source_id", "[a-z]+_[a-z]+")


@query("SELECT source_id, (row_number() OVER (ORDER BY source_id) + 32999)::BIGINT AS id FROM source_spec")
def name_ids(spark, sf):
    """Ids of reserved names, in order of the names."""
    return telemetry.name_ids(table(spark, sf, "source_spec"), "source_id", 33_000)


@query("WITH r AS (SELECT source_id, (row_number() OVER (ORDER BY target_weight DESC, source_id) + row_number() OVER (ORDER BY max_repeats, source_id) + 2 * row_number() OVER (ORDER BY shuffle_buffer, source_id)) / 4.0 AS mean_rank FROM source_spec WHERE NOT needs_token) SELECT source_id, mean_rank::DOUBLE AS mean_rank FROM r UNION ALL SELECT source_id, NULL FROM source_spec WHERE needs_token")
def variant_ranking(spark, sf):
    """Mean of ordinal ranks, one criterion counted twice; what is not eligible has none."""
    return telemetry.rank_variants(table(spark, sf, "source_spec"), "source_id", [(F.desc("target_weight"), 1), (F.asc("max_repeats"), 1), (F.asc("shuffle_buffer"), 2)], ~F.col("needs_token"))


@query("SELECT source_id, lines, lines >= max_repeats AND max_repeats > 0 AS saturated FROM source_spec JOIN (SELECT lower(trim(source)) AS source, count(*) AS lines FROM documents GROUP BY 1) ON source = source_id")
def saturation_check(spark, sf):
    n = table(spark, sf, "documents").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("lines"))
    return telemetry.saturated(table(spark, sf, "source_spec"), n, "source_id", "max_repeats")


@query("SELECT range AS step, range + 1 >= 100 AND (range + 1) % 25 = 0 AS due, CASE WHEN range >= 800 THEN 'cooldown' ELSE 'main' END AS phase FROM range(0, 1000)")
def scheduled_steps(spark, sf):
    """Cadence of an injection and the phase of every step."""
    return telemetry.schedule(spark.range(1000).withColumnRenamed("id", "step"), "step", 100, 25, 800)


@query("SELECT gate, passed, metric FROM (SELECT 'records' AS gate, count(*) > 0 AS passed, count(*)::DOUBLE AS metric FROM scan_stats UNION ALL SELECT 'unknown', sum(total_unk) <= 0.01 * sum(total_words), round(sum(total_unk) / sum(total_words)::DOUBLE, 6) FROM scan_stats UNION ALL SELECT 'fertility', sum(total_tokens) / sum(total_words)::DOUBLE < 4, round(sum(total_tokens) / sum(total_words)::DOUBLE, 6) FROM scan_stats UNION ALL SELECT 'bytes', sum(total_byte_tokens) <= 0.02 * sum(total_tokens), round(sum(total_byte_tokens) / sum(total_tokens)::DOUBLE, 6) FROM scan_stats)")
def tokenizer_gates(spark, sf):
    """Checks over the scan reports, one row each: passed or not, and the figure."""
    return telemetry.gates(table(spark, sf, "scan_stats"))
