"""Apportionment, blends, splits and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import blend, windows
from loomtext.plans.lineage import broadcast_if_small
from loomtext.queries.registry import query, table

SRC = "lower(trim(source))"


def draw_sql(x: str) -> str:
    return f"('0x' || substr(sha256({x}), 1, 15))::BIGINT"


def _source(c: str = "source"):
    return F.lower(F.trim(c))


def _counts(spark, sf):
    return table(spark, sf, "documents").groupBy(_source().alias("source")).agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))


COUNTS = f"(SELECT {SRC} AS source, count(*) AS lines, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes FROM documents GROUP BY 1)"


@query(
    f"""WITH s AS (SELECT source, lines, least(333, sum(lines) OVER ()) * lines AS product, sum(lines) OVER () AS total, least(333, sum(lines) OVER ()) AS want FROM {COUNTS}),
    f AS (SELECT *, (product // total)::BIGINT AS floor, row_number() OVER (ORDER BY product % total DESC, source) AS rk FROM s)
    SELECT source, lines, (floor + CASE WHEN rk <= want - sum(floor) OVER () THEN 1 ELSE 0 END)::BIGINT AS share FROM f"""
)
def largest_remainder(spark, sf):
    """333 lines shared out over sources by their lines."""
    return blend.largest_remainder(_counts(spark, sf).select("source", "lines"), 333, "lines", "source")


@query()
def allocate_quota(spark, sf):
    """Water-filling of lines by target weight, capped by what each source has."""
    spec = table(spark, sf, "source_spec").select("source_id", "target_weight")
    have = _counts(spark, sf).select(F.col("source").alias("source_id"), F.col("lines"))
    return blend.allocate_table(spec.join(have, "source_id", "left"), 600, "source_id", "target_weight", "lines")


@query(f"WITH p AS (SELECT b.source_id AS source, target_weight / (bytes / lines::DOUBLE) AS w FROM source_spec b JOIN {COUNTS} c ON c.source = b.source_id WHERE bytes > 0) SELECT source, round(w / sum(w) OVER (), 6) AS weight FROM p")
def blend_weights(spark, sf):
    shares = table(spark, sf, "source_spec").select(F.col("source_id").alias("source"), F.col("target_weight").alias("share"))
    return blend.blend_weights(shares, _counts(spark, sf)).select("source", F.round("weight", 6).alias("weight"))


@query(f"SELECT source, lines, CASE WHEN lines <= 40 THEN lines - greatest(1, lines // 10) ELSE 40 END::BIGINT AS budget FROM {COUNTS}")
def train_budgets(spark, sf):
    return _counts(spark, sf).select("source", "lines", blend.train_budget(F.col("lines"), F.lit(40)).alias("budget"))


@query(f"WITH w AS (SELECT source_id, target_weight / sum(target_weight) OVER () AS share FROM source_spec) SELECT source_id, floor(share * 1000000)::BIGINT AS wanted_bytes, coalesce(bytes, 0) < 0.9 * share * 1000000 AS underfilled FROM w LEFT JOIN {COUNTS} c ON c.source = source_id")
def byte_budgets(spark, sf):
    """Bytes every source should give to a million, and whether it has less than nine tenths of that."""
    return blend.byte_budgets(table(spark, sf, "source_spec"), _counts(spark, sf), 1_000_000)


@query(f"SELECT source, (bytes / 4)::BIGINT AS rounded, floor(bytes / 4.0)::BIGINT AS tokens, round(bytes / 1073741824.0, 6) AS gib FROM {COUNTS}")
def token_estimates(spark, sf):
    return blend.token_estimates(_counts(spark, sf))


@query(f"SELECT doc_id, rn <= quota AS train FROM (SELECT doc_id, row_number() OVER (PARTITION BY {SRC} ORDER BY {draw_sql(chr(39) + '7:' + chr(39) + ' || doc_id')}) AS rn, floor(0.8 * count(*) OVER (PARTITION BY {SRC})) AS quota FROM documents)")
def algorithm_s_split(spark, sf):
    """Four fifths of every source, exactly, chosen by draw."""
    docs = table(spark, sf, "documents").select("doc_id", _source().alias("source"))
    n = docs.groupBy("source").agg(F.floor(F.count(F.lit(1)) * 0.8).alias("q"))
    quota = docs.join(broadcast_if_small(n, 100_000), "source")
    return blend.select_quota(quota, ["source"], F.col("q"), F.lit("7"), F.col("doc_id")).select("doc_id", F.col("selected").alias("train"))


@query(f"WITH s AS (SELECT doc_id, {SRC} AS source, row_number() OVER (PARTITION BY {SRC} ORDER BY {draw_sql(chr(39) + '7:' + chr(39) + ' || doc_id')}) AS rn, floor(0.8 * count(*) OVER (PARTITION BY {SRC})) AS quota FROM documents), e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {draw_sql(chr(39) + '9:' + chr(39) + ' || doc_id')}) AS rn2 FROM s WHERE rn > quota) SELECT doc_id FROM e WHERE rn2 <= 3")
def eval_capped(spark, sf):
    """What was not trained, at most three documents of every source."""
    split = algorithm_s_split(spark, sf)
    docs = table(spark, sf, "documents").select("doc_id", _source().alias("source"))
    rest = docs.join(split.filter("train"), "doc_id", "left_anti")
    return blend.select_quota(rest, ["source"], F.lit(3), F.lit("9"), F.col("doc_id")).filter("selected").select("doc_id")


@query("WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('salt' || chr(1) || text), doc_id) AS rn FROM (SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL GROUP BY text)) SELECT doc_id, CASE WHEN rn <= 50 THEN 'eval' WHEN rn <= 350 THEN 'train' ELSE 'rest' END AS split FROM k")
def key_order_split(spark, sf):
    """Distinct texts by salted key: the first 50 evaluate, the next 300 train."""
    return blend.key_order_split(table(spark, sf, "documents"), "doc_id", "text", "salt", 50, 300)


@query(f"SELECT doc_id FROM documents ORDER BY {draw_sql(chr(39) + '3:' + chr(39) + ' || doc_id')} LIMIT 100")
def reservoir_sample(spark, sf):
    """A uniform sample of 100 documents: the lowest draws."""
    return blend.bottom_draws(table(spark, sf, "documents").select("doc_id"), 100, "doc_id", "3").select("doc_id")


@query(f"SELECT doc_id FROM documents ORDER BY {draw_sql(chr(39) + '19:' + chr(39) + ' || doc_id')} LIMIT 60")
def merged_samples(spark, sf):
    """Samples of four unequal parts merged: the sample of the whole."""
    docs = table(spark, sf, "documents").select("doc_id", F.least(F.lit(3), F.pmod("doc_id", F.lit(11))).alias("part"))
    parts = [blend.bottom_draws(docs.filter(F.col("part") == k), 60, "doc_id", "19") for k in range(4)]
    return blend.merge_samples(parts, 60, "doc_id").select("doc_id")


@query(f"SELECT {SRC} AS source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY {SRC} ORDER BY {draw_sql(chr(39) + '5:' + chr(39) + ' || doc_id')}) <= greatest(1, count(*) OVER (PARTITION BY {SRC}) // 10)")
def merged_reservoirs(spark, sf):
    """A tenth of every source, at least one."""
    docs = table(spark, sf, "documents").select("doc_id", _source().alias("source"))
    n = docs.groupBy("source").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 10)).alias("q"))
    return blend.select_quota(docs.join(broadcast_if_small(n, 100_000), "source"), ["source"], F.col("q"), F.lit("5"), F.col("doc_id")).filter("selected").select("source", "doc_id")


@query(f"SELECT doc_id, {draw_sql(chr(39) + '11:' + chr(39) + ' || doc_id')} AS seed FROM documents")
def example_seeds(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.draw(F.lit("11"), F.col("doc_id")).alias("seed"))


@query("SELECT source_id, (list_sum(list_transform(string_split(source_id, ''), lambda x: ascii(x))) * 31)::BIGINT AS seed_offset FROM source_spec")
def seed_offsets(spark, sf):
    return table(spark, sf, "source_spec").select("source_id", blend.seed_offset(F.col("source_id")).alias("seed_offset"))


@query("SELECT source_id, c AS counter, CASE WHEN ('0x' || substr(sha256(source_id || ':' || c), 1, 1))::BIGINT >= 8 THEN 1 ELSE -1 END AS sign FROM source_spec, range(0, 16) r(c)")
def key_stream(spark, sf):
    """Sixteen signs per key from a digest in counter mode."""
    return blend.sign_stream(table(spark, sf, "source_spec"), "source_id", 16)


@query("SELECT mode, size, 17 AS seed, encoder_capacity * size AS cells FROM pack_spec, (VALUES (1), (2), (4), (8)) v(size)")
def job_grid(spark, sf):
    """One configuration per mode and size."""
    return blend.grid(table(spark, sf, "pack_spec"), {"size": [1, 2, 4, 8], "seed": [17]}).select("mode", "size", "seed", (F.col("encoder_capacity") * F.col("size")).alias("cells"))


@query(
    f"""WITH w AS (SELECT source_id, sum(target_weight) OVER (ORDER BY source_id) / sum(target_weight) OVER () AS hi, row_number() OVER (ORDER BY source_id DESC) AS last FROM source_spec),
    b AS (SELECT source_id, coalesce(lag(hi) OVER (ORDER BY source_id), 0) AS lo, CASE WHEN last = 1 THEN 2 ELSE hi END AS hi FROM w)
    SELECT doc_id, source_id AS drawn FROM (SELECT doc_id, {draw_sql(chr(39) + '13:' + chr(39) + ' || doc_id')} / 1152921504606846976.0::DOUBLE AS u FROM documents) d JOIN b ON u >= lo AND u < hi"""
)
def blended_draw(spark, sf):
    """A source for every draw, by running weights."""
    weights = table(spark, sf, "source_spec").select("source_id", "target_weight")
    docs = table(spark, sf, "documents").select("doc_id")
    return blend.cumulative_draw(docs, weights, T.uniform(F.lit("13"), F.col("doc_id")), "source_id", "target_weight")


@query(
    f"""WITH w AS (SELECT source_id, sum(target_weight) OVER (ORDER BY source_id) / sum(target_weight) OVER () AS hi, row_number() OVER (ORDER BY source_id DESC) AS last FROM source_spec),
    b AS (SELECT source_id, coalesce(lag(hi) OVER (ORDER BY source_id), 0) AS lo, CASE WHEN last = 1 THEN 2 ELSE hi END AS hi FROM w),
    d AS (SELECT source_id AS source, count(*) AS draws FROM (SELECT {draw_sql(chr(39) + '13:' + chr(39) + ' || doc_id')} / 1152921504606846976.0::DOUBLE AS u FROM documents) d JOIN b ON u >= lo AND u < hi GROUP BY 1)
    SELECT source, draws, round(draws / sum(draws) OVER (), 6) AS share, (draws // lines)::BIGINT AS epochs FROM d JOIN {COUNTS} c USING (source)"""
)
def realized_shares(spark, sf):
    """Draws per source, their share, and how often the source was gone through."""
    return blend.realized_shares(blended_draw(spark, sf), _counts(spark, sf))


@query("SELECT lang, p AS percent, v AS n_chars FROM (SELECT lower(substr(lang, 1, 2)) AS lang, n_chars AS v, row_number() OVER (PARTITION BY lower(substr(lang, 1, 2)) ORDER BY n_chars) - 1 AS rk, count(*) OVER (PARTITION BY lower(substr(lang, 1, 2))) AS n FROM documents WHERE n_chars IS NOT NULL), (VALUES (1.0::DOUBLE), (50.0::DOUBLE), (95.0::DOUBLE), (99.0::DOUBLE)) t(p) WHERE rk = least(n - 1, round_even(p / 100 * (n - 1), 0)::BIGINT)")
def percentiles(spark, sf):
    docs = table(spark, sf, "documents").select(F.lower(F.substring("lang", 1, 2)).alias("lang"), "n_chars")
    return windows.nearest_rank(docs, ["lang"], "n_chars", [1.0, 50.0, 95.0, 99.0])


@query("WITH c AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?')) AS w FROM documents) GROUP BY w), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS rk, count(*) OVER () AS ids, sum(n) OVER () AS total FROM c) SELECT p AS percent, round(sum(n) FILTER (rk <= greatest(1, floor(ids * p / 100.0))) / first(total), 6) AS share FROM r, (VALUES (1), (5), (10), (25), (50)) t(p) GROUP BY p")
def top_share_tokens(spark, sf):
    """Share of all words held by the most frequent percents of the vocabulary."""
    w = table(spark, sf, "documents").select(F.explode(T.metric_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return windows.top_shares(w, "n", [1, 5, 10, 25, 50])


@query(
    """WITH t AS (SELECT doc_id, octet_length(encode(text)) + 12 AS line_bytes FROM documents WHERE text IS NOT NULL), c AS (SELECT *, coalesce(sum(line_bytes) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bytes_before FROM t)
    SELECT doc_id, line_bytes, bytes_before, bytes_before // 50000 AS shard FROM c WHERE bytes_before < 300000"""
)
def budget_cut(spark, sf):
    """Documents in order until 300,000 bytes are written, in shards of 50,000."""
    docs = table(spark, sf, "documents").filter("text is not null").select("doc_id", "text")
    return blend.budget_cut(docs, "doc_id", F.octet_length("text") + 12, 300_000, 50_000).select("doc_id", "line_bytes", "bytes_before", "shard")


@query("SELECT worker, count(*) AS records, sum(octet_length(encode(text)))::BIGINT AS bytes FROM (SELECT *, doc_id % 4 AS worker FROM documents) GROUP BY worker")
def fan_out(spark, sf):
    """Work items go round the workers in turn."""
    dealt = blend.in_turn(table(spark, sf, "documents"), "doc_id", 4)
    return dealt.groupBy("worker").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("text")).alias("bytes"))
