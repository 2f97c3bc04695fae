"""Examples, batches, windows, rewriting pairs. Token sequences are the unpadded inputs of padded_batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import examples as X
from loomtext.operators import rewrite, windows
from loomtext.queries.cleaning import count_sql, ratio_sql
from loomtext.queries.registry import heavy, query, table
from loomtext.queries.sampling import draw_sql
from loomtext.queries.telemetry import LEN_E, LEN_L

TOK = f"tok AS (SELECT DISTINCT example_id, mode, batch_id, encoder_input_ids[1:{LEN_E}] AS t, labels[1:{LEN_L}] AS lab FROM padded_batch)"


def tokens(spark, sf):
    """(example_id, mode, batch_id, t, lab), every example once."""
    return table(spark, sf, "padded_batch").select("example_id", "mode", "batch_id", X.strip_pad("encoder_input_ids", 0).alias("t"), X.strip_pad("labels", -100).alias("lab")).dropDuplicates(["example_id"])


_C = "greatest(1, least(round_even(n * {r}, 0)::INT, n - 1))"
_S = "greatest(1, least(round_even({c} / {m}::DOUBLE, 0)::INT, {c}, n - {c}))"


def _plan(r: str, m: str) -> tuple[str, str]:
    c = _C.format(r=r)
    return c, _S.format(c=c, m=m)


_CR, _SR = _plan("0.15", "3.0")
_CX, _SX = _plan("0.5", "32.0")


@query(f"SELECT n, {_CR}::INT AS corrupted_r, {_SR}::INT AS spans_r, {_CX}::INT AS corrupted_x, {_SX}::INT AS spans_x FROM (SELECT range::INT AS n FROM range(2, 1025))")
def span_plan(spark, sf):
    """Corrupted tokens and spans of every length, for both rates."""
    n = F.col("id").cast("int")
    (cr, sr), (cx, sx) = X.span_plan(n, F.lit(0.15), F.lit(3.0)), X.span_plan(n, F.lit(0.5), F.lit(32.0))
    return spark.range(2, 1025).select(n.alias("n"), cr.alias("corrupted_r"), sr.alias("spans_r"), cx.alias("corrupted_x"), sx.alias("spans_x"))


@query(f"WITH p AS (SELECT n, {_CR} AS c, {_SR} AS s FROM (SELECT range::INT AS n FROM range(8, 513))) SELECT max(n - c + s + 2)::INT AS most_encoder, max(c + s + 1)::INT AS most_target, max(s)::INT AS most_spans FROM p")
def capacity_proof(spark, sf):
    """The longest encoder, target and number of spans over all admissible lengths."""
    n = F.col("id").cast("int")
    c, s = X.span_plan(n, F.lit(0.15), F.lit(3.0))
    return spark.range(8, 513).select(F.max(n - c + s + 2).alias("most_encoder"), F.max(c + s + 1).alias("most_target"), F.max(s).alias("most_spans"))


@query(f"WITH {TOK} SELECT example_id, greatest(1, least(trunc(len(t) * (0.25 + {draw_sql(chr(39) + 's:' + chr(39) + ' || example_id')} / 1152921504606846976.0::DOUBLE * 0.5))::INT, len(t) - 1))::INT AS prefix FROM tok WHERE len(t) >= 8")
def prefix_split(spark, sf):
    t = tokens(spark, sf).filter(F.size("t") >= 8)
    return t.select("example_id", X.prefix_length(F.size("t"), T.uniform(F.lit("s"), F.col("example_id"))).alias("prefix"))


_EVEN = f"""{TOK}, q AS (SELECT example_id, t, len(t)::INT AS n FROM tok WHERE len(t) BETWEEN 8 AND 512), pl AS (SELECT *, {_CR} AS c, {_SR} AS s FROM q), wd AS (SELECT *, (n // s)::INT AS w, greatest(1, least(c // s, n // s - 1))::INT AS z FROM pl),
    el AS (SELECT example_id, n, s, w, z, t, unnest(range(0, n)) AS i FROM wd), cl AS (SELECT *, i // w AS k, i // w < s AND i % w >= w - z AS cut, i // w < s AND i % w = w - z AS head FROM el)"""


@query(
    f"""WITH {_EVEN}, e AS (SELECT example_id, list(CASE WHEN cut THEN {X.FIRST_SENTINEL} - k ELSE t[i + 1] END ORDER BY i) AS enc FROM cl WHERE NOT cut OR head GROUP BY example_id),
    g AS (SELECT example_id, flatten(list(CASE WHEN head THEN [{X.FIRST_SENTINEL} - k, t[i + 1]] ELSE [t[i + 1]] END ORDER BY i)) AS tg FROM cl WHERE cut GROUP BY example_id)
    SELECT example_id, array_to_string([{X.MODES['R']}] || enc || [{X.EOS}], ' ') AS encoder, array_to_string(tg || [{X.EOS}], ' ') AS target, array_to_string([{X.START}] || tg, ' ') AS decoder FROM e JOIN g USING (example_id)"""
)
def span_examples(spark, sf):
    """Span corruption of every admissible sequence, with evenly spaced spans."""
    t = tokens(spark, sf).filter(F.size("t").between(8, 512)).withColumn("n", F.size("t"))
    c, s = X.span_plan(F.col("n"), F.lit(0.15), F.lit(3.0))
    t = t.withColumn("c", c).withColumn("s", s)
    made = t.select("example_id", X.corrupt(F.col("t"), X.even_spans(F.col("n"), F.col("c"), F.col("s")), X.MODES["R"]).alias("x"))
    return made.select("example_id", *[F.array_join(F.transform(F.col(f"x.{c}"), lambda v: v.cast("string")), " ").alias(c) for c in ("encoder", "target", "decoder")])


@query(f"WITH {TOK}, p AS (SELECT example_id, t, len(t) // 2 AS k FROM tok WHERE len(t) >= 8) SELECT example_id, array_to_string([{X.MODES['S']}] || t[1:k] || [{X.EOS}], ' ') AS encoder, array_to_string(t[k + 1:] || [{X.EOS}], ' ') AS target FROM p")
def prefix_examples(spark, sf):
    t = tokens(spark, sf).filter(F.size("t") >= 8)
    made = t.select("example_id", X.prefix_example(F.col("t"), F.floor(F.size("t") / 2).cast("int")).alias("x"))
    return made.select("example_id", *[F.array_join(F.transform(F.col(f"x.{c}"), lambda v: v.cast("string")), " ").alias(c) for c in ("encoder", "target")])


@query(f"WITH {TOK} SELECT example_id, CASE WHEN list_has_any(t, [{X.STYLE}, {X.OPEN}, {X.CLOSE}, {X.EOS}]) THEN 'control_token_in_text' ELSE 'ok' END AS state, CASE WHEN NOT list_has_any(t, [{X.STYLE}, {X.OPEN}, {X.CLOSE}, {X.EOS}]) THEN array_to_string([{X.STYLE}, {X.OPEN}] || t || [{X.CLOSE}, {X.EOS}], ' ') END AS encoder FROM tok")
def framed_pairs(spark, sf):
    """Framed pairs; sequences with a control token are told apart."""
    made = tokens(spark, sf).select("example_id", X.frame(F.col("t"), F.col("lab")).alias("x"))
    return made.select("example_id", F.when(F.col("x").isNull(), "control_token_in_text").otherwise("ok").alias("state"), F.array_join(F.transform("x.encoder", lambda v: v.cast("string")), " ").alias("encoder"))


@query(f"WITH {TOK}, w AS (SELECT batch_id, (ceil(max(len(t)) / 8.0) * 8)::INT AS we, (ceil(max(len(lab)) / 8.0) * 8)::INT AS wl FROM tok GROUP BY batch_id) SELECT example_id, we AS width, array_to_string(t || list_transform(range(len(t), we), lambda i: 0), ' ') AS ids, array_to_string(lab || list_transform(range(len(lab), wl), lambda i: -100), ' ') AS labels, len(t)::INT AS mask_sum FROM tok JOIN w USING (batch_id)")
def pad_batch(spark, sf):
    """Batches padded again, to multiples of eight."""
    padded = X.pad_batches(tokens(spark, sf), "batch_id", "t", "lab")
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return padded.select("example_id", F.size("t").alias("width"), text("t").alias("ids"), text("lab").alias("labels"), F.aggregate("attention_mask", F.lit(0), lambda a, v: a + v).alias("mask_sum"))


@query(f"WITH {TOK} SELECT example_id, len(t)::INT AS n_ids, len(lab)::INT AS n_labels FROM tok")
def unpadded_rows(spark, sf):
    return tokens(spark, sf).select("example_id", F.size("t").alias("n_ids"), F.size("lab").alias("n_labels"))


@query(f"WITH {TOK}, s AS (SELECT example_id, mode, (example_id // 256)::INT AS pool_no, greatest(len(t), len(lab)) * 10000 + len(t) AS size FROM tok) SELECT example_id, mode, pool_no, ((row_number() OVER (PARTITION BY mode, pool_no ORDER BY size, example_id) - 1) // 16)::INT AS batch_no FROM s")
def length_batches(spark, sf):
    """Batches of sixteen by length inside bounded pools."""
    size = F.greatest(F.size("t"), F.size("lab")) * 10000 + F.size("t")
    return X.length_batches(tokens(spark, sf), "example_id", "mode", size).select("example_id", "mode", "pool_no", "batch_no")


@query(
    f"""
    WITH RECURSIVE {TOK}, r AS (SELECT example_id, mode, example_id // 256 AS pool_no, len(t) AS e, len(lab) AS l, row_number() OVER (PARTITION BY mode, example_id // 256 ORDER BY greatest(len(t), len(lab)), len(t), example_id) AS k FROM tok),
    w AS (SELECT *, 1 AS n, e AS we, l AS wl, 0 AS batch_no FROM r WHERE k = 1
          UNION ALL
          SELECT r.*, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN r.e ELSE greatest(we, r.e) END, CASE WHEN cut THEN r.l ELSE greatest(wl, r.l) END, CASE WHEN cut THEN batch_no + 1 ELSE batch_no END
          FROM (SELECT r.*, w.n, w.we, w.wl, w.batch_no, (w.n + 1) * greatest(w.we, r.e) > 4096 OR (w.n + 1) * greatest(w.wl, r.l) > 2048 OR w.n = 64 AS cut FROM w JOIN r ON r.mode IS NOT DISTINCT FROM w.mode AND r.pool_no = w.pool_no AND r.k = w.k + 1) x, LATERAL (SELECT x.example_id, x.mode, x.pool_no, x.e, x.l, x.k) r)
    SELECT example_id, mode, pool_no::INT AS pool_no, batch_no::INT AS batch_no FROM w
    """
)
def capacity_batches(spark, sf):
    """Batches cut where rows times width would exceed a capacity."""
    t = tokens(spark, sf).select("example_id", "mode", F.size("t").alias("e"), F.size("lab").alias("l"))
    return X.capacity_batches(t, "example_id", "mode", "e", "l", 4096, 2048)


@query(f"WITH {TOK}, s AS (SELECT example_id, floor({draw_sql(chr(39) + '17:0:' + chr(39) + ' || example_id')} / 1152921504606846976.0::DOUBLE * ceil(count(*) OVER () / 64.0))::INT AS win, len(t) AS n FROM tok) SELECT example_id, win AS epoch_window, ((row_number() OVER (PARTITION BY win ORDER BY n, example_id) - 1) // 8)::INT AS step FROM s")
def epoch_plan(spark, sf):
    """An epoch shuffled by draw into windows of about 64 rows, each ordered by length and cut into steps of eight."""
    return X.epoch_plan(tokens(spark, sf).select("example_id", F.size("t").alias("n")), "example_id", "n", "17:0")


@query()
def sampled_examples(spark, sf):
    """Random span corruption and prefixes of every sequence, each with its own generator."""
    return X.sampled_examples(tokens(spark, sf), "example_id", "t", F.col("mode"))


@query(
    f"""
    WITH RECURSIVE {TOK}, r AS (SELECT example_id, mode, len(t) + 2 AS n, row_number() OVER (PARTITION BY mode ORDER BY example_id) AS k FROM tok),
    w AS (SELECT example_id, mode, k, n AS used, 1 AS segment, 0::BIGINT AS window_no FROM r WHERE k = 1
          UNION ALL
          SELECT r.example_id, r.mode, r.k, CASE WHEN w.used + r.n > 512 OR w.segment = 16 THEN r.n ELSE w.used + r.n END, CASE WHEN w.used + r.n > 512 OR w.segment = 16 THEN 1 ELSE w.segment + 1 END,
            CASE WHEN w.used + r.n > 512 OR w.segment = 16 THEN w.window_no + 1 ELSE w.window_no END FROM w JOIN r ON r.mode IS NOT DISTINCT FROM w.mode AND r.k = w.k + 1)
    SELECT example_id, mode, window_no, segment::INT AS segment FROM w
    """
)
def packed_windows(spark, sf):
    """Sequences packed into windows in order, one sequence of windows per mode."""
    t = tokens(spark, sf).select("example_id", "mode", F.size("t").alias("n"))
    return X.pack_windows(t, "example_id", "mode", "n", 512, 16)


@query()
def packed_examples(spark, sf):
    """Windows of several sequences as one example each."""
    return X.packed_examples(tokens(spark, sf), "example_id", "mode", "t", 512, 16)


@query(
    f"""
    WITH RECURSIVE {TOK}, r AS (SELECT mode, batch_id, batch_id // 256 AS stretch, sum(len(lab))::BIGINT AS v, row_number() OVER (PARTITION BY mode, batch_id // 256 ORDER BY batch_id) AS k FROM tok GROUP BY mode, batch_id),
    w AS (SELECT mode, batch_id, stretch, v, k, v AS total, 0 AS window_no FROM r WHERE k = 1
          UNION ALL
          SELECT r.mode, r.batch_id, r.stretch, r.v, r.k, CASE WHEN w.total >= 2000 THEN r.v ELSE w.total + r.v END, CASE WHEN w.total >= 2000 THEN w.window_no + 1 ELSE w.window_no END
          FROM w JOIN r ON r.mode IS NOT DISTINCT FROM w.mode AND r.stretch = w.stretch AND r.k = w.k + 1)
    SELECT mode, batch_id, v AS label_tokens, stretch::INT AS stretch, window_no::INT AS window_no FROM w
    """
)
def step_windows(spark, sf):
    """Batches gathered until their label tokens reach a budget, inside bounded stretches of batches."""
    b = tokens(spark, sf).groupBy("mode", "batch_id").agg(F.sum(F.size("lab")).cast("long").alias("label_tokens"))
    return windows.reset_windows(b.withColumn("stretch", F.floor(F.col("batch_id") / 256).cast("int")), ["mode", "stretch"], ["batch_id"], "label_tokens", 2000)


@query(f"WITH {TOK} SELECT example_id, '{{\"example_id\":' || example_id || ',\"mode\":\"' || mode || '\",\"t\":[' || array_to_string(t, ',') || ']}}' AS json FROM tok WHERE mode IS NOT NULL")
def example_json(spark, sf):
    t = tokens(spark, sf).filter("mode is not null").select("example_id", "mode", "t")
    return t.select("example_id", X.example_json(t).alias("json"))


_GROUPS = ", ".join(f"({k}, '{w.replace(chr(39), chr(39) * 2)}')" for k, g in enumerate(rewrite.grammar_groups()) for w in g)


@query(f"WITH g(k, w) AS (VALUES {_GROUPS}) SELECT a.w AS word, string_agg(DISTINCT b.w, ',' ORDER BY b.w) AS others FROM g a JOIN g b ON a.k = b.k AND a.w <> b.w GROUP BY a.w")
def confusion_table(spark, sf):
    """The other members of every group a word belongs to."""
    g = spark.createDataFrame([(k, w) for k, ws in enumerate(rewrite.grammar_groups()) for w in ws], "k int, w string")
    return rewrite.confusion_table(g, "k", "w").withColumn("others", F.array_join("others", ","))


_SOLID = r"length(regexp_replace(x, '[ \t\r\n]', '', 'g'))"
_LETTERS, _SYMBOLS = count_sql("x", r"\p{L}"), count_sql("x", r"[#$%&*+/<=>@\\^_`{|}~]")


@query(
    rf"""SELECT doc_id, line_no, regexp_matches(x, '[a-z]') AND NOT regexp_matches(x, '^[ \t]*([#>|$]|```|import |def |class |//|[{{}}])') AND len(regexp_extract_all(x, '[A-Za-z][A-Za-z''-]*')) >= 4
      AND {ratio_sql(_LETTERS, _SOLID)} >= 0.6 AND {ratio_sql(_SYMBOLS, _SOLID)} <= 0.04 AS prose
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"""
)
def prose_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "x")).select("doc_id", "line_no", rewrite.is_prose_line(F.col("x")).alias("prose"))


@query()
def rewrite_pairs(spark, sf):
    """Corrupted texts with the originals, seeded by document."""
    return rewrite.corrupted_pairs(heavy(spark, sf, "documents"), "doc_id", "text")


@query()
def rewrite_report(spark, sf):
    return rewrite.task_report(rewrite_pairs(spark, sf))


_CODES = "list_transform(string_split({}, ''), lambda c: unicode(c) + 1000)"


@query(
    f"""SELECT doc_id, CASE WHEN length(t) < 4 THEN 'too_short' WHEN length(t) + 1 > 512 THEN 'too_long' WHEN s IS NULL THEN 'not_prose' WHEN length(s) + 4 > 512 THEN 'too_long' END AS skipped,
      CASE WHEN length(t) BETWEEN 4 AND 508 AND s IS NOT NULL THEN array_to_string([{X.STYLE}, {X.OPEN}] || {_CODES.format('s')} || [{X.CLOSE}, {X.EOS}], ',') END AS encoder,
      CASE WHEN length(t) BETWEEN 4 AND 508 AND s IS NOT NULL THEN array_to_string({_CODES.format('t')} || [{X.EOS}], ',') END AS target
    FROM (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN length(trim(text)) > 0 THEN replace(text, 'e', 'E') END AS s FROM documents)"""
)
def framed_rewrites(spark, sf):
    """Framed pairs of a text with its letters e raised (a change that keeps lengths) and the text, one token per character."""
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.length(F.trim("text")) > 0, F.replace("text", F.lit("e"), F.lit("E"))).alias("source"), F.col("text").alias("target"))
    chars = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x) + 1000)
    framed = rewrite.framed_pairs(docs, "doc_id", chars)
    return framed.select("doc_id", "skipped", F.array_join("example.encoder", ",").alias("encoder"), F.array_join("example.target", ",").alias("target"))
