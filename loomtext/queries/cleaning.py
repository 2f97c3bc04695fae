"""Cleaning, quality, duplicates, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.functions.lexicon import ALT_PLACEHOLDER, BOILERPLATE_LINES, BOILERPLATE_PHRASES, STOPWORDS
from loomtext.operators import audit, clean, dedup, quality
from loomtext.queries.registry import heavy, query, table

# ------------------------------------------------------------------ the same definitions in SQL
SP = r"[ \t\r\n\f\x0b]"
STOP_SQL = "[" + ",".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS) + "]"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def count_sql(x: str, cls: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{cls}', '', 'g')))"


def ratio_sql(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {a} / ({b})::DOUBLE ELSE 0.0 END)"


def tokens_sql(x: str) -> str:
    return rf"regexp_extract_all({x}, '[^ \t\r\n\f\x0b]+')"


BOILER_SQL = "'^(?:" + "|".join(BOILERPLATE_LINES).replace("'", "''") + ")'"
LATIN_SQL = ratio_sql(count_sql("t", "[A-Za-z]"), count_sql("t", r"\p{L}"))
WORDS_SQL = "list_filter(regexp_extract_all(lower(t), '[a-z'']+'), lambda w: length(w) >= 2)"
STOP_RATIO_SQL = ratio_sql(f"len(list_filter({WORDS_SQL}, lambda w: list_contains({STOP_SQL}, w)))", f"len({WORDS_SQL})")
LINES_SQL = f"list_filter(list_transform(string_split(t, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')"
REPEAT_SQL = f"(CASE WHEN len({LINES_SQL}) > 4 THEN 1 - len(list_distinct({LINES_SQL})) / len({LINES_SQL})::DOUBLE ELSE 0.0 END)"
HITS_SQL = "(" + " + ".join(f"contains(lower(t), '{p}')::INT" for p in BOILERPLATE_PHRASES) + ")"
HIT_SQL = f"({HITS_SQL} >= 2 OR ({HITS_SQL} >= 1 AND length(t) < 600))"
FOLD_SQL = strip_sql(rf"regexp_replace(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}_ \t\r\n]+', '', 'g'), '{SP}+', ' ', 'g')")
SHORT_LINES = f"list_filter({LINES_SQL}, lambda x: len({tokens_sql('x')}) <= 6 AND NOT regexp_matches(x, '[.!?:;…\"'')]$'))"
SHARE_SQL = f"(CASE WHEN len({LINES_SQL}) >= 5 THEN {ratio_sql(f'coalesce(list_sum(list_transform({SHORT_LINES}, lambda x: length(x))), 0)', f'list_sum(list_transform({LINES_SQL}, lambda x: length(x)))')} ELSE 0.0 END)"
HEAD_SQL = "split_part(lower(trim(coalesce(source, ''))), '_', 1)"
CLASS_SQL = f"(CASE {HEAD_SQL} WHEN 'code' THEN 'code' WHEN 'cli' THEN 'code' WHEN 'qa' THEN 'qa' WHEN 'forum' THEN 'qa' WHEN 'lit' THEN 'verse' ELSE 'prose' END)"


def assess_sql(q: quality.Thresholds) -> str:
    tok = tokens_sql("t")
    mean = ratio_sql(f"list_sum(list_transform({tok}, lambda x: length(x)))", f"len({tok})")
    return f"""(CASE WHEN len({tok}) < {q.min_tokens} THEN 'too_short' WHEN len({tok}) > {q.max_tokens} THEN 'too_long'
        WHEN {mean} < {q.min_mean_word} THEN 'mean_word_length_low' WHEN {mean} > {q.max_mean_word} THEN 'mean_word_length_high'
        WHEN {ratio_sql(count_sql("t", r"[\p{L} \t\r\n]"), "length(t)")} < {q.min_text_share} THEN 'symbol_soup'
        WHEN {ratio_sql(count_sql("t", "[0-9]"), "length(t)")} > {q.max_digit_share} THEN 'mostly_digits'
        WHEN {REPEAT_SQL} > {q.max_repeated_lines} THEN 'repeated_lines' WHEN {LATIN_SQL} < {q.min_latin} THEN 'not_latin_script'
        WHEN {STOP_RATIO_SQL} < {q.min_stopwords} THEN 'not_english_prose' ELSE 'keep' END)"""


#: Sources of the tables whose language is judged more strictly, a question source among them.
STRICT_SOURCES = (*quality.LANGUAGE_STRICT, "web_lantern", "web_juniper", "synth_primer", "qa_orchard")
_NAMED = "lower(trim(coalesce(source, ''))) IN (" + ", ".join(f"'{x}'" for x in STRICT_SOURCES) + ")"
STRICT_SQL = f"""(CASE WHEN {CLASS_SQL} = 'qa' AND {_NAMED} THEN {assess_sql(quality.QA_STRICT)} WHEN {CLASS_SQL} = 'qa' THEN {assess_sql(quality.Thresholds())}
    WHEN {_NAMED} THEN {assess_sql(quality.STRICT)} ELSE {assess_sql(quality.SHARES)} END)"""
DOCS = "(SELECT *, text AS t FROM documents)"
FILLED = "(SELECT * EXCLUDE (text), coalesce(text, '') AS t, text FROM documents)"
# most frequent run of four tokens, per document
SPAM_CTE = f"""tok AS (SELECT doc_id, list_transform(regexp_extract_all(t, '[A-Za-z'']+'), lambda x: lower(x)) AS w FROM {FILLED}),
    gram AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) AS g FROM tok WHERE len(w) >= 40),
    top AS (SELECT doc_id, max(n) / sum(n)::DOUBLE AS share FROM (SELECT doc_id, g, count(*) AS n FROM gram GROUP BY ALL) GROUP BY doc_id),
    spam AS (SELECT doc_id, coalesce(share > 0.12, false) AS hit FROM tok LEFT JOIN top USING (doc_id))"""


@query(rf"SELECT doc_id, regexp_replace(t, '(?i)(!\[)[^\]]*{ALT_PLACEHOLDER}[^\]]*(\])', '\1\2', 'g') AS text FROM {DOCS}")
def blank_alt_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.blank_alt(F.col("text")).alias("text"))


_WS = strip_sql(r"regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[ \t]{3,}\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


@query(f"SELECT chunk_id, loaded_at, {_WS} AS text FROM (SELECT *, text AS t FROM budget_writer)")
def normalize_whitespace(spark, sf):
    return table(spark, sf, "budget_writer").select("chunk_id", "loaded_at", T.normalize_whitespace(F.col("text")).alias("text"))


@query(f"SELECT doc_id, line_no, {strip_sql('x')} = '' OR regexp_matches({strip_sql('x')}, {BOILER_SQL}) AS boilerplate FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)")
def boilerplate_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "x")).select("doc_id", "line_no", T.is_boilerplate(F.col("x")).alias("boilerplate"))


@query(f"SELECT doc_id, array_to_string({LINES_SQL}, chr(10)) AS text FROM {DOCS}")
def record_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.join_record_lines(F.col("text")).alias("text"))


@query("SELECT doc_id, replace(replace(text, chr(57344), chr(57344) || chr(57344)), chr(9601), chr(57344) || chr(57345)) AS escaped, text AS restored FROM documents")
def marker_escape(spark, sf):
    """Escape and its inverse: the restored text must be the text."""
    docs = table(spark, sf, "documents").select("doc_id", "text", T.escape_markers(F.col("text")).alias("escaped"))
    return docs.select("doc_id", "escaped", T.unescape_markers(F.col("escaped")).alias("restored"))


_ENT = "regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _a, _b in T.ENTITIES.items():
    _ENT = "replace({}, '{}', '{}')".format(_ENT, _a, _b.replace("'", "''"))


@query(f"SELECT doc_id, {_ENT} AS text FROM {DOCS}")
def strip_html(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.strip_html(F.col("text")).alias("text"))


@query()
def clean_chunks(spark, sf):
    """Cleaned chunks of every document."""
    return clean.clean_records(heavy(spark, sf, "documents"), "doc_id", "text")


@query("SELECT doc_id, sha256(text) AS exact_key, sha256(" + FOLD_SQL + f") AS folded_key FROM {DOCS}")
def dedup_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.exact_key(F.col("text")).alias("exact_key"), T.folded_key(F.col("text")).alias("folded_key"))


@query(f"SELECT doc_id, round({LATIN_SQL}, 6) AS latin, round({STOP_RATIO_SQL}, 6) AS stopword, {LATIN_SQL} >= 0.7 AND {STOP_RATIO_SQL} >= 0.06 AS english FROM {FILLED}")
def english_ratios(spark, sf):
    """Letter and function-word ratios and the English predicate; null counts as empty."""
    t = F.coalesce("text", F.lit(""))
    latin, stop = T.latin_ratio(t), T.stopword_ratio(t)
    return heavy(spark, sf, "documents").select("doc_id", F.round(latin, 6).alias("latin"), F.round(stop, 6).alias("stopword"), ((latin >= 0.7) & (stop >= 0.06)).alias("english"))


@query(f"SELECT doc_id, {assess_sql(quality.Thresholds())} AS reason FROM {FILLED}")
def assess_reason(spark, sf):
    return heavy(spark, sf, "documents").select("doc_id", quality.assess(F.col("text")).alias("reason"))


@query(f"SELECT lower(trim(source)) AS source, {assess_sql(quality.Thresholds())} AS reason, count(*) AS n FROM {FILLED} GROUP BY ALL")
def quality_tally(spark, sf):
    docs = heavy(spark, sf, "documents").withColumn("source", F.lower(F.trim("source")))
    return quality.tally(docs, quality.assess(F.col("text")))


@query(f"SELECT doc_id, {CLASS_SQL} AS kind, {STRICT_SQL} AS reason FROM {FILLED}")
def strict_assess(spark, sf):
    return heavy(spark, sf, "documents").select("doc_id", quality.source_class(F.col("source")).alias("kind"), quality.strict_assess(F.col("text"), F.col("source"), STRICT_SOURCES).alias("reason"))


@query(f"SELECT doc_id, {HITS_SQL}::INT AS hits, {HIT_SQL} AS hit FROM {FILLED}")
def boilerplate_phrases(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", T.boilerplate_hits(t).alias("hits"), T.boilerplate_phrase_hit(t).alias("hit"))


@query(f"WITH {SPAM_CTE} SELECT doc_id, hit FROM spam")
def ngram_spam(spark, sf):
    return heavy(spark, sf, "documents").select("doc_id", T.ngram_spam(F.coalesce("text", F.lit(""))).alias("hit"))


@query(f"SELECT doc_id, round({SHARE_SQL}, 6) AS share FROM {FILLED}")
def layout_short_share(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(T.layout_short_share(F.coalesce("text", F.lit(""))), 6).alias("share"))


_TOK = tokens_sql("t")
_PUNCT = quality.SPAM_PUNCT.replace("'", "''")


@query(
    rf"""
    SELECT doc_id,
      kind NOT IN ('code', 'qa') AND kind <> 'verse' AND len(w) >= 30 AND NOT contains(t, '```') AND share >= 0.5 AS nonprose_layout,
      kind NOT IN ('code', 'qa') AND len(w) >= 200 AND regexp_matches(t, '[a-z]$') AND NOT regexp_matches(right(t, 200), '[.!?…]') AS nonprose_tail,
      kind NOT IN ('code', 'qa') AND len(w) >= 100 AND NOT regexp_matches(t, '[.!?…]') AS no_sentence_punct,
      kind NOT IN ('code', 'qa') AND urls >= 8 AND urls * 20 >= len(w) AS link_farm,
      kind <> 'code' AND len(w) >= 120 AND len(list_distinct(list_transform(w, lambda x: lower(x)))) / greatest(len(w), 1)::DOUBLE <= 0.22 AND len(regexp_extract_all(t, '\\[a-z]+')) < 10 AS low_lexical_diversity,
      kind <> 'code' AND len(w) >= 40 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]{{2,}}[^a-z]*$'))) / greatest(len(w), 1)::DOUBLE >= 0.5 AS all_caps,
      kind <> 'code' AND {count_sql("t", chr(0xFFFD))} >= 3 AS replacement_chars,
      kind <> 'code' AND regexp_matches(t, '{_PUNCT}') AS spam_punctuation
    FROM (SELECT doc_id, t, {CLASS_SQL} AS kind, {_TOK} AS w, {SHARE_SQL} AS share, len(regexp_extract_all(t, 'https?://')) AS urls FROM {FILLED})
    """
)
def structural_rules(spark, sf):
    rules = quality.structural_rules(F.col("text"), F.col("source"))
    return heavy(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in rules.items()])


_DUP_CTE = f"""dup AS (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 OR row_number() OVER (PARTITION BY fold ORDER BY doc_id) > 1 AS dup
    FROM (SELECT doc_id, text, {FOLD_SQL} AS fold FROM {DOCS} WHERE text IS NOT NULL))"""
_BITS = f"""bits AS (
    SELECT d.doc_id, lower(trim(d.source)) AS source, length(d.text) AS n_chars,
      (CASE WHEN empty THEN 1 ELSE 0 END
       + CASE WHEN NOT empty AND kind NOT IN ('code', 'qa') THEN CASE reason {' '.join(f"WHEN '{r}' THEN {1 << k}" for k, r in enumerate(quality.PASS1) if 0 < k < 10)} ELSE 0 END ELSE 0 END
       + CASE WHEN NOT empty AND kind NOT IN ('code', 'qa') AND phrase THEN 1024 ELSE 0 END + CASE WHEN NOT empty AND kind <> 'code' AND spam.hit THEN 2048 ELSE 0 END + CASE WHEN coalesce(dup.dup, false) THEN 4096 ELSE 0 END)::INT AS bits
    FROM (SELECT *, {CLASS_SQL} AS kind, {STRICT_SQL} AS reason, {HIT_SQL} AS phrase, {strip_sql("t")} = '' AS empty FROM {FILLED}) d JOIN spam USING (doc_id) LEFT JOIN dup USING (doc_id))"""
AUDIT_CTE = f"WITH {SPAM_CTE}, {_DUP_CTE}, {_BITS}"
_NAMES = "[" + ",".join(f"'{n}'" for n in quality.PASS1) + "]"
REASONS_CTE = f"{AUDIT_CTE}, reasons AS (SELECT doc_id, source, bits, unnest(list_filter(list_transform(range(0, 13), lambda k: CASE WHEN (bits >> k) & 1 = 1 THEN {_NAMES}[k + 1] END), lambda x: x IS NOT NULL)) AS reason FROM bits)"


@query(f"{AUDIT_CTE} SELECT doc_id, bits FROM bits")
def reason_bits(spark, sf):
    return audit.pass1(heavy(spark, sf, "documents"), STRICT_SOURCES).select("doc_id", "bits")


@query(f"{AUDIT_CTE} SELECT source, count(*) AS lines, count(*) FILTER (bits = 0) AS kept, count(*) FILTER (bits <> 0) AS moved FROM bits GROUP BY source")
def audit_route(spark, sf):
    """Kept and moved documents per source: the flagship."""
    return audit.route_counts(audit.pass1(heavy(spark, sf, "documents"), STRICT_SOURCES))


@query(f"{REASONS_CTE} SELECT source, reason, count(*) AS n, grouping(source)::INT * 2 + grouping(reason)::INT AS level FROM reasons GROUP BY GROUPING SETS ((source, reason), (source), (reason), ())")
def audit_report_sets(spark, sf):
    return audit.report(audit.pass1(heavy(spark, sf, "documents"), STRICT_SOURCES))


@query(f"{REASONS_CTE} SELECT reason, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS rn FROM reasons) WHERE rn <= 5")
def audit_samples(spark, sf):
    """The first five documents of every reason."""
    return audit.samples(audit.pass1(heavy(spark, sf, "documents"), STRICT_SOURCES), 5).select("reason", "doc_id")


@query("SELECT doc_id AS pos, CASE WHEN rn > 1 THEN 'exact' WHEN rn2 > 1 THEN 'near' ELSE 'keep' END AS verdict FROM (SELECT *, CASE WHEN rn = 1 THEN row_number() OVER (PARTITION BY fold, rn = 1 ORDER BY doc_id) END AS rn2 FROM (SELECT doc_id, text, " + FOLD_SQL + f" AS fold, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM {DOCS} WHERE text IS NOT NULL))")
def dedup_two_stage(spark, sf):
    return dedup.two_stage(table(spark, sf, "documents"))


@query(f"WITH {_DUP_CTE} SELECT doc_id AS pos, coalesce(dup, false) AS is_duplicate FROM documents LEFT JOIN dup USING (doc_id)")
def corpus_duplicates(spark, sf):
    return dedup.corpus_duplicates(table(spark, sf, "documents"))


@query("WITH v AS (SELECT count(*) AS records, count(*) FILTER (verdict = 'exact') AS dropped_exact, count(*) FILTER (verdict = 'near') AS dropped_near, count(*) FILTER (verdict = 'keep') AS kept FROM (SELECT CASE WHEN rn > 1 THEN 'exact' WHEN rn2 > 1 THEN 'near' ELSE 'keep' END AS verdict FROM (SELECT *, CASE WHEN rn = 1 THEN row_number() OVER (PARTITION BY fold, rn = 1 ORDER BY doc_id) END AS rn2 FROM (SELECT doc_id, text, " + FOLD_SQL + f" AS fold, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM {DOCS} WHERE text IS NOT NULL)))) SELECT * FROM v")
def dedup_report(spark, sf):
    v = dedup.two_stage(table(spark, sf, "documents"))
    of = lambda x: F.count(F.when(F.col("verdict") == x, 1))
    return v.agg(F.count(F.lit(1)).alias("records"), of("exact").alias("dropped_exact"), of("near").alias("dropped_near"), of("keep").alias("kept"))


_D = "(('0x' || substr(sha256('{}:' || k), 1, 15))::BIGINT)"


@query(
    f"""
    WITH k AS (SELECT DISTINCT sha256(text) AS k FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS items, greatest(64, 8 * count(*)) AS bits FROM k),
    p AS (SELECT DISTINCT ({_D.format('a')} % bits + i * ({_D.format('b')} % (bits - 1) + 1)) % bits AS p FROM k, n, range(0, 5) r(i)), s AS (SELECT count(*) AS bits_set FROM p)
    SELECT items, bits, bits_set, round(bits_set / bits::DOUBLE, 6) AS fill, round(pow(bits_set / bits::DOUBLE, 5), 6) AS fpr FROM n, s
    """
)
def bloom_fpr(spark, sf):
    return dedup.bloom_figures(table(spark, sf, "documents"), "text")


@query("SELECT lower(trim(source)) AS source, sum(octet_length(encode(text)))::BIGINT AS bytes, greatest(ceil(sum(octet_length(encode(text))) / 1200.0), 1000)::BIGINT AS expected FROM documents GROUP BY 1")
def dedup_sizing(spark, sf):
    by = table(spark, sf, "documents").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum(F.octet_length("text")).alias("bytes"))
    return by.select("source", "bytes", F.coalesce(dedup.filter_size(F.col("bytes")), F.lit(1000)).cast("long").alias("expected"))


_PERMS = ", ".join(f"({k // dedup.ROWS}, {k % dedup.ROWS}, {a}, {b})" for k, (a, b) in enumerate(dedup.PERMS))
BANDS_CTE = f"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents WHERE text IS NOT NULL),
    g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM w WHERE len(w) >= 5),
    h AS (SELECT doc_id, unnest(g) AS x FROM g WHERE len(g) >= 20), hh AS (SELECT doc_id, ('0x' || substr(sha256(x), 1, 7))::BIGINT AS h FROM h),
    m AS (SELECT doc_id, band_no, r, min((h * a + b) % {dedup.PRIME}) AS low FROM hh, (VALUES {_PERMS}) p(band_no, r, a, b) GROUP BY ALL),
    bands AS (SELECT doc_id AS pos, band_no, substr(sha256(string_agg(low, ',' ORDER BY r)), 1, 16) AS band_hash FROM m GROUP BY ALL)"""


@query(f"WITH {BANDS_CTE} SELECT pos, band_no, band_hash FROM bands")
def minhash_bands(spark, sf):
    return dedup.minhash_bands(heavy(spark, sf, "documents"))


@query(f"WITH {BANDS_CTE} SELECT pos, bool_or(rn > 1) AS is_near_duplicate FROM (SELECT pos, row_number() OVER (PARTITION BY band_no, band_hash ORDER BY pos) AS rn FROM bands) GROUP BY pos")
def near_duplicates(spark, sf):
    return dedup.near_duplicates(dedup.minhash_bands(heavy(spark, sf, "documents")))


@query()
def pass2_bits(spark, sf):
    """Structural, tokenizer and near-duplicate reasons of every document."""
    return audit.pass2(heavy(spark, sf, "documents")).select("doc_id", "bits", "reasons")
