"""Discovery, records, lines, pipeline counters, personal data in the reference's sense."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import audit, clean, dedup, pii, quality
from loomtext.queries.cleaning import strip_sql
from loomtext.queries.registry import heavy, query, table
from loomtext.sources import records

SRC = "lower(trim(source))"


@query("SELECT DISTINCT shard_path, split_part(replace(shard_path, 'shards/', ''), '/', 1) AS directory, regexp_replace(regexp_replace(shard_path, '^.*/', ''), '\\.(jsonl|json|txt)$', '') AS file FROM scan_stats WHERE shard_path IS NOT NULL")
def source_labels(spark, sf):
    """Labels of shard files by directory and by name."""
    p = F.col("shard_path")
    return table(spark, sf, "scan_stats").filter("shard_path is not null").select("shard_path", records.directory_label(p, "shards").alias("directory"), records.file_label(p).alias("file")).distinct()


@query("SELECT key, CASE WHEN cut = '' THEN key ELSE cut END AS label, count(*) AS reports FROM (SELECT k AS key, regexp_replace(k, '(?i)_\\d+(\\.\\d+)?mb$', '') AS cut FROM (SELECT unnest(map_keys(per_source)) AS k FROM scan_stats)) GROUP BY ALL")
def size_suffix_labels(spark, sf):
    """Labels of file names that may end in their size."""
    keys = table(spark, sf, "scan_stats").select(F.explode(F.map_keys("per_source")).alias("key"))
    return keys.groupBy("key", records.file_label(F.col("key")).alias("label")).agg(F.count(F.lit(1)).alias("reports"))


@query("SELECT split_part(replace(shard_path, 'shards/', ''), '/', 1) AS source, count(DISTINCT shard_path) AS files, min(shard_path) AS first_file FROM scan_stats WHERE shard_path IS NOT NULL GROUP BY 1")
def files_by_source(spark, sf):
    return records.files_by_source(table(spark, sf, "scan_stats"), "shard_path", "shards")


_RAW = """CASE WHEN text IS NULL THEN '{"text": null}' WHEN line_no % 11 = 1 THEN '{"text": 5}' WHEN line_no % 11 = 2 THEN '[1, 2]' WHEN line_no % 11 = 3 THEN '{"text": "cut' WHEN line_no % 11 = 4 THEN '{"other": "x"}' ELSE '{"text": "' || {T} || '"}' END"""


@query(
    f"""WITH raw AS (SELECT chunk_id, loaded_at, {_RAW.replace('{T}', "regexp_replace(text, '[^A-Za-z0-9 .,]', '', 'g')")} AS line FROM budget_writer)
    SELECT chunk_id, loaded_at, CASE WHEN NOT json_valid(line) OR json_type(line) <> 'OBJECT' THEN 'bad_json' WHEN json_type(line, '$.text') = 'VARCHAR' AND {strip_sql("json_extract_string(line, '$.text')")} <> '' THEN 'ok' ELSE 'missing_text' END AS status,
      coalesce(length(CASE WHEN json_valid(line) AND json_type(line, '$.text') = 'VARCHAR' AND {strip_sql("json_extract_string(line, '$.text')")} <> '' THEN json_extract_string(line, '$.text') END), 0) AS n_chars FROM raw"""
)
def scan_status(spark, sf):
    """What a scan makes of raw lines: chunks as JSON, some of them broken in different ways."""
    raw = F.expr(_RAW.replace("{T}", "regexp_replace(text, '[^A-Za-z0-9 .,]', '')"))
    scanned = table(spark, sf, "budget_writer").select("chunk_id", "loaded_at", records.scan_json(raw).alias("r"))
    return scanned.select("chunk_id", "loaded_at", F.col("r.status").alias("status"), F.coalesce(F.length("r.text"), F.lit(0)).alias("n_chars"))


_LINES = f"""l AS (SELECT {SRC} AS source, regexp_replace(x, '\r$', '') AS line FROM (SELECT source, unnest(string_split(text, chr(10))) AS x FROM documents)),
    s AS (SELECT source, strlen(line) AS n_bytes, CASE WHEN {strip_sql('line')} = '' THEN 'empty' WHEN strlen(line) > 400 THEN 'oversized' ELSE 'eligible' END AS state FROM l)"""
_STATS = "count(*) FILTER (state = 'eligible') AS eligible, count(*) FILTER (state = 'empty') AS empty, count(*) FILTER (state = 'oversized') AS oversized, coalesce(sum(n_bytes) FILTER (state = 'eligible'), 0)::BIGINT AS bytes, round(CASE WHEN count(*) FILTER (state <> 'empty') > 0 THEN count(*) FILTER (state = 'oversized') / count(*) FILTER (state <> 'empty')::DOUBLE ELSE 0 END, 6) AS drop_fraction"


def _lines(spark, sf):
    docs = table(spark, sf, "documents").withColumn("source", F.lower(F.trim("source")))
    return records.eligible_lines(docs, ["source", "doc_id"], limit=400)


@query(f"WITH {_LINES} SELECT source, {_STATS} FROM s GROUP BY source")
def eligible_lines(spark, sf):
    """Lines and bytes per source, and what was dropped."""
    return records.line_stats(_lines(spark, sf), ["source"])


@query(f"WITH {_LINES} SELECT 'all' AS scope, {_STATS} FROM s")
def drop_fraction(spark, sf):
    return records.line_stats(_lines(spark, sf).withColumn("scope", F.lit("all")), ["scope"])


@query(f"SELECT doc_id, line_no, line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, {strip_sql('unnest(string_split(text, chr(10)))')} AS line FROM documents) WHERE line <> ''")
def line_iteration(spark, sf):
    return records.trimmed_lines(table(spark, sf, "documents"), ["doc_id"])


@query("SELECT s.source_id, CASE WHEN needs_token THEN o.open ELSE s.source_id END AS used_source FROM source_spec s LEFT JOIN (SELECT kind, min(source_id) AS open FROM source_spec WHERE NOT needs_token GROUP BY kind) o USING (kind)")
def source_registry(spark, sf):
    """The source that is used when no token is there."""
    return records.registry(table(spark, sf, "source_spec")).select("source_id", "used_source")


@query("SELECT source_id, row_number() OVER (ORDER BY source_id = 'web_lantern', CASE kind WHEN 'stackexchange' THEN 0 WHEN 'git_cheat' THEN 2 WHEN 'man_pages' THEN 2 ELSE 1 END, shuffle_buffer, source_id)::INT AS rank FROM source_spec WHERE kind <> 'git_nl2bash'")
def site_order(spark, sf):
    return records.site_order(table(spark, sf, "source_spec"), "source_id", "kind", "shuffle_buffer", "web_lantern", ("git_nl2bash",)).select("source_id", "rank")


@query("SELECT source_id, shuffle_buffer FROM source_spec SEMI JOIN slice_budget USING (source_id) ORDER BY shuffle_buffer, source_id")
def allowed_sites(spark, sf):
    """Sites of an allow-list, by size and name."""
    return records.allowed(table(spark, sf, "source_spec"), table(spark, sf, "slice_budget"), "source_id", ["shuffle_buffer", "source_id"]).select("source_id", "shuffle_buffer")


@query(f"SELECT a.doc_id, a.text || chr(10) || b.text AS pair FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE {strip_sql('a.text')} <> '' AND {strip_sql('b.text')} <> ''")
def aligned_pairs(spark, sf):
    """Documents joined with the one at the next position."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return records.aligned_pairs(docs, docs.withColumn("doc_id", F.col("doc_id") - 1), ["doc_id"])


@query(f"SELECT {SRC} AS source, domain, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def first_seen(spark, sf):
    return records.first_seen(table(spark, sf, "documents"), {"source": F.lower(F.trim("source")), "domain": F.col("domain")}, "doc_id")


@query("SELECT suite, count(*) AS items, sum(length(text))::BIGINT AS chars FROM eval_items WHERE text IS NOT NULL GROUP BY suite")
def eval_records(spark, sf):
    return records.items_by_suite(table(spark, sf, "eval_items"), "suite", "text")


@query(f"SELECT {SRC} AS source, shard_index, count(*) AS lines FROM (SELECT DISTINCT chunk_id, source_id AS source, shard_index FROM budget_writer) GROUP BY ALL")
def shards_per_source(spark, sf):
    return records.shards_per_source(table(spark, sf, "budget_writer"), "chunk_id", "source_id", "shard_index")


@query()
def pipeline_counters(spark, sf):
    """Records in, chunks made, and what each stage dropped, per source."""
    docs = heavy(spark, sf, "documents").withColumn("source", F.lower(F.trim("source")))
    chunks = clean.clean_records(docs, "doc_id", "text").join(docs.select("doc_id", "source"), "doc_id").withColumn("pos", F.struct("doc_id", "chunk_no"))
    verdict = dedup.two_stage(chunks.select("pos", "text"), "pos")
    marked = chunks.join(verdict, "pos").select("source", "doc_id", (quality.assess(F.col("text")) == "keep").alias("good"), "verdict")
    by_chunk = marked.groupBy("source").agg(
        F.countDistinct("doc_id").alias("with_chunks"), F.count(F.lit(1)).alias("chunks_produced"), F.count(F.when(~F.col("good"), 1)).alias("dropped_quality"),
        F.count(F.when(F.col("good") & (F.col("verdict") != "keep"), 1)).alias("dropped_duplicate"), F.count(F.when(F.col("good") & (F.col("verdict") == "keep"), 1)).alias("emitted"),
    )
    total = docs.groupBy("source").agg(F.count(F.lit(1)).alias("records_in"))
    return total.join(by_chunk, "source", "left").select(
        "source", "records_in", (F.col("records_in") - F.coalesce("with_chunks", F.lit(0))).alias("empty_after_clean"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks_produced", "dropped_quality", "dropped_duplicate", "emitted")]
    )


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{pii.EMAIL_SIMPLE}')) AS emails, len(regexp_extract_all(text, '{pii.MENTION_SIMPLE}')) AS mentions FROM documents WHERE text IS NOT NULL")
def email_hits(spark, sf):
    """Addresses and handles by patterns that need no look-around."""
    t = F.col("text")
    count = lambda p: F.regexp_count(t, F.lit(p))
    return table(spark, sf, "documents").filter(t.isNotNull()).select("doc_id", count(pii.EMAIL_SIMPLE).alias("emails"), count(pii.MENTION_SIMPLE).alias("mentions"))


@query()
def mask_documents(spark, sf):
    """Texts with addresses, handles and phone numbers replaced by invented ones, and the counters."""
    return pii.mask_documents(heavy(spark, sf, "budget_writer").select("chunk_id", "text").dropDuplicates(["chunk_id"]), "chunk_id", "text")


@query()
def mask_counters(spark, sf):
    masked = mask_documents(spark, sf)
    return masked.agg(F.count(F.lit(1)).alias("documents"), *[F.sum(c).alias(c) for c in ("emails", "mentions", "phones")])


@query("SELECT count(DISTINCT chunk_id) AS chunks, 0::BIGINT AS repeated_emails, 0::BIGINT AS repeated_handles, true AS any_issued FROM budget_writer")
def issued_identities(spark, sf):
    """Masking of every chunk: addresses and handles that two chunks were both given (none), out of all that were given out."""
    shapes = {"email": r"[a-z._]+[0-9]*@(?:" + "|".join(d.replace(".", "[.]") for d in pii.Allocator.domains) + ")", "handle": r"(?<![A-Za-z0-9_@.])@[A-Za-z_.]+[0-9]*"}
    old = table(spark, sf, "budget_writer").select("chunk_id", F.col("text").alias("old")).dropDuplicates(["chunk_id"])
    both = mask_documents(spark, sf).select("chunk_id", F.coalesce("text", F.lit("")).alias("new")).join(old.withColumn("old", F.coalesce("old", F.lit(""))), "chunk_id")
    # what stood in a text before was not given out
    given = lambda p: F.array_except(F.regexp_extract_all("new", F.lit(p), F.lit(0)), F.regexp_extract_all("old", F.lit(p), F.lit(0)))
    tag = lambda k: lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    by_value = both.select("chunk_id", F.explode(F.concat(*[F.transform(given(p), tag(k)) for k, p in shapes.items()])).alias("i")).groupBy("i.kind", "i.value").agg(F.count(F.lit(1)).alias("n"))
    repeated = lambda k: F.count(F.when((F.col("kind") == k) & (F.col("n") > 1), 1)).alias(f"repeated_{k}s")
    found = by_value.agg(repeated("email"), repeated("handle"), (F.count(F.lit(1)) > 0).alias("any_issued"))
    return old.agg(F.count(F.lit(1)).alias("chunks")).crossJoin(found)  # one row each


_A = pii.Allocator()
_LIST = lambda xs: "[" + ",".join(f"'{x}'" for x in xs) + "]"
_CAPITAL = lambda x: f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"
_FIRST, _LAST = f"{_LIST(_A.first)}[({{x}} // {len(_A.last)} + 1)::INT]", f"{_LIST(_A.last)}[({{x}} % {len(_A.last)} + 1)::INT]"


def _shape_sql(x: str, styles: list[str]) -> str:
    """The SQL of one of the shapes of an identity whose scrambled number is ``x``."""
    suffix, style, people = f"({x} % {_A.suffixes})", f"({x} // {_A.suffixes} % {len(styles)})", f"({x} // {_A.suffixes * len(styles)})"
    f, n = _FIRST.format(x=people), _LAST.format(x=people)
    names = {"f": f, "l": n, "a": f"substr({f}, 1, 1)", "b": f"substr({n}, 1, 1)"}
    names |= {k.upper(): _CAPITAL(v) for k, v in names.items()}
    shapes = [" || ".join(names[p[1]] if p[0] == "{" else f"'{p}'" for p in re.findall(r"\{\w\}|[^{}]+", shape)) for shape in styles]
    return f"(CASE {style} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(shapes)) + f" END || CASE WHEN {suffix} = 0 THEN '' ELSE {suffix}::VARCHAR END)"


_SCR = lambda n: f"(range % {n} * {_A.multiplier} + {_A.offset}) % {n}"


@query(
    f"""WITH s AS (SELECT range AS id, {_SCR(_A.size)} AS x, {_SCR(_A.handles)} AS y, {_SCR(_A.names)} AS z FROM range(0, 2000))
    SELECT id, {_CAPITAL(_FIRST.format(x='z'))} || ' ' || {_CAPITAL(_LAST.format(x='z'))} AS name, {_shape_sql(f'(x // {len(_A.domains)})', _A.email_styles)} || '@' || {_LIST(_A.domains)}[(x % {len(_A.domains)} + 1)::INT] AS email,
      '@' || {_shape_sql('y', _A.handle_styles)} AS handle FROM s"""
)
def pii_identity(spark, sf):
    """The first two thousand invented identities: an injection from numbers."""
    return pii.identities(spark.range(2000), "id").select("id", "name", "email", "handle")


@query("SELECT range AS id, lpad((range * 862933 + 442695) % 1000000 || '', 6, '0') AS digits FROM range(0, 2000)")
def phone_digits(spark, sf):
    """Six digits per number, without a collision below a million."""
    return spark.range(2000).select("id", pii.phone_digits(F.col("id"), 6).alias("digits"))


@query(f"SELECT {SRC} AS source, count(*) AS wanted, (sum(count(*)) OVER (ORDER BY {SRC}) - count(*))::BIGINT AS first_index FROM documents GROUP BY 1")
def index_reservation(spark, sf):
    """Disjoint ranges of identity numbers per source."""
    n = table(spark, sf, "documents").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("wanted"))
    return pii.reserve(n, "source", "wanted")


@query("SELECT range AS id FROM range(0, 500) WHERE range NOT IN (SELECT doc_id FROM token_counts WHERE doc_id IS NOT NULL)")
def reserved_blocklist(spark, sf):
    """Candidate numbers that are not reserved already."""
    taken = table(spark, sf, "token_counts").select(F.col("doc_id").alias("id"))
    return spark.range(500).join(taken, "id", "left_anti")
