"""Readers and sinks: each query writes a form of its table to the shared folder and reads it back; SQL says what must come."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import pii
from loomtext.plans import corpus_build, lineage
from loomtext.queries.cleaning import strip_sql
from loomtext.queries.registry import query, table
from loomtext.queries.sampling import draw_sql
from loomtext.sources import formats, records, sinks

PLAIN = "regexp_replace(text, '[^A-Za-z0-9 .,]', '')"


def _folder(spark: SparkSession, name: str) -> str:
    path = f"{lineage.shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    lineage._written.append(path)
    return path


def _jsonl(df: DataFrame, path: str, *by: str) -> None:
    """One record {"text": ...} per line, in folders by the given columns."""
    lines = df.select(*by, F.to_json(F.struct("text")).alias("value"))
    (lines.write.partitionBy(*by) if by else lines.write).text(path)


@query("SELECT DISTINCT 'kind=' || split_part(source_id, '_', 1) AS label FROM source_spec WHERE split_part(source_id, '_', 1) <> 'code'")
def discovered_files(spark, sf):
    """Folders of corpus files found by suffix, one folder left out and files with other suffixes passed over."""
    path = _folder(spark, "discovery")
    spec = table(spark, sf, "source_spec").select(F.col("source_id").alias("text"), F.split_part("source_id", F.lit("_"), F.lit(1)).alias("kind"))
    _jsonl(spec, path, "kind")
    found = records.discover(spark, path, (".txt", ".json"), exclude="kind=code")
    return found.select(records.directory_label(F.col("path"), path.rsplit("/", 1)[-1]).alias("label")).distinct()


@query("SELECT item_id, suite, text FROM eval_items")
def strict_records(spark, sf):
    """Records read with an explicit schema; a bad line would be an error."""
    path = _folder(spark, "strict")
    items = table(spark, sf, "eval_items").select("item_id", "suite", "text")
    items.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return records.read_strict(spark, path, "item_id long, suite string, text string")


@query(f"SELECT doc_id, text IS NOT NULL AND {strip_sql('text')} <> '' AS kept, text <> '' AS kept_with_blanks FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def blank_records(spark, sf):
    """Records whose text is blank are missing, or only those whose text is empty."""
    line = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text")))
    docs = table(spark, sf, "documents").select("doc_id", line.alias("line"))
    ok = lambda blank: records.scan_json(F.col("line"), blank)["status"] == "ok"
    return docs.select("doc_id", ok(True).alias("kept"), ok(False).alias("kept_with_blanks"))


@query(f"SELECT {strip_sql('text')} AS text, count(*) AS n FROM documents WHERE text IS NOT NULL AND {strip_sql('text')} <> '' GROUP BY 1")
def jsonl_records(spark, sf):
    """Usable records of a folder of JSON lines."""
    path = _folder(spark, "jsonl")
    _jsonl(table(spark, sf, "documents").select("text"), path)
    return records.read_jsonl(spark, path).groupBy(T.strip(F.col("text")).alias("text")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {draw_sql(chr(39) + '23:' + chr(39) + ' || doc_id')}) - 1 AS place FROM documents WHERE {draw_sql(chr(39) + 'shard:' + chr(39) + ' || doc_id')} % 4 = 2")
def shuffled_shard(spark, sf):
    """One of four shards of the documents in an order that depends on the seed, and the place of each."""
    shard = records.shuffled(table(spark, sf, "documents").select("doc_id"), "doc_id", 23, 4, 2)
    # written in order, so that places can be read off
    path = _folder(spark, "shuffled")
    shard.withColumn("text", F.col("doc_id").cast("string")).coalesce(1).select("text").write.text(path)
    rows = spark.read.text(path).select(F.col("value").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place"))
    return rows


@query("SELECT shard, count(*) AS lines, sum(n)::BIGINT AS bytes FROM (SELECT n, (coalesce(sum(n) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 20000)::BIGINT AS shard, coalesce(sum(n) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT chunk_id, strlen(regexp_replace(any_value(text), '[^A-Za-z0-9 .,]', '', 'g')) + 12 AS n FROM budget_writer WHERE text IS NOT NULL GROUP BY chunk_id)) WHERE before < 100000 GROUP BY shard")
def written_shards(spark, sf):
    """Shards within a budget, written as JSON lines and counted as they lie in storage."""
    path = _folder(spark, "shards")
    chunks = table(spark, sf, "budget_writer").filter("text is not null").select("chunk_id", F.expr(PLAIN).alias("text")).dropDuplicates(["chunk_id"])
    sinks.write_shards(chunks, "chunk_id", "text", path, 100_000, 20_000)
    digests = sinks.shard_digests(spark, path)
    lines = spark.read.option("recursiveFileLookup", True).text(path).groupBy(F.regexp_extract(F.col("_metadata.file_path"), "/shard=([0-9]+)/", 1).cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("lines"))
    return lines.join(digests.groupBy("shard").agg(F.sum("bytes").alias("bytes")), "shard")


@query("SELECT source_id, kind FROM source_spec")
def frozen_set(spark, sf):
    """A frozen set written and read again, with its version, count and digest checked, and a manifest that names the digest."""
    path = _folder(spark, "frozen")
    digest = sinks.save_frozen(table(spark, sf, "source_spec").select("source_id", "kind"), "source_id", f"{path}/set.jsonl")
    sinks.write_manifest(spark, f"{path}/manifest.json", {"sha256": digest})
    if json.loads(lineage.read_text(spark, f"{path}/manifest.json"))["sha256"] != digest:
        raise RuntimeError("the manifest names another digest")
    return sinks.load_frozen(spark, f"{path}/set.jsonl", "source_id string, kind string")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS line_no FROM documents")
def ordered_corpus(spark, sf):
    """A corpus written in total order: the number of every line when its files are read one after another by name."""
    path = _folder(spark, "ordered")
    sinks.write_ordered(table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("line")), ["doc_id"], "line", path)
    lines = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\n$", "").alias("value"), F.col("_metadata.file_name").alias("file"))
    each = lines.select("file", F.posexplode(F.split("value", "\n")).alias("at", "line"))
    sizes = each.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.file") < F.col("a.file"), "left").groupBy(F.col("a.file").alias("file")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))  # one row per file
    return each.join(before, "file").select(F.col("line").try_cast("long").alias("doc_id"), (F.col("before") + F.col("at")).alias("line_no"))


_WORDS = "trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT doc_id AS id, 'See ' || w || chr(10) || chr(10) || '> **' || w || '**' || chr(10) || chr(10) || '![' || doc_id || '](i.png)' AS text FROM (SELECT doc_id, substr({_WORDS}, 1, 200) AS w FROM documents WHERE text IS NOT NULL) WHERE w <> '' AND w = trim(w)")
def xml_posts(spark, sf):
    """Posts of an XML dump as Markdown: paragraphs, quotations, bold text and images."""
    path = _folder(spark, "posts")
    w = F.substring(F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z0-9 ]", ""), " +", " ")), 1, 200)
    docs = table(spark, sf, "documents").filter("text is not null").select("doc_id", w.alias("w")).filter("w <> '' and w = trim(w)")
    body = F.format_string('<p>See %s</p><blockquote><p><b>%s</b></p></blockquote><img src="i.png" alt="%d">', "w", "w", "doc_id")
    docs.select(F.col("doc_id").alias("_Id"), body.alias("_Body")).write.format("xml").option("rowTag", "row").option("rootTag", "posts").save(path)
    return formats.read_posts(spark, path)


_SHEET = "SELECT doc_id, lower(trim(source)) AS name, coalesce(domain, 'none') AS about, lower(trim(coalesce(lang, 'xx'))) AS lang FROM documents WHERE source IS NOT NULL"


def _sheets(spark, sf):
    docs = table(spark, sf, "documents").filter("source is not null")
    return docs.select("doc_id", F.lower(F.trim("source")).alias("name"), F.coalesce("domain", F.lit("none")).alias("about"), F.lower(F.trim(F.coalesce("lang", F.lit("xx")))).alias("lang"))


@query(f"SELECT name || ' ' || doc_id AS name, name || ' ' || doc_id || ': ' || about || '.' || chr(10) || chr(10) || 'Show ' || about || chr(10) || 'show ' || doc_id || chr(10) || chr(10) || 'List' || chr(10) || 'ls ' || lang AS text FROM ({_SHEET})")
def command_pages(spark, sf):
    """Pages of examples: the header, and every example with its explanation."""
    raw = F.format_string("# x\n\n> %s.\n\n- Show %s:\n\n`show %d`\n\n- List:\n`ls %s`\n\n- Nothing:\n", "about", "about", "doc_id", "lang")
    pages = _sheets(spark, sf).select(F.concat_ws(" ", "name", "doc_id").alias("name"), raw.alias("raw"))
    return formats.format_records(pages, "name", "raw", "page")


@query(f"SELECT name || ' ' || doc_id AS name, replace(name, '_', ' ') || ' ' || doc_id || ': about ' || about || ' more' || chr(10) || chr(10) || 'ls ' || lang || chr(10) || 'who' || chr(10) || chr(10) || 'du ' || doc_id AS text FROM ({_SHEET})")
def cheat_sheets(spark, sf):
    """Cheat sheets: descriptions in the header, blocks of commands."""
    raw = F.format_string("# about %s\nls %s\n  who\n\n\n## more\ndu %d\n#\n", "about", "lang", "doc_id")
    sheets = _sheets(spark, sf).select(F.concat_ws(" ", "name", "doc_id").alias("name"), raw.alias("raw"))
    return formats.format_records(sheets, "name", "raw", "sheet")


@query("SELECT source_id, true AS masked FROM source_spec")
def masked_names(spark, sf):
    """A column of names replaced: a different invented name for every different one, blank ones kept."""
    spec = table(spark, sf, "source_spec").select("source_id", F.col("source_id").alias("who"))
    made = lineage.materialize(pii.mask_names(spec.unionByName(spec), "who").distinct(), "names")
    different = made.select("who").distinct().count() == made.count() == spec.count()
    return made.select("source_id", (F.lit(different) & (F.col("who") != F.col("source_id"))).alias("masked"))


@query("SELECT 'email' AS kind, range AS index FROM range(0, 50) UNION ALL SELECT 'email', range FROM range(0, 50)")
def issue_log(spark, sf):
    """What was issued, appended twice; the log holds what was given out and nothing that it replaced."""
    path = _folder(spark, "issued")
    issued = pii.identities(spark.range(50), "id")
    for _ in range(2):
        pii.log_issued(issued, "email", "id", "email", path)
    return spark.read.schema("kind string, index long, value string").json(path).select("kind", "index")


@query("SELECT lower(trim(source)) AS source, count(*) AS n FROM documents GROUP BY 1")
def resumed_stage(spark, sf):
    """A stage that is written once and taken up again as long as it is whole."""
    path = _folder(spark, "stage")
    counts = table(spark, sf, "documents").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    n = counts.count()
    lineage.resume(spark, path, n, lambda: counts)
    return lineage.resume(spark, path, n, lambda: (_ for _ in ()).throw(RuntimeError("a whole stage is not made again")))


@query("SELECT source_id AS source, CASE WHEN n IS NULL THEN 'empty' ELSE 'done' END AS state, least(coalesce(n, 0), 20)::BIGINT AS rows FROM (SELECT source_id FROM source_spec WHERE kind <> 'git_nl2bash') LEFT JOIN (SELECT lower(trim(source)) AS source_id, count(*) AS n FROM documents GROUP BY 1) USING (source_id) UNION ALL SELECT source_id, 'failed', 0 FROM source_spec WHERE kind = 'git_nl2bash'")
def source_jobs(spark, sf):
    """A job per source within a budget of twenty documents; the sources of one kind fail, and the others go on."""
    docs = table(spark, sf, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"))
    path = _folder(spark, "jobs")

    def job(name: str, kind: str):
        def make():
            if kind == "git_nl2bash":
                raise OSError("no network")
            return docs.filter(F.col("source") == name)

        return make

    def write(name: str, df: DataFrame) -> int:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}").count()

    spec = lineage.small_rows(table(spark, sf, "source_spec").select("source_id", "kind"), 10_000, "sources")
    report = corpus_build.run_sources({r.source_id: job(*r) for r in spec}, write, {r.source_id: 20 for r in spec})
    return spark.createDataFrame([(r["source"], r["state"], r["rows"]) for r in report], "source string, state string, rows long")


