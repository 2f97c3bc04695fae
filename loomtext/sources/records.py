"""Reading corpora: discovery, labels, JSON records, lines.

Readers take explicit schemas and never infer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.plans.lineage import broadcast_if_small

#: Kinds of sources that are broadcast.
MAX_KINDS = 100_000
SUFFIXES = (".jsonl", ".json", ".txt")


def discover(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, exclude: str | None = None) -> DataFrame:
    """(path, length) of corpus files below ``path``, by suffix without regard to case; no file is an error.

    ``exclude`` names a path component whose files are left out. Contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower("path").endswith(s)
    found = files.filter(wanted)
    if exclude:
        found = found.filter(~F.array_contains(F.split("path", "/"), exclude))
    if found.isEmpty():
        raise FileNotFoundError(f"no file with a suffix of {suffixes} below {path}")
    return found.orderBy("path")


def directory_label(path: Column, root: str) -> Column:
    """The first component below the root; the file's stem for files right below it."""
    rest = F.regexp_replace(path, f"^.*?{root.strip('/')}/", "")
    return F.when(F.instr(rest, "/") > 0, F.split_part(rest, F.lit("/"), F.lit(1))).otherwise(F.regexp_replace(rest, r"\.[^.]*$", ""))


def file_label(path: Column) -> Column:
    """The stem without a size suffix such as _6.5MB; the stem itself where nothing would be left."""
    stem = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.(jsonl|json|txt)$", "")
    cut = F.regexp_replace(stem, r"(?i)_\d+(\.\d+)?mb$", "")
    return F.when(cut == "", stem).otherwise(cut)


def scan_json(line: Column, blank_is_missing: bool = True) -> Column:
    """struct(status, text) of a raw line: ok, bad_json or missing_text.

    Only a JSON object with a string field ``text`` is ok: numbers are not turned into strings. ``blank_is_missing``
    decides about white space alone.
    """
    parsed = F.try_parse_json(line)
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.text", "variant"))
    value = F.try_variant_get(parsed, "$.text", "string")
    usable = (kind == "STRING") & ((T.strip(value) != "") if blank_is_missing else (F.length(value) > 0))
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    status = F.when(parsed.isNull() | ~is_object, "bad_json").when(usable, "ok").otherwise("missing_text")
    return F.struct(status.alias("status"), F.when(usable & is_object, value).alias("text"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of usable records; anything else is dropped."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("path"))
    return raw.withColumn("r", scan_json(F.col("value"))).filter("r.status = 'ok'").select("path", "r.text")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines folder; blank lines are skipped, the first bad line is an error that names its file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).filter(T.strip(F.col("value")) != "")
    parsed = raw.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    bad = parsed.filter(F.try_parse_json("value").isNull() | F.col("r").isNull()).select("_file", "value").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['_file']}: {bad[0]['value'][:80]!r} is no record")
    return parsed.select("r.*")


def eligible_lines(df: DataFrame, keys: list[str], text: str = "text", limit: int = 4096) -> DataFrame:
    """(keys, line_no, line, n_bytes, state): every line of every text; state is eligible, empty or oversized (in bytes)."""
    cut = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", "\r$", ""))
    size = F.octet_length("line")
    state = F.when(T.strip(F.col("line")) == "", "empty").when(size > limit, "oversized").otherwise("eligible")
    return cut.select(*keys, "line_no", "line", size.alias("n_bytes"), state.alias("state"))


def line_stats(lines: DataFrame, by: list[str]) -> DataFrame:
    """Counts and bytes per group, and the share of non-blank lines that was dropped."""
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    g = lines.groupBy(*by).agg(n("eligible").alias("eligible"), n("empty").alias("empty"), n("oversized").alias("oversized"), F.coalesce(F.sum(F.when(F.col("state") == "eligible", F.col("n_bytes"))), F.lit(0)).alias("bytes"))
    return g.withColumn("drop_fraction", F.round(T.ratio(F.col("oversized"), F.col("eligible") + F.col("oversized")), 6))


def trimmed_lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Every trimmed line that is not empty, numbered from 0 as in the text."""
    cut = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", T.strip(F.col("line")))
    return cut.filter("line <> ''")


def registry(spec: DataFrame, has_token: bool = False) -> DataFrame:
    """Adds used_source: a gated source falls back to the first open one of its kind when there is no token."""
    open_ = spec.filter(~F.coalesce("needs_token", F.lit(False))).groupBy("kind").agg(F.min("source_id").alias("_open"))
    gated = F.coalesce("needs_token", F.lit(False)) & F.lit(not has_token)
    return spec.join(broadcast_if_small(open_, MAX_KINDS), "kind", "left").withColumn("used_source", F.when(gated, F.col("_open")).otherwise(F.col("source_id"))).drop("_open")


# Order of the kinds of sources; others stand in the middle.
TIERS = {"stackexchange": 0, "git_cheat": 2, "man_pages": 2}


def site_order(sites: DataFrame, name: str, kind: str, size: str, last: str | None = None, drop_kinds: tuple[str, ...] = ()) -> DataFrame:
    """Adds rank: by tier, size and name; one site can be pinned to the end. For small tables."""
    from pyspark.sql import Window

    tier = F.lit(1)
    for k, v in TIERS.items():
        tier = F.when(F.col(kind) == k, v).otherwise(tier)
    kept = sites.filter(~F.col(kind).isin(*drop_kinds)) if drop_kinds else sites
    pinned = (F.col(name) == last) if last else F.lit(False)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(pinned, tier, size, name)))


def aligned_pairs(left: DataFrame, right: DataFrame, on: list[str], text: str = "text") -> DataFrame:
    """Texts of two aligned files by position, both sides non-blank, joined by a line end."""
    other = right.select(*on, F.col(text).alias("_other"))
    j = left.select(*on, text).join(other, on)
    return j.filter((T.strip(F.col(text)) != "") & (T.strip(F.col("_other")) != "")).select(*on, F.concat_ws("\n", text, "_other").alias("pair"))


def first_seen(df: DataFrame, keys: dict[str, Column], pos: str) -> DataFrame:
    """The first position of every combination of keys."""
    return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.min(pos).alias(pos))


def shuffled(df: DataFrame, key: str, seed: int, shards: int, shard: int) -> DataFrame:
    """One shard of the rows, in an order that depends on the seed only."""
    return df.filter(F.pmod(T.draw(F.lit("shard"), F.col(key)), F.lit(shards)) == shard).orderBy(T.draw(F.lit(seed), F.col(key)), key)


def files_by_source(files: DataFrame, path: str, root: str) -> DataFrame:
    """(source, files, first_file) of different files below ``root``, by directory label."""
    named = files.filter(F.col(path).isNotNull()).select(path).distinct()
    return named.groupBy(directory_label(F.col(path), root).alias("source")).agg(F.count(F.lit(1)).alias("files"), F.min(path).alias("first_file"))


def allowed(sites: DataFrame, allow: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Sites of an allow-list, in order."""
    return sites.join(allow.select(key), key, "left_semi").orderBy(*order)


def items_by_suite(items: DataFrame, suite: str, text: str) -> DataFrame:
    """(suite, items, chars) of the items that have a text."""
    return items.filter(F.col(text).isNotNull()).groupBy(suite).agg(F.count(F.lit(1)).alias("items"), F.sum(F.length(text)).alias("chars"))


def shards_per_source(lines: DataFrame, key: str, source: str, shard: str) -> DataFrame:
    """(source, shard, lines): lines of every shard, deliveries of one line counted once; sources in any case."""
    once = lines.select(key, F.lower(F.trim(source)).alias("source"), shard).distinct()
    return once.groupBy("source", shard).agg(F.count(F.lit(1)).alias("lines"))
