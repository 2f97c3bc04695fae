"""Writing: shards within a budget, manifests, frozen sets, ordered corpora."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.blend import budget_cut
from loomtext.plans.lineage import read_text, small_rows, write_text


def write_shards(df: DataFrame, pos: str, text: str, path: str, budget: int, shard: int) -> DataFrame:
    """Write JSON lines in order until the budget is met, a folder per shard; returns lines and bytes per shard.

    The size of a line is that of its JSON encoding with the line end.
    """
    encoded = df.filter(F.col(text).isNotNull()).select(pos, F.to_json(F.struct(F.col(text).alias("text"))).alias("value"))
    cut = budget_cut(encoded, pos, F.octet_length("value") + 1, budget, shard)
    cut.select("shard", pos, "value").repartitionByRange("shard", pos).sortWithinPartitions("shard", pos).select("shard", "value").write.partitionBy("shard").mode("overwrite").text(path)
    return cut.groupBy("shard").agg(F.count(F.lit(1)).alias("lines"), F.sum("line_bytes").alias("bytes"))


def shard_digests(spark: SparkSession, path: str) -> DataFrame:
    """(shard, file, bytes, sha256) of every file that ``write_shards`` wrote."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    shard = F.regexp_extract("path", "/shard=([0-9]+)/", 1).cast("long")
    return files.select(shard.alias("shard"), F.regexp_replace("path", "^.*/", "").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """In any storage; readers see the old or the new file, never a part."""
    write_text(spark, path, json.dumps(content, indent=2, sort_keys=True))


#: A frozen set is a small, versioned file; more rows than this do not belong in one.
MAX_FROZEN = 1_000_000
VERSION = 1


def _digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def save_frozen(df: DataFrame, order: str, path: str) -> str:
    """One manifest line and one JSON line per row, in order; returns the digest."""
    rows = small_rows(df.orderBy(order).select(F.to_json(F.struct(*df.columns)).alias("j")), MAX_FROZEN, "frozen set")
    lines = [r.j for r in rows]
    digest = _digest(lines)
    write_text(df.sparkSession, path, "\n".join([json.dumps({"version": VERSION, "count": len(lines), "sha256": digest}), *lines]) + "\n")
    return digest


def load_frozen(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a frozen set; a wrong version, count or digest is an error."""
    head, *lines = read_text(spark, path).rstrip("\n").split("\n")
    m = json.loads(head)
    for what, have in (("version", VERSION), ("count", len(lines)), ("sha256", _digest(lines))):
        if m.get(what) != have:
            raise ValueError(f"{path}: {what} is {m.get(what)}, the content has {have}")
    return spark.createDataFrame([(x,) for x in lines], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")


def write_ordered(df: DataFrame, order: list[str], text: str, path: str) -> None:
    """One line per row in total order: range partitions whose files, by name, follow one another."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(text).alias("value")).write.mode("overwrite").text(path)
