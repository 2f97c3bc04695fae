"""Audit passes, routing and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import dedup, quality, tokens
from loomtext.plans.lineage import materialize, read_text, shared_dir, write_text


def pass1(docs: DataFrame, strict: tuple[str, ...] = quality.LANGUAGE_STRICT) -> DataFrame:
    """(doc_id, source, bits, reasons): the reasons of the first pass, duplicates of the whole corpus included; ``strict`` names the sources whose language is judged more strictly."""
    dup = dedup.corpus_duplicates(docs).withColumnRenamed("pos", "doc_id")
    marked = docs.select("doc_id", "source", "text").join(dup, "doc_id", "left")
    bits = quality.pass1_bits(F.col("text"), F.col("source"), F.coalesce("is_duplicate", F.lit(False)), strict)
    return marked.select("doc_id", F.lower(F.trim("source")).alias("source"), bits.alias("bits")).withColumn("reasons", quality.decode_bits(quality.PASS1, F.col("bits")))


def pass2(docs: DataFrame, byte_share: float = 0.02, fertility: float = 4.0) -> DataFrame:
    """(doc_id, source, bits, reasons) of the second pass; byte share and fertility are those of the tokenizer model."""
    near = dedup.near_duplicates(dedup.minhash_bands(docs)).withColumnRenamed("pos", "doc_id")
    c = F.coalesce(F.col("text"), F.lit(""))
    kind = quality.source_class(F.col("source"))
    classed = docs.select("doc_id", "source", "text", (kind == "code").alias("_code"), (kind == "qa").alias("_qa"))
    fit = tokens.fitness(classed, ["doc_id", "source", "text"], "text", "_code", qa="_qa", byte_share=byte_share, most=fertility)
    flags = quality.structural_rules(F.col("text"), F.col("source")) | {
        "byte_fallback": F.col("byte_fallback"),
        "fertility": F.col("fertility"),
        "near_duplicate": F.coalesce("is_near_duplicate", F.lit(False)),
        "corrupt_or_empty": T.strip(c) == "",
    }
    marked = fit.join(near, "doc_id", "left")
    bits = marked.select("doc_id", F.lower(F.trim("source")).alias("source"), quality.bitmask(quality.PASS2, flags).alias("bits"))
    return bits.withColumn("reasons", quality.decode_bits(quality.PASS2, F.col("bits")))


def route_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("bits") == 0, 1)).alias("kept"), F.count(F.when(F.col("bits") != 0, 1)).alias("moved"))


def report(audited: DataFrame) -> DataFrame:
    """Rows per reason: by source and reason, by source, by reason, in all (``level`` 0, 1, 2, 3)."""
    # an outer explode: the filter that Spark infers for the inner one would compute every reason again
    rows = audited.select("source", F.explode_outer("reasons").alias("reason")).filter("reason is not null")
    sets = rows.groupingSets([["source", "reason"], ["source"], ["reason"], []], "source", "reason")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id("source", "reason").cast("int").alias("level"))


def samples(audited: DataFrame, n: int) -> DataFrame:
    """The first n rows of every reason.

    Spark limits every reason inside each part before the shuffle (WindowGroupLimit), so a
    frequent reason moves n rows a part, not all.
    """
    rows = audited.select(F.explode_outer("reasons").alias("reason"), "doc_id", "source").filter("reason is not null")
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("reason").orderBy("doc_id")))
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


def route(docs: DataFrame, audited: DataFrame, out: str | None = None) -> tuple[str, str]:
    """Write kept and rejected rows to two folders of a new version, which becomes the current one only when the counts add up.

    The audit is computed once; both writes come from one joined frame; rejected rows carry their reasons. The file CURRENT names the
    version (``routed``); earlier versions stay until somebody removes them, so no failure loses a table.
    """
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/routed"
    version = f"{out}/v-{uuid.uuid4().hex}"
    n = docs.count()
    joined = docs.join(materialize(audited.select("doc_id", "bits", "reasons"), "audited"), "doc_id")
    for name, part in (("kept", joined.filter("bits = 0").drop("bits", "reasons")), ("rejected", joined.filter("bits <> 0"))):
        part.write.parquet(f"{version}/{name}")
    kept, moved = (spark.read.parquet(f"{version}/{x}").count() for x in ("kept", "rejected"))
    if kept + moved != n:
        raise RuntimeError(f"{kept} kept and {moved} rejected rows do not add up to {n}")
    write_text(spark, f"{out}/CURRENT", version)
    return routed(spark, out)


def routed(spark: SparkSession, out: str) -> tuple[str, str]:
    """The folders of kept and of rejected rows of the current version."""
    version = read_text(spark, f"{out}/CURRENT")
    return f"{version}/kept", f"{version}/rejected"
