"""Corpora as streams: resumable readers, incremental duplicates, buffers that outlive a batch.

State lives in the checkpoint of the query: a stream that is started again with the same
checkpoint goes on where it stopped, and a changed capacity is refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtext.functions import text as T
from loomtext.plans.lineage import file_system, read_text, small_rows, write_text
from loomtext.sources.records import scan_json

#: Files of a corpus whose state one manifest keeps.
MAX_FILES = 1_000_000


def read_corpus(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """(path, text) of the usable records of JSON-lines files, as they arrive."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).text(path)
    scanned = raw.select(F.col("_metadata.file_path").alias("path"), scan_json(F.col("value")).alias("r"))
    return scanned.filter("r.status = 'ok'").select("path", "r.text")


def epochs(df: DataFrame, pos: str, n: int, seed: int = 0) -> DataFrame:
    """A bounded corpus repeated: (epoch, shuffled position); the order of every epoch depends on seed and epoch only."""
    repeated = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return repeated.withColumn("epoch_key", T.draw(F.lit(seed), F.col("epoch"), F.col(pos)))


def first_seen_stream(events: DataFrame, key: Column, time: str, delay: str) -> DataFrame:
    """The first row of every key within the watermark: exact duplicates drop out as they arrive."""
    keyed = events.withColumn("_key", key).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def refuse_changes(spark: SparkSession, path: str, manifest: str) -> int:
    """Compares the files of a corpus with those of the manifest that the first start wrote: a file that changed or went is an error, new files are
    added. Returns the number of files. Called before a stream is started again."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").cast("string").alias("at"))
    now = {r.path: [r.length, r.at] for r in small_rows(files, MAX_FILES, "files of a corpus")}
    fs, p = file_system(spark, manifest)
    known = json.loads(read_text(spark, manifest)) if fs.exists(p) else {}
    if changed := sorted(k for k, v in known.items() if now.get(k) != v):
        raise ValueError(f"{len(changed)} files changed or went since the stream began, first {changed[0]}")
    write_text(spark, manifest, json.dumps(known | now))
    return len(now)


def blend_streams(streams: dict[str, DataFrame], weights: dict[str, float], key: str | None = None, volumes: dict[str, float] | None = None, seed: int = 17) -> DataFrame:
    """A union of streams with a source column and the share wanted; a missing, unknown or non-positive weight is an error.

    With ``key`` rows are drawn by its digest so that the sources come in the shares wanted, given their ``volumes`` (rows in a stretch of time;
    equal ones unless given): the source that is scarcest for its weight passes whole, others in proportion. A row passes or not
    whatever the batch it comes in, so a restart draws the same.
    """
    if set(streams) != set(weights) or volumes is not None and set(volumes) != set(streams):
        raise ValueError(f"streams {sorted(streams)} and weights {sorted(weights)} differ")
    if any(w <= 0 for w in [*weights.values(), *(volumes or {}).values()]):
        raise ValueError("weights and volumes must be positive")
    need = {k: w / (volumes or {}).get(k, 1.0) for k, w in weights.items()}
    out = None
    for name in sorted(streams):
        part = streams[name]
        if key is not None:
            part = part.filter(T.uniform(F.lit(seed), F.lit(name), F.col(key)) < need[name] / max(need.values()))
        part = part.withColumn("source", F.lit(name)).withColumn("weight", F.lit(weights[name] / sum(weights.values())))
        out = part if out is None else out.unionByName(part)
    return out


def pack_stream(docs: DataFrame, by: str, pos: str, length: str, budget: int, most: int) -> DataFrame:
    """(by, window_no, n_documents, used): windows closed so far; what does not fill one waits in the state.

    ``by`` must split the stream finely enough for one task per value.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, n, used, capacity = state.get if state.exists else (0, 0, 0, budget)
        if capacity != budget:
            raise ValueError(f"the state was written with a budget of {capacity}, not {budget}")
        out = []
        for pdf in batches:
            for size in pdf.sort_values(pos)[length]:
                if n and (used + size + 2 > budget or n == most):
                    out.append((key[0], number, n, used))
                    number, n, used = number + 1, 0, 0
                n, used = n + 1, used + int(size) + 2
        state.update((number, n, used, budget))
        yield pd.DataFrame(out, columns=[by, "window_no", "n_documents", "used"])

    kind = docs.schema[by].dataType.simpleString()
    return docs.select(by, pos, length).groupBy(by).applyInPandasWithState(
        run, f"{by} {kind}, window_no long, n_documents long, used long", "number long, n long, used long, capacity long", "append", GroupStateTimeout.NoTimeout
    )


def event_windows(events: DataFrame, time: str, window: str, delay: str, *by: str) -> DataFrame:
    """Counts and means of a log in tumbling windows; late rows count until the watermark has passed."""
    grouped = events.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("start"), *by, "n", "mean")
