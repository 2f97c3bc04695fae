"""Cutting lineage and sizing broadcasts.

Intermediate results that are used more than once are written to the folder that the
cluster names in ``spark.checkpoint.dir``, so that they outlive any executor.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    jsc = spark.sparkContext._jsc.sc()
    known = jsc.getCheckpointDir()
    if known.isDefined():
        return known.get()
    path = tempfile.mkdtemp(prefix="loomtext-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return path


_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; ``temporary`` and ``release`` remove what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> int:
    """Removes the tables that ``materialize`` wrote in this process (the latest, from number ``since`` on); frames that read them are of no more use."""
    paths = _written[since:]
    del _written[since:]
    for path in paths:
        delete(spark, path)
    return len(paths)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end: for work whose result is written or collected inside."""
    since = len(_written)
    try:
        yield
    finally:
        release(spark, since)


def file_system(spark: SparkSession, path: str):
    """(file system, path object) of a path in whatever storage Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its target and moved over it: readers see the old or the new file, never a part.

    In storage that cannot move over a file, the old one goes right before the move.
    """
    fs, target = file_system(spark, path)
    _, draft = file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text, also one that was edited by other means than Hadoop's."""
    fs, p = file_system(spark, path)
    fs.setVerifyChecksum(False)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
        fs.setVerifyChecksum(True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only after counting that it has at most ``max_rows`` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def small_rows(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a table that must be small; refuses, instead of collecting, beyond the bound."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; this table must stay small")
    return rows


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows, the same ones at any partitioning; of rows with one key, the greatest.

    A row belongs to the sample when its hashed key lies under a threshold, so nothing is
    sorted and only the sample leaves the executors. A key that many rows share counts once, so the
    sample stays near its size whatever the keys.
    """
    total = df.count()
    if total <= rows:
        return df
    buckets = 1 << 30
    chosen = df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(buckets)) < int(buckets * rows / total))
    others = [c for c in df.columns if c != key]
    if not others:
        return chosen.distinct()
    return chosen.groupBy(key).agg(F.max(F.struct(*others)).alias("__row")).select(key, *[F.col(f"__row.{c}").alias(c) for c in others]).select(*df.columns)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores, dealt out over the cores; any larger scan as it is.

    For work that costs far more than moving its rows. ``df`` must be a plain scan: the number of
    parts of anything behind a shuffle is only known by running it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def resume(spark: SparkSession, path: str, rows: int, make) -> DataFrame:
    """A stage written earlier, if it is whole; otherwise ``make()`` is written there again.

    Whole means: it can be read and holds ``rows`` rows.
    """
    from pyspark.errors import AnalysisException

    try:
        done = spark.read.parquet(path)
        if done.count() == rows:
            return done
    except AnalysisException:
        pass
    make().write.mode("overwrite").parquet(path)
    done = spark.read.parquet(path)
    if (n := done.count()) != rows:
        raise RuntimeError(f"{path} has {n} rows, not {rows}")
    return done
