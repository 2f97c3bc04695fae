"""Every query over empty tables, and over tables with a row of nulls and columns of other names."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomtext.queries import ORACLE_SQL, QUERIES

DATA = Path(os.environ.get("LOOMTEXT_TESTDATA", "/root/testdata/sf0.001"))
TABLES = ["budget_writer", "documents", "padded_batch", "scan_stats", "source_spec", "slice_budget", "pack_spec", "eval_items", "token_counts", "events", "embeddings"]
#: A dead table of settings is an error that says so, not an empty result.
REFUSES_EMPTY = {"blended_draw", "realized_shares", "discovered_files"}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("edges")
    for name in TABLES:
        df = spark.read.parquet(str(DATA / f"{name}.parquet"))
        df.limit(0).write.parquet(str(root / "empty" / f"{name}.parquet"))
        nulls = df.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
        few = df.limit(40).unionByName(nulls).withColumn("_first", F.lit("x")).withColumn("_rn", F.lit("x")).withColumn("pos", F.lit("x")).withColumn("reason", F.lit("x")).withColumn("t", F.lit("x"))
        few.write.parquet(str(root / "nulls" / f"{name}.parquet"))
    return root


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_every_query(spark, folders, kind):
    failed = {}
    for name, q in QUERIES.items():
        try:
            q(spark, str(folders / kind)).write.format("noop").mode("overwrite").save()
        except (ValueError, FileNotFoundError) as e:
            if not (kind == "empty" and name in REFUSES_EMPTY):
                failed[name] = repr(e)[:300]
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:300]
    assert not failed, "\n".join(f"{k}: {v}" for k, v in failed.items())


def test_sql_names_are_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
