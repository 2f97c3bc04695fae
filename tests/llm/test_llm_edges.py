"""Every query of the subpackage over empty tables, and over tables with a row of nulls and clashing columns."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomtext.llm.queries import QUERIES

DATA = Path(os.environ.get("LOOMTEXT_TESTDATA", "/root/testdata/sf0.001"))
TABLES = ["budget_writer", "documents", "padded_batch", "scan_stats", "source_spec", "slice_budget", "pack_spec", "eval_items", "token_counts", "given_names"]

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_every_query(spark, clashing, tmp_path, kind):
    for name in TABLES:
        df = spark.read.parquet(str(DATA / f"{name}.parquet"))
        if kind == "empty":
            df = df.limit(0)
        else:
            nulls = df.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
            df = clashing(df.limit(60).unionByName(nulls).unionByName(df.limit(5)))
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    failed = {}
    for name, q in QUERIES.items():
        try:
            n = q(spark, str(tmp_path)).count()
            if kind == "empty" and name.endswith("_found") and n:
                failed[name] = f"{n} rows"
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:400]
    assert not failed, "\n".join(f"{k}: {v}" for k, v in failed.items())
