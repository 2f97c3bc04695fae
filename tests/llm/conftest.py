import pytest
from pyspark.sql import functions as F


@pytest.fixture
def clashing():
    """Extra columns whose names the operators use inside."""

    def add(df):
        for c in ("tokens", "rep", "label", "_k", "_n", "_part", "_rank", "container_id", "similarity", "p", "word_count", "est_tokens", "copy_no", "start_pos"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit("x"))
        return df

    return add
