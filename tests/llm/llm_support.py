"""Helpers of these tests; the session is that of the folder above."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text) as documents, in several partitions."""
    def build(rows):
        df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)
        return df.repartition(3) if rows else df
    return build


def clashing(df):
    """The frame with more columns, of names that operators use themselves."""
    for name in ("key", "data", "size", "row", "slice", "features", "fingerprint", "range", "score", "spans", "id"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("other"))
    return df


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)
