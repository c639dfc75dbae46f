"""Each registered query with SQL against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from defectflow import plans


def rows(values):
    return sorted((tuple(round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r) for r in values), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query(spark, sf_dir, name):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = db.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = plans.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    a, b = rows(tuple(r) for r in got.select(*columns).collect()), rows(want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or isinstance(u, float) and math.isclose(u, v, abs_tol=2e-5) for u, v in zip(x, y, strict=True)), (x, y)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0


def test_contexts_of_blank_texts(spark, tmp_path):
    texts = ["a", "", "  ", " " * 600 + "x", "+", "-", None, "++ a", "\n", "é" * 600, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = plans.QUERIES["e4_without_context"](spark, str(tmp_path)).select("commit_hash", "context", "predicted", "reason")
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(f"SELECT commit_hash, context, predicted, reason FROM ({plans.ORACLE_SQL['e4_without_context']})").fetchall())
