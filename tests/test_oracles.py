"""Every registered query of the core against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillspark.plans.driver_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def rows(df):
    plain = lambda v: None if pd.isna(v) else v.item() if isinstance(v, np.generic) else v
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    found, wanted = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_all_vectors_without_order_or_limit(spark):
    plan = QUERIES["semantic_null_excluded"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["chunk_id", "source_id", "path", "content", "rn", "store_idx"]
