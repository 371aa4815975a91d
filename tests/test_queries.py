"""Every query with SQL gives what DuckDB gives on the same tables; the others run and keep their schema."""

import math

import duckdb
import pytest

from plumbline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def tidy(v):
    if isinstance(v, float):
        return round(v, 5) if math.isfinite(v) else str(v)
    return v


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    r = con.execute(SQL[name])
    theirs = [d[0] for d in r.description]
    assert sorted(theirs) == cols
    at = [theirs.index(c) for c in cols]
    want = sorted((tuple(tidy(row[i]) for i in at) for row in r.fetchall()), key=key)
    got = sorted((tuple(tidy(row[c]) for c in cols) for row in df.collect()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted({"effective_rank", "pca", "mia_zlib", "rouge_stemmed", "classifier_prob", "lasso_loo", "feature_importance"}))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
