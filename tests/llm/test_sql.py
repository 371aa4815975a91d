"""The operators that SQL can express give what DuckDB gives; all eleven queries are registered."""

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.llm import queries


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    r = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted((tuple(x[c] for c in cols) for x in df.collect()), key=key) == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=key)


@pytest.mark.parametrize("name", ["op1_toxicity", "op2_language", "op3_packing", "op5_quality", "op6_near_dedup", "op8_bpe", "op9_token_counts"])
def test_whole_table(spark, sf, name):
    ids = {r[0] for r in queries.queries()[name](spark, sf).select("doc_id").distinct().collect()}
    assert ids == {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
