"""Every query that has SQL gives what DuckDB makes of that SQL."""

import os

import duckdb
import pandas as pd
import pytest

from quillspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v

    frame = frame[sorted(frame.columns)]
    return sorted(str([plain(v) for v in r]) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    if name in catalogue.oracle_sql():
        want = db.execute(catalogue.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["refs_locations", "trigram_postings", "camel_segments", "name_hash_buckets", "shared_source_division"])
def test_query_over_all(spark, name):
    some, every = (set(map(tuple, catalogue.queries()[q](spark, SF).drop("n").collect())) for q in (name, f"{name}_all"))
    assert len(every) > len(some)


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
