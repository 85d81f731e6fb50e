"""Every registered query against its DuckDB twin on the smallest test tables."""

import os

import duckdb
import pytest

from tools.check_oracle import TABLES, family_duck, family_spark, rows_of

SF = "/root/testdata/sf0.001"


def _names():
    from __spark_entry__ import oracle_sql
    return sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", _names())
def test_query_matches_sql_twin(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    sdf = queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    srecs = [r.asDict() for r in sdf.collect()]
    rel = con.sql(oracle_sql()[name])
    assert sorted(rel.columns) == cols
    drecs = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert len(srecs) == len(drecs)
    sfam = {f.name: family_spark(f.dataType.simpleString()) for f in sdf.schema.fields}
    dfam = {c: family_duck(str(t)) for c, t in zip(rel.columns, rel.types)}
    assert sfam == dfam
    assert rows_of(srecs, cols) == rows_of(drecs, cols)


def test_rows_only_queries_run(spark):
    from __spark_entry__ import oracle_sql, queries
    for name, fn in queries().items():
        if name not in oracle_sql():
            assert fn(spark, SF).count() >= 0


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["time", "station", "lat", "lon", "value"]
    assert df.count() >= 0


def test_registry_is_consistent():
    from __spark_entry__ import oracle_sql, queries
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert len(q) == len(set(q))
    for name, sql in o.items():
        assert sql.strip(), name
