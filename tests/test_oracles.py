"""Every registered query against its DuckDB oracle on sf0.001."""

import duckdb
import pytest

from tests.conftest import SMALL
from tools.oracle_check import TABLES, rows_of
from vendorlytics import registry

DUCK_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
             "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
QUERIES = registry.queries()
ORACLES = registry.oracle_sql()
BRUTE_FORCE = {"custom_item_submit"}  # compared with a sequential brute force in test_admission.py


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    srows = df.collect()
    if name in BRUTE_FORCE:
        assert srows
        return
    rel = duck.sql(ORACLES[name])
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    for f in df.schema.fields:
        assert DUCK_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString().upper()) == types.get(f.name), \
            (f.name, f.dataType.simpleString(), types.get(f.name))
    cur = duck.execute(ORACLES[name])
    drows = cur.fetchall()
    sc, sr = rows_of(df.columns, srows)
    dc, dr = rows_of([d[0] for d in cur.description], drows)
    assert sc == dc
    assert sr == dr, (list((sr - dr).elements())[:3], list((dr - sr).elements())[:3])


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0
    assert "resumen" in df.columns
