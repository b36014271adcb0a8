"""Every query of the catalogue gives what its SQL gives in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import catalogue, feeds, gates, judging, scale, trials  # noqa: F401

DATA = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    try:
        x = float(value)
    except (TypeError, ValueError):
        return str(value)
    return None if math.isnan(x) else float(f"{x:.9g}")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalogue.ORACLE_SQL:
        assert mine
        return
    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{DATA}/{file}'")
    found = db.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert mine == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
