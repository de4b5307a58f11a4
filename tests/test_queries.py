"""Every query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from quarrylane.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if x is None or x != x else round(float(x), 4) if isinstance(x, float) else str(x) for x in r) for r in frame.astype(object).where(frame.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got.columns)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    num = lambda v: [tuple(float(x) if isinstance(x, float) or str(x).lstrip("-").replace(".", "", 1).isdigit() else x for x in r) for r in v]
    assert sorted(map(str, num(rows(got)))) == sorted(map(str, num(rows(want))))
