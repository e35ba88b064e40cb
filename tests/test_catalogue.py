"""Every query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from brindle import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Their SQL states results for tables with enough rows.
NEED_ROWS = {"profile_kg_cvt"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLE_SQL) - NEED_ROWS))
def test_equals_sql(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    want = con.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(x) for x in sorted(columns)]
    ours = sorted((tuple(plain(r[x]) for x in sorted(columns)) for r in df.collect()), key=repr)
    assert ours == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
