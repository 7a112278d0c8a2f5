"""Every query with SQL against DuckDB on the same tables; the others must return rows."""

import math

import duckdb
import pytest

from weir.plans import catalog

D = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    rows = df.collect()
    if name not in catalog.oracle_sql():
        assert rows
        return
    cols = sorted(df.columns)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=str)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=str)
    assert len(got) == len(want) and got == want
    assert want or name in ("search_names_without",)
