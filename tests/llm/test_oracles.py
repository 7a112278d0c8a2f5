"""Queries with SQL, whole tables."""

def test_queries_against_sql(spark):
    import duckdb

    from weir.llm import registry

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        cur = c.execute(sql)
        names = [x[0] for x in cur.description]
        want = sorted(cur.fetchall(), key=str)
        df = registry.queries()[name](spark, "/root/testdata/sf0.01")
        assert sorted(names) == sorted(df.columns), name
        assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == want, name
