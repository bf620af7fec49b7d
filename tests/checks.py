"""Compare a DataFrame with what DuckDB gives on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql, sf):
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        found = c.execute(sql)
        names = [x[0] for x in found.description]
        return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def same(df, sql, sf):
    expected = rows_of_sql(sql, sf)
    names = sorted(df.columns)
    key = lambda r: repr([r[n] for n in names])
    mine = sorted(([r[n] for n in names] for r in df.collect()), key=repr)
    theirs = sorted(([r[n] for n in names] for r in sorted(expected, key=key)), key=repr)
    assert mine == theirs
