"""Compares a query with its SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(rows, columns, names):
    place = [names.index(c) for c in columns]
    return sorted(([None if r[i] is None else repr(r[i]) if isinstance(r[i], float) else str(r[i]) for i in place] for r in rows), key=str)


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = query(spark, sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    assert values(df.collect(), columns, df.columns) == values(found.fetchall(), columns, names)
