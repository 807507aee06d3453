"""Compare a registered query with its SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows_of(frame, cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame[cols].astype(object).where(frame[cols].notna(), "\0").itertuples(index=False, name=None))


def compare(spark, name, query, sql, sf_dir):
    got = query(spark, sf_dir).toPandas()
    want = connect(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns), name
    cols = sorted(got.columns)
    a, b = rows_of(got, cols), rows_of(want, cols)
    assert len(a) == len(b), (name, len(a), len(b))
    for x, y in zip(a, b, strict=True):
        assert x == y, (name, x, y)
