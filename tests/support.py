"""Comparing Spark with DuckDB, and small tables."""

from pathlib import Path

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(repr([plain(r[k]) for k in order]) for r in rows)


def same(df, sql, con):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, cursor.fetchall())


def column(df, name):
    return [r[name] for r in df.collect()]
