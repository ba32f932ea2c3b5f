"""Holds a query's rows against its SQL in DuckDB, as the driver does: columns by name, rows in any order."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, sf_dir, query, sql):
    """Empty if both give the same columns and rows."""
    cursor = connect(sf_dir).execute(sql)
    names = [c[0] for c in cursor.description]
    want = _rows(names, cursor.fetchall())
    df = query(spark, sf_dir)
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return [f"{len(got)} rows and {len(want)}", *map(str, got[:2]), *map(str, want[:2])]
    return [f"{a} and {b}" for a, b in zip(got, want, strict=True) if a != b][:3]
