"""Side-by-side run of a registered query and its SQL oracle."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value) if not isinstance(value, (int, bool, type(None))) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, query, sql):
    """None where both agree, else what differs."""
    frame = query(spark, sf_dir)
    ours = rows_of(frame.columns, frame.collect())
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows; first: {ours[:2]} and {theirs[:2]}"
    bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ, as {bad[0]}" if bad else None
