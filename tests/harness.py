"""Compare a Spark query with its DuckDB SQL: rows, columns and values, in any order."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def differences(df, db, sql):
    """What differs, as a list of texts; empty if nothing does."""
    a_names, a = rows(df.columns, df.collect())
    cur = db.execute(sql)
    b_names, b = rows([d[0] for d in cur.description], cur.fetchall())
    if a_names != b_names:
        return [f"columns {a_names} and {b_names}"]
    if len(a) != len(b):
        return [f"{len(a)} and {len(b)} rows"]
    return [f"{x} and {y}" for x, y in zip(a, b) if x != y and repr(x) != repr(y)][:5]
