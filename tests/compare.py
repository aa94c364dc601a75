"""Run registered queries beside their SQL on one of the driver's folders and compare all values."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def canonical(rows):
    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return str(x)

    return sorted(tuple(value(x) for x in r) for r in rows)


def differences(spark, sf_dir, name, frame, sql):
    relation = duck(sf_dir).sql(sql)
    columns = sorted(frame.columns)
    if columns != sorted(relation.columns):
        return f"{name}: columns {columns} and {sorted(relation.columns)}"
    ours = canonical([tuple(r[c] for c in columns) for r in frame.collect()])
    order = [relation.columns.index(c) for c in columns]
    theirs = canonical([tuple(r[i] for i in order) for r in relation.fetchall()])
    if ours != theirs:
        odd = [(a, b) for a, b in zip(ours, theirs) if a != b][:2]
        return f"{name}: {len(ours)} and {len(theirs)} rows; {odd}"
    return None
