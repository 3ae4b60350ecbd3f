"""Compare a Spark result with DuckDB, values bit for bit, row order aside."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return ("~",)
    if isinstance(v, float):
        return ("~",) if math.isnan(v) else (repr(v),)
    return (repr(v),)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql, show=3):
    """Empty text if equal."""
    cur = con.execute(sql)
    cols_d = [d[0] for d in cur.description]
    rows_d = cur.fetchall()
    cols_s, rows_s = canon(df.columns, [tuple(r) for r in df.collect()])
    cols_d, rows_d = canon(cols_d, rows_d)
    if cols_s != cols_d:
        return f"columns {cols_s} vs {cols_d}"
    if len(rows_s) != len(rows_d):
        return f"rows {len(rows_s)} vs {len(rows_d)}"
    bad = [(a, b) for a, b in zip(rows_s, rows_d) if a != b]
    if bad:
        out = [f"{len(bad)} of {len(rows_s)} rows differ; columns {cols_s}"]
        for a, b in bad[:show]:
            out.append(str([(c, x[0], y[0]) for c, x, y in zip(cols_s, a, b) if x != y]) + f" in {a}")
        return "\n".join(out)
    return ""
