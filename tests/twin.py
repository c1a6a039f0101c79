"""Run a registered query and its SQL twin on the same tables and compare."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def twin_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def differences(spark_df, con, sql: str, limit: int = 4) -> list[str]:
    """Empty when both sides return the same columns and the same bag of rows."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    right_rows = rel.fetchall()
    left_names = spark_df.columns
    if sorted(names) != sorted(left_names):
        return [f"columns differ: spark {sorted(left_names)} sql {sorted(names)}"]
    order = sorted(names)
    li, ri = [left_names.index(n) for n in order], [names.index(n) for n in order]
    left = Counter(tuple(plain(r[i]) for i in li) for r in spark_df.collect())
    right = Counter(tuple(plain(r[i]) for i in ri) for r in right_rows)
    if left == right:
        types = {n: {type(v).__name__ for row in left for n2, v in zip(order, row) if n2 == n and v is not None} for n in order}
        rtypes = {n: {type(v).__name__ for row in right for n2, v in zip(order, row) if n2 == n and v is not None} for n in order}
        bad = [f"{n}: {types[n]} vs {rtypes[n]}" for n in order if types[n] != rtypes[n]]
        return [f"types differ: {bad}"] if bad else []
    out = [f"rows: spark {sum(left.values())} sql {sum(right.values())}; columns {order}"]
    only_left, only_right = left - right, right - left
    out.append(f"only spark {sum(only_left.values())}, only sql {sum(only_right.values())}")
    out += [f"  spark {r}" for r in sorted(only_left, key=repr)[:limit]]
    out += [f"  sql   {r}" for r in sorted(only_right, key=repr)[:limit]]
    return out
