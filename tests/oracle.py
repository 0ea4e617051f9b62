"""Runs a registered query in Spark and in DuckDB and compares the rows."""

from __future__ import annotations

import sys
import time

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

#: Columns that are null by contract where a row has no such thing.
NULL_BY_CONTRACT = {"rank", "refers_to"}


def _value(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


def _rows(frame):
    names = sorted(frame.column_names)
    columns = [[_value(v) for v in frame[n].to_pylist()] for n in names]
    return names, sorted(zip(*columns), key=repr)


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf) -> str | None:
    """None when both agree, else a description of the difference."""
    ours = fn(spark, sf).toArrow()
    if sql is None:
        return None if len(ours) else "no rows"
    theirs = con.execute(sql).to_arrow_table()
    a_names, a = _rows(ours)
    b_names, b = _rows(theirs)
    if a_names != b_names:
        return f"columns {a_names} vs {b_names}"
    if len(a) != len(b):
        return f"{len(a)} vs {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {a_names} {bad[0]}"
    types = [(n, str(ours[n].type), str(theirs[n].type)) for n in a_names]
    other = [t for t in types if t[1] != t[2] and "string" not in t[1]]
    if other:
        return f"types {other}"
    nullable = [n for n in a_names if n not in NULL_BY_CONTRACT and ours[n].null_count and not pa.types.is_string(ours[n].type)]
    return f"NULLs in {nullable}" if nullable else None


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry_module
    from kinetable.session import local_session

    sf = f"/root/testdata/{sys.argv[1]}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    oracles = entry_module.oracle_sql()
    for name, fn in entry_module.queries().items():
        if len(sys.argv) > 2 and not any(p in name for p in sys.argv[2:]):
            continue
        began = time.time()
        try:
            problem = compare(spark, con, name, fn, oracles.get(name), sf)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - began:.1f}s {problem or ''}", flush=True)
