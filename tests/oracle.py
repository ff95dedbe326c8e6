"""Run registered queries next to their SQL: python tests/oracle.py [sf] [name …]."""

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())


def sql_rows(text, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    con.execute("SET TimeZone='UTC'")
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    order = [names.index(c) for c in cols]
    return cols, Counter(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())


def compare(spark, name, folder):
    """None when equal, else a short account of the difference."""
    got_cols, got = spark_rows(queries()[name](spark, folder))
    if name not in oracle_sql():
        return None if got else "no rows"
    want_cols, want = sql_rows(oracle_sql()[name], folder)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got == want:
        kinds = [{type(v) for r in side for v in (r[i],) if v is not None}
                 for i in range(len(got_cols)) for side in (got, want)]
        for i, c in enumerate(got_cols):
            if kinds[2 * i] != kinds[2 * i + 1]:
                return f"types of {c}: {kinds[2 * i]} != {kinds[2 * i + 1]}"
        return None if got else "no rows"
    extra, missing = got - want, want - got
    return (f"{sum(got.values())} rows vs {sum(want.values())}; only spark {sum(extra.values())}: "
            f"{list(extra)[:2]}; only sql {sum(missing.values())}: {list(missing)[:2]}")


if __name__ == "__main__":
    from gridspark.runtime import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    session = local_session("8")
    bad = 0
    for q in sys.argv[2:] or queries():
        t0 = time.time()
        try:
            note = compare(session, q, f"/root/testdata/sf{sf}")
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:600]}"
        bad += note is not None
        kind = "sql" if q in oracle_sql() else "rows"
        print(f"{'ok ' if note is None else 'BAD'} {q:24s} {kind:4s} {time.time() - t0:6.2f}s {note or ''}", flush=True)
    print("bad:", bad)
