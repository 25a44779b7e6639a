"""Run registered queries beside their SQL and compare rows, columns and values."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, fn, sql):
    df = fn(spark, sf)
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got), None
    rel = con.execute(sql)
    want_cols, want = canonical([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return False, len(got), f"columns {got_cols} != {want_cols}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lack = [r for r in want if r not in set(got)][:3]
        return False, len(got), f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {lack}"
    return True, len(got), None


def main(sf: str, names: list[str]) -> int:
    from corpuslens.session import local_session
    from __spark_entry__ import oracle_sql, queries
    spark = local_session(8)
    con = duck(sf)
    q, o = queries(), oracle_sql()
    bad = 0
    for name in q:
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            ok, n, why = compare(spark, con, sf, q[name], o.get(name))
        except Exception as error:  # noqa: BLE001
            ok, n, why = False, -1, str(error)[:1500]
        bad += ok is False
        print(f"{'ok ' if ok else ('-- ' if ok is None else 'BAD')} {name} rows={n} {time.time() - start:.1f}s {why or ''}",
              flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
