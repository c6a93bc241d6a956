"""Run registered queries beside their SQL twins and compare the rows.

    python -m tests.oracle [names...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SF = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def connect(path: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return repr(v)
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, else what differs."""
    got_cols = df.columns
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        extra = [r for r in got[:3000] if r not in set(want)][:2]
        return f"{len(got)} rows, expected {len(want)}; e.g. got {got[:2]} want {want[:2]} extra {extra}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}"
    return None


def main(names):
    from gleaner import plans
    from gleaner.session import local_session

    plans.load_all()
    spark = local_session("8")
    con = connect(SF)
    failed = []
    for name, fn in plans.QUERIES.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, SF)
            if name in plans.ORACLES:
                why = compare(df, con, plans.ORACLES[name])
                n = "ok" if why is None else why
            else:
                n, why = f"rows {df.count()}", None
        except Exception as e:  # noqa: BLE001 - report and go on
            why = n = f"{type(e).__name__}: {str(e)[:600]}"
        if why:
            failed.append(name)
        print(f"{'FAIL' if why else 'ok  '} {name} {time.time() - t0:.2f}s {n if why or n != 'ok' else ''}", flush=True)
    print(len(failed), "failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
