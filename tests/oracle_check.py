"""Compare registered queries with their SQL oracles on given tables.

    python tests/oracle_check.py /root/testdata/sf0.01 [name-substring …]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import threading
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return f"{value:.6f}" if value != 0 else "0.000000"
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def compare(df, con, sql: str) -> tuple[bool, str]:
    cols = sorted(df.columns)
    stop = threading.Timer(float(os.environ.get("ORACLE_LIMIT", "90")), con.interrupt)
    stop.start()
    try:
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        types = {d[0]: str(d[1]) for d in cur.description}
        want_rows = cur.fetchall()
    finally:
        stop.cancel()
    if sorted(names) != cols:
        return False, f"columns {cols} != {sorted(names)}"
    bad = [
        (f.name, f.dataType.simpleString(), types[f.name])
        for f in df.schema.fields
        if TYPES.get(f.dataType.simpleString()) != types[f.name]
    ]
    idx = [names.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in idx) for r in want_rows)
    got = sorted(tuple(_norm(v) for v in r) for r in df.select(*cols).collect())
    if want != got:
        extra = [g for g in got if g not in set(want)][:3]
        missing = [w for w in want if w not in set(got)][:3]
        return False, f"rows {len(got)} vs {len(want)}; only spark {extra}; only oracle {missing}"
    if bad:
        return False, f"types {bad}"
    return True, f"{len(got)} rows"


def main() -> int:
    import __spark_entry__ as entry
    from naskah.session import get_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = get_session(cpus=8)
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                t1 = time.time()
                ok, note = compare(df, con, oracles[name])
            else:
                ok, note = True, f"{len(df.collect())} rows (rows only)"
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:500]}"
        failed += not ok
        flag = "" if not note.startswith("0 rows") else "  EMPTY"
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t0:6.2f}s {note}{flag}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
