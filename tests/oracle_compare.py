"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Mirrors the driver's gate: row count, column names (sorted) and an
order-insensitive hash of values (doubles rounded to 6 places).

    python tests/oracle_compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from snipflow.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        if r == 0:
            r = 0.0
        return repr(r)
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, int):
        return repr(float(v)) if abs(v) < 2**53 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]
    return [columns[i] for i in order], len(rows), h, lines


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def type_diffs(df, rel):
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
          for f in df.schema.fields}
    dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
    return [(c, st.get(c), dt.get(c)) for c in sorted(set(st) | set(dt)) if st.get(c) != dt.get(c)]


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as entry
    qs = entry.queries()
    oracles = entry.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        srows = [tuple(r) for r in df.collect()]
        scols = df.columns
        t1 = time.time()
        if name not in oracles:
            results[name] = ("rows-only", len(srows), round(t1 - t0, 2))
            if verbose:
                print(f"{name:40s} rows-only rows={len(srows)} {t1 - t0:.1f}s", flush=True)
            continue
        rel = con.sql(oracles[name])
        ocols = rel.columns
        orows = rel.fetchall()
        sc, sn, sh, sl = digest(scols, srows)
        oc, on, oh, ol = digest(ocols, orows)
        tdiff = type_diffs(df, rel)
        ok = sc == oc and sn == on and sh == oh and not tdiff and len(scols) == len(set(scols))
        results[name] = ("ok" if ok else "MISMATCH", sn, round(t1 - t0, 2))
        if verbose:
            print(f"{name:40s} {'ok' if ok else 'MISMATCH'} rows={sn}/{on} {t1 - t0:.1f}s",
                  flush=True)
            if not ok:
                if tdiff:
                    print("   types (spark, duckdb):", tdiff)
                if sc != oc:
                    print("   cols spark:", sc, "\n   cols duck: ", oc)
                a, b = set(sl), set(ol)
                for x in sorted(a - b)[:4]:
                    print("   spark only:", x[:300])
                for x in sorted(b - a)[:4]:
                    print("   duck only: ", x[:300])
    return results


if __name__ == "__main__":
    from snipflow.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = set(sys.argv[2:]) or None
    spark = get_spark("local[8]", 8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] == "MISMATCH"]
    print("mismatches:", bad)
    sys.exit(1 if bad else 0)
