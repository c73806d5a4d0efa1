"""Compare every registered Spark query with its DuckDB oracle.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Checks column names, Spark vs DuckDB types, row counts and the sorted values
(order-insensitive), like the driver's correctness gate.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

TYPE_MAP = {
    "DoubleType": "DOUBLE", "LongType": "BIGINT", "IntegerType": "INTEGER",
    "StringType": "VARCHAR", "DateType": "DATE", "BooleanType": "BOOLEAN",
}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, repr(v))
    if hasattr(v, "isoformat"):
        return (1, v.isoformat()[:10])
    return (1, str(v))


def compare(spark, con, sf_dir: str, key: str, q, sql: str | None) -> dict:
    t0 = time.time()
    sdf = q(spark, sf_dir)
    cols = sdf.columns
    srows = [tuple(_norm(r[c]) for c in sorted(cols)) for r in sdf.collect()]
    t1 = time.time()
    out = {"key": key, "rows_spark": len(srows), "sec_spark": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    rel = con.sql(sql)
    dcols = rel.columns
    dtypes = {c: str(t) for c, t in zip(dcols, rel.types)}
    drows_raw = rel.fetchall()
    idx = {c: i for i, c in enumerate(dcols)}
    out["rows_oracle"] = len(drows_raw)
    if sorted(cols) != sorted(dcols):
        out["status"] = f"COLUMNS differ: spark={sorted(cols)} oracle={sorted(dcols)}"
        return out
    bad_types = []
    for f in sdf.schema.fields:
        want = TYPE_MAP.get(type(f.dataType).__name__, type(f.dataType).__name__)
        if dtypes[f.name] != want:
            bad_types.append((f.name, want, dtypes[f.name]))
    drows = [tuple(_norm(r[idx[c]]) for c in sorted(cols)) for r in drows_raw]
    if len(srows) != len(drows):
        out["status"] = "ROWCOUNT differs"
    elif sorted(srows) != sorted(drows):
        s_only = sorted(set(srows) - set(drows))[:3]
        d_only = sorted(set(drows) - set(srows))[:3]
        out["status"] = f"VALUES differ; spark-only {s_only} oracle-only {d_only}"
    else:
        out["status"] = "ok"
    if bad_types:
        out["status"] += f" TYPES {bad_types}"
    return out


def main(argv):
    import __spark_entry__ as E
    from tiltkit.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    spark = local_session(8, 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for k in keys or list(qs):
        try:
            r = compare(spark, con, sf_dir, k, qs[k], sqls.get(k))
        except Exception as e:  # noqa: BLE001
            r = {"key": k, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        print(r, flush=True)
        bad += not (r["status"] in ("ok", "rows-only"))
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
