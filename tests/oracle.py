"""Run a registered query in Spark and its oracle SQL in DuckDB; compare.

Mirrors the driver's check: row count, column names, and an
order-insensitive comparison of the values (columns sorted by name).
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9) + 0.0
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, dt.datetime):
        return v.date() if v.time() == dt.time(0) else v
    if isinstance(v, dt.date):
        return v
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    out = [tuple(_norm(v) for v in r) for r in pdf.itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    got = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    res = {"query": name, "rows": len(got), "spark_s": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    exp = con.execute(sql).df()
    res["duck_s"] = round(time.time() - t1, 2)
    if sorted(got.columns) != sorted(exp.columns):
        res["status"] = f"COLUMNS spark={sorted(got.columns)} duck={sorted(exp.columns)}"
        return res
    if len(got) != len(exp):
        res["status"] = f"ROWCOUNT spark={len(got)} duck={len(exp)}"
        return res
    a, b = rows(got), rows(exp)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    res["status"] = "ok" if not bad else f"VALUES {len(bad)} differ, e.g. {bad[:2]}"
    return res


def main(keys=None, sf_dir=os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from marketframe.session import local_session
    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for k in (keys or qs):
        try:
            r = compare(spark, con, k, qs[k], sqls.get(k), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"query": k, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        bad += r["status"] not in ("ok", "rows-only")
        print(r, flush=True)
    print("BAD", bad)


if __name__ == "__main__":
    main(sys.argv[1:] or None)
