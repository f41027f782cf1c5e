"""Compare every query with its SQL: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from .views import TABLES


def session(cores: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("checks")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)

    def cell(v):
        if v is None or (not isinstance(v, (list, tuple, dict)) and pd.isna(v)):
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, bool):
            return v
        if isinstance(v, float):
            return round(v, 6)
        return str(v) if isinstance(v, list) else v
    rows = [tuple(cell(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def main(argv: list[str]) -> int:
    from .all import ORACLES, QUERIES
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con, bad = session(), connect(sf), 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}")
            continue
        took = time.time() - start
        if name not in ORACLES:
            print(f"ROWS  {name}: {len(got)} rows {took:.1f}s")
            continue
        try:
            want = con.execute(ORACLES[name]).df()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"SQL   {name}: {str(e)[:700]}")
            con = connect(sf)  # a fatal error of the other engine ends its connection
            continue
        (gc, gr), (wc, wr) = canonical(got), canonical(want)
        kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in gc if c in want and len(got) and got[c].dtype.kind != want[c].dtype.kind}
        if gc == wc and gr == wr:
            print(f"ok    {name}: {len(gr)} rows {took:.1f}s {kinds or ''}")
        else:
            bad += 1
            print(f"DIFF  {name}: cols {gc} vs {wc}; rows {len(gr)} vs {len(wr)} {kinds or ''}")
            shown = 0
            for a in gr:
                if a not in wr and shown < 3:
                    print("   spark:", a)
                    shown += 1
            shown = 0
            for b in wr:
                if b not in gr and shown < 3:
                    print("   sql:  ", b)
                    shown += 1
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
