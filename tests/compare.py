"""Compare registered queries with their SQL twins on DuckDB."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def kind(dtype) -> str:
    return {"i": "int", "u": "int", "f": "float", "b": "bool"}.get(dtype.kind, "text")


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    got, want = canon(got), canon(want)
    for c in got.columns:
        if kind(got[c].dtype) != kind(want[c].dtype) and len(got) and not (got[c].isna().any() or want[c].isna().any()):
            return f"type of {c}: {got[c].dtype} vs {want[c].dtype}"
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if not same.all():
            i = int((~same).to_numpy().argmax())
            return f"{(~same).sum()} values differ in {c}, e.g.\n{got.iloc[[i]].to_string()}\n{want.iloc[[i]].to_string()}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from pulsegrid.session import build_session

    sf = os.environ.get("SF", "0.01")
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = sys.argv[1:]
    spark = build_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            t1 = time.time()
            sql = oracle_sql().get(name)
            if sql is None:
                print(f"rows {name} {len(got)} {t1 - t0:.1f}s", flush=True)
                continue
            why = difference(got, con.execute(sql).df())
            note = f"{len(got)} rows {t1 - t0:.1f}s sql {time.time() - t1:.1f}s"
        except Exception as e:  # noqa: BLE001
            why, note = str(e)[:1500], ""
        if why:
            bad += 1
            print(f"BAD  {name} {note}: {why}", flush=True)
        else:
            print(f"ok   {name} {note}" + ("" if len(got) else "  EMPTY"), flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
