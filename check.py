"""Runs registered queries against their SQL in DuckDB and compares values: ``python check.py [sf] [name ...]``."""

import hashlib
import sys
import time

import duckdb
import pandas as pd

from newsframe.session import local_session
from queries import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def digest(frame: pd.DataFrame) -> str:
    frame = frame.reindex(sorted(frame.columns), axis=1)
    rows = sorted("|".join("" if value is None or value is pd.NA or value != value else str(value) for value in row)
                  for row in frame.itertuples(index=False, name=None))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    folder = f"/root/testdata/sf{sf}"
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            mine = QUERIES[name](spark, folder).toPandas()
            spent = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name}: {len(mine)} rows, {spent:.1f}s", flush=True)
                continue
            start = time.time()
            theirs = con.execute(ORACLES[name]).df()
            same = sorted(mine.columns) == sorted(theirs.columns) and len(mine) == len(theirs) and digest(mine) == digest(theirs)
            bad += not same
            print(f"{'ok   ' if same else 'DIFF '} {name}: {len(mine)}/{len(theirs)} rows, {spent:.1f}s, SQL {time.time() - start:.1f}s",
                  flush=True)
            if not same:
                print("   types", dict(mine.dtypes), dict(theirs.dtypes))
                columns = sorted(set(mine.columns) & set(theirs.columns))
                a = mine[columns].astype(str).sort_values(columns).reset_index(drop=True)
                b = theirs[columns].astype(str).sort_values(columns).reset_index(drop=True)
                size = min(len(a), len(b))
                differ = (a[:size] != b[:size]).any(axis=1)
                for at in list(differ[differ].index[:3]):
                    print("   mine  ", str(a.loc[at].to_dict())[:1200])
                    print("   theirs", str(b.loc[at].to_dict())[:1200])
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            bad += 1
            print(f"FAIL  {name}: {type(error).__name__}: {str(error)[:1500]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
