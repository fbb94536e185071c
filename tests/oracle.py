"""Compare registered queries with their SQL in DuckDB: `python tests/oracle.py [sf] [names]`."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    keys = df.astype(str).agg("|".join, axis=1) if len(df.columns) else pd.Series(dtype=str)
    return df.iloc[keys.argsort(kind="stable")].reset_index(drop=True)


def types_of(con, sql: str) -> dict[str, str]:
    return {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(spark_df, con, sql: str) -> str | None:
    """None when rows, columns, types and values agree."""
    want_types = types_of(con, sql)
    have_types = {f.name: SAME.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema}
    have = ordered(spark_df.toPandas())
    want = ordered(con.execute(sql).fetch_df())
    if have_types != want_types:
        return f"types {sorted(set(have_types.items()) ^ set(want_types.items()))}"
    if len(have) != len(want):
        return f"rows {len(have)} != {len(want)}"
    for column in have.columns:
        a, b = have[column], want[column]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = same.idxmin()
            return f"{column} at {at}: {have.loc[at].to_dict()} != {want.loc[at].to_dict()} ({(~same).sum()} of {len(same)})"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from folioscope.session import drop_staged, local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session()
    con = connect(f"/root/testdata/{sf}")
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, f"/root/testdata/{sf}")
            if name in entry.oracle_sql():
                problem = difference(df, con, entry.oracle_sql()[name])
                state = "ok" if problem is None else f"DIFF {problem[:600]}"
            else:
                state = f"rows {df.count()}"
        except Exception as error:  # report and go on with the next query
            state = f"FAIL {type(error).__name__} {str(error)[:500]}"
            if len(sys.argv) > 2 and len(names) == 1:
                traceback.print_exc()
        drop_staged(spark)
        print(f"{name:24s} {time.time() - start:6.1f}s {state}", flush=True)


if __name__ == "__main__":
    main()
