"""Run registered queries next to their SQL: python -m checks.compare [sf_dir] [name ...]"""

import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def oracle(folder: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con.execute(sql).df()


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return float(v) if float(v) != 0 else 0.0
        return str(v)

    rows = [tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} != {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    a, b = canonical(mine), canonical(theirs)
    off = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(off)} rows differ, first {off[0]}" if off else None


def main() -> None:
    from checks import REGISTRY
    from trackloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name in names:
        query, sql = REGISTRY[name]
        start = time.time()
        try:
            mine = query(spark, folder).toPandas()
            spent = time.time() - start
            problem = differences(mine, oracle(folder, sql)) if sql else None
        except Exception as error:  # report every query, then fail
            spent, problem, mine = time.time() - start, f"{type(error).__name__}: {str(error)[:1500]}", []
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={len(mine)} {spent:.1f}s"
              f"{'' if sql else ' (rows only)'} {problem or ''}", flush=True)
        failed += [name] if problem else []
    print("failed:", failed)
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
