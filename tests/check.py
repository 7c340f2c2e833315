"""Run catalogue queries against their SQL in DuckDB: ``python tests/check.py [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, int):
        return v
    return str(v)


def compare(spark, con, fn, sql: str, folder: str) -> str:
    """Empty string when equal, else what differs."""
    df = fn(spark, folder)
    names = sorted(df.columns)
    got = Counter(tuple(_cell(row[n]) for n in names) for row in df.collect())
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    if sorted(cols) != names:
        return f"columns {names} against {sorted(cols)}"
    order = [cols.index(n) for n in names]
    want = Counter(tuple(_cell(row[i]) for i in order) for row in rel.fetchall())
    if got == want:
        return ""
    only_got, only_want = got - want, want - got
    return (
        f"rows {sum(got.values())} against {sum(want.values())}; columns {names}; "
        f"{sum(only_got.values())} rows differ, e.g. spark {sorted(only_got, key=repr)[:2]} "
        f"sql {sorted(only_want, key=repr)[:2]}"
    )


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from pathpulse.session import get_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = argv[1:] or list(queries)
    spark = get_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in wanted:
        began = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, queries[name], oracles[name], folder)
            else:
                problem = "" if queries[name](spark, folder).count() else "no rows"
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem)
        tag = "FAIL" if problem else ("ok" if name in oracles else "rows")
        print(f"{tag:5}{time.time() - began:7.2f}s  {name}  {problem}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} good")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
