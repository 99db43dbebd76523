"""Run queries next to their SQL and compare rows.  ``python tests/oracle.py [sf] [names...]``"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return ("decimal", value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return ("date", str(value))
    return value


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    made = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(made, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(con, df, sql: str) -> str:
    """Empty when equal, else what differs."""
    names, mine = _sorted([tuple(r) for r in df.collect()], df.columns)
    found = con.execute(sql)
    theirs_names, theirs = _sorted(found.fetchall(), [d[0] for d in found.description])
    if names != theirs_names:
        return f"columns {names} != {theirs_names}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(bad)} of {len(mine)} rows differ, e.g. {bad[0]}" if bad else ""


def main() -> None:
    import __spark_entry__ as contract
    from tablewright.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, checks = contract.queries(), contract.oracle_sql()
    wrong = []
    after = next((n[6:] for n in names if n.startswith("after:")), None)
    if after:
        every = list(queries)
        names = every[every.index(after) + 1 :]
    for name in names or queries:
        begin = time.time()
        try:
            df = queries[name](spark, folder)
            if name in checks:
                note = compare(con, df, checks[name])
                note = f"WRONG {note}" if note else "ok"
            else:
                note = f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            note = f"WRONG error {type(error).__name__}: {str(error)[:700]}"
        if note.startswith("WRONG"):
            wrong.append(name)
        print(f"{name:32s} {time.time() - begin:6.2f}s  {note[:1200]}", flush=True)
    print(f"{len(names or queries) - len(wrong)} good, {len(wrong)} wrong: {wrong}")


if __name__ == "__main__":
    main()
