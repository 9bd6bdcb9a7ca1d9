"""Runs registered queries next to their SQL oracles: python tests/check_oracle.py [folder] [key ...]."""

from __future__ import annotations

import datetime
import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from eventcast import catalog  # noqa: E402
from eventcast.session import build_session  # noqa: E402

SPARK_TO_SQL = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                "date": "DATE", "boolean": "BOOLEAN"}


def open_tables(folder: str):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.date().isoformat() if value.time() == datetime.time() else value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return repr(value)


def compare(df, con, sql) -> str:
    names = sorted(df.columns)
    types = dict(df.dtypes)
    result = con.execute(sql)
    found = {d[0]: str(d[1]) for d in result.description}
    if sorted(found) != names:
        return f"columns {names} against {sorted(found)}"
    wrong = [c for c in names if SPARK_TO_SQL.get(types[c]) != found[c]]
    if wrong:
        return f"types {[(c, types[c], found[c]) for c in wrong]}"
    order = [list(found).index(c) for c in names]
    theirs = sorted(tuple(normal(r[i]) for i in order) for r in result.fetchall())
    ours = sorted(tuple(normal(r[c]) for c in names) for r in df.collect())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} against {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            n = sum(x != y for x, y in zip(ours, theirs))
            return f"{n} rows differ, first {a} against {b}"
    return f"ok {len(ours)}"


def main() -> int:
    args = sys.argv[1:]
    folder = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    keys = [a for a in args if "/" not in a]
    spark = build_session("oracle", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(folder)
    oracles = catalog.oracle_sql()
    bad = 0
    for key, build in catalog.queries().items():
        if keys and not any(key.startswith(k) for k in keys):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            outcome = compare(df, con, oracles[key]) if key in oracles else f"rows {len(df.collect())}"
            failed = key in oracles and not outcome.startswith("ok")
        except Exception as error:  # report and go on with the next query
            outcome, failed = f"ERROR {str(error)[:600]}", True
            if len(keys) == 1:
                traceback.print_exc()
        bad += failed
        print(f"{'FAIL' if failed else 'pass'} {key} {time.time() - start:.2f}s {outcome}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
