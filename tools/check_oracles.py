"""Run every query on Spark and its SQL on DuckDB and compare the rows.

python tools/check_oracles.py [folder] [key prefix ...]
"""

from __future__ import annotations

import collections
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docloom.plans.oracles import ORACLES  # noqa: E402
from docloom.plans.queries import QUERIES  # noqa: E402
from docloom.session import local_session  # noqa: E402

KINDS = {
    "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER",
}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def compare(spark, con, folder: str, name: str) -> str:
    frame = QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    left = collections.Counter(tuple(plain(v) for v in row) for row in frame.select(*columns).collect())
    relation = con.sql(ORACLES[name])
    types = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    if sorted(types) != columns:
        return f"COLUMNS {columns} {sorted(types)}"
    wrong = [
        (f.name, f.dataType.simpleString(), types[f.name])
        for f in frame.schema.fields
        if KINDS.get(f.dataType.simpleString()) != types[f.name]
    ]
    order = [relation.columns.index(c) for c in columns]
    right = collections.Counter(tuple(plain(row[i]) for i in order) for row in relation.fetchall())
    if left != right:
        only_left, only_right = left - right, right - left
        return (
            f"ROWS {sum(left.values())} {sum(right.values())} differ {sum(only_left.values())}"
            f"\n   spark {sorted(only_left)[:2]}\n   sql   {sorted(only_right)[:2]}"
        )
    return f"ok {sum(left.values())} rows" + (f" TYPES {wrong}" if wrong else "")


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = database(folder)
    bad = 0
    for name in QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        if name not in ORACLES:
            print(f"{name:28s} no SQL")
            continue
        start = time.time()
        try:
            result = compare(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {str(error)[:600]}"
        bad += not result.startswith("ok")
        if not result.startswith("ok") or "TYPES" in result or prefixes:
            print(f"{name:28s} {time.time() - start:5.1f}s {result[:900]}", flush=True)
    print("not equal:", bad)


if __name__ == "__main__":
    main()
