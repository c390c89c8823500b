"""Compare named queries with their SQL twins: ``python tests/check_oracle.py [sf] [name-prefix ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from shardframe.plans import QUERIES  # noqa: E402
from shardframe.session import local_session  # noqa: E402

ROOT = "/root/testdata"


def connect(sf_dir: str):
    """A DuckDB connection with every table of the folder as a view."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """A comparable form of one cell."""
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows_of(columns, rows):
    """Rows with columns in name order, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def kind(dtype: str) -> str:
    """A type class both engines share."""
    d = dtype.lower()
    return {"string": "varchar", "long": "bigint", "int": "integer", "timestamp_ntz": "timestamp", "binary": "blob"}.get(d, d)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    """Run one query both ways."""
    q = QUERIES[name]
    t0 = time.time()
    df = q.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if q.sql is None:
        return bool(got), f"{len(got)} rows, no SQL, {took:.1f}s"
    rel = con.sql(q.sql)
    types = dict(zip(rel.columns, [kind(str(t)) for t in rel.types]))
    mine = {c: kind(t) for c, t in df.dtypes}
    if sorted(types) != sorted(mine):
        return False, f"columns {sorted(mine)} vs {sorted(types)}"
    want = rel.fetchall()
    a, b = rows_of(df.columns, got), rows_of(list(rel.columns), want)
    notes = [f"{c}: {mine[c]} vs {types[c]}" for c in mine if mine[c] != types[c]]
    if a != b:
        diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return False, f"{len(a)} vs {len(b)} rows, first difference {sorted(mine)} {str(diff)[:700]} {notes}"
    return bool(a), f"{len(a)} rows equal, {took:.1f}s {'; '.join(notes)}"


def main() -> None:
    """Command line."""
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"{ROOT}/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name in QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main()
