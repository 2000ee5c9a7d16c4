"""Side-by-side check of registered queries and their SQL on one folder of tables.

Usage: python tests/check.py <folder> [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if hasattr(value, "item"):
        return _cell(value.item())
    return value


def frame(pdf):
    names = sorted(pdf.columns)
    columns = [[_cell(v) for v in pdf[n].tolist()] for n in names]
    return names, list(zip(*columns)) if columns else []


def key(row):
    return tuple((v is None, str(type(v).__name__ in ("int", "float", "bool")), v if isinstance(v, str) else "",
                  round(float(v), 3) if isinstance(v, (int, float)) else 0.0, str(v)) for v in row)


def compare(spark_pdf, duck_pdf) -> list[str]:
    problems = []
    names, left = frame(spark_pdf)
    other, right = frame(duck_pdf)
    if names != other:
        return [f"columns differ: {sorted(set(names) ^ set(other))}"]
    for n in names:
        a, b = str(spark_pdf[n].dtype), str(duck_pdf[n].dtype)
        if a != b:
            problems.append(f"dtype {n}: {a} / {b}")
    if len(left) != len(right):
        return problems + [f"row count {len(left)} / {len(right)}"]
    exact = sorted(map(str, left)) == sorted(map(str, right))
    if exact:
        return problems
    left, right = sorted(left, key=key), sorted(right, key=key)
    bad = 0
    for a, b in zip(left, right):
        for n, x, y in zip(names, a, b):
            same = x == y
            if not same and isinstance(x, (int, float)) and isinstance(y, (int, float)):
                same = abs(x - y) <= 1e-9 * max(1, abs(x))
            if not same:
                bad += 1
                if bad <= 4:
                    problems.append(f"value {n}: {x!r} / {y!r} in {dict(zip(names, a))}"[:400])
    if bad:
        problems.append(f"{bad} cells differ in {len(left)} rows")
    return problems


def main(folder: str, wanted: list[str]) -> int:
    from shelfline.plans import ORACLES, QUERIES, load_all
    from shelfline.session import build_session

    load_all()
    spark = build_session(master="local[8]", shuffle_partitions=8, driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in wanted or list(QUERIES):
        start = time.time()
        try:
            got = QUERIES[name](spark, folder).toPandas()
            mid = time.time()
            if name in ORACLES:
                problems = compare(got, con.execute(ORACLES[name]).df())
            else:
                problems = []
            tag = "OK " if not problems else "BAD"
            note = "" if name in ORACLES else "(rows only)"
            print(f"{tag} {name:32s} rows={len(got):8d} spark={mid - start:6.2f}s sql={time.time() - mid:6.2f}s {note}")
            for p in problems:
                print("     ", p)
            failed += bool(problems)
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"ERR {name}: {type(error).__name__}: {str(error)[:1500]}")
        sys.stdout.flush()
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
