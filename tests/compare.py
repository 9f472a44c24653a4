"""Run registered queries and their SQL side by side. Also a script: compare.py FOLDER [name ...]"""

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def duck(folder: str):
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cells = [tuple(plain(row[k]) for k in order) for row in rows]
    return [columns[k] for k in order], sorted(cells, key=repr)


def spark_rows(frame):
    return canonical(frame.columns, [tuple(r) for r in frame.collect()])


def duck_rows(con, sql):
    found = con.execute(sql)
    return canonical([d[0] for d in found.description], found.fetchall())


def main(folder: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__

    QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8") \
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC") \
        .config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, bad = duck(folder), 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            columns, rows = spark_rows(QUERIES[name](spark, folder))
        except Exception as error:  # noqa: BLE001  (report every query)
            bad += 1
            print(f"{name}: FAILED {str(error)[:600]}")
            continue
        taken = time.time() - start
        if name not in ORACLES:
            print(f"{name}: no SQL, {len(rows)} rows, {taken:.2f}s")
            continue
        try:
            expected = duck_rows(con, ORACLES[name])
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"{name}: SQL FAILED {str(error)[:600]}")
            continue
        if (columns, rows) == expected:
            print(f"{name}: ok, {len(rows)} rows, {taken:.2f}s")
            continue
        bad += 1
        odd = [r for r in rows if r not in set(expected[1])][:2] if len(rows) < 200000 else []
        missing = [r for r in expected[1] if r not in set(rows)][:2]
        print(f"{name}: DIFFERENT {len(rows)}/{len(expected[1])} {columns}/{expected[0]} {odd} {missing}"[:900])
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
