"""Run registered queries and their SQL side by side: ``python tests/oracle.py FOLDER [name …]``."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, int) and not isinstance(value, bool):
        return value
    return value


def _rows(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


def from_sql(con, sql: str):
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    return _rows(names, result.fetchall())


def from_spark(df):
    return _rows(df.columns, df.collect())


def main() -> int:
    import __spark_entry__ as driver
    from deckweave.session import local_session

    folder, wanted = sys.argv[1], set(sys.argv[2:])
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), driver.oracle_sql(), 0
    for name, run in driver.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            got = from_spark(run(spark, folder))
        except Exception as failure:
            bad += 1
            print(f"FAIL  {name}: {str(failure)[:600]}", flush=True)
            continue
        spent = time.time() - start
        try:
            expected = from_sql(con, sql[name])
        except Exception as failure:
            bad += 1
            print(f"SQL   {name}: {str(failure)[:600]}", flush=True)
            continue
        same = got == expected
        bad += not same
        print(f"{'ok   ' if same else 'DIFF '} {name} {len(got[1])} rows {spent:.2f}s", flush=True)
        if not same:
            print("   columns", got[0], expected[0], "rows", len(got[1]), len(expected[1]))
            for one, two in [(a, b) for a, b in zip(got[1], expected[1]) if a != b][:3]:
                print("   spark", str(one)[:400])
                print("   sql  ", str(two)[:400])
    return bad


if __name__ == "__main__":
    sys.exit(main())
