"""Run registered queries beside their SQL in DuckDB and report differences."""

import math
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, query, sql):
    """None if equal, else what differs."""
    found = query(spark, sf_dir)
    names = sorted(found.columns)
    got = normal(tuple(r) for r in found.select(*[f"`{n}`" for n in names]).collect())
    want = con.sql(sql)
    if sorted(want.columns) != names:
        return f"columns {names} against {sorted(want.columns)}"
    order = [want.columns.index(n) for n in names]
    rows = normal(tuple(r[i] for i in order) for r in want.fetchall())
    if got != rows:
        return f"{len(got)} against {len(rows)} rows; first difference " + next((f"{a} | {b}" for a, b in zip(got, rows) if a != b), "in length")[:300]
    return None


if __name__ == "__main__":
    import time

    sys.path[:0] = ["/root/repo"]
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    con = duck(sf)
    sqls = entry.oracle_sql()
    for name, q in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        if len(sys.argv) == 2 and (name.startswith("op") or name == "pipeline"):
            continue
        t = time.time()
        try:
            said = compare(spark, con, sf, q, sqls[name]) if name in sqls else f"rows {len(q(spark, sf).collect())}"
        except Exception as e:
            said = f"ERROR {str(e)[:400]}"
        print(f"\n{name}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
