"""Run every registered query next to its SQL and compare: ``python tests/check_oracle.py [folder] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, round(v, 1) if isinstance(v, float) else str(v)) for v in row)


def compare(spark: SparkSession, con, folder: str, name: str) -> str | None:
    """None if the query and its SQL agree, else what differs."""
    df = queries()[name](spark, folder)
    sql = oracle_sql().get(name)
    names = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    if sql is None:
        return None if mine else "no rows"
    cur = con.execute(sql)
    theirs_names = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    theirs = cur.fetchall()
    if sorted(theirs_names) != names:
        return f"columns {names} / {sorted(theirs_names)}"
    at = [theirs_names.index(c) for c in names]
    theirs = [tuple(r[i] for i in at) for r in theirs]
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    if not mine:
        return "no rows"
    mine, theirs = sorted(mine, key=key), sorted(theirs, key=key)
    notes = [f"type {c}: {t} / {types[c]}" for c, t in df.dtypes if KINDS.get(t) != types[c].replace("NUMBER", "DOUBLE")]
    for a, b in zip(mine, theirs):
        for c, x, y in zip(names, a, b):
            same = (x == y) or (isinstance(x, float) and y is not None and math.isclose(x, float(y), rel_tol=1e-12, abs_tol=1e-9))
            if not same:
                return f"{c}: {x!r} / {y!r} in {dict(zip(names, a))} / {dict(zip(names, b))}"[:700]
    return "; ".join(notes)[:300] if notes else None


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    if "CHUNK_ROWS" in os.environ:  # force the split layout
        spark.conf.set("spark.tidalspan.chunkRows", os.environ["CHUNK_ROWS"])
    con = connect(folder)
    bad = 0
    for name in sys.argv[2:] or queries():
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} differ", flush=True)


if __name__ == "__main__":
    main()
