"""Compare registered queries with their SQL on one data folder.

    python tools/check_queries.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rankforge.plans import REGISTRY  # noqa: E402
from rankforge.session import get_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()



def sort_key(row: tuple) -> tuple:
    return tuple((v is None, f"{v:.6f}" if isinstance(v, float) else str(v)) for v in row)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    query = REGISTRY[name]
    began = time.time()
    df = query.run(spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    took = time.time() - began
    if query.sql is None:
        return bool(got), f"{took:6.1f}s rows={len(got)} (no SQL)"
    began = time.time()
    result = con.execute(query.sql)
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in columns] if sorted(names) == columns else None
    if order is None:
        return False, f"columns {columns} != {sorted(names)}"
    want = [tuple(r[i] for i in order) for r in result.fetchall()]
    sql_took = time.time() - began
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(sorted(got, key=sort_key), sorted(want, key=sort_key))
           if not all(same(x, y) for x, y in zip(g, w))]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, e.g. {columns}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"[:900]
    return True, f"{took:6.1f}s sql {sql_took:5.1f}s rows={len(got)}"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    failed = 0
    for name in names:
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")


if __name__ == "__main__":
    main()
