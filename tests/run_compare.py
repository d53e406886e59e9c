"""``python tests/run_compare.py [sf_dir] [name ...]``: compare registered queries with their SQL."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from recordloom.session import build_session  # noqa: E402
from tests.compare import connect, difference  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sql = connect(sf_dir), queries(), oracle_sql()
    bad = 0
    for name in sys.argv[2:] or qs:
        start = time.time()
        try:
            result = difference(spark, con, name, sf_dir, qs, sql)
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:700]}"
        bad += result is not None
        print(f"{'ok  ' if result is None else 'DIFF'} {time.time() - start:6.2f}s {name}{'' if name in sql else ' (rows only)'} {result or ''}", flush=True)
    print(f"{bad} differ of {len(sys.argv[2:] or qs)}")


main()
