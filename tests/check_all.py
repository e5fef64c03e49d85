"""Command line: compare every registered query with its SQL twin.

    python tests/check_all.py [sf_dir] [name prefix ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest import make_session  # noqa: E402
from oracle import connect, difference, spark_result, sql_result  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = make_session()
    con = connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            t = time.time()
            got = spark_result(fn(spark, sf_dir))
            t1 = time.time() - t
            t = time.time()
            diff = difference(got, sql_result(con, sqls[name])) if name in sqls else "no sql"
            t2 = time.time() - t
            if diff and diff != "no sql":
                bad += 1
            empty = " EMPTY" if not got[1] else ""
            print(f"{'ok ' if not diff else '-- '} {name} rows={len(got[1])}{empty} spark={t1:.2f}s sql={t2:.2f}s {(diff or '')[:1500]}", flush=True)
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"ERR {name} {type(e).__name__}: {str(e)[:900]}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
