"""CLI: python tests/run_oracle.py [sf_dir] [key ...] -- compare Spark with the oracle."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_compare import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from flowscore.session import get_spark  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    spark = get_spark()
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for k in keys or sorted(qs):
        t0 = time.time()
        try:
            sp = qs[k](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:400]}")
            traceback.print_exc(limit=3)
            continue
        t1 = time.time()
        if k not in sql:
            print(f"ROWS {k}: {len(sp)} rows (no oracle) {t1 - t0:.1f}s")
            continue
        try:
            dk = con.execute(sql[k]).fetchdf()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {k}: duckdb error {str(e)[:400]}")
            continue
        diff = compare(sp, dk)
        if diff:
            bad += 1
            print(f"FAIL {k}: {diff}")
        else:
            print(f"OK   {k}: {len(sp)} rows spark {t1 - t0:.1f}s")
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
