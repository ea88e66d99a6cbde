"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name-regex]
"""
from __future__ import annotations

import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pat = re.compile(sys.argv[2]) if len(sys.argv) > 2 else None
    from hearth.catalog import REGISTRY
    from hearth.catalog.oracle import compare, duck
    from hearth.session import get_spark
    spark = get_spark("local[8]", 8)
    con = duck(sf)
    bad = 0
    for name, e in REGISTRY.items():
        if pat and not pat.search(name):
            continue
        t0 = time.time()
        try:
            if e.sql is None:
                n = e.fn(spark, sf).count()
                print(f"rows  {name}: {n} rows ({time.time() - t0:.1f}s) [no oracle]")
                continue
            ok, msg = compare(spark, con, e, sf)
        except Exception as ex:  # noqa: BLE001
            ok, msg = False, f"error {type(ex).__name__}: {str(ex)[:300]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'}  {name}: {msg} ({time.time() - t0:.1f}s)")
    print(f"done, {bad} failing")
    spark.stop()


if __name__ == "__main__":
    main()
