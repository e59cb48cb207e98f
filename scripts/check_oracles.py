"""Run every registered query against its DuckDB oracle and print a summary.

usage: python scripts/check_oracles.py [sf_dir] [name ...]
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewater.registry import all_oracles, all_queries  # noqa: E402
from tidewater.session import build_session  # noqa: E402
from tidewater.verify.compare import compare, duckdb_connection  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb_connection(sf_dir)
    qs, os_ = all_queries(), all_oracles()
    bad = 0
    for name in names or sorted(qs):
        t = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in os_:
                res = compare(df, con, os_[name])
            else:
                res = {"rows_spark": df.count(), "oracle": None}
        except Exception as e:  # report and continue
            res = {"error": f"{type(e).__name__}: {str(e)[:400]}"}
        res["sec"] = round(time.time() - t, 2)
        ok = res.get("values_match") or (res.get("oracle", 0) is None and "error" not in res)
        bad += not ok
        print(("OK  " if ok else "BAD ") + name, json.dumps(res, default=str)[:1500], flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} bad")


if __name__ == "__main__":
    main()
