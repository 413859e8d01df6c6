"""python tests/compare.py DIR [NAME_PREFIX...]: runs queries against their SQL and prints what differs."""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]
import __spark_entry__ as entry
from oracle import same

from chronoweave.session import build_session

spark = build_session()
spark.sparkContext.setLogLevel("ERROR")
sql = entry.oracle_sql()
bad = 0
for name, f in entry.queries().items():
    if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
        continue
    began = time.time()
    try:
        df = f(spark, sys.argv[1])
        what = same(df, sql[name], sys.argv[1]) if name in sql else f"(no SQL) {df.count()} rows"
    except Exception as e:
        what = f"ERROR {type(e).__name__}: {str(e)[:900]}"
    ok = what == "" or what.startswith("(no SQL)")
    bad += not ok
    print(f"{'ok  ' if ok else 'BAD '} {name} {time.time() - began:.1f}s {what[:1200]}", flush=True)
print("bad:", bad)
