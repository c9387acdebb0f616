"""Run named queries against DuckDB from the shell: try_queries.py [--sf 0.01] [prefix ...]"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])
import __spark_entry__ as e
from oracle import connect, mismatch
from sparktile.session import get_spark

args = sys.argv[1:]
sf = "0.01"
if args[:1] == ["--sf"]:
    sf, args = args[1], args[2:]
d = f"/root/testdata/sf{sf}"
spark = get_spark(master="local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="8g")
spark.sparkContext.setLogLevel("ERROR")
con = connect(d)
bad = 0
for name, fn in e.queries().items():
    if args and not any(name.startswith(a) for a in args):
        continue
    t0 = time.time()
    try:
        df = fn(spark, d)
        sql = e.oracle_sql().get(name)
        res = mismatch(df, con, sql) if sql else f"rows {df.count()}"
    except Exception as x:  # noqa: BLE001
        res = "ERROR " + str(x)[:1500]
    bad += bool(res) and not (res or "").startswith("rows ") or "!=" in (res or "")
    print(f"{name:32s} {time.time() - t0:6.2f}s {res or 'ok'}", flush=True)
print("bad", bad)
