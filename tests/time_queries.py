"""Time the Spark side of named queries: time_queries.py sf prefix..."""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])
import __spark_entry__ as e
from sparktile.session import get_spark

sf, names = sys.argv[1], sys.argv[2:]
spark = get_spark(master="local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="8g")
spark.sparkContext.setLogLevel("ERROR")
e.queries()["q_tile_grid"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
total = 0.0
for n, fn in e.queries().items():
    if names and not any(n.startswith(p) for p in names):
        continue
    t = time.time()
    fn(spark, f"/root/testdata/sf{sf}").write.format("noop").mode("overwrite").save()
    total += time.time() - t
    print(f"{n:32s} {time.time() - t:6.2f}", flush=True)
print("total", round(total, 1))
