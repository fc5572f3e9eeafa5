"""python tools/compare_plans.py [folder]: the two internal comparisons that matter most.

1. POI distance and counts: all pairs, our cells broadcast, our cells shuffled, for two POI tables.
2. Profiling four columns: all statistics in shared passes against one scan per statistic.
"""

import sys
import time

sys.path[:0] = ["."]

from pyspark.sql import functions as F  # noqa: E402

from lotwise.functions.geo import haversine_m  # noqa: E402
from lotwise.operators.profile import describe  # noqa: E402
from lotwise.operators.spatial import poi_features  # noqa: E402
from lotwise.queries.base import table, with_place  # noqa: E402
from lotwise.session import build_session  # noqa: E402

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def seconds(run) -> float:
    best = None
    for _ in range(3):
        start = time.perf_counter()
        run()
        spent = time.perf_counter() - start
        best = spent if best is None or spent < best else best
    return best


def drop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "20g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    listings = with_place(table(spark, folder, "customer"), "c_custkey").select("c_custkey", "lat", "lon")
    for name, key in (("supplier", "s_suppkey"), ("part", "p_partkey")):
        poi = with_place(table(spark, folder, name), key).select(F.lit("x").alias("category"), "lat", "lon")
        pairs = listings.crossJoin(F.broadcast(poi.select(F.col("lat").alias("plat"), F.col("lon").alias("plon"))))
        metres = haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
        naive = pairs.groupBy("c_custkey").agg(F.min(metres), F.count_if(metres <= 500))
        print(f"{poi.count()} POIs, all pairs        {seconds(lambda: drop(naive)):7.2f} s", flush=True)
        for label, limit in (("cells, broadcast", 10**9), ("cells, shuffled", 0)):
            spent = seconds(lambda: drop(poi_features(listings, poi, {"x": 500}, broadcast_bytes=limit)))
            print(f"{poi.count()} POIs, {label:16s} {spent:7.2f} s", flush=True)
    li = table(spark, folder, "lineitem")
    shared = seconds(lambda: drop(describe(li, COLS)))

    def one_by_one():
        for c in COLS:
            for f in (F.count, F.avg, F.stddev_samp, F.min, F.max):
                li.agg(f(c)).collect()
            for p in (0.25, 0.5, 0.75):
                li.agg(F.percentile(c, F.lit(p))).collect()

    print(f"describe, shared passes  {shared:7.2f} s")
    print(f"describe, one scan each  {seconds(one_by_one):7.2f} s")


main()
