import os
import re
import subprocess
import sys
import tempfile

from pyspark.sql import functions as F

from __spark_entry__ import queries
from lotwise.operators.spatial import poi_features
from lotwise.schemas import RAW_LISTINGS
from lotwise.sources.files import read_listings
from lotwise.streaming.landing import LandedKeys, canonical_sets, land_once, listing_stream
from lotwise.streaming.scoring import score_stream


def write(folder, name, rows):
    head = ",".join(RAW_LISTINGS.fieldNames())
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write("\n".join([head, *[f"R$ 1,Rua,x,1.0,1.0,1.0,{link},c,pr,{when}" for link, when in rows]]) + "\n")


def test_stream_landing_keeps_first_and_restarts(spark):
    src, out = (tempfile.mkdtemp(prefix="run-", dir="/tmp") for _ in range(2))

    def run():
        land_once(listing_stream(spark, src), ["link"], f"{out}/table", f"{out}/state")
        return sorted(r["link"] for r in spark.read.parquet(f"{out}/table").collect())

    write(src, "c_pr_pagina1.csv", [("a", "2026-02-09 08:00:00"), ("b", "2026-02-09 08:00:00"), ("a", "2026-02-09 08:10:00")])
    assert run() == ["a", "b"]
    write(src, "c_pr_pagina2.csv", [("b", "2026-02-09 08:20:00"), ("c", "2026-02-09 08:30:00")])
    assert run() == ["a", "b", "c"]
    write(src, "c_pr_pagina3.csv", [("late", "2020-01-01 00:00:00"), ("a", "2026-02-10 08:00:00")])
    assert run() == ["a", "b", "c", "late"]
    assert run() == ["a", "b", "c", "late"]


def test_stream_landing_keeps_the_first_row(spark):
    """The first row by page and place, as the batch reader keeps it, though a larger file is read first."""
    src, out = (tempfile.mkdtemp(prefix="run-", dir="/tmp") for _ in range(2))
    write(src, "c_pr_pagina2.csv", [("a", "2026-02-09 09:00:00"), *((f"x{i}", "2026-02-09 09:00:00") for i in range(500))])
    write(src, "c_pr_pagina1.csv", [("a", "2026-02-09 08:00:00"), ("b", "2026-02-09 08:00:00"), ("b", "2026-02-09 08:01:00")])
    land_once(listing_stream(spark, src), ["link"], f"{out}/table", f"{out}/state")
    landed = spark.read.parquet(f"{out}/table").select("link", "data_coleta").collect()
    assert set(map(tuple, landed)) == set(map(tuple, read_listings(spark, src).select("link", "data_coleta").collect()))
    assert {r["link"]: r["data_coleta"][-8:] for r in landed if r["link"] in "ab"} == {"a": "08:00:00", "b": "08:00:00"}


def test_canonical_sets_cover_all_batches():
    for fan in (2, 3, 16):
        for n in range(200):
            sets = canonical_sets(n, fan)
            assert [b for a, size in sets for b in range(a, a + size)] == list(range(n))
            assert all(a % size == 0 for a, size in sets)


def test_landing_over_many_batches(spark):
    """One file a batch, sets of two merged again and again, null links, a batch without anything new."""
    src, out = (tempfile.mkdtemp(prefix="run-", dir="/tmp") for _ in range(2))
    first = {}
    for page in range(9):
        links = [f"k{(page * 7 + i * i) % 23}" for i in range(6)] + ["", "k0"]
        write(src, f"c_pr_pagina{page}.csv", [(link, f"2026-02-{10 + page} 08:00:0{i}") for i, link in enumerate(links)])
        for i, link in enumerate(links):
            first.setdefault(link or None, f"2026-02-{10 + page} 08:00:0{i}")
        land_once(listing_stream(spark, src), ["link"], f"{out}/table", f"{out}/state", folders=4, fan=2)
    landed = spark.read.parquet(f"{out}/table").select("link", "data_coleta").collect()
    assert sorted(map(str, map(tuple, landed))) == sorted(map(str, first.items()))
    assert os.path.exists(f"{out}/table-keys/set=0-8/_SUCCESS")


def test_a_batch_reads_its_own_key_folders(spark):
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    keys = LandedKeys(spark, f"{out}/keys", ["k"], folders=16)
    keys.add(spark.range(1000).select(F.col("id").alias("k")), 0)
    found = keys.unknown(spark.createDataFrame([(5,), (5000,)], "k long"), 1)
    assert [r[0] for r in found.collect()] == [5000]
    filters = re.search(r"PartitionFilters: \[_folder#\d+ IN \(([\d,]+)\)\]", plan(found))
    assert len(filters[1].split(",")) == 2


def test_stream_scoring_replaces_a_repeated_batch(spark):
    src, out = (tempfile.mkdtemp(prefix="run-", dir="/tmp") for _ in range(2))
    write(src, "c_pr_pagina1.csv", [("a", "2026-02-09 08:00:00"), ("b", "2026-02-09 08:00:00")])
    for state in ("s1", "s2"):  # a second run with fresh state repeats batch 0
        score_stream(listing_stream(spark, src), lambda d: d.select("link", F.lit(1.0).alias("p")), f"{out}/t", f"{out}/{state}")
    assert spark.read.parquet(f"{out}/t").count() == 2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


PYTHON = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def test_plans_stay_native(spark, folder):
    for name in ("group_price_stats", "dedup_keep_first", "page_listings", "key_lookup_cascade", "wkt_centroid", "boxplot_groups", "corr_pairs", "linear_contributions"):
        text = plan(queries()[name](spark, folder))
        assert not any(p in text for p in PYTHON), name
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_poi_plan_has_no_cross_join_in_either_form(spark):
    pts = spark.range(50).select("id", (F.col("id") / 1000).alias("lat"), (F.col("id") / 900).alias("lon"))
    poi = pts.select(F.lit("x").alias("category"), "lat", "lon")
    for limit in (0, 32_000_000):
        text = plan(poi_features(pts, poi, {"x": 100}, leaf_points=4, broadcast_bytes=limit))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_is_pruned(spark, folder):
    text = plan(queries()["boxplot_groups"](spark, folder))
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in text


def test_functions_travel_without_the_package():
    """A worker that cannot import the package can still run what is sent to it."""
    from pyspark import cloudpickle

    from lotwise.operators.distributions import f_tail
    from lotwise.operators.explain import shapley_rows

    blob = cloudpickle.dumps((f_tail, shapley_rows)).hex()
    code = f"import pickle; f, s = pickle.loads(bytes.fromhex('{blob}')); print(round(f(1.0, 7, 7), 6))"
    got = subprocess.run([sys.executable, "-c", code], cwd="/", capture_output=True, text=True, env={})
    assert got.stdout.strip() == "0.5", got.stderr
