"""Compare three plans for the bounded forward as-of join on the same data.

* ``library`` - the library's plan (one exchange by key and equal-depth time cell)
* ``by_key``  - one window per key over requests and mounts (a hot key is
                one task)
* ``copies``  - cells as wide as the window, each mount copied into its own
                and the previous cell

Case: line items by supplier nation -> next order by customer nation within
100 days (many equal times).  All three must give the same answers; the
script prints one line per form with seconds (second run) and a checksum.
Usage: python tools/asof_forms.py [sf_dir]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

WINDOW_US = 100 * 86_400 * 1_000_000


def sides(spark, sf):
    from mountwait.operators.joins import join_dimension
    rd = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    li = join_dimension(rd("lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                              "l_suppkey", "l_shipdate"),
                        rd("supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                                              F.col("s_nationkey").alias("k")), "l_suppkey")
    od = join_dimension(rd("orders").select("o_orderkey", "o_custkey", "o_orderdate"),
                        rd("customer").select(F.col("c_custkey").alias("o_custkey"),
                                              F.col("c_nationkey").alias("mk")), "o_custkey")
    return li, od


def form_library(li, od):
    from mountwait.operators.asof import next_within
    out = next_within(li, od, left_by="k", right_by="mk", left_time="l_shipdate",
                      right_time="o_orderdate", window=WINDOW_US / 1e6, tie="o_orderkey")
    return out.select(F.col("match.o_orderkey").alias("hit"))


def _window_form(li, od, copies: bool):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    req = li.select(F.col("k"), us("l_shipdate").alias("t"), F.lit(1).alias("r"),
                    F.lit(None).cast("long").alias("id"))
    mnt = od.select(F.col("mk").alias("k"), us("o_orderdate").alias("t"), F.lit(0).alias("r"),
                    F.col("o_orderkey").alias("id"))
    part = ["k"]
    if copies:
        req = req.withColumn("b", F.floor(F.col("t") / WINDOW_US))
        mnt = mnt.withColumn("b0", F.floor(F.col("t") / WINDOW_US)).select(
            "k", "t", "r", "id", F.explode(F.array(F.col("b0"), F.col("b0") - 1)).alias("b"))
        part = ["k", "b"]
    u = req.unionByName(mnt)
    w = (Window.partitionBy(*part).orderBy(F.col("t").desc(), F.col("r").desc(),
                                          F.col("id").desc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    m = F.last(F.when(F.col("r") == 0, F.struct("t", "id")), ignorenulls=True).over(w)
    out = u.select("t", "r", m.alias("m")).filter(F.col("r") == 1)
    return out.select(F.when(F.col("m.t") - F.col("t") < WINDOW_US, F.col("m.id")).alias("hit"))


def main() -> None:
    from mountwait.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    li, od = sides(spark, sf)
    forms = {"library": form_library,
             "by_key": lambda a, b: _window_form(a, b, False),
             "copies": lambda a, b: _window_form(a, b, True)}
    for name, fn in forms.items():
        for _ in range(2):
            t0 = time.perf_counter()
            row = fn(li, od).agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("m"),
                                 F.sum("hit").alias("s")).first()
            sec = time.perf_counter() - t0
        print(f"{name:8s} {sec:6.2f}s rows={row.n} matched={row.m} checksum={row.s}")


if __name__ == "__main__":
    main()
