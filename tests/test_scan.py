"""Two-level scans against one window a track."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cueforge.operators import scan


def table(spark, seed):
    r = random.Random(seed)
    rows = []
    for t in ("a", "b", None, ""):
        places = r.sample(range(-40, 200), r.randrange(1, 90))
        rows += [(t, p, r.choice((None, 1, 2, 2, 3)), f"x{p}") for p in places]
    rows.append(("n", None, 5, "null place"))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "track_id string, pos long, v int, text string")


def same(got, want, name):
    key = lambda r: (r.track_id is None, r.track_id or "", r.pos is not None, r.pos or 0)
    assert [tuple(x) for x in sorted(got.collect(), key=key)] == [tuple(x) for x in sorted(want.select(*got.columns).collect(), key=key)]
    assert name in got.columns


@pytest.mark.parametrize("span", [1, 7, 64, 1 << 16])
def test_scans_equal_windows(spark, span):
    df = table(spark, span).cache()
    w = Window.partitionBy("track_id").orderBy("pos")
    for inclusive in (True, False):
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = df.withColumn("s", F.coalesce(F.sum("v").over(frame), F.lit(0)))
        same(scan.running(df, "track_id", ["pos"], {"s": F.col("v")}, inclusive, span), want, "s")
    same(scan.ranked(df, "track_id", ["pos"], "n", span), df.withColumn("n", F.row_number().over(w)), "n")
    same(scan.next_value(df, "track_id", ["pos"], "v", "after", span), df.withColumn("after", F.lead("v").over(w)), "after")
    new = F.when(F.lag(F.lit(1)).over(w).isNotNull() & F.lag("v").over(w).eqNullSafe(F.col("v")), 0).otherwise(1)
    want = df.withColumn("_new", new).withColumn("i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    same(scan.islands(df, "track_id", ["pos"], "v", "i", span), want, "i")


def test_a_track_is_spread_over_tasks(spark):
    n, span = 200_000, 1 << 12
    df = spark.range(n, numPartitions=5).select(F.when(F.col("id") >= 0, "one").alias("track_id"), F.col("id").alias("pos"), (F.col("id") % 7).alias("v"))
    got = scan.running(df, "track_id", ["pos"], {"s": F.col("v")}, span=span)
    total = got.agg(F.sum((F.col("s") == F.expr("(pos div 7) * 21 + (pos % 7) * (pos % 7 + 1) div 2")).cast("int")), F.max("s")).first()
    assert total[0] == n
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(_scan_track") >= 1 and "hashpartitioning(track_id" not in plan
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) > 1 and max(rows) < n


def test_no_rows(spark):
    df = table(spark, 1).limit(0)
    assert scan.islands(df, "track_id", ["pos"], "v", "i").count() == scan.next_value(df, "track_id", ["pos"], "v", "a").count() == 0
