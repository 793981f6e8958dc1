"""Places and running sums across ranges against plain windows."""

import random

from pyspark.sql import Window, functions as F

from stratalith.operators import ranges


def test_ranges_equal_plain_windows(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 3, 5]), rng.randint(0, 9)) for i in range(3000)], "id long, g string, x int, v long").repartition(5)
    keys = [F.col("x"), F.col("id")]
    within = Window.partitionBy("g").orderBy(*(k.asc_nulls_first() for k in keys))
    want = {r["id"]: (r["p"], r["s"], r["d"]) for r in rows.select("id", F.row_number().over(within).alias("p"), F.sum("v").over(within).alias("s"), F.dense_rank().over(Window.partitionBy("g").orderBy(F.col("x").asc_nulls_last())).alias("d")).collect()}
    for size in (40, 10**6):
        got = ranges.place(rows, ["g"], keys, "p", size)
        got = ranges.running(got, ["g"], keys, F.col("v"), "s", size)
        got = ranges.dense(got, ["g"], "x", "d", size)
        assert {r["id"]: (r["p"], r["s"], r["d"]) for r in got.collect()} == want
    assert ranges.place(rows.limit(0), [], keys, "p").count() == 0
    every = {r["id"]: r["p"] for r in ranges.place(rows, [], keys, "p", 100).collect()}
    assert every == {r["id"]: r["p"] for r in rows.select("id", F.row_number().over(Window.orderBy(*(k.asc_nulls_first() for k in keys))).alias("p")).collect()}
