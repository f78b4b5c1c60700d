import math

from pyspark.sql import functions as F

from basketlens.functions import bins

INF, NAN = math.inf, math.nan


def binned(spark, rule, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r.b for r in df.select("i", rule(F.col("v")).alias("b")).orderBy("i").collect()]


def test_age_closed_ranges_leave_gaps(spark):
    got = binned(spark, bins.age_bin, [17.0, 18.0, 25.0, 25.5, 26.0, 70.0, 70.5, 71.0, INF, NAN, None])
    assert got == [
        "Invalid", "18-25", "18-25", "Invalid", "26-35", "51-70", "Invalid", ">70", ">70", "Invalid", None,
    ]


def test_amount_tiers(spark):
    got = binned(spark, bins.purchase_amount_bin, [19.99, 20.0, 40.0, 40.5, 41.0, 100.0, 100.01, NAN])
    assert got == ["Invalid", "Low", "Low", "Invalid", "Medium", "High", "Invalid", "Invalid"]


def test_previous_purchases(spark):
    got = binned(spark, bins.previous_purchases_bin, [-1.0, 0.0, 5.0, 5.5, 6.0, 50.0, 51.0])
    assert got == ["Invalid", "0-5", "0-5", "Invalid", "6-10", "46-50", "Invalid"]


def test_half_open_cut(spark):
    got = binned(spark, bins.age_group, [17.0, 17.5, 25.0, 25.5, 35.0, 70.0, 70.5, INF, NAN, None])
    assert got == [None, "18-25", "18-25", "26-35", "26-35", "51-70", ">70", ">70", None, None]


def test_first_matching_range_wins_and_names_are_free(spark):
    rule = lambda c: bins.closed_bins(c, [(0, 10), (5, 20)], ["first", "second"], "other")
    assert binned(spark, rule, [5.0, 12.0, 30.0]) == ["first", "second", "other"]


def test_integer_columns(spark):
    df = spark.createDataFrame([(18,), (71,), (None,)], "v int")
    assert [r.b for r in df.select(bins.age_bin(F.col("v")).alias("b")).collect()] == ["18-25", ">70", None]


def test_order_of_groups(spark):
    df = spark.createDataFrame([(">70",), ("18-25",), (None,), ("x",)], "g string")
    got = [r.o for r in df.select(bins.age_group_order(F.col("g")).alias("o")).collect()]
    assert got == [4, 0, None, None]
