"""The flat table under skew: one customer, order and part hold a third of the rows."""

import compare
import pytest
from pyspark.sql import functions as F

from basketlens.plans import oracle
from basketlens.sources.shop import position_in_group, shop


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    i = F.col("id")
    day = F.expr("timestamp_ntz'1998-01-01 00:00:00' + make_dt_interval(cast(id * 37 % 400 as int))")
    ship = F.expr("timestamp_ntz'1998-03-01 00:00:00' + make_dt_interval(cast(id * 17 % 400 as int))")
    tables = {
        "nation": spark.range(25).select(i.cast("int").alias("n_nationkey"), F.concat(F.lit("N"), i).alias("n_name")),
        "customer": spark.range(200).select(
            i.alias("c_custkey"),
            (i % 25).cast("int").alias("c_nationkey"),
            F.when(i % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("c_mktsegment"),
        ),
        "part": spark.range(300).select(
            i.alias("p_partkey"),
            F.concat(F.lit("red p"), i % 9).alias("p_name"),
            F.concat(F.lit("T"), i % 4).alias("p_type"),
            (i % 50 + 1).cast("int").alias("p_size"),
        ),
        "orders": spark.range(6_000).select(
            i.alias("o_orderkey"),
            F.when(i % 3 == 0, 7).otherwise(i * 31 % 200).alias("o_custkey"),
            day.alias("o_orderdate"),
            F.when(i % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("o_orderpriority"),
        ),
        "lineitem": spark.range(30_000).select(
            F.when(i % 3 == 1, 11).otherwise(i * 7 % 6_000).alias("l_orderkey"),
            F.when(i % 3 == 2, 5).otherwise(i * 13 % 300).alias("l_partkey"),
            (i % 7 + 1).cast("int").alias("l_linenumber"),
            (i % 9_000 + 900).cast("double").alias("l_extendedprice"),
            (F.lit(0.01) * (i % 10)).cast("double").alias("l_discount"),
            (F.lit(0.01) * (i % 8)).cast("double").alias("l_tax"),
            F.lit("A").alias("l_returnflag"),
            F.lit("F").alias("l_linestatus"),
            ship.alias("l_shipdate"),
        ),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


def duck(folder, sql):
    con = compare.duckdb.connect()
    for name in ("nation", "customer", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return compare.duck_table(con, sql)


def test_nothing_is_lost_or_changed_by_skew(spark, skewed):
    want = duck(skewed, f"WITH {oracle.SHOP} SELECT * FROM shop")
    assert len(want[1]) == 30_000
    assert compare.difference(compare.spark_table(shop(spark, skewed)), want) is None


def test_adaptive_execution_splits_the_hot_order(spark, skewed, eager_skew_splits):
    df = shop(spark, skewed, ["row_key", "purchase_amount"])
    assert len(df.collect()) == 30_000
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bits", [2, 24])
def test_positions_match_one_window_per_key(spark, skewed, bits):
    orders = spark.read.parquet(f"{skewed}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    got = position_in_group(orders, "o_custkey", "o_orderdate", "o_orderkey", "p", bits)
    want = orders.selectExpr(
        "o_custkey", "o_orderdate", "o_orderkey",
        "cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as int) as p",
    )
    columns = ["o_orderkey", "p"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_positions_when_one_customer_buys_all_on_one_day(spark):
    orders = spark.range(2_000).select(
        F.col("id").alias("k"), F.lit(1).alias("c"), F.lit("1998-01-01").cast("timestamp_ntz").alias("d")
    )
    got = position_in_group(orders, "c", "d", "k", "p", bits=5)
    assert got.where("p = k").count() == 2_000
    largest = got.groupBy("c", "d", F.shiftright("k", 5)).count().agg(F.max("count")).first()[0]
    assert largest == 32


def test_no_window_sorts_all_rows_of_a_customer(spark, skewed):
    """The window over the customer alone runs on counts, above an aggregate."""
    plan = shop(spark, skewed, ["row_key", "previous_purchases"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    by_customer = next(i for i, l in enumerate(plan.splitlines()) if "Window [" in l and "coalesce" not in l and "row_number" not in l)
    assert "Aggregate [o_custkey" in plan.splitlines()[by_customer + 1]


def test_unused_history_is_not_computed(spark, skewed):
    plan = shop(spark, skewed, ["row_key", "age"])._jdf.queryExecution().executedPlan().toString()
    for unused in ("Window", "o_orderdate", "l_extendedprice"):
        assert unused not in plan
