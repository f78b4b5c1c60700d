"""The flat purchase table, assembled from a star schema (one row per order line)."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.schema import ROW_KEY

# How source codes read in the retail vocabulary.
PAYMENT_BY_STATUS = {
    "AF": "PayPal",
    "AO": "Venmo",
    "NF": "Cash",
    "NO": "Credit Card",
    "RF": "Apple Pay",
    "RO": "Debit Card",
}
SHIPPING_BY_PRIORITY = {
    "1-URGENT": "Next Day Air",
    "2-HIGH": "Express",
    "3-MEDIUM": "Standard",
    "5-LOW": "Store Pickup",
}
FREQUENCY_LABELS = [
    "Weekly",
    "Fortnightly",
    "Monthly",
    "Quarterly",
    "Bi-Annually",
    "Annually",
    "Every 2 Years",
    "Every 3 Months",
]
SEASON_BY_MONTH = {
    12: "Winter", 1: "Winter", 2: "Winter",
    3: "Spring", 4: "Spring", 5: "Spring",
    6: "Summer", 7: "Summer", 8: "Summer",
    9: "Fall", 10: "Fall", 11: "Fall",
}


# The columns read, stated so that no job is spent on looking into the files.
TABLES = {
    "lineitem": "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_discount double, "
    "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_type string, p_size int",
    "nation": "n_nationkey int, n_name string",
}


def _lookup(value: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def position_in_group(
    df: DataFrame, key: str, day: str, tie: str, name: str, bits: int = 24
) -> DataFrame:
    """0-based position of each row among the rows of its ``key``, by ``day`` then ``tie``.

    One window over ``key`` would sort all rows of a hot key in a single task.  Here the
    rows of a key are cut into steps: a day, and within it ranges of 2**bits values of the
    unique ``tie``, so that no step can hold more rows than that.  Rows are ranked within
    their step; the rows of earlier steps come from counts per step, which partial
    aggregation shrinks before the shuffle.
    """
    steps = df.withColumn("_range", F.shiftright(tie, bits))
    step = [key, day, "_range"]
    counts = steps.groupBy(*step).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy(day, "_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*step, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*step).orderBy(tie))
    return (
        steps.withColumn("_rank", within)
        .join(before, step)
        .withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("int"))
        .drop("_before", "_rank", "_range")
    )


def shop(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The flat table; with ``columns`` given, only those (and only the work they need).

    No side is broadcast by hint: Spark does so only when its known size is under the
    session's threshold.  Lines and orders, both large, meet in a sort-merge join, which
    can spill and whose hot keys adaptive execution splits; all work after it runs on
    the partitions of that shuffle.
    """

    def table(name: str) -> DataFrame:
        return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")

    orders = table("orders")
    if columns is None or "previous_purchases" in columns:
        # Before any join on the customer, so that rows are spread by customer and day.
        orders = position_in_group(
            orders, "o_custkey", "o_orderdate", "o_orderkey", "previous_purchases"
        )
    buyers = table("customer").join(
        table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    orders = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    lines = (
        table("lineitem")
        .join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    )

    cust, part, size = F.col("c_custkey"), F.col("p_partkey"), F.col("p_size")
    rules = {
        ROW_KEY: F.col("l_orderkey") * 8 + F.col("l_linenumber"),
        "customer_id": cust,
        "age": (F.lit(15) + (cust * 37) % 66).cast("int"),
        "gender": F.when(F.col("c_nationkey") % 2 == 0, "Male").otherwise("Female"),
        "item_purchased": F.col("p_name"),
        "category": F.when(part % 97 != 0, F.col("p_type")),
        "purchase_amount": F.col("l_extendedprice") / F.lit(1000.0),
        "location": F.col("n_name"),
        "size_label": F.when(
            part % 89 != 0,
            F.when(size <= 6, "XS")
            .when(size <= 15, "S")
            .when(size <= 32, "M")
            .when(size <= 44, "L")
            .otherwise("XL"),
        ),
        "color": F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)),
        "season": _lookup(F.month("l_shipdate"), SEASON_BY_MONTH),
        "review_rating": F.when(
            F.col("l_orderkey") % 101 != 0, F.lit(1.0) + F.col("l_tax") * F.lit(50.0)
        ),
        "subscription_status": F.when(
            F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"), "Yes"
        ).otherwise("No"),
        "payment_method": _lookup(
            F.concat("l_returnflag", "l_linestatus"), PAYMENT_BY_STATUS
        ),
        "shipping_type": _lookup(F.col("o_orderpriority"), SHIPPING_BY_PRIORITY),
        "discount_applied": F.when(F.col("l_discount") > F.lit(0.045), "Yes").otherwise("No"),
        "promo_code_used": F.when(F.col("l_discount") > F.lit(0.075), "Yes").otherwise("No"),
        "previous_purchases": F.col("previous_purchases"),
        "frequency_of_purchases": _lookup(
            (cust % 8).cast("int"), dict(enumerate(FREQUENCY_LABELS))
        ),
    }
    return lines.select(*[rules[c].alias(c) for c in (columns or list(rules))])
