"""The segment report from one pass over the data, at any number of categories and seasons.

One aggregation over (segment, category, season) writes sums and counts; every section is derived
from that small table.  Shares stay in long form, and the text is made of lines by Spark, so
neither columns nor the driver grow with the values.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.features import percentage, rounder
from basketlens.operators.report import SECTIONS
from basketlens.operators.segment import segment_names
from basketlens.schema import SEGMENT, has, is_numeric
from basketlens.sources.files import materialised

# Measures of a segment: column behind it, digits, and whether it is a share of ones in percent.
MEASURES = {
    "avg_age": ("age", 1, False),
    "avg_previous": ("previous_purchases", 1, False),
    "discount_rate": ("discount_applied", 1, True),
    "subscription_rate": ("subscription_status", 1, True),
    "value_score": ("value_score", 3, False),
    "purchase_frequency": ("purchase_frequency_num", 1, False),
    "discount_sensitivity": ("discount_sensitivity", 2, False),
    "digital_payment": ("digital_payment_pref", 1, True),
    "fast_shipping": ("fast_shipping_pref", 1, True),
}
FAMILIES = ("category", "season")
_SIZES = ("size_small", "size_large")


def facts(df: DataFrame) -> DataFrame:
    """Counts and sums per (segment, category, season): the one pass over ``df``, written once.

    Also rows without a segment are counted, for shares of all rows.  Missing columns are null.
    """
    keys = [F.col(c) if has(df, c) else F.lit(None).cast("string").alias(c) for c in (SEGMENT, *FAMILIES)]

    def measure(column: str, rate: bool) -> Column:
        if not has(df, column):
            return F.lit(None).cast("double")
        c = F.col(column)
        return (c == "Yes").cast("int") if rate and not is_numeric(df, column) else c

    sums = {name: measure(column, rate) for name, (column, _, rate) in MEASURES.items()}
    sums |= {c: measure(c, True) for c in _SIZES}
    totals = [a for name, x in sums.items() for a in (F.sum(x).cast("double").alias(f"sum_{name}"), F.count(x).alias(f"n_{name}"))]
    return materialised(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *totals), "segment-facts")


def sizes(found: DataFrame, k: int = 4, half_even: bool = False) -> DataFrame:
    """Size of each of the k segments and its share of all rows; an empty segment reads 0."""
    names = segment_names(k)
    counts = found.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum(F.when(F.col(SEGMENT) == s, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, s in enumerate(names)],
    )
    rows = [
        F.struct(
            F.lit(s).alias(SEGMENT),
            F.col(f"n{i}").alias("count"),
            rounder(half_even)(percentage(F.col(f"n{i}"), F.col("total")), 1).alias("pct_of_all"),
        )
        for i, s in enumerate(names)
    ]
    return counts.select(F.inline(F.array(*rows)))


def profile(found: DataFrame, half_even: bool = False) -> DataFrame:
    """Size, share of labelled rows and mean behaviour of each segment."""
    rnd = rounder(half_even)
    known = found.where(F.col(SEGMENT).isNotNull())

    def mean(name: str, digits: int, rate: bool) -> Column:
        factor = F.lit(100.0 if rate else 1.0)
        return rnd(F.try_divide(factor * F.sum(f"sum_{name}"), F.sum(f"n_{name}")), digits).alias(name)

    labelled = known.agg(F.sum("n")).scalar()
    return known.groupBy(SEGMENT).agg(
        F.sum("n").alias("count"),
        rnd(percentage(F.sum("n"), F.first(labelled)), 1).alias("pct"),
        *[mean(name, digits, rate) for name, (_, digits, rate) in MEASURES.items()],
    )


def size_shares(found: DataFrame, half_even: bool = False) -> DataFrame:
    """Small, medium and large shares; medium is the rest."""
    rnd = rounder(half_even)
    small, large, n = F.sum("sum_size_small"), F.sum("sum_size_large"), F.sum("n_size_small")
    shares = {"small": small, "medium": n - small - large, "large": large}
    known = found.where(F.col(SEGMENT).isNotNull())
    return known.groupBy(SEGMENT).agg(*[rnd(percentage(x, n), 1).alias(name) for name, x in shares.items()])


def shares(found: DataFrame, family: str, k: int = 4, half_even: bool = False) -> DataFrame:
    """One row per value of a family with its percentage in each of the k segments, absent ones as 0.

    k columns whatever the number of values; a segment without any known value is null.
    """
    names = segment_names(k)
    known = found.where(F.col(SEGMENT).isNotNull() & F.col(family).isNotNull())

    def rows_of(s: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(SEGMENT) == s, F.col("n"))), F.lit(0))

    totals = known.agg(*[rows_of(s).alias(f"t{i}") for i, s in enumerate(names)])
    per_value = known.groupBy(family).agg(*[rows_of(s).alias(f"n{i}") for i, s in enumerate(names)])
    return per_value.select(
        family,
        *[rounder(half_even)(percentage(F.col(f"n{i}"), totals.select(f"t{i}").scalar()), 1).alias(s) for i, s in enumerate(names)],
    )


def sections(found: DataFrame, k: int = 4, half_even: bool = False) -> dict[str, DataFrame]:
    """The five sections, all from the facts."""
    return {
        SECTIONS["counts"]: sizes(found, k, half_even),
        SECTIONS["profile"]: profile(found, half_even),
        SECTIONS["category"]: shares(found, "category", k, half_even),
        SECTIONS["season"]: shares(found, "season", k, half_even),
        SECTIONS["size"]: size_shares(found, half_even),
    }


def long_form(tables: dict[str, DataFrame]) -> DataFrame:
    """All sections as (section, row, item, number)."""

    def unpivoted(title: str, table: DataFrame) -> DataFrame:
        key, *rest = table.columns
        cells = F.array(*[F.struct(F.lit(c).alias("item"), F.col(f"`{c}`").cast("double").alias("number")) for c in rest])
        return table.select(F.lit(title).alias("section"), F.col(key).alias("row"), F.inline(cells))

    return reduce(DataFrame.unionByName, [unpivoted(t, x) for t, x in tables.items()])


def lines(tables: dict[str, DataFrame]) -> DataFrame:
    """The report as ordered lines (section, part, key, value); write ``value`` in that order.

    Only the widths of the columns come to the driver.
    """
    out = []
    for number, (title, table) in enumerate(tables.items()):
        text = table.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(table.columns)])
        widest = text.agg(*[F.max(F.length(c)).alias(c) for c in text.columns]).first()
        widths = [max(len(c), widest[i] or 0) for i, c in enumerate(table.columns)]
        shown = F.rtrim(F.concat_ws("  ", *[F.rpad(c, w, " ") for c, w in zip(text.columns, widths)]))
        head = "  ".join(c.ljust(w) for c, w in zip(table.columns, widths)).rstrip()
        fixed = [(number, 0, "", f"{title}:"), (number, 1, "", head), (number, 3, "", "")]
        spark = table.sparkSession
        out.append(spark.createDataFrame(fixed, "section int, part int, key string, value string"))
        out.append(text.select(F.lit(number).alias("section"), F.lit(2).alias("part"), F.col("c0").alias("key"), shown.alias("value")))
    return reduce(DataFrame.unionByName, out).orderBy("section", "part", "key")
