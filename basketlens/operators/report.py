"""The segment report: sizes, profile, preferences and distributions per segment.

Every table groups by the few segments, so partial aggregation reduces the input to
k rows per task before anything is shuffled.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.features import percentage, rounder
from basketlens.operators.quantile import exact_quantiles
from basketlens.operators.segment import segment_names
from basketlens.schema import (
    CATEGORY_FLAG,
    SEASON_FLAG,
    SEGMENT,
    flag_columns,
    flag_label,
    has,
    is_numeric,
)

# Titles of the report's sections.
SECTIONS = {
    "counts": "IDENTIFIED CUSTOMER SEGMENTS",
    "profile": "SEGMENT CHARACTERISTICS",
    "category": "CATEGORY PREFERENCES BY SEGMENT",
    "season": "SEASONAL PREFERENCES BY SEGMENT",
    "size": "SIZE PREFERENCES BY SEGMENT",
}
QUARTILES = [0.25, 0.5, 0.75]


def _known(df: DataFrame) -> DataFrame:
    return df.where(F.col(SEGMENT).isNotNull())


def segment_counts(df: DataFrame, k: int = 4, half_even: bool = False) -> DataFrame:
    """Size of each of the k segments and its share of all rows, also unlabelled ones.

    One conditional count per segment, so that an empty segment reads 0.
    """
    names = segment_names(k)
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(SEGMENT) == n).alias(f"n{i}") for i, n in enumerate(names)],
    )
    rows = [
        F.struct(
            F.lit(n).alias(SEGMENT),
            F.col(f"n{i}").alias("count"),
            rounder(half_even)(percentage(F.col(f"n{i}"), F.col("total")), 1).alias("pct_of_all"),
        )
        for i, n in enumerate(names)
    ]
    return counts.select(F.inline(F.array(*rows)))


def segment_sizes(df: DataFrame) -> DataFrame:
    """Rows per segment, the data of a bar chart."""
    return _known(df).groupBy(SEGMENT).agg(F.count(F.lit(1)).alias("count"))


def _share(flag: Column) -> Column:
    """Percentage of ones among the known values of a 0/1 column."""
    return percentage(F.sum(flag), F.count(flag))


def _rate(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    return _share(c if is_numeric(df, column) else (c == "Yes").cast("int"))


def segment_profile(df: DataFrame, by: str = SEGMENT, half_even: bool = False) -> DataFrame:
    """One row per segment with its size and mean behaviour.

    ``pct`` is the share of labelled rows.  A metric whose column is missing is null.
    """
    rnd = rounder(half_even)
    none = F.lit(None).cast("double")

    def mean(column: str, digits: int) -> Column:
        return rnd(F.avg(column), digits) if has(df, column) else none

    def rate(column: str) -> Column:
        return rnd(_rate(df, column), 1) if has(df, column) else none

    metrics = {
        "avg_age": mean("age", 1),
        "avg_previous": mean("previous_purchases", 1),
        "discount_rate": rate("discount_applied"),
        "subscription_rate": rate("subscription_status"),
        "value_score": mean("value_score", 3),
        "purchase_frequency": mean("purchase_frequency_num", 1),
        "discount_sensitivity": mean("discount_sensitivity", 2),
        "digital_payment": rate("digital_payment_pref"),
        "fast_shipping": rate("fast_shipping_pref"),
    }
    grouped = (
        df.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("count"), *[m.alias(n) for n, m in metrics.items()])
    )
    # This window runs over the finished rows, one per segment, not over the data.
    labelled = F.sum("count").over(Window.partitionBy())
    return grouped.withColumn("pct", rnd(percentage(F.col("count"), labelled), 1)).select(
        by, "count", "pct", *metrics
    )


def _preferences(df: DataFrame, flags: dict[str, str], half_even: bool) -> DataFrame:
    rnd = rounder(half_even)
    return (
        _known(df)
        .groupBy(SEGMENT)
        .agg(*[rnd(_share(F.col(f"`{c}`")), 1).alias(name) for c, name in flags.items()])
    )


def category_preferences(df: DataFrame, with_sizes: bool = False, half_even: bool = False) -> DataFrame:
    """Percentage of each category per segment, one column per category.

    ``with_sizes`` adds the small and large size flags, as the published table shows them.
    """
    flags = {c: flag_label(c, CATEGORY_FLAG) for c in flag_columns(df, CATEGORY_FLAG)}
    if with_sizes:
        flags |= {"size_small": "size small", "size_large": "size large"}
    return _preferences(df, flags, half_even)


def season_preferences(df: DataFrame, half_even: bool = False) -> DataFrame:
    """Percentage of each season per segment."""
    flags = {c: flag_label(c, SEASON_FLAG) for c in flag_columns(df, SEASON_FLAG)}
    return _preferences(df, flags, half_even)


def size_preferences(df: DataFrame, half_even: bool = False) -> DataFrame:
    """Small, medium and large shares; medium is the rest, so unknown sizes count there."""
    rnd = rounder(half_even)
    small, large, n = F.sum("size_small"), F.sum("size_large"), F.count("size_small")
    return (
        _known(df)
        .groupBy(SEGMENT)
        .agg(
            rnd(percentage(small, n), 1).alias("small"),
            rnd(percentage(n - small - large, n), 1).alias("medium"),
            rnd(percentage(large, n), 1).alias("large"),
        )
    )


def category_shares_long(df: DataFrame) -> DataFrame:
    """(segment, category, preference): the wide table unpivoted, unrounded."""
    flags = flag_columns(df, CATEGORY_FLAG)
    wide = (
        _known(df)
        .groupBy(SEGMENT)
        .agg(*[F.avg(f"`{c}`").alias(flag_label(c, CATEGORY_FLAG)) for c in flags])
    )
    names = [flag_label(c, CATEGORY_FLAG) for c in flags]
    return wide.unpivot(SEGMENT, names, "category", "preference")


def category_shares_any(df: DataFrame, k: int = 4) -> DataFrame:
    """As ``category_shares_long`` from the category itself, for any number of categories."""
    return shares_any(df, "category", k)


def shares_any(df: DataFrame, column: str, k: int = 4) -> DataFrame:
    """Share of each value of a column per segment, in long form (segment, category, preference).

    No column per value is made: pairs are counted, then each value is given its
    k segments, so that an absent pair reads 0.
    """
    names = segment_names(k)
    known = _known(df).select(SEGMENT, F.col(column).alias("category")).where(F.col("category").isNotNull())
    pairs = known.groupBy("category", SEGMENT).agg(F.count(F.lit(1)).alias("n"))
    # k conditional sums per category; the segment totals are one row.
    per_category = pairs.groupBy("category").agg(
        *[F.coalesce(F.sum(F.when(F.col(SEGMENT) == s, F.col("n"))), F.lit(0)).alias(f"n{i}")
          for i, s in enumerate(names)]
    )
    totals = pairs.agg(
        *[F.sum(F.when(F.col(SEGMENT) == s, F.col("n"))).alias(f"t{i}") for i, s in enumerate(names)]
    )
    rows = [
        F.struct(
            F.lit(s).alias(SEGMENT),
            F.try_divide(F.col(f"n{i}").cast("double"), totals.select(f"t{i}").scalar()).alias("preference"),
        )
        for i, s in enumerate(names)
    ]
    shown = F.regexp_replace("category", "_", " ")
    long = per_category.select(shown.alias("category"), F.inline(F.array(*rows)))
    return long.where(F.col("preference").isNotNull()).select(SEGMENT, "category", "preference")


def box_stats(df: DataFrame, value: str) -> DataFrame:
    """Box-plot data per segment: exact quartiles (linear interpolation), whiskers, outliers.

    Quartiles are selected by counting (``quantile.exact_quantiles``); one more scan counts
    what lies beyond the whiskers.  No task holds or sorts a segment.
    """
    rows, found = exact_quantiles(df, SEGMENT, value, QUARTILES)
    boxes = df.sparkSession.createDataFrame(
        [(s, *quartiles) for s, (_, quartiles) in found.items()], f"{SEGMENT} string, q1 double, median double, q3 double"
    )
    v, reach = F.col("v"), F.lit(1.5) * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    return (
        rows.withColumnRenamed("g", SEGMENT)
        .join(boxes, SEGMENT)
        .groupBy(SEGMENT, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(v >= low, v)).alias("whisker_low"),
            F.max(F.when(v <= high, v)).alias("whisker_high"),
            F.count_if((v < low) | (v > high)).alias("outliers"),
        )
        .select(SEGMENT, "n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")
    )


def segment_report(df: DataFrame, k: int = 4, half_even: bool = False) -> dict[str, DataFrame]:
    """The five sections of the report that the columns of ``df`` allow."""
    report = {
        SECTIONS["counts"]: segment_counts(df, k, half_even),
        SECTIONS["profile"]: segment_profile(df, half_even=half_even).orderBy(SEGMENT),
    }
    if flag_columns(df, CATEGORY_FLAG):
        report[SECTIONS["category"]] = category_preferences(df, half_even=half_even).orderBy(SEGMENT)
    if flag_columns(df, SEASON_FLAG):
        report[SECTIONS["season"]] = season_preferences(df, half_even).orderBy(SEGMENT)
    if has(df, "size_small", "size_large"):
        report[SECTIONS["size"]] = size_preferences(df, half_even).orderBy(SEGMENT)
    return report


def report_text(sections: dict[str, DataFrame]) -> str:
    """The report as text; each section has one row per segment."""
    parts = []
    for title, table in sections.items():
        rows = [table.columns, *[["" if x is None else str(x) for x in r] for r in table.collect()]]
        widths = [max(len(r[i]) for r in rows) for i in range(len(table.columns))]
        lines = ["  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in rows]
        parts.append("\n".join([title + ":", *lines]))
    return "\n\n".join(parts) + "\n"
