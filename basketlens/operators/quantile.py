"""Exact quantiles of groups by distributed selection: count sub-ranges, keep the one that holds the rank, go on."""

from math import ceil, floor, isinf

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.sources.files import materialised

#: Sub-ranges that an interval is counted in per round; no window holds more rows.
SUBRANGES = 1024
_LARGEST = 1.7976931348623157e308


def exact_quantiles(df: DataFrame, by: str, value: str, shares: list[float]) -> tuple[DataFrame, dict]:
    """The rows (by, v) that were read, written once, and {group: (n, [quantile of each share])}.

    Quantiles are linear interpolations between the two neighbouring ranks.  Each round is one scan: rows in an
    interval that holds a wanted rank are counted in ``SUBRANGES`` parts of equal width, with the least and
    largest value of each; the part with the rank is the next interval, until it is a single
    value.  At least one end leaves in every round; spread-out values need a round per factor of 1024
    in their number.  Nothing is sorted, and tasks send counts only.  The driver
    holds an interval per group and rank; groups are few, as segments are.

    Rows whose group or value is null or NaN do not count.  Infinite values are read as the largest doubles.
    """
    given = df.select(F.col(f"`{by}`").alias("g"), F.col(f"`{value}`").cast("double").alias("v"))
    given = given.where(F.col("g").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    # Adding 0 makes -0.0 and 0.0 one value.
    given = given.withColumn("v", F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), "v")) + F.lit(0.0))
    rows = materialised(given, "quantile-rows")
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    wanted = {r["g"]: [p * (r["n"] - 1) for p in shares] for r in groups}
    # Per group and rank: the interval that holds it and its place among the rows inside.
    at = {(r["g"], k): (r["low"], r["high"], k) for r in groups for h in wanted[r["g"]] for k in (floor(h), ceil(h))}
    while any(low < high for low, high, _ in at.values()):
        at |= _narrowed(rows, {key: x for key, x in at.items() if x[0] < x[1]})
    found = {}
    for r in groups:
        ranks = [(at[r["g"], floor(h)][0], at[r["g"], ceil(h)][0], h - floor(h)) for h in wanted[r["g"]]]
        found[r["g"]] = (r["n"], [a + (b - a) * part for a, b, part in ranks])
    return rows, found


def _narrowed(rows: DataFrame, at: dict) -> dict:
    """One round: the sub-range of each interval in which its rank lies."""
    spark, kind = rows.sparkSession, rows.schema["g"].dataType.simpleString()
    # Halves where the width of an interval is beyond the largest double.
    spans = sorted({(g, low, high, 0.5 if isinf(high - low) else 1.0) for (g, _), (low, high, _) in at.items()}, key=str)
    intervals = spark.createDataFrame(spans, f"g {kind}, low double, high double, half double")
    targets = spark.createDataFrame(
        [(g, low, high, rank, place) for (g, rank), (low, high, place) in at.items()],
        f"g {kind}, low double, high double, rank long, place long",
    )
    half = F.col("half")
    share = (F.col("v") * half - F.col("low") * half) / (F.col("high") * half - F.col("low") * half)
    part = F.least(F.lit(SUBRANGES - 1), F.floor(share * SUBRANGES)).alias("part")
    inside = rows.join(intervals, "g").where(F.col("v").between(F.col("low"), F.col("high")))
    counts = inside.groupBy("g", "low", "high", part).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")
    )
    running = F.sum("n").over(Window.partitionBy("g", "low", "high").orderBy("part"))
    placed = counts.withColumn("end", running).join(targets, ["g", "low", "high"])
    hit = placed.where((F.col("place") < F.col("end")) & (F.col("place") >= F.col("end") - F.col("n")))
    next_place = (F.col("place") - F.col("end") + F.col("n")).alias("place")
    chosen = hit.select("g", "rank", "least", "most", next_place).collect()  # an interval per group and rank
    return {(r["g"], r["rank"]): (r["least"], r["most"], r["place"]) for r in chosen}
