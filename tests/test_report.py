import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.operators import report
from basketlens.plans.features import add_features


def small(spark):
    rows = [
        ("Segment 1", 20, "Clothing", "Winter", "S", "Yes"),
        ("Segment 1", 30, None, "Fall", None, "No"),
        ("Segment 3", 40, "Shoes", "Fall", "XL", None),
        (None, 50, "Shoes", "Fall", "M", "Yes"),
    ]
    return spark.createDataFrame(
        rows, "segment string, age int, category string, season string, size_label string, subscription_status string"
    )


def by_segment(df):
    return {r.segment: r for r in df.collect()}


def test_counts_cover_absent_segments_and_all_rows(spark):
    got = by_segment(report.segment_counts(small(spark)))
    assert [(got[f"Segment {i}"]["count"], got[f"Segment {i}"].pct_of_all) for i in range(1, 5)] == [
        (2, 50.0), (0, 0.0), (1, 25.0), (0, 0.0),
    ]
    assert {s: r["count"] for s, r in by_segment(report.segment_sizes(small(spark))).items()} == {
        "Segment 1": 2, "Segment 3": 1,
    }


def test_profile_uses_labelled_rows_and_gives_null_without_a_column(spark):
    got = by_segment(report.segment_profile(small(spark)))
    first = got["Segment 1"]
    assert (first["count"], first.pct, first.avg_age, first.subscription_rate) == (2, 66.7, 25.0, 50.0)
    assert first.value_score is None and first.discount_rate is None and first.fast_shipping is None
    assert got["Segment 3"].subscription_rate is None


def test_preferences(spark):
    made = add_features(small(spark)).df
    cats = by_segment(report.category_preferences(made))
    assert cats["Segment 1"].asDict() == {"segment": "Segment 1", "Clothing": 100.0, "Shoes": 0.0}
    both = report.category_preferences(made, with_sizes=True)
    assert both.columns == ["segment", "Clothing", "Shoes", "size small", "size large"]
    seasons = by_segment(report.season_preferences(made))
    assert (seasons["Segment 1"].Winter, seasons["Segment 1"].Fall) == (50.0, 50.0)
    sizes = by_segment(report.size_preferences(made))
    # The unknown size of segment 1 counts as medium.
    assert tuple(sizes["Segment 1"])[1:] == (50.0, 50.0, 0.0)
    assert tuple(sizes["Segment 3"])[1:] == (0.0, 0.0, 100.0)


def test_long_shares_with_and_without_flag_columns(spark):
    made = add_features(small(spark)).df
    want = {(r.segment, r.category): r.preference for r in report.category_shares_long(made).collect()}
    got = {(r.segment, r.category): r.preference for r in report.category_shares_any(small(spark)).collect()}
    assert got == want and len(got) == 4


def test_half_even_rounding(spark):
    rows = [("Segment 1", x) for x in (0, 0, 0, 1)] * 2
    df = spark.createDataFrame(rows, "segment string, age int")
    assert report.segment_profile(df, half_even=True).first().avg_age == 0.2
    assert report.segment_profile(df).first().avg_age == 0.3


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 100, 1001])
def test_quartiles_are_exact_at_any_size(spark, n):
    values = [float((i * 7919) % 1009) ** 1.5 for i in range(n)]
    check_box(spark, values)


def check_box(spark, values):
    df = spark.createDataFrame([("Segment 1", v) for v in values], "segment string, v double")
    got = report.box_stats(df, "v").first()
    q1, median, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in values if low <= v <= high]
    assert (got.q1, got.median, got.q3) == pytest.approx((q1, median, q3))
    assert (got.whisker_low, got.whisker_high) == (min(inside), max(inside))
    assert (got.n, got.outliers) == (len(values), len(values) - len(inside))


def test_quartiles_with_a_hot_value_and_outliers(spark):
    check_box(spark, [5.0] * 400 + [float(i) for i in range(300)] + [1e9, -1e9])


def test_quartiles_beyond_the_exact_range_of_the_sketch(spark):
    """More distinct values than the sketch keeps: the counts still make it exact."""
    df = spark.range(0, 120_001, 1, 8).select(
        F.concat(F.lit("Segment "), (F.col("id") % 2 + 1).cast("string")).alias("segment"),
        ((F.col("id") * 48_271) % 1_000_003).cast("double").alias("v"),
    )
    want = {
        r.segment: r.q
        for r in df.groupBy("segment").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).collect()
    }
    for row in report.box_stats(df, "v").collect():
        assert [row.q1, row.median, row.q3] == pytest.approx(want[row.segment])


def test_box_ignores_missing_values(spark):
    rows = [("Segment 1", 1.0), ("Segment 1", None), ("Segment 1", math.nan), (None, 9.0)]
    df = spark.createDataFrame(rows, "segment string, v double")
    got = report.box_stats(df, "v").collect()
    assert len(got) == 1 and got[0].n == 1 and got[0].median == 1.0


def test_report_has_the_published_sections(spark):
    made = add_features(small(spark)).df
    sections = report.segment_report(made)
    assert list(sections) == [
        "IDENTIFIED CUSTOMER SEGMENTS",
        "SEGMENT CHARACTERISTICS",
        "CATEGORY PREFERENCES BY SEGMENT",
        "SEASONAL PREFERENCES BY SEGMENT",
        "SIZE PREFERENCES BY SEGMENT",
    ]
    assert len(sections["SEGMENT CHARACTERISTICS"].columns) == 12
    text = report.report_text(sections)
    assert "Segment 1" in text and text.count("\n\n") == 4
