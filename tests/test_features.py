import pytest
from pyspark.sql import functions as F

from basketlens.functions import features
from basketlens.plans.features import add_features, add_value_score, levels
from basketlens.schema import flag_label


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def one(spark, expr, data, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in data], schema).select(expr).collect()]


def test_equality_keeps_null_membership_does_not(spark):
    v = F.col("v")
    assert one(spark, features.equals_flag(v, "Winter"), ["Winter", "Fall", None]) == [1, 0, None]
    assert one(spark, features.member_flag(v, features.DIGITAL_PAYMENTS), ["Venmo", "Cash", None]) == [1, 0, 0]
    assert one(spark, features.member_flag(v, features.FAST_SHIPPING), ["Express", "Standard", None]) == [1, 0, 0]
    assert one(spark, features.member_flag(v, features.SMALL_SIZES), ["XS", "S", "M", None]) == [1, 1, 0, 0]
    assert one(spark, features.member_flag(v, features.LARGE_SIZES), ["L", "XL", "M", None]) == [1, 1, 0, 0]


def test_yes_no(spark):
    assert one(spark, features.yes_no(F.col("v")), ["Yes", "No", "maybe", None]) == [1, 0, 0, None]


def test_purchases_per_year(spark):
    labels = [*features.PURCHASES_PER_YEAR, "Every 3 Months", None]
    got = one(spark, features.purchases_per_year(F.col("v")), labels)
    assert got == [52.0, 26.0, 12.0, 4.0, 2.0, 1.0, 0.5, None, None]


def test_first_slot(spark):
    got = one(spark, features.first_slot(F.col("v")), [[0, 1], [1, 0], [], None], "v array<int>")
    assert got == [0.0, 1.0, 0.0, None]


def test_value_score_skips_missing_in_the_maxima(spark):
    rows = [(100.0, 10), (50.0, 5), (None, 7), (float("nan"), 2), (25.0, None)]
    df = spark.createDataFrame(rows, "purchase_amount double, previous_purchases int")
    got = values(add_value_score(df), "value_score")
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(0.5)
    assert got[2] is None and got[4] is None


def test_value_score_of_zeros_is_null(spark):
    df = spark.createDataFrame([(0.0, 0)], "purchase_amount double, previous_purchases int")
    assert values(add_value_score(df), "value_score") == [None]


def test_discounts_as_text_and_as_numbers(spark):
    text = spark.createDataFrame(
        [("Yes", "Yes"), ("Yes", "No"), ("No", "No"), (None, "Yes")],
        "discount_applied string, promo_code_used string",
    )
    assert values(add_features(text).df, "discount_sensitivity") == [2, 1, 0, None]
    numbers = spark.createDataFrame([(1, 1), (0, 1)], "discount_applied int, promo_code_used int")
    assert values(add_features(numbers).df, "discount_sensitivity") == [2, 1]


def test_flags_do_not_collide_with_sizes(spark):
    df = spark.createDataFrame([("Small", "XL"), (None, None)], "category string, size_label string")
    made = add_features(df)
    assert [tuple(r) for r in made.df.select("category_Small", "size_small", "size_large").collect()] == [
        (1, 0, 1), (None, 0, 0),
    ]
    assert made.groups["preference"] == ["size_small", "size_large", "size_label"]


def test_missing_columns_skip_their_feature(spark):
    df = spark.createDataFrame([("Yes",)], "promo_code_used string")
    made = add_features(df)
    assert made.df.columns == ["promo_code_used"]
    assert values(made.df, "promo_code_used") == ["Yes"]
    assert made.groups["purchase_behavior"] == ["promo_code_used"]
    assert made.groups["demographic"] == []


def test_levels_have_no_limit(spark):
    df = spark.range(3_000).select(F.col("id").cast("string").alias("v"))
    assert len(levels(df, "v")["v"]) == 3_000


def test_similar_values_keep_their_own_flags(spark):
    similar = ["a b", "a_b", "Small", "SMALL", "a.b", "50%", "plain"]
    df = spark.createDataFrame([(v,) for v in similar], "category string")
    made = add_features(df)
    names = made.groups["category"][:-1]
    assert len({n.lower() for n in names}) == len(similar) and "category_plain" in names
    rows = made.df.select("category", *[f"`{n}`" for n in names]).collect()
    assert [sum(r[1:]) for r in rows] == [1] * len(similar)
    assert sorted(flag_label(n, "category_") for n in names) == sorted(similar)


def test_values_and_maxima_come_from_one_pass(spark):
    """Rows without a value count for the maxima; all null is null; nothing but that pass reads the table again."""
    rows = [("b", "Fall", 1.0, 7), (None, None, 90.0, 50), ("a", None, float("nan"), None), ("a", "Fall", None, 2)]
    df = spark.createDataFrame(rows, "category string, season string, purchase_amount double, previous_purchases int")
    made = add_features(df)
    assert made.groups["category"] == ["category_a", "category_b", "category"]
    assert made.groups["seasonal"] == ["season_Fall", "season"]
    assert "ubquery" not in made.df._jdf.queryExecution().optimizedPlan().toString()
    both = [made.df, add_value_score(df)]
    got, want = (sorted((str(r.previous_purchases), str(r.value_score)) for r in x.collect()) for x in both)
    assert got == want and got[1] == ("50", "1.0")
    none = add_features(df.where("category = 'a'"))
    assert values(none.df, "value_score") == [None, None]
    assert values(add_features(df.limit(0)).df, "value_score") == []
