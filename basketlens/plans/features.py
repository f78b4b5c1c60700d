"""All behaviour features in one projection, guarded by the columns that exist."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions import bins, features
from basketlens.schema import CATEGORY_FLAG, CATEGORY_FLAGS, SEASON_FLAG, SEASON_FLAGS, flag_names, has, is_numeric


@dataclass
class Featured:
    """The table with its features, and which columns belong to which group."""

    df: DataFrame
    groups: dict[str, list[str]] = field(default_factory=dict)


def levels(df: DataFrame, *columns: str) -> dict[str, list[str]]:
    """The distinct values of some columns, sorted, found in one pass.

    They are to become one column each, which the caller asks for; the reports in long
    form (``operators.report.shares_any``) need no levels.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns])
    found = df.select(F.inline(pairs)).where(F.col("v").isNotNull()).distinct()
    values: dict[str, list[str]] = {c: [] for c in columns}
    for row in found.collect():
        values[row["c"]].append(row["v"])
    return {c: sorted(v) for c, v in values.items()}


SCORED = ("purchase_amount", "previous_purchases")


def _maxima() -> list[Column]:
    """The inputs of the value score at their greatest; null and NaN are skipped."""
    return [F.max(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in SCORED]


def levels_and_maxima(df: DataFrame, *columns: str) -> tuple[dict[str, list[str]], dict[str, Column]]:
    """``levels`` and the maxima behind the value score, both from one pass over ``df``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).alias("_v")) for c in columns])
    found = df.select(*SCORED, F.inline(pairs)).groupBy("_c", "_v").agg(*_maxima()).collect()
    values = {c: sorted(r["_v"] for r in found if r["_c"] == c and r["_v"] is not None) for c in columns}
    top = {c: max((r[c] for r in found if r[c] is not None), default=None) for c in SCORED}
    return values, {c: F.lit(x).cast("double") for c, x in top.items()}


def add_value_score(df: DataFrame, top: dict[str, Column] | None = None) -> DataFrame:
    """Value score; unless ``top`` has them, both maxima come from one one-row subquery."""
    if top is None:
        row = df.agg(F.struct(*_maxima()).alias("top")).scalar()
        top = {c: row.getField(c) for c in SCORED}
    amount, previous = SCORED
    return df.withColumn(
        "value_score", features.value_score(F.col(amount), F.col(previous), top[amount], top[previous])
    )


def add_flags(df: DataFrame, column: str, prefix: str, values: list[str]) -> DataFrame:
    """One 0/1 column per value; null stays null."""
    return df.withColumns(
        {name: features.equals_flag(F.col(column), v) for v, name in flag_names(prefix, values).items()}
    )


def flag_table(df: DataFrame, column: str) -> DataFrame:
    """The names behind a family's sparse flags: (name, value, n)."""
    known = df.where(F.col(column).isNotNull())
    counts = known.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(features.flag_name(F.col("value")).alias("name"), "value", "n")


def add_features(
    df: DataFrame, categories: list[str] | None = None, seasons: list[str] | None = None, sparse: bool = False
) -> Featured:
    """Every feature whose inputs exist; a missing column skips its feature.

    The values behind the category and season flags are looked up unless given, in the pass that
    finds the maxima of the value score.  ``sparse`` makes
    one map of flags per family instead (``features.sparse_flag``), for any number of values.
    """
    groups: dict[str, list[str]] = {
        g: [] for g in ("demographic", "value", "purchase_behavior", "category", "seasonal", "preference")
    }
    new = {}
    out = df
    known = {"category": categories, "season": seasons}
    unknown = [c for c, v in known.items() if v is None and has(df, c) and not sparse]
    top = None
    if unknown and has(df, *SCORED):
        found, top = levels_and_maxima(df, *unknown)
        known |= found
    elif unknown:
        known |= levels(df, *unknown)

    if has(df, "age"):
        new["age_group"] = bins.age_group(F.col("age"))
        groups["demographic"] += ["age", "age_group"]
    groups["demographic"] += [c for c in ("gender", "location") if has(df, c)]

    if has(df, *SCORED):
        out = add_value_score(out, top)
        groups["value"] += ["value_score", "purchase_amount", "previous_purchases"]

    if has(df, "frequency_of_purchases"):
        new["purchase_frequency_num"] = features.purchases_per_year(F.col("frequency_of_purchases"))
        groups["purchase_behavior"] += ["purchase_frequency_num", "frequency_of_purchases"]
    if has(df, "discount_applied", "promo_code_used"):
        coded = {
            c: F.col(c) if is_numeric(df, c) else features.yes_no(F.col(c))
            for c in ("discount_applied", "promo_code_used")
        }
        new |= coded
        new["discount_sensitivity"] = coded["discount_applied"] + coded["promo_code_used"]
        groups["purchase_behavior"].append("discount_sensitivity")
    groups["purchase_behavior"] += [
        c
        for c in ("discount_applied", "promo_code_used", "subscription_status", "review_rating")
        if has(df, c)
    ]

    for column, prefix, family, group in (
        ("category", CATEGORY_FLAG, CATEGORY_FLAGS, "category"),
        ("season", SEASON_FLAG, SEASON_FLAGS, "seasonal"),
    ):
        if has(df, column) and sparse:
            new[family] = features.sparse_flag(F.col(column))
            groups[group] += [family, column]
        elif has(df, column):
            names = flag_names(prefix, known[column])
            new |= {name: features.equals_flag(F.col(column), v) for v, name in names.items()}
            groups[group] += [*names.values(), column]
    if has(df, "item_purchased"):
        groups["category"].append("item_purchased")

    if has(df, "payment_method"):
        new["digital_payment_pref"] = features.member_flag(
            F.col("payment_method"), features.DIGITAL_PAYMENTS
        )
        groups["preference"] += ["digital_payment_pref", "payment_method"]
    if has(df, "shipping_type"):
        new["fast_shipping_pref"] = features.member_flag(F.col("shipping_type"), features.FAST_SHIPPING)
        groups["preference"] += ["fast_shipping_pref", "shipping_type"]
    if has(df, "size_label"):
        new["size_small"] = features.member_flag(F.col("size_label"), features.SMALL_SIZES)
        new["size_large"] = features.member_flag(F.col("size_label"), features.LARGE_SIZES)
        groups["preference"] += ["size_small", "size_large", "size_label"]
    if has(df, "color"):
        groups["preference"].append("color")

    return Featured(out.withColumns(new) if new else out, groups)
