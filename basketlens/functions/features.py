"""Scalar behaviour features.

Null rules differ on purpose: ``equals_flag`` keeps an unknown value unknown,
``member_flag`` counts it as "not in the list".
"""

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Purchases per year by label, and the lists behind the preference flags.
PURCHASES_PER_YEAR = {
    "Weekly": 52.0,
    "Fortnightly": 26.0,
    "Monthly": 12.0,
    "Quarterly": 4.0,
    "Bi-Annually": 2.0,
    "Annually": 1.0,
    "Every 2 Years": 0.5,
}
DIGITAL_PAYMENTS = ["PayPal", "Venmo", "Apple Pay"]
FAST_SHIPPING = ["Express", "Next Day Air"]
SMALL_SIZES = ["S", "XS"]
LARGE_SIZES = ["L", "XL"]
AMOUNT_WEIGHT = 0.6
PREVIOUS_WEIGHT = 0.4


def equals_flag(value: Column, wanted: str) -> Column:
    """1 if equal, 0 if not, null if unknown."""
    return (value == F.lit(wanted)).cast("int")


def member_flag(value: Column, wanted: Iterable[str]) -> Column:
    """1 if in the list, else 0, also for null."""
    return F.coalesce(value.isin(list(wanted)).cast("int"), F.lit(0))


def flag_name(value: Column) -> Column:
    """Name of a value's flag, made from the value alone: spaces become underscores, ``%`` and ``_`` are spelled."""
    spelled = F.replace(F.replace(value, F.lit("%"), F.lit("%25")), F.lit("_"), F.lit("%5F"))
    return F.replace(spelled, F.lit(" "), F.lit("_"))


def sparse_flag(value: Column) -> Column:
    """The flags of a whole family in one map that holds only the flag that is 1; null if unknown.

    A flag that the map lacks is 0.  No column per value is made and no value is looked up, so
    any number of values will do; distinct values never share a name.
    """
    return F.when(value.isNotNull(), F.create_map(flag_name(value), F.lit(1)))


def yes_no(value: Column) -> Column:
    """1 for Yes, 0 for any other text, null if unknown."""
    return equals_flag(value, "Yes")


def purchases_per_year(label: Column) -> Column:
    """Yearly number of purchases behind a frequency label; unknown labels give null."""
    table = F.create_map(*[F.lit(x) for pair in PURCHASES_PER_YEAR.items() for x in pair])
    return F.try_element_at(table, label)


def value_score(amount: Column, previous: Column, max_amount: Column, max_previous: Column) -> Column:
    """Weighted mix of spend and history, each relative to its maximum."""
    return F.try_divide(amount, max_amount) * F.lit(AMOUNT_WEIGHT) + F.try_divide(
        previous, max_previous
    ) * F.lit(PREVIOUS_WEIGHT)


def first_slot(encoded: Column) -> Column:
    """First entry of an encoded array as a double; empty gives 0.0, null stays null."""
    return F.when(
        encoded.isNotNull(), F.coalesce(F.try_element_at(encoded, F.lit(1)).cast("double"), F.lit(0.0))
    )


def vector_head(vector: Column) -> Column:
    """An ML vector's first entry as an array of one (or none), at no cost for its width."""
    parts = F.unwrap_udt(vector)
    values, at = parts["values"], F.array_position(parts["indices"], F.lit(0)).cast("int")
    sparse = F.when(parts["size"] > 0, F.array(F.when(at > 0, F.try_element_at(values, at)).otherwise(F.lit(0.0))))
    known = F.when(parts["type"] == 1, F.slice(values, 1, 1)).otherwise(F.coalesce(sparse, F.array().cast("array<double>")))
    return F.when(vector.isNotNull(), known)


def rounder(half_even: bool = False):
    """``round`` as Spark does it (half up), or half to even."""
    return F.bround if half_even else F.round


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole in double arithmetic; null when there is nothing to divide by."""
    return F.try_divide(F.lit(100.0) * part, whole)
