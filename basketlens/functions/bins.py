"""Two binning rules: closed ranges with gaps, and half-open cuts."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INVALID = "Invalid"
INFINITY = float("inf")

# Closed ranges and their names.
AGE_RANGES = [(18, 25), (26, 35), (36, 50), (51, 70), (71, INFINITY)]
AGE_NAMES = ["18-25", "26-35", "36-50", "51-70", ">70"]
AMOUNT_RANGES = [(20, 40), (41, 70), (71, 100)]
AMOUNT_NAMES = ["Low", "Medium", "High"]
PREVIOUS_RANGES = [
    (0, 5), (6, 10), (11, 15), (16, 20), (21, 25),
    (26, 30), (31, 35), (36, 40), (41, 45), (46, 50),
]
PREVIOUS_NAMES = [f"{low}-{high}" for low, high in PREVIOUS_RANGES]

# Break points of the half-open age groups (17, 25], (25, 35], ...
AGE_BREAKS = [17, 25, 35, 50, 70, INFINITY]


def _literal(bound: float) -> Column:
    # Spark reads a bare inf as a column name in some contexts; a typed literal is safe.
    return F.lit(bound).cast("double") if bound in (INFINITY, -INFINITY) else F.lit(bound)


def closed_bins(
    value: Column,
    ranges: Sequence[tuple[float, float]],
    names: Sequence[str],
    invalid: str = INVALID,
) -> Column:
    """Name of the first range with ``low <= value <= high``, else ``invalid``.

    Ranges may leave gaps (25.5 lies in none of the age ranges).  NaN is in no
    range, although Spark orders it above every number; null stays null.
    """
    if len(ranges) != len(names):
        raise ValueError("one name per range is needed")
    out = F.when(value.isNull(), F.lit(None).cast("string")).when(F.isnan(value), F.lit(invalid))
    for (low, high), name in zip(ranges, names):
        out = out.when(value.between(_literal(low), _literal(high)), F.lit(name))
    return out.otherwise(F.lit(invalid))


def age_bin(value: Column) -> Column:
    return closed_bins(value, AGE_RANGES, AGE_NAMES)


def purchase_amount_bin(value: Column) -> Column:
    return closed_bins(value, AMOUNT_RANGES, AMOUNT_NAMES)


def previous_purchases_bin(value: Column) -> Column:
    return closed_bins(value, PREVIOUS_RANGES, PREVIOUS_NAMES)


def cut(value: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open interval ``(low, high]`` holding ``value``, else null.

    ``Bucketizer`` is closed on the left and raises outside its range, so it
    cannot express this rule.
    """
    if len(breaks) != len(labels) + 1:
        raise ValueError("n + 1 break points make n intervals")
    out = None
    for low, high, label in zip(breaks, breaks[1:], labels):
        inside = (value > _literal(low)) & (value <= _literal(high))
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def age_group(value: Column) -> Column:
    return cut(value, AGE_BREAKS, AGE_NAMES)


def age_group_order(label: Column) -> Column:
    """Ordinal of an age group, since ``>70`` does not sort as text."""
    return ordinal(label, AGE_NAMES)


def ordinal(label: Column, names: Sequence[str]) -> Column:
    """0-based place of ``label`` in an ordered list of names; null if absent."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), label).cast("int")
    return F.when(place > 0, place - 1)
