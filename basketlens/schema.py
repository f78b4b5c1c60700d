"""Column names of the flat retail table and the feature groups built on it.

Inside the engine every column is snake_case; display names appear only when a
file for people is written (``sources.files.to_display_names``).
"""

import re
from collections import Counter
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROW_KEY = "row_key"
CUSTOMER_ID = "customer_id"
GENERATED_ID = "id"
CLUSTER = "cluster"
SEGMENT = "segment"

RETAIL = T.StructType(
    [
        T.StructField(CUSTOMER_ID, T.LongType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("gender", T.StringType()),
        T.StructField("item_purchased", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("purchase_amount", T.DoubleType()),
        T.StructField("location", T.StringType()),
        T.StructField("size_label", T.StringType()),
        T.StructField("color", T.StringType()),
        T.StructField("season", T.StringType()),
        T.StructField("review_rating", T.DoubleType()),
        T.StructField("subscription_status", T.StringType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("shipping_type", T.StringType()),
        T.StructField("discount_applied", T.StringType()),
        T.StructField("promo_code_used", T.StringType()),
        T.StructField("previous_purchases", T.IntegerType()),
        T.StructField("frequency_of_purchases", T.StringType()),
    ]
)

# Header texts of the retail CSV and of the exported features.
DISPLAY_NAMES = {
    "customer_id": "Customer ID",
    "id": "ID",
    "age": "Age",
    "gender": "Gender",
    "item_purchased": "Item Purchased",
    "category": "Category",
    "purchase_amount": "Purchase Amount (USD)",
    "location": "Location",
    "size_label": "Size",
    "color": "Color",
    "season": "Season",
    "review_rating": "Review Rating",
    "subscription_status": "Subscription Status",
    "payment_method": "Payment Method",
    "shipping_type": "Shipping Type",
    "discount_applied": "Discount Applied",
    "promo_code_used": "Promo Code Used",
    "previous_purchases": "Previous Purchases",
    "frequency_of_purchases": "Frequency of Purchases",
    "cluster": "Cluster",
    "segment": "Segment",
    "value_score": "Value_Score",
    "age_group": "Age_Group",
    "purchase_frequency_num": "Purchase_Frequency_Num",
    "discount_sensitivity": "Discount_Sensitivity",
    "digital_payment_pref": "Digital_Payment_Pref",
    "fast_shipping_pref": "Fast_Shipping_Pref",
    "size_small": "Prefers_Small",
    "size_large": "Prefers_Large",
    "flags_category": "Prefers",
    "flags_season": "Shops",
}

# One map per family with its flags; ``CATEGORY_FLAG`` and ``SEASON_FLAG`` begin the names of flags in columns of their own.
CATEGORY_FLAGS = "flags_category"
SEASON_FLAGS = "flags_season"

# A category may itself be called "Small", so each family of 0/1 flags has a
# prefix of its own; both map to the same display prefix.
CATEGORY_FLAG = "category_"
SEASON_FLAG = "season_"
DISPLAY_PREFIXES = {CATEGORY_FLAG: "Prefers_", SEASON_FLAG: "Shops_"}


def flag_names(prefix: str, values: list[str]) -> dict[str, str]:
    """Column name of the 0/1 flag of each value of one family: spaces become underscores.

    Column names ignore case, so values like "Small" and "SMALL", or "a b" and "a_b", would
    share a name, and some characters are awkward in one.  Such values are spelled with
    ``%`` codes for all but a-z and 0-9 instead, which is reversible.
    """
    plain = {v: v.replace(" ", "_") for v in values}
    taken = Counter(p.lower() for p in plain.values())
    return {
        v: prefix + (p if taken[p.lower()] == 1 and not re.search(r"[%.`\\]", p) else _spelled(v))
        for v, p in plain.items()
    }


def _spelled(value: str) -> str:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def flag_columns(df: DataFrame, prefix: str) -> list[str]:
    """The flags of one family that are present in ``df``."""
    return [c for c in df.columns if c.startswith(prefix)]


def flag_label(column: str, prefix: str) -> str:
    """Display text of a flag: prefix off, codes or underscores back to what they stand for."""
    rest = column.removeprefix(prefix)
    return unquote(rest) if "%" in rest else rest.replace("_", " ")


def has(df: DataFrame, *columns: str) -> bool:
    """True when every named column exists (the guard before each feature)."""
    return set(columns) <= set(df.columns)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of all numeric columns, in table order."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def is_floating(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType))
